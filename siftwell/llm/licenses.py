"""Operator 13: licence scans. Aho-Corasick over words finds notice phrases and identifier tags, a shunting-yard parser evaluates
licence expressions.

A text in lower case (A-Z) is cut into words; words that no phrase has are 0, the others have a number, and one automaton over
numbers finds every place of every phrase in one pass, overlapping ones included. At a place of an identifier tag, the rest of
the line is read as an expression of identifiers, ``and``, ``or``, ``with`` and parentheses: operators wait on a stack while
stronger ones go first (with, and, or), so that nesting of any depth takes linear time and no recursion. Values are
evaluated as they come: an ``or`` is as free as its freest side, an ``and`` as bound as its most bound one, and an exception
takes a licence one step towards free. The classes are, from free to bound: permissive, weak (copyleft of files or libraries),
copyleft, restricted; an identifier that isn't known is restricted.

Labels come from phrases and from the identifiers of expressions. ``score`` is the confidence that a text carries a licence
notice: 1 - product of (1 - weight) over its different phrases and tags; 0 without any.

One pass, no shuffle. Defined results: null and empty texts have no words, no places, empty labels and score 0; an expression that
breaks off counts as far as it is whole and is not ``valid``; a tag without an identifier after it is no finding beyond its place; repeated rows have
the same result each; texts of any length are taken whole; columns of docs that are called like a result give way; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .token_output import slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases: label and weight.
NOTICES = {
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "apache license": ("apache", 0.8),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "isc license": ("isc", 0.7),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "creative commons": ("creative-commons", 0.6),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "dedicated to the public domain": ("public-domain", 0.8),
    "boost software license": ("bsl", 0.9),
    "the unlicense": ("unlicense", 0.8),
}
BASE_WEIGHTS = {"cc-by": 0.7, "gpl": 0.9, "reserved": 0.5}
#: Words that announce an expression, and their weight.
TAG, TAG_WEIGHT = "spdx license identifier", 0.99
CLASSES = ("permissive", "weak", "copyleft", "restricted")
#: Identifiers by class; versions and their "-only", "-or-later" and "+" follow the name.
FAMILIES = {
    "permissive": ("0bsd", "apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "ncsa", "postgresql", "python", "unlicense", "wtfpl", "zlib"),
    "weak": ("cddl", "epl", "eupl", "lgpl", "mpl", "ms-pl"),
    "copyleft": ("agpl", "cc-by-sa", "gpl", "osl"),
}
_FAMILY = {f: c for c, fs in enumerate(FAMILIES.values()) for f in fs}
_WORDS = re.compile(WORD)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_AFTER_TAG = re.compile(r"[ \t]*:[ \t]*")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
RESULT = "n_words long, places array<struct<label:string,word:long,words:int>>, expressions array<struct<text:string,valid:boolean,class:string,ids:array<string>>>, base_labels array<string>, labels array<string>, score double"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int32())]))
_EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("class", pa.string()), ("ids", pa.list_(pa.string()))]))


def lowered(text: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Phrases:
    """An automaton over numbered words; ``find`` gives (phrase, first word) of all places."""

    def __init__(self, phrases: list[str]):
        self.number: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            words = phrase.split()
            self.automaton.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in words), (phrase, len(words)))
        self.automaton.make_automaton()

    def find(self, words: list[str]) -> list[tuple[str, int]]:
        if self.number.keys().isdisjoint(words):
            return []
        number = self.number.get
        return [(phrase, end - n + 1) for end, (phrase, n) in self.automaton.iter(tuple([number(w, 0) for w in words]))]


def class_of(name: str) -> int:
    """The class of an identifier in lower case: that of the longest family it belongs to."""
    bare = name.rstrip("+")
    while bare:
        if bare in _FAMILY:
            return _FAMILY[bare]
        if "-nc" in bare or "-nd" in bare:
            break
        bare = bare.rpartition("-")[0]
    return len(CLASSES) - 1


class Expression:
    """A licence expression read from a text at a place, as far as it goes: ``text``, ``valid``, ``ids``, ``bound`` (a class, None if
    there is no identifier)."""

    def __init__(self, text: str, at: int = 0):
        values: list[int] = []
        waiting: list[str] = []
        ids: list[str] = []
        good, start, open_, operand = True, at, 0, True

        def apply(op: str) -> None:
            right, left = values.pop(), values.pop()
            values.append(min(left, right) if op == "or" else max(left, right) if op == "and" else max(left - 1, 0))

        exception = False
        end = at
        while m := _TOKEN.match(text, end):
            token, low = m[1], m[1].lower()
            if operand:
                if token == "(" and not exception:
                    waiting.append("(")
                    open_ += 1
                elif token in "()" or low in _STRENGTH or text.startswith(":", m.end()):  # the last: another tag
                    good = False
                    break
                else:
                    ids.append(low)
                    values.append(0 if exception else class_of(low))
                    operand = exception = False
            elif token == ")":
                if not open_:
                    break
                while waiting[-1] != "(":
                    apply(waiting.pop())
                waiting.pop()
                open_ -= 1
            elif low in _STRENGTH:
                while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[low]:
                    apply(waiting.pop())
                waiting.append(low)
                operand, exception = True, low == "with"
            else:
                break  # another word: the expression is over
            end = m.end()
        if operand:  # an operator waits for what doesn't come: it goes, with the parentheses after it
            good = False
            while waiting and waiting.pop() == "(":
                pass
        while waiting:
            op = waiting.pop()
            if op == "(":
                good = False
            else:
                apply(op)
        self.text, self.valid, self.ids = text[start:end].strip(), good and bool(ids), list(dict.fromkeys(ids))
        self.bound = values[-1] if values else None


class Scanner:
    """What a text holds: words, places, expressions, base labels, labels, score."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None, tag: str = TAG):
        self.base, self.notices, self.tag = BASE if base is None else base, NOTICES if notices is None else notices, tag
        self.phrases = Phrases([*dict.fromkeys([*self.base, *self.notices, tag])])

    def scan(self, text: str | None) -> tuple[int, list, list, list[str], list[str], float]:
        low = lowered(text) if text else ""
        words = _WORDS.findall(low)
        found = self.phrases.find(words)
        if not found:
            return len(words), [], [], [], [], 0.0
        places, weights, labels, tags = [], {}, set(), []
        for phrase, at in found:
            n = phrase.count(" ") + 1
            if phrase in self.base:
                places.append({"label": self.base[phrase], "word": at, "words": n})
                weights[phrase] = BASE_WEIGHTS.get(self.base[phrase], 0.5)
            if phrase in self.notices:
                label, weights[phrase] = self.notices[phrase]
                labels.add(label)
            if phrase == self.tag:
                tags.append(at + n - 1)
        expressions = []
        if tags:
            wanted, last = set(tags), max(tags)
            for i, m in enumerate(_WORDS.finditer(low)):
                if i in wanted and (colon := _AFTER_TAG.match(text, m.end())):
                    e = Expression(text, colon.end())
                    if e.ids:
                        expressions.append({"text": e.text, "valid": e.valid, "class": CLASSES[e.bound], "ids": e.ids})
                        labels.update(e.ids)
                        weights[self.tag] = TAG_WEIGHT
                if i >= last:
                    break
        base = sorted({p["label"] for p in places})
        rest = 1.0
        for phrase in sorted(weights):
            rest *= 1 - weights[phrase]
        return len(words), sorted(places, key=lambda p: (p["word"], p["label"])), expressions, base, sorted({*base, *labels}), 1 - rest


def _scan(columns: list[str], base: dict | None, notices: dict | None, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tag)
        kinds = (pa.int64(), _PLACES, _EXPRESSIONS, pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
        for batch in batches:
            for part in slices(batch):
                if len(part):
                    results = zip(*map(scanner.scan, part["text"].to_pylist()))
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), *(pa.array(x, k) for x, k in zip(results, kinds))], names=[*columns, "n_words", "places", "expressions", "base_labels", "labels", "score"])

    return run


def find_licenses(docs: DataFrame, columns: list[str], base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None, tag: str = TAG) -> DataFrame:
    """The named columns of docs with ``n_words``, ``places`` of base phrases (label, first word, words), ``expressions`` after
    tags (text, valid, class, ids), ``base_labels``, ``labels`` (all) and ``score``."""
    ship(docs.sparkSession)
    own = ("n_words", "places", "expressions", "base_labels", "labels", "score")
    kept = [c for c in columns if c not in own]
    inner = {c: f"given {i}" for i, c in enumerate(kept)}
    given = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()], F.col("text").cast("string").alias("text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in given.select(*inner.values()).dtypes] + [RESULT])
    return given.mapInArrow(_scan(list(inner.values()), base, notices, tag), schema).withColumnsRenamed({x: c for c, x in inner.items()})


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    at = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
