"""Operator 9: word-first backoff language identification.

A known word scores the log of its relative frequency in each language; an unseen word falls back to its character
n-grams (word edges marked), longest order first: the first order of which any n-gram is known gives the mean of their
log frequencies. A text's language is the one with the highest mean score per word.

Words are runs of letters (\\p{L}) in lower case. The model is learned on Spark from a sample of labelled documents of at
most about MAX_TRAIN (chosen by a hash of the row's place, so that null and hot ids take part like others), for all languages in it, and keeps the MAX_WORDS most frequent words of at least
MIN_COUNT occurrences and the MAX_GRAMS most frequent n-grams of each order. What is kept is the size of the model; what
is scored is every word of every text.

Defined results: null, empty and letterless texts are ``und`` with score 0; ties go to the language that sorts first;
without any labelled document, every text is ``und``; a null doc_id counts as not held out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .token_output import slices

MAX_TRAIN = 12_000
MAX_WORDS, MIN_COUNT = 60_000, 2
MAX_GRAMS = 30_000
ORDERS = (5, 4, 3, 2, 1)
KEPT = 400_000
_LETTERS = regex.compile(r"\p{L}+")
_caches: dict[object, tuple] = {}


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def below(most: int, n: int) -> int:
    """The bound under which about ``most`` of n hashes of 63 bits lie; above 0 for any n."""
    return max(1, (most << 63) // n)


def bounded_sample(rows: DataFrame, most: int, *keys: Column) -> DataFrame:
    """About ``most`` rows at most, and one at least if there is any, chosen row by row by a hash of the keys."""
    hashed = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    n, least = rows.agg(F.count("*"), F.min(hashed)).first()
    return rows if n <= most else rows.filter(hashed <= max(below(most, n), least))


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """Learns from rows (doc_id, text, lang); the result holds at most max_words + len(ORDERS) * max_grams entries."""
    given = labelled.filter("text is not null and lang is not null").withColumn("row", F.monotonically_increasing_id())
    rows = bounded_sample(given, max_train, F.lit(9), F.col("row")).drop("row")
    langs = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return {"langs": [], "words": {}, "grams": {}}
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("w", "lang").agg(F.count("*").alias("n"))
    per_lang = [F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, l in enumerate(langs)]
    wide = words.groupBy("w").agg(F.sum("n").alias("n"), *per_lang).persist()
    cols = [f"n{i}" for i in range(len(langs))]

    def logs(counted: DataFrame, most: int) -> dict[str, tuple[float, ...]]:
        totals = [x or 0 for x in counted.agg(*[F.sum(c) for c in cols]).first()]
        kept = counted.orderBy(F.desc("n"), "w").limit(most).collect()
        return {r["w"]: tuple(math.log((r[c] + 0.5) / (t + 0.5 * most)) for c, t in zip(cols, totals)) for r in kept}

    marked = wide.withColumn("w", F.concat(F.lit("<"), "w", F.lit(">")))
    grams = {}
    for n in ORDERS:
        cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.col("w").substr(i, F.lit(n))))
        pieces = marked.filter(F.length("w") >= n).select(cut.alias("w"), "n", *cols)
        grams[n] = logs(pieces.groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]), max_grams)
    model = {"langs": langs, "words": logs(wide.filter(F.col("n") >= MIN_COUNT), max_words), "grams": grams}
    wide.unpersist()
    return model


def word_score(word: str, model: dict) -> tuple[float, ...] | None:
    """Log frequencies by language; None if neither the word nor any of its letters is known."""
    known = model["words"].get(word)
    if known is not None:
        return known
    marked = f"<{word}>"
    for n in ORDERS:
        table_n = model["grams"].get(n, {})
        found = [g for g in (table_n.get(marked[i : i + n]) for i in range(len(marked) - n + 1)) if g is not None]
        if found:
            return tuple(sum(x) / len(found) for x in zip(*found))
    return None


class _Scores(dict):
    """The row of each word in a growing matrix of scores."""

    def __init__(self, model: dict):
        self.model, self.none = model, (0.0,) * len(model["langs"])
        self.rows: list[tuple[float, ...]] = []

    def __missing__(self, word: str) -> int:
        self.rows.append(word_score(word, self.model) or self.none)
        self[word] = at = len(self)
        return at


def classify(texts: list[str | None], model: dict, scores: _Scores) -> list[tuple[str, float]]:
    langs = model["langs"]
    if len(scores) > KEPT:
        scores.clear()
        scores.rows.clear()
    words = [_LETTERS.findall(t.lower()) if t and langs else [] for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    at = np.fromiter(map(scores.__getitem__, (w for ws in words for w in ws)), np.int64, int(lens.sum()))
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not len(at):
        return out
    per_word = np.array(scores.rows)[at]
    some = np.flatnonzero(lens)
    sums = np.add.reduceat(per_word, (np.cumsum(lens) - lens)[some])
    for k, s in zip(some, sums):
        # Frequencies of words in a row aren't independent: the evidence counts as that of a few words.
        z = s / lens[k] * min(lens[k], 8)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        out[k] = (langs[best], float(p[best] / p.sum()))
    return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for whole texts."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _caches:
            _caches.clear()
            _caches[key] = (shared.value, _Scores(shared.value))
        learned, scores = _caches[key]
        for batch in batches:
            for part in slices(batch, 2 << 20):
                langs, p = zip(*classify(part["text"].to_pylist(), learned, scores)) if len(part) else ((), ())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(langs, pa.string()), pa.array(p, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
