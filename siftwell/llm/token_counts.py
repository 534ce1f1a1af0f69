"""Operator 7: token counts by prefix dynamic programming.

For a byte-pair vocabulary, the encoding of a prefix ends in exactly one token whose removal leaves the encoding of a
shorter prefix; it is the one that is compatible with that prefix's last token (the two, merged anew, stay the two).
So going through a word's prefixes in order, the last token of each is found from those before, and

    count(prefix) = count(prefix without its last token) + 1.

With word ends, a prefix has two states: open (the word goes on) and closed (the text stops there, the last token
carries the word end). The stored count of a prefix is the closed one, that is, what the tokenizer gives for the text
cut there. ``prefix_counts`` stores it for every prefix of every text, and ``n_tokens``, ``fits``, ``cut_at`` answer
count, budget and truncation questions from the stored array alone, without encoding again.

Positions count characters of the text as it is given. Words of any script go the same way: the tokenizer's own normalizer
and pre-tokenizer cut a word into pieces, and the recurrence runs over each piece's bytes, so that work is linear in the
length of a text without blanks, composed or not. Parts of a text that normal forms join (a letter and its combining marks) count
as they end; a prefix that ends within such a part goes on from the recurrence's state at the part's start with the normal form of
what it has of the part. Only a text whose normal form isn't that of its parts one after another would be encoded prefix by prefix.

Defined results: null and empty texts have the single prefix of length 0 with count 0; a null doc_id and repeated rows
give a row each; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from unicodedata import combining, is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .token_output import slices
from .words import PIECE, SHORT_PIECES, Encoder, WordTable, blanks, symbols

LIMIT = 2048
_END = "</w>"
_NEVER, _ONE = 1 << 60, (1,)
#: Prefixes of this length are kept with their counts, so many at most: words share them.
HEAD, HEADS = 6, 100_000
#: Pieces up to this length are cut anew with what is added to them; the tokenizer's contractions are no longer than that.
SHORT = 8
#: Pairs of tokens whose compatibility is kept, and normal forms of single characters.
PAIRS, FORMS = 1_000_000, 50_000
_tables: dict[str, WordTable] = {}


class PrefixCounter:
    """Counts for each prefix of a word."""

    def __init__(self, path: str):
        import json

        self.encoder = Encoder(path)
        model = json.loads(self.encoder.tokenizer.to_str())["model"]
        vocab = set(model["vocab"])
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        # Every token's text: bit 0 if it is a token, bit 1 if it is one with the word end.
        self.kinds = {t: (t in vocab) + 2 * (t + _END in vocab) for t in (v.removesuffix(_END) if len(v) > len(_END) else v for v in vocab)}
        # By a token's last two symbols: how long those are that end so, the longest first. All single symbols are tokens.
        lengths: dict[str, set[int]] = defaultdict(lambda: {1})
        for t in self.kinds:
            lengths[t[-2:]].add(len(t))
        self.lengths = {t: tuple(sorted(n, reverse=True)) for t, n in lengths.items() if len(t) == 2}
        self.heads: dict[str, tuple] = {}
        self.made: dict[str, tuple[str, str]] = {}
        self.edges: dict[str, list | None] = {}
        # Which tokens may follow a token, as they are and with the word end; PAIRS at most.
        self.after: dict[str, dict[str, bool]] = defaultdict(dict)
        self.ends: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0
        #: The longest token, in symbols: what goes on from a prefix looks back so far.
        self.back = max(map(len, self.kinds))
        self.forms: dict[str, str] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merged(self, parts: list[str]) -> tuple[str, ...]:
        """Byte-pair merging, lowest rank first, leftmost first; notes what each new token was made of."""
        while len(parts) > 1:
            ranks = [self.rank.get(pair, _NEVER) for pair in zip(parts, parts[1:])]
            at = ranks.index(min(ranks))
            if ranks[at] == _NEVER:
                break
            self.made[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def spines(self, token: str):
        """For the token's right and left edge: (part, rank of the merge that takes it up), outermost first; None if the
        merges don't make this token of its own text."""
        if token not in self.edges:
            body = token.removesuffix(_END) if len(token) > len(_END) else token
            units = [*body] if body == token else [*body[:-1], body[-1] + _END]
            sides = None
            if self.merged(units) == (token,):
                sides = []
                for side in (1, 0):
                    part, spine = token, [(token, _NEVER)]
                    while part in self.made:
                        rank = self.rank[self.made[part]]
                        part = self.made[part][side]
                        spine.append((part, rank))
                    sides.append(spine)
            self.edges[token] = sides
        return self.edges[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges leave the two tokens in a row as they are; with an empty left, whether they make right.

        They don't if parts at the joint that stand there at the same time make a pair: one whose rank comes before the
        merge that takes up the left part, and not after the one that takes up the right part (leftmost first).
        """
        edge = self.spines(right)
        if edge is None or not left:
            return edge is not None
        rank = self.rank
        for a, a_taken in self.spines(left)[0]:
            for b, b_taken in edge[1]:
                q = rank.get((a, b))
                if q is not None and q < a_taken and q <= b_taken:
                    return False
        return True

    def extend(self, text: str, last: list, opened: list[int], closed: list[int]) -> tuple[list, list[int], list[int]]:
        """Goes on from the prefixes whose last token (None: there is none) and counts are given to all of text.

        Of all tokens that end at a prefix, one is compatible with the last token of what stands before it, as the word
        goes on, and one as it ends there.
        """
        kinds, after, ends, lengths = self.kinds, self.after, self.ends, self.lengths
        if self.n_pairs > PAIRS:
            after.clear()
            ends.clear()
            self.n_pairs = 0
        for i in range(len(last), len(text) + 1):
            token_open, n_open, n_closed = None, 0, 0
            for n in lengths.get(text[i - 2 : i], _ONE) if i > 1 else _ONE:
                j = i - n
                if j < 0 or (left := last[j]) is None:
                    continue
                token = text[j:i]
                kind = kinds.get(token)
                if kind is None:
                    continue
                if kind & 1 and token_open is None:
                    ok = after[left].get(token)
                    if ok is None:
                        ok = after[left][token] = self.compatible(left, token)
                        self.n_pairs += 1
                    if ok:
                        token_open, n_open = token, opened[j] + 1
                if kind & 2 and not n_closed:
                    ok = ends[left].get(token)
                    if ok is None:
                        ok = ends[left][token] = self.compatible(left, token + _END)
                        self.n_pairs += 1
                    if ok:
                        n_closed = opened[j] + 1
                if n_closed and token_open is not None:
                    break
            last.append(token_open)
            opened.append(n_open)
            closed.append(n_closed)
        return last, opened, closed

    def piece(self, piece: str) -> tuple[int, ...]:
        """Counts of all prefixes of a piece that the pre-tokenizer leaves whole."""
        got = self.pieces.get(piece)
        if got is not None:
            return got
        text = symbols(piece)
        head = text[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self.extend(head, [""], [0], [0])
            if len(self.heads) < HEADS:
                self.heads[head] = known
        closed = self.extend(text, *map(list, known))[2] if len(text) > HEAD else known[2]
        if piece.isascii():
            got = tuple(closed[1:])
        else:
            got = tuple(closed[i] for i in accumulate(len(c.encode()) for c in piece))
        if len(piece) < 5 and len(self.pieces) < SHORT_PIECES:
            self.pieces[piece] = got
        return got

    def counted(self, pieces: list[tuple[str, int]], length: int) -> list[int]:
        """Counts of all prefixes, from length 1, of a normalised text of pieces (with their places)."""
        out: list[int] = []
        base = 0
        for p, at in pieces:
            out += [base] * (at - len(out))
            counts = self.piece(p)
            if p[0] == "'" and len(p) > 1 and p[1].isalpha():
                counts = tuple(sum(self.piece(q)[-1] for q in PIECE.findall(p[:i])) for i in range(1, len(p))) + counts[-1:]
            out += [base + c for c in counts]
            base = out[-1]
        return out + [base] * (length - len(out))

    def form(self, part: str) -> str:
        """A part's normal form."""
        got = self.forms.get(part)
        if got is None:
            got = self.encoder.tokenizer.normalizer.normalize_str(part)
            if len(part) == 1 and len(self.forms) < FORMS:
                self.forms[part] = got
        return got

    def by_library(self, text: str) -> list[int]:
        return [len(self.encoder.tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]

    def stretch(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special tokens' strings, in any script, from length 1."""
        parts, whole, blank = parts_of(text), [], False
        for part in parts:  # the normalizer makes one blank of several
            form = self.form(part)
            whole.append("" if blank and form == " " else form)
            blank = form == " " or blank and not form
        normal = "".join(whole)
        if normal != self.encoder.tokenizer.normalizer.normalize_str(text):
            return self.by_library(text)
        pieces = [(normal[a:b], a) for _, (a, b) in self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        counts = [0, *self.counted(pieces, len(normal))]
        out, at, k, tail = [], 0, 0, None
        for part, form in zip(parts, whole):
            if len(part) > 1:
                while k < len(pieces) and pieces[k][1] + len(pieces[k][0]) < at:
                    k, tail = k + 1, None
                start = min(pieces[k][1], at) if k < len(pieces) else at
                if at - start > SHORT and tail is None:
                    tail = _Tail(self, pieces[k][0])
                for i in range(1, len(part)):
                    more = self.form(part[:i])
                    if at - start > SHORT:
                        out.append(counts[start] + tail.count(at - start, more))
                    else:
                        out.append(counts[start] + sum(self.piece(q)[-1] for q in PIECE.findall(normal[start:at] + more)))
            at += len(form)
            out.append(counts[at])
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Counts of all prefixes of what stands between blanks, from length 1."""
        if not self.encoder.plain(word) or "İ" in word:  # in lower case two characters
            out: list[int] = []
            base = 0
            while True:  # a special token's string cuts a word in two, but only when it is whole
                at, special = min(((word.find(s), s) for s in self.encoder.special if s in word), default=(-1, ""))
                if at < 0:
                    return tuple(out + [base + c for c in self.stretch(word)])
                counts = self.stretch(word[: at + len(special) - 1])
                out += [base + c for c in counts]
                base += (counts[at - 1] if at else 0) + 1
                out.append(base)
                word = word[at + len(special) :]
        if word.isascii() and word.isalpha():
            return self.piece(word.lower())
        return tuple(self.counted([(m[0], m.start()) for m in PIECE.finditer(word.lower())], len(word)))


class _Tail:
    """A piece whose prefixes go on with other characters: its recurrence's states are kept, so that only what is added counts."""

    def __init__(self, counter: PrefixCounter, piece: str):
        self.counter, self.symbols = counter, symbols(piece)
        self.last, self.opened, self.closed = counter.extend(self.symbols, [""], [0], [0])
        self.ends = [0, *accumulate(len(c.encode()) for c in piece)]
        # A character of the piece's kind: what goes on in the same piece after it does so after the piece.
        self.kind = "a" if piece[0].isalpha() else "!"

    def count(self, n: int, more: str) -> int:
        """Tokens of the first n characters and of what is added to them."""
        first, *rest = PIECE.findall(self.kind + more)
        end = self.ends[n]
        if len(first) > 1:
            a = max(0, end - self.counter.back)
            text = self.symbols[a:end] + symbols(first[1:])
            own = self.counter.extend(text, self.last[a : end + 1], self.opened[a : end + 1], self.closed[a : end + 1])[2][-1]
        else:
            own = self.closed[end]
        return own + sum(self.counter.piece(q)[-1] for q in rest)


def parts_of(text: str) -> list[str]:
    """The parts of a text whose normal forms (NFC) stand side by side in that of the text."""
    if is_normalized("NFC", text):
        return list(text)
    parts: list[str] = []
    for c in text:
        if parts and (combining(c) or normalize("NFC", parts[-1] + c) != normalize("NFC", parts[-1]) + normalize("NFC", c)):
            parts[-1] += c
        else:
            parts.append(c)
    return parts


def prefix_arrays(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Per text, the count of the prefix of each length from 0 on."""
    if path not in _tables:
        _tables[path] = WordTable(PrefixCounter(path).word, np.int32)
    known = _tables[path]
    words = [blanks(t) if t else [] for t in texts]
    at = known.look_up([w for ws in words for w in ws])
    runs, lens = known.gather(at)
    ends = np.cumsum(lens)
    totals = np.where(lens > 0, np.concatenate([runs, [0]])[np.maximum(ends - 1, 0)], 0)
    before = np.cumsum(totals) - totals
    # A blank before each word keeps the count; before the first word of a text it is the prefix of length 0.
    flat = np.empty(len(runs) + len(lens), np.int32)
    heads = ends - lens + np.arange(len(lens))
    body = np.ones(len(flat), bool)
    body[heads] = False
    flat[heads] = before
    flat[body] = runs + np.repeat(before, lens)
    out, w, c = [], 0, 0
    for ws in words:
        if not ws:
            out.append(np.zeros(1, np.int32))
            continue
        n = int(lens[w : w + len(ws)].sum()) + len(ws)
        out.append(flat[c : c + n] - np.int32(before[w]))
        w, c = w + len(ws), c + n
    return out


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                texts = part["text"].to_pylist()
                counts = prefix_arrays(texts, path)
                ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                flat = np.concatenate(counts) if counts else np.zeros(0, np.int32)
                n_bytes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], n_bytes, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n_bytes", "counts"])

    return count


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, counts: counts[i] is the number of tokens of the first i characters."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(path), "doc_id long, n_bytes long, counts array<int>")


def n_tokens(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("long")


def fits(counts: Column, budget: int) -> Column:
    """Whether the whole text fits a budget of tokens."""
    return n_tokens(counts) <= budget


def cut_at(counts: Column, budget: int) -> Column:
    """Length in characters of the longest prefix that fits a budget of tokens."""
    fit = F.transform(counts, lambda c, i: F.when(c <= budget, i).otherwise(-1))
    return F.when(fits(counts, budget), F.size(counts) - 1).otherwise(F.array_max(fit))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", n_tokens(F.col("counts")).alias("n_tokens"), (~fits(F.col("counts"), LIMIT)).alias("over_limit"))
