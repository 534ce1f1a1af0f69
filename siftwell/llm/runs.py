"""Operator 12: periodic runs of words, by online dyadic square catching.

Words come in order. A level k holds the completed blocks of 2^k words that start at multiples of 2^k, and a name for each
window of that length (a 64-bit fingerprint made from the names of its halves one level below). Each completed block has a
catcher: a repetition of period p whose words agree with those p further on over p places or more holds a whole
block of the level that p belongs to, and that block comes again p words later. So a block's catcher compares its name with those of
the windows that begin at each of its periods' distances as they are completed, and a hit is a place where suffixes agree.
The agreement is compared exactly to the left, and to the right as far as words have come; while it reaches the last
word it stays open, and each appended word carries it on. Once it is over, or the text ends, a stretch of agreement of p
places or more has squares in it, all of one run; runs with the same bounds are merged to the one with the smallest period.

Each level compares about 2 n names, so that a text of n words takes n log n steps, in vectors over all catchers that are due.
Blocks inside a known repetition aren't followed at multiples of its period, so that a text of one word
over and over takes no more. Names that are equal by chance are found out by the comparison; equal windows have equal names.

One pass, no shuffle; a worker holds one slice of a batch. Defined results: null, empty and blank texts have no words, no runs
and an empty collapsed text; repeated rows have the same result each; texts of any length are taken whole; columns of docs
that are called like a result give way; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ship, table
from .token_output import slices

#: Runs of fewer words aren't reported.
LEAST = 12
#: Words appended at once, and names compared at once.
APPEND, AT_ONCE = 1 << 16, 1 << 20
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_WORDS = re.compile(WORD)
_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of windows from the names of their halves."""
    x = left * _A
    x ^= x >> _M
    x += right
    x *= _B
    x ^= x >> _M
    return x


class Level:
    """Blocks of ``size`` words and the periods, ``low`` to ``high``, that their catchers look for. ``names`` holds the names of the
    windows that begin at ``start`` and after it; all that begin before ``done`` were compared."""

    def __init__(self, size: int, low: int, high: int):
        self.size, self.low, self.high = size, low, high
        self.names, self.start, self.done = np.zeros(0, np.uint64), 0, 0


class SquareCatcher:
    """Finds the runs of a growing text: append() words (as numbers), then finish()."""

    def __init__(self, least: int = LEAST):
        self.least, self.n = least, 0
        self.words = np.zeros(0, np.int64)
        self.levels: list[Level] = []
        # For each place: the period of the repetition that reaches furthest from there, and where it ends.
        self.period, self.reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: dict[int, tuple[int, int]] = {}  # by period, the bounds of the stretch that reaches the last word
        self.past: dict[int, int] = {}  # by period, where the last stretch ended
        self.runs: dict[tuple[int, int], int] = {}

    def need(self, p: int) -> int:
        """How many places must agree with those p further on."""
        return max(p, self.least - p)

    def grow(self, n: int) -> None:
        """Adds the levels that a text of n words may have use for. A stretch of 2^(k+1) - 1 places holds a whole block of level k."""
        while True:
            k = len(self.levels)
            least, most = (2 << k) - 1, (4 << k) - 2
            if least > n // 2 and least > self.least:
                return
            of = [p for p in (*range(1, min(self.least, most) + 1), least, most) if least <= self.need(p) <= most]
            self.levels.append(Level(1 << k, min(of, default=1), max(of, default=0)))

    def same(self, a: int, b: int, limit: int) -> int:
        """How many words from a and from b on are the same, up to limit."""
        w, got, step = self.words, 0, 64
        while got < limit:
            m = min(step, limit - got)
            differ = w[a + got : a + got + m] != w[b + got : b + got + m]
            k = int(differ.argmax())
            if differ[k]:
                return got + k
            got, step = got + m, 4 * step
        return got

    def same_before(self, a: int, b: int) -> int:
        """How many words before a are the same as those before b (a < b)."""
        w, got, step = self.words, 0, 64
        while got < a:
            m = min(step, a - got)
            differ = (w[a - got - m : a - got] != w[b - got - m : b - got])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return got + k
            got, step = got + m, 4 * step
        return got

    def note(self, a: int, e: int, p: int) -> None:
        """Takes up that words a to e - 1 agree with those p further on."""
        if e - a >= p:
            reach, period = self.reach[a:e], self.period[a:e]
            further = (reach < e + p) | ((reach == e + p) & (period > p))
            reach[further] = e + p
            period[further] = p

    def close(self, p: int) -> None:
        a, e = self.open.pop(p)
        self.past[p] = e
        if e - a >= self.need(p) and self.runs.get((a, e + p), p) >= p:
            self.runs[a, e + p] = p

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        n = self.n
        if n > len(self.words):
            room = max(n, 2 * len(self.words)) - len(self.words)
            self.words, self.period, self.reach = (np.concatenate([x, np.zeros(room, np.int64)]) for x in (self.words, self.period, self.reach))
        self.words[old:n] = words
        for p, (a, e) in list(self.open.items()):
            e += self.same(e, e + p, n - p - e)
            self.open[p] = (a, e)
            self.note(a, e, p)
            if e + p < n:
                self.close(p)
        self.grow(n)
        for k, level in enumerate(self.levels):
            have = level.start + len(level.names)
            if k == 0:
                new = (self.words[have:n].astype(np.uint64) + np.uint64(1)) * _A
            else:
                below = self.levels[k - 1]
                upto = below.start + len(below.names) - below.size
                if upto <= have:
                    break
                x = below.names
                new = joined(x[have - below.start : upto - below.start], x[have + below.size - below.start : upto + below.size - below.start])
            level.names = np.concatenate([level.names, new]) if len(level.names) else new
            if level.low <= level.high:
                self.catch(level)
        for level, above in zip(self.levels, self.levels[1:]):  # forget the names that nobody will ask for
            drop = above.start + len(above.names) - level.start
            if level.low <= level.high:
                drop = min(drop, level.done - level.high - level.size - level.start)
            if drop > max(4096, len(level.names) // 2):
                level.names, level.start = level.names[drop:].copy(), level.start + drop

    def catch(self, level: Level) -> None:
        """Compares each block with the windows at its distances that are new since the last time."""
        size, low, high, first = level.size, level.low, level.high, level.start
        end = first + len(level.names)  # windows that begin before it are complete
        done, level.done = level.done, end
        s = -(-max(0, done - high) // size) * size
        last = end - 1 - low
        if s > last:
            return
        width = high - low + 1
        names = np.concatenate([level.names, np.zeros(high, np.uint64)])
        blocks, places = [], []
        step = max(1, AT_ONCE // width)
        while s <= last:
            m = min(step, (last - s) // size + 1)
            ahead = np.ndarray((m, width), np.uint64, names, 8 * (s + low - first), (8 * size, 8))
            row, col = np.nonzero(ahead == names[s - first : s - first + m * size : size][:m, None])
            if len(row):
                at, p = s + row * size, low + col
                fresh = (at + p >= done) & (at + p < end)
                blocks.append(at[fresh])
                places.append(p[fresh])
            s += m * size
        if any(map(len, blocks)):
            self.follow(np.concatenate(blocks), np.concatenate(places), size)

    def unknown(self, at: np.ndarray, p: np.ndarray | int, size: int) -> np.ndarray:
        """Whether hits aren't those of a known repetition that holds block and window and whose period divides theirs."""
        q = self.period[at]
        return (q == 0) | (at + p + size > self.reach[at]) | (p % np.maximum(q, 1) != 0)

    def follow(self, blocks: np.ndarray, periods: np.ndarray, size: int) -> None:
        """Extends the hits, smallest period first, each stretch of agreement once."""
        fresh = self.unknown(blocks, periods, size)
        blocks, periods = blocks[fresh], periods[fresh]
        if not len(blocks):
            return
        order = np.lexsort((blocks, periods))
        blocks, periods = blocks[order], periods[order]
        cuts = [0, *(np.flatnonzero(np.diff(periods)) + 1).tolist(), len(periods)]
        for i, j in zip(cuts, cuts[1:]):
            p, at = int(periods[i]), blocks[i:j]
            at = at[self.unknown(at, p, size)]
            k = 0
            while k < len(at):
                if p in self.open:
                    break
                s = int(at[k])
                if s < self.past.get(p, 0):
                    k = int(np.searchsorted(at, self.past[p]))
                    continue
                right = self.same(s, s + p, self.n - p - s)
                if right < size:  # names equal by chance
                    k += 1
                    continue
                a, e = s - self.same_before(s, s + p), s + right
                self.open[p] = (a, e)
                self.note(a, e, p)
                if e + p < self.n:
                    self.close(p)
                k = int(np.searchsorted(at, e))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs: start, length, smallest period, in order."""
        for p in list(self.open):
            self.close(p)
        return sorted((a, b - a, p) for (a, b), p in self.runs.items())


def runs_of(words: np.ndarray, least: int = LEAST, at_once: int = APPEND) -> list[tuple[int, int, int]]:
    """The runs of a text of numbered words."""
    if len(words) < least:
        return []
    catcher = SquareCatcher(least)
    for i in range(0, len(words), at_once):
        catcher.append(words[i : i + at_once])
    return catcher.finish()


def numbered(words: list[str]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def looped(n: int, seed: int) -> np.ndarray:
    """The numbers of the words that a text of n words gets: from a place drawn by the seed, a stretch of it is repeated to the end."""
    at = seed % n
    period = 1 + (n - at) // (3 + seed % 8)
    out = np.arange(n)
    out[at:] = at + np.arange(n - at) % period
    return out


def keep(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those of a run go after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def _find(columns: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, found, left = [], [], []
                for text, seed in zip(part["text"].to_pylist(), part["seed"].to_pylist()):
                    words = _WORDS.findall(text) if text else []
                    ids = numbered(words)
                    if seed is not None and words:
                        at = looped(len(words), seed)
                        ids, words = ids[at], [words[i] for i in at]
                    runs = runs_of(ids, least)
                    if runs:
                        words = [words[i] for i in np.flatnonzero(keep(len(ids), runs))]
                    counts.append(len(ids))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    left.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())], names=[*columns, *("n_words", "runs", "collapsed")])

    return run


def find_runs(docs: DataFrame, columns: list[str], least: int = LEAST, seed: Column | None = None) -> DataFrame:
    """The named columns of docs with ``n_words``, ``runs`` (maximal stretches of at least ``least`` words and two periods) and
    ``collapsed``, the text without what runs repeat. A row with a seed gets a loop planted first (see ``looped``)."""
    ship(docs.sparkSession)
    kept = [c for c in columns if c not in ("n_words", "runs", "collapsed")]
    inner = {c: f"given {i}" for i, c in enumerate(kept)}
    seed = F.lit(None) if seed is None else seed
    given = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()], F.col("text").cast("string").alias("text"), seed.cast("long").alias("seed"))
    schema = ", ".join([f"`{c}` {t}" for c, t in given.select(*inner.values()).dtypes] + [RESULT])
    return given.mapInArrow(_find(list(inner.values()), least), schema).withColumnsRenamed({x: c for c, x in inner.items()})


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    found = find_runs(table(spark, sf_dir, "documents"), ["doc_id"], seed=F.when(h % 10 == 0, F.floor(h / 10)))
    # The greatest length, then the smallest start and period: the least of these.
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    top = found.withColumn("top", longest).withColumn("listed", listed)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
