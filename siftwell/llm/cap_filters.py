"""Operator 6: embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: the turned vector is cut into parts, each part has its own random
code of unit vectors, and every combination of one code word per part is a direction. A vector passes the filters whose
cap it lies in (inner product over a threshold); they are list-decoded: partial sums that can't reach the threshold with
the best that is left are given up, so that the many directions are never all looked at. The number of directions follows
from the number of vectors (a filter is passed by about OCCUPANCY unrelated ones), the threshold from PASSED, the number of
independent codes from MISS.

Vectors are then joined on filters and verified in double precision. Rows of a partition come sorted by filter, and a
filter's rows are compared in one matrix product; filters with more than BUCKET rows are cut into salted blocks, and
pairs of blocks are groups of their own, so that no task gets an unbounded group. No pairs leave a task: per group, a
vector reports how many it links with (a pair counts only at the first filter it shares) and the root of its
local component; counts are then summed, and components joined over the graph of roots. Equal vectors are one class, weighted by its size.

Recall is that of the filters: about 1 - MISS at the wanted cosine, higher above it; vectors below it never link.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links and are their
own component; vectors of different lengths never link; rows that repeat a vec_id are rows of their own; a null vec_id
is never a component's id unless it has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .graph import components

COSINE = 0.9
#: Unrelated vectors in a filter, filters of one code that a vector passes, pairs at the wanted cosine that may be missed.
OCCUPANCY, PASSED, MISS = 8.0, 2.5, 0.004
BUCKET = 1024
_MAX_CODE = 256
_DIMS = 65_536


class Caps:
    """The filters for n vectors of a dimension: several independently turned product codes.

    The size of a code follows from n, its threshold from how far seeded random vectors reach, and the number of codes
    from how often seeded random pairs at the wanted cosine share no filter of one code, so that of such pairs all codes
    together miss a share of about MISS.
    """

    def __init__(self, n: int, dim: int, cosine: float, seed: int = 6):
        rng = np.random.default_rng(seed * 1_000_003 + dim)
        directions = max(256, n * PASSED / OCCUPANCY)
        parts = 1
        while parts < min(dim, 6) and directions ** (1 / parts) > _MAX_CODE:
            parts += 1
        self.size = math.ceil(directions ** (1 / parts))
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        self.turns, self.codes = [], []
        x = rng.normal(size=(128, dim))
        z = rng.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z
        passed = PASSED
        while True:
            self.turns, self.codes = [], []
            self._add(rng, dim)
            # The PASSED-th best of all directions for each of a few vectors; their median is the threshold.
            self.threshold = -1.0
            reach = [np.sort(self._all_sums(v))[::-1][: int(passed) + 1].min() for v in x[:16]]
            self.threshold = float(np.median(reach))
            missed = 0
            (ra, ka), (rb, kb) = self.passed(x), self.passed(y)
            shared = np.intersect1d(ra * (1 << 40) + ka, rb * (1 << 40) + kb) >> 40
            missed = 1 - len(np.unique(shared)) / len(x)
            tables = 1 if missed <= MISS else math.ceil(math.log(MISS) / math.log(min(missed, 0.999)))
            if tables <= 40 or passed > directions / 2:
                break
            passed *= 2
        for _ in range(tables - 1):
            self._add(rng, dim)

    def _add(self, rng, dim: int) -> None:
        self.turns.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
        code = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.normal(size=(self.size, b - a))
            code.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * math.sqrt((b - a) / dim))
        self.codes.append(code)

    def _all_sums(self, unit: np.ndarray) -> np.ndarray:
        """The 4096 best partial sums carried on part by part: enough for the best of all directions."""
        x, total = unit @ self.turns[0], np.zeros(1)
        for c, a, b in zip(self.codes[0], self.cuts, self.cuts[1:]):
            total = (total[:, None] + (c @ x[a:b])[None]).reshape(-1)
            if len(total) > 4096:
                total = np.partition(total, len(total) - 4096)[-4096:]
        return total

    def passed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors pass, by row and filter."""
        rows, keys = [], []
        for t, (turn, code) in enumerate(zip(self.turns, self.codes)):
            x = units @ turn
            sums = [x[:, a:b] @ c.T for c, a, b in zip(code, self.cuts, self.cuts[1:])]
            best = [s.max(1) for s in sums]
            row, key, total = np.arange(len(x)), np.full(len(x), t, np.int64), np.zeros(len(x))
            for k, s in enumerate(sums):
                rest = sum(best[k + 1 :], np.zeros(len(x)))
                i, j = np.nonzero(total[:, None] + s[row] >= (self.threshold - rest - 1e-12)[row][:, None])
                total, key, row = total[i] + s[row[i], j], key[i] * self.size + j, row[i]
            rows.append(row)
            keys.append(key)
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        return row[order], key[order]


_caps: dict[tuple, Caps] = {}


def caps_for(n: int, dim: int, cosine: float) -> Caps:
    key = (n, dim, cosine)
    if key not in _caps:
        if len(_caps) > 8:
            _caps.clear()
        _caps[key] = Caps(n, dim, cosine)
    return _caps[key]


def _floats(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    out = []
    for v in batch["embedding"]:
        x = None
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False)
            x = x if np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [None if x is None else (x + 0.0).tobytes() for x in _floats(batch)]
        prints = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "print", "raw"])


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: list[bytes]) -> list[np.ndarray]:
    lens = np.array([len(r) for r in raw])
    return [np.flatnonzero(lens == n) for n in np.unique(lens)]


def _decode(n: int, cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                raw = part["raw"].to_pylist()
                for own in _by_length(raw):
                    units = _units([raw[k] for k in own], kind)
                    row, key = caps_for(n, units.shape[1], cosine).passed(units)
                    at = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(key * _DIMS + units.shape[1] % _DIMS), *(part[c].take(at) for c in ("print", "raw", "n"))], names=["key", "print", "raw", "n"])

    return run


def _verify(n: int, cosine: float, kind: str):
    """Of a partition sorted by (key, lo, hi): links within each group, or across its two blocks."""
    lists: dict[bytes, np.ndarray] = {}

    def filters(prints: list[bytes], units: np.ndarray) -> list[np.ndarray]:
        if len(lists) > 20_000:
            lists.clear()
        new = [i for i, p in enumerate(prints) if p not in lists]
        if new:
            row, key = caps_for(n, units.shape[1], cosine).passed(units[new])
            for i, k in zip(new, np.split(key, np.searchsorted(row, np.arange(1, len(new))))):
                lists[prints[i]] = k
        return [lists[p] for p in prints]

    def group(rows: dict, key: int, lo: int, hi: int):
        units = _units(rows["raw"], kind)
        close = units @ units.T >= cosine
        np.fill_diagonal(close, False)
        if lo != hi:
            side = np.array(rows["block"]) == lo
            close &= side[:, None] != side[None]
        some = np.flatnonzero(close.any(1))
        if not len(some):
            return None
        close = close[np.ix_(some, some)]
        prints = [rows["print"][i] for i in some]
        got = filters(prints, units[some])
        number = key // _DIMS
        before = [g[g < number] for g in got]
        names, place = np.unique(np.concatenate(before), return_inverse=True) if sum(map(len, before)) else (np.zeros(0), np.zeros(0, int))
        marks = np.zeros((len(some), len(names)), np.float32)
        marks[np.repeat(np.arange(len(some)), [len(b) for b in before]), place] = 1
        counted = close & (marks @ marks.T == 0)
        weights = np.array([rows["n"][i] for i in some], np.int64)
        # The least print that a vector reaches within the group: smallest label until nothing changes.
        rank = np.argsort(np.argsort(prints))
        root = rank.copy()
        while True:
            new = np.minimum(root, np.where(close, root[None], len(some)).min(1))
            if (new == root).all():
                break
            root = new
        name = sorted(prints)
        return prints, [name[r] for r in root], counted.astype(np.int64) @ weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {c: [] for c in ("print", "raw", "n", "block")}
        out: list = [[], [], []]

        def solve():
            if now is not None and len(held["raw"]) > 1 and (got := group(held, *now)):
                for o, g in zip(out, got):
                    o.extend(g)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array([int(x) for x in out[2]], pa.int64())], names=["print", "root", "n_links"])

        for batch in batches:
            if not len(batch):
                continue
            ids = [batch[c].to_numpy() for c in ("key", "lo", "hi")]
            cuts = [0, *(np.flatnonzero((np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0) | (np.diff(ids[2]) != 0)) + 1), len(batch)]
            cols = {c: batch[c].to_pylist() for c in held}
            for a, b in zip(cuts, cuts[1:]):
                name = tuple(int(x[a]) for x in ids)
                if name != now:
                    solve()
                    now, held = name, {c: [] for c in held}
                for c in held:
                    held[c] += cols[c][a:b]
            if len(out[0]) > 10_000:
                yield flush()
                out = [[], [], []]
        solve()
        yield flush()

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "caps")
    kind = "f4" if "float" in dict(vectors.dtypes)["embedding"] else "f8"
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding") if kind == "f4" else F.col("embedding").cast("array<double>"))
    rows = scratch.save(given.mapInArrow(_print, "vec_id long, print binary, raw binary"))
    classes = scratch.save(rows.filter("print is not null").groupBy("print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("raw").alias("raw")))
    n = classes.count()
    listed = classes.select("print", "raw", "n").repartition(max(spark.sparkContext.defaultParallelism, -(-n // 20_000))).mapInArrow(_decode(n, cosine, kind), "key long, print binary, raw binary, n long")
    large = scratch.save(listed.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > BUCKET).select(F.col("key").alias("l_key"), F.ceil(F.col("rows") / BUCKET).cast("int").alias("blocks")))
    cut = listed.join(large, F.col("key") == F.col("l_key"), "left") if large.count() else listed.withColumn("blocks", F.lit(None).cast("int"))
    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("block", block).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "print", "raw", "n")
    found = scratch.save(dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_verify(n, cosine, kind), "print binary, root binary, n_links long"))
    counts = found.groupBy("print").agg(F.sum("n_links").alias("linked")).withColumnRenamed("print", "n_print")
    comp = components(found.select(F.col("print").alias("a"), F.col("root").alias("b")), scratch)
    whole = classes.select("print", "vec_id", "n").join(comp, F.col("print") == F.col("node"), "left").join(counts, F.col("print") == F.col("n_print"), "left").select("print", "vec_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "print").alias("comp"))
    ids = whole.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    labels = scratch.save(whole.join(ids, "comp").select(F.col("print").alias("l_print"), "links", "component_id"))
    out = rows.select("vec_id", "print").join(labels, F.col("print") == F.col("l_print"), "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, COUNT(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, COALESCE(degree.n, 0)::BIGINT AS n_links, least.component_id::BIGINT AS component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
