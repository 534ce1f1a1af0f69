"""Operator 5: exact top-k by inner product, as a Voronoi kNN join.

With M no less than any candidate's norm, appending sqrt(M^2 - |x|^2) to a candidate x and 0 to a query q turns the
largest inner product into the nearest distance, |q|^2 + M^2 - 2<q, x>. There, queries and candidates are grouped by
their nearest pivot. Per cell, small summaries are kept: its radius, the distances of its k + 1 nearest ids to the pivot, and
the greatest distance of its queries. From these alone follow, per group of queries, a bound that its k-th neighbour can't
exceed, and the cells that can hold a nearer one; only what can lie within the bound is joined. Joins are solved locally,
block against block, in exact arithmetic, and each passes on its k best per query, which are merged in two steps.

Vectors only meet those of their own length. Pivots are a sample by hash whose number grows with the square root of the rows
(16 to MAX_PIVOTS), for each of the PIVOT_LENGTHS most frequent lengths; rows of other lengths make one cell per length, which no bound
leaves out. The driver holds pivots and their summaries, at most PIVOT_LENGTHS * MAX_PIVOTS * (k + 2 + MAX_PIVOTS) numbers, never data.
A cell of any size is cut by row into blocks of candidates, and the queries that need it into blocks by id, so that a hot cell or a
hot vec_id becomes more tasks and a task holds one block of candidates and streams one of queries. Queries, the smaller side (a
twentieth), are replicated to the blocks of the cells they need. On data without structure the bounds exclude little (distances
concentrate), and the join is then the blocked comparison of the query set with all rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id; empty
vectors score 0 with each other; rows that repeat a vec_id are candidates of their own, but as queries count once each, with
the least of their vectors; with fewer than k candidates all are returned; ties go to the smaller vec_id; scores beyond the
range of a long stop at its ends; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, ship, table

K = 20
MAX_PIVOTS, PIVOT_LENGTHS = 512, 8
#: Candidates and queries of a block; blocks of candidates grow with the rows up to so many bytes.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 4096, 16_384, 16 << 20
SCALE = 64
EVERY = 20
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53
#: Beyond this squared norm distances say nothing, and no cell is left out.
_LARGE = 1e200
_NEVER, _LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
_ROWS = "query_id long, vec_id long, score long"
_PLACED = "vec_id long, v array<double>, dim int, cell int, dist double"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles, of the rows that take part."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # ceil and floor of doubles give longs, which end too soon.
    down = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return vectors.filter(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: down(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lens = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lens):
        yield int(n), batch if (lens == n).all() else batch.take(pa.array(np.flatnonzero(lens == n)))


def _assign(pivots: dict[int, tuple[np.ndarray, float]], query: bool):
    """Each row's length, nearest pivot and its distance; cell 0 at distance 0 where a length has no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                cell, dist = np.zeros(len(part), np.int32), np.zeros(len(part))
                if dim in pivots:
                    at, top = pivots[dim]
                    x = _matrix(part["v"], dim)
                    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0))
                    x = np.concatenate([x, lift[:, None]], axis=1)
                    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ at.T + (at * at).sum(1), 0))
                    cell = d.argmin(1).astype(np.int32)
                    dist = d[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(np.full(len(part), dim, np.int32)), pa.array(cell), pa.array(dist)], names=["vec_id", "v", "dim", "cell", "dist"])

    return run


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return order[rank < k]


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows that hold whole numbers."""
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    if (q * q).sum(1).max() * (x * x).sum(1).max() < _EXACT**2:
        return (q @ x.T).astype(np.int64)
    ints = [[int(a) for a in w] for w in x]
    return np.array([[min(max(sum(int(a) * b for a, b in zip(u, w)), _LEAST), _MOST) for w in ints] for u in q], np.int64)


def _solve(k: int):
    """Of a partition sorted by (dim, cell, block, query block, side): candidates (side 0), then the queries that need them."""

    def join(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, min(256, (4 << 20) // len(ids)))
        for i in range(0, len(q), step):
            part, p_ids = exact_products(q[i : i + step], x), q_ids[i : i + step]
            part[p_ids[:, None] == ids] = _NEVER  # the query itself, on however many rows
            n = min(k, len(ids))
            floor = np.partition(part, len(ids) - n, axis=1)[:, len(ids) - n]
            r, c = np.nonzero((part >= floor[:, None]) & (part != _NEVER))
            keep = best(r, ids[c], part[r, c], k)
            r, c = r[keep], c[keep]
            yield pa.RecordBatch.from_arrays([pa.array(p_ids[r]), pa.array(ids[c]), pa.array(part[r, c])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, ready = None, [], None
        for batch in batches:
            for dim, part in _by_dim(batch):
                keys = np.stack([part[c].to_numpy().astype(np.int64) for c in ("dim", "cell", "block", "q_block", "side")])
                ids, x = part["vec_id"].to_numpy(), _matrix(part["v"], dim)
                cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    if (name := tuple(keys[:4, a])) != now:
                        now, data, ready = name, [], None
                    if keys[4, a] == 0:
                        data.append((ids[a:b], x[a:b].copy()))
                    elif data:
                        if ready is None:
                            ready = tuple(map(np.concatenate, zip(*data)))
                        yield from join(ids[a:b], x[a:b], *ready)

    return run


def _least(k: int):
    """Of each cell of a partition, the k + 1 nearest ids and their distances."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in rows:
            names, ids, dists = b["dim"].to_numpy().astype(np.int64) << 32 | b["cell"].to_numpy(), b["vec_id"].to_numpy(), b["dist"].to_numpy()
            for c in np.unique(names):
                old, mine = held.get(c, (ids[:0], dists[:0])), names == c
                i, d = np.concatenate([old[0], ids[mine]]), np.concatenate([old[1], dists[mine]])
                order = np.argsort(d, kind="stable")
                once = order[np.sort(np.unique(i[order], return_index=True)[1])[: k + 1]]
                held[c] = i[once], d[once]
        for c, (i, d) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c >> 32] * len(d), pa.int32()), pa.array([c & 0xFFFFFFFF] * len(d), pa.int32()), pa.array(i), pa.array(d)], names=["dim", "cell", "vec_id", "dist"])

    return run


def _merge(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in rows:
            held = [np.concatenate([h, b[c].to_numpy()]) for h, c in zip(held, ("query_id", "vec_id", "score"))]
            if len(held[0]) > 400_000:
                keep = best(*held, k)
                held = [h[keep] for h in held]
                if len(held[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["query_id", "vec_id", "score"])
                    held = [np.zeros(0, np.int64)] * 3
        keep = best(*held, k)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]) for h in held], names=["query_id", "vec_id", "score"])

    return run


def _pivots(data: DataFrame, pivots: int | None) -> dict[int, tuple[np.ndarray, float]]:
    """For the most frequent lengths: lifted pivots, and the greatest squared norm of the length's rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").limit(PIVOT_LENGTHS).collect()
    out = {}
    for r in stats:
        if r["dim"] and r["top"] < _LARGE:
            most = pivots or min(MAX_PIVOTS, max(16, round(r["n"] ** 0.5 / 8)))
            p = np.array([x["v"] for x in data.filter(F.size("v") == r["dim"]).select("v").orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id", "v").limit(most).collect()])
            out[r["dim"]] = np.concatenate([p, np.sqrt(np.maximum(r["top"] - (p * p).sum(1), 0))[:, None]], axis=1), r["top"]
    return out


def _needed(placed: DataFrame, asked: DataFrame, pivots: dict[int, tuple[np.ndarray, float]], k: int) -> list[tuple[int, int, int, float]]:
    """(dim, q_cell, cell, least): the cells that a group of queries needs, and the least distance to their pivot from which on
    a candidate can matter to it. For lengths that have pivots."""
    own = F.col("dim").isin(list(pivots))
    single = placed.filter(own).select("dim", "cell", "vec_id", "dist").mapInArrow(_least(k), "dim int, cell int, vec_id long, dist double").groupBy("dim", "cell", "vec_id").agg(F.min("dist").alias("dist"))
    ranked = single.withColumn("r", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("dist", "vec_id"))).filter(F.col("r") <= k + 1)
    near: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for r in ranked.collect():
        near.setdefault((r["dim"], r["cell"]), []).append((r["dist"], r["vec_id"]))
    radius = {(r["dim"], r["cell"]): r["hi"] for r in placed.filter(own).groupBy("dim", "cell").agg(F.max("dist").alias("hi")).collect()}
    out = []
    for g in asked.filter(own).groupBy("dim", "cell").agg(F.max("dist").alias("hi")).collect():
        dim, i, wide = g["dim"], g["cell"], g["hi"]
        p, top = pivots[dim]
        between = np.sqrt(np.maximum(((p - p[i]) ** 2).sum(1), 0))
        of_id: dict[int, float] = {}
        for (d, j), ds in near.items():
            if d == dim:
                for dist, v in ds:
                    of_id[v] = min(of_id.get(v, float("inf")), wide + between[j] + dist)
        # One id may be the query's own, whose rows, however many, don't count.
        upper = sorted(of_id.values())
        bound = upper[k] + 1e-6 * (1 + top**0.5) if len(upper) > k else float("inf")
        out += [(dim, i, j, float(between[j] - wide - bound)) for (d, j), hi in radius.items() if d == dim and between[j] - wide - hi <= bound]
    return out


def _blocks(n: Column, size: Column | int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def top_k(queries: DataFrame, data: DataFrame, k: int = K, pivots: int | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, v), v whole numbers as doubles, a query's own id left out."""
    spark = data.sparkSession
    ship(spark)
    scratch = Scratch(spark, "top-k")
    at = _pivots(data, pivots)
    placed = scratch.save(data.select("vec_id", "v").mapInArrow(_assign(at, False), _PLACED).withColumn("row", F.monotonically_increasing_id()))
    asked = scratch.save(queries.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_assign(at, True), _PLACED))

    # Which cells each group of queries needs, and into how many blocks both sides of a cell are cut.
    by_bound = spark.createDataFrame(_needed(placed, asked, at, k), "dim int, q_cell int, cell int, least double")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    groups = asked.groupBy(F.col("dim").alias("g_dim"), F.col("cell").alias("q_cell")).agg(F.count("*").alias("n_asked"))
    plain = cells.filter(~F.col("dim").isin(list(at))).select("dim", F.lit(0).alias("q_cell"), "cell", F.lit(float("-inf")).alias("least"))
    needs = by_bound.unionByName(plain).join(groups, (F.col("dim") == F.col("g_dim")) & (by_bound["q_cell"] == groups["q_cell"])).select("dim", groups["q_cell"], "cell", "least", "n_asked")
    total = needs.groupBy(F.col("dim").alias("t_dim"), F.col("cell").alias("t_cell")).agg(F.sum("n_asked").alias("asked"), F.min("least").alias("least"))
    # Blocks grow with the cell, so that fewer copies are made, as far as a task's memory goes.
    size = F.greatest(F.lit(block), F.least(F.col("n") / 64, F.floor(F.lit(BLOCK_BYTES) / (8 * (F.col("dim") + 1)))))
    plan = scratch.save(cells.join(total, (F.col("dim") == F.col("t_dim")) & (F.col("cell") == F.col("t_cell"))).select("dim", "cell", "least", _blocks(F.col("n"), size).alias("blocks"), _blocks(F.col("asked"), query_block).alias("q_blocks")))
    wanted = scratch.save(needs.select(F.col("dim").alias("w_dim"), "q_cell", F.col("cell").alias("w_cell")).join(plan.drop("least"), (F.col("w_dim") == F.col("dim")) & (F.col("w_cell") == F.col("cell"))).select("w_dim", "q_cell", "w_cell", "blocks", "q_blocks"))

    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = broadcast_if_small(plan.withColumnsRenamed({"dim": "p_dim", "cell": "p_cell"}))
    candidates = placed.join(mine, (F.col("dim") == F.col("p_dim")) & (F.col("cell") == F.col("p_cell")) & (F.col("dist") >= F.col("least")))
    candidates = candidates.select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64(F.lit(6), "row"), F.col("blocks")).cast("int").alias("block"), each(F.col("q_blocks")).alias("q_block"), F.lit(0).alias("side"))
    asks = asked.join(broadcast_if_small(wanted), (F.col("dim") == F.col("w_dim")) & (F.col("cell") == F.col("q_cell")))
    asks = asks.select("vec_id", "v", "dim", F.col("w_cell").alias("cell"), each(F.col("blocks")).alias("block"), F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.col("q_blocks")).cast("int").alias("q_block"), F.lit(1).alias("side"))
    group = ["dim", "cell", "block", "q_block"]
    found = candidates.unionByName(asks).repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(_solve(k), _ROWS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.mapInArrow(_merge(k), _ROWS).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "top-k").save(quantized(table(spark, sf_dir, "embeddings")))
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
