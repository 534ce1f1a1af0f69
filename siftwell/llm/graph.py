"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the node, with no list of neighbours ever gathered: the centre of a hot
star is a skewed join key, which adaptive execution splits, and its minimum is aggregated map-side. Rounds are written to
scratch tables and older ones dropped; the rounds needed grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with m: the least of x and all its y."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("mx"), F.least("x", "m").alias("m"))
    return pairs.join(least, F.col("x") == F.col("mx")).drop("mx")


def _round(edges: DataFrame) -> DataFrame:
    """edges (u, v), v < u, to edges that bring nodes nearer to their component's least node."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    large = _least(both).filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
    small = _least(large)
    out = small.filter("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, least) for every node of an edge but the least of each component. Nodes are of any orderable type."""
    now, mark = None, None
    step = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    while True:
        # The state of a round is seen as it is written: its number of edges and the sum of their hashes.
        seen = Observation()
        last, now = now, scratch.save(step.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        if last is not None:
            scratch.drop(last)
        state = (seen.get["n"], seen.get["h"])
        if state[0] == 0 or state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        mark, step = state, _round(now)
