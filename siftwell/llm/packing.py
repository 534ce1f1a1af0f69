"""Operator 8: conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words; a full piece is a bin of its own, the rest are items. Items
are dealt by a hash of the document and its copy number to shards of a bounded expected size, and each shard is packed on
its own, largest item first. In a shard, open bins are ordered by residual capacity and carry two bitmaps: the sources and the duplicate
clusters they hold. The search starts at the smallest residual that takes the item and goes on to the successor until
the tightest compatible bin is found, that is, one that shares neither a source nor a cluster with the item.

A shard's work is bounded by its expected number of items, whatever the corpus; a hot source, a large group of copies or an
id on very many rows is spread over all shards and only opens more bins. No text is shuffled. Copy numbers are counted within
partitions, with offsets from counts per id and partition, so that no window gathers the rows of an id.

Defined results: a null or blank text has size 0 and one piece of size 0 in the bin of the tightest fit; a null source
is a source of its own; a null cluster conflicts with nothing; rows repeated with the same doc_id are told apart by
``copy`` (from 1); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .mixing import word_count

CAPACITY = 2048
SHARD_ITEMS = 2048
SCHEMA = "doc_id long, copy int, piece int, bin_id long, size long, bin_start long, n_in_bin int, residual long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each item (size, source bit mask, cluster bit mask), in the order given.

    Bins of the same residual and the same source bitmap share a group, so that the successor search steps over groups
    that the source rules out as a whole, and looks at single bins only for cluster conflicts.
    """
    residuals: list[int] = []
    open_bins: dict[int, dict[int, list[int]]] = {}
    clusters: list[int] = []
    placed = []
    for size, source, cluster in items:
        found = None
        for k in range(bisect_left(residuals, size), len(residuals)):
            room = residuals[k]
            for held, bins in open_bins[room].items():
                if held & source:
                    continue
                at = next((i for i, b in enumerate(bins) if not clusters[b] & cluster), None)
                if at is not None and (found is None or bins[at] < found[3][found[2]]):
                    found = (room, held, at, bins)
            if found:
                break
        if found:
            room, held, at, bins = found
            b = bins.pop(at)
            if not bins:
                del open_bins[room][held]
                if not open_bins[room]:
                    del open_bins[room]
                    residuals.pop(bisect_left(residuals, room))
        else:
            b, room, held = len(clusters), capacity, 0
            clusters.append(0)
        placed.append((b, capacity - room))
        clusters[b] |= cluster
        left, now = room - size, held | source
        if left not in open_bins:
            insort(residuals, left)
            open_bins[left] = {}
        insort(open_bins[left].setdefault(now, []), b)
    return placed


def _pack(capacity: int, shards: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # Nulls would turn ids into doubles: they come as 0 with a mark.
        rows = rows.sort_values(["no_id", "doc_id", "copy"], kind="stable").reset_index(drop=True)
        sources = {s: 1 << i for i, s in enumerate(sorted(rows["source"].dropna().unique()))}
        none = 1 << len(sources)
        repeated = rows["cluster"].value_counts()
        masks = {c: 1 << i for i, c in enumerate(sorted(repeated[repeated > 1].index))}
        full, items = [], []
        for r in rows.itertuples():
            whole, rest = divmod(int(r.size), capacity)
            full += [(r.Index, r.copy, p) for p in range(whole)]
            if rest or not whole:
                items.append((rest, sources.get(r.source, none), masks.get(r.cluster, 0), r.Index, r.copy, whole))
        items.sort(key=lambda x: -x[0])
        bins = best_fit([x[:3] for x in items], capacity)
        out = [(i, c, p, b, s, at) for (s, _, _, i, c, p), (b, at) in zip(items, bins)]
        first = max((b for b, _ in bins), default=-1) + 1
        out += [(i, c, p, first + k, capacity, 0) for k, (i, c, p) in enumerate(full)]
        out = pd.DataFrame(out, columns=["row", "copy", "piece", "bin_id", "size", "bin_start"])
        by = out.groupby("bin_id")["size"]
        out["n_in_bin"], out["residual"] = by.transform("count"), capacity - by.transform("sum")
        out["bin_id"] = out["bin_id"] * shards + int(rows["shard"].iloc[0])
        at = out["row"].to_numpy()
        out["doc_id"] = pd.arrays.IntegerArray(rows["doc_id"].to_numpy(np.int64)[at], rows["no_id"].to_numpy(bool)[at])
        return out[[c.split()[0] for c in SCHEMA.split(", ")]]

    return pack


def numbered(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items (doc_id, row, ...) with ``copy``: 1, or the place among the rows of the same doc_id. items is a stored table."""
    here = items.withColumn("part", F.shiftright("row", 33))  # the partition that monotonically_increasing_id names
    per = here.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("part")
    counted = per.withColumn("before", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    repeated, n = scratch.save_counted(counted.filter("all > 1").select(F.col("doc_id").alias("r_id"), F.col("part").alias("r_part"), "before"))
    if not n:
        return items.withColumn("copy", F.lit(1))
    found = here.join(repeated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("part") == F.col("r_part")), "left")
    within = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("row"))
    return found.filter("before is null").withColumn("copy", F.lit(1)).unionByName(found.filter("before is not null").withColumn("copy", (F.col("before") + within).cast("int"))).select(*items.columns, "copy")


def pack(docs: DataFrame, size: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece: doc_id, copy, piece, bin_id, size, bin_start, n_in_bin, residual.

    size: words of the text unless given. cluster: a digest of the text unless given, so that equal texts conflict.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack")
    size = word_count(F.col("text")) if size is None else size
    cluster = F.md5("text") if cluster is None else cluster.cast("string")
    items, n = scratch.save_counted(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.cast("long").alias("size"), cluster.alias("cluster"), F.monotonically_increasing_id().alias("row")))
    shards = max(1, -(-n // shard_items))
    shard = F.pmod(F.xxhash64(F.lit(8), F.coalesce(F.col("doc_id").cast("string"), F.col("cluster")), "copy"), F.lit(shards))
    dealt = numbered(items, scratch).drop("row").withColumn("shard", shard).withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity, shards), SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
