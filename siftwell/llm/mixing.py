"""Operator 1: mixing sources to target weights, with DataFrame functions only.

Words are aggregated per source, the repetition rate of a source is its target over its size, and each document is
emitted floor(rate) times plus one further copy that a hash-seeded Bernoulli draw grants with the fraction as its
probability. The only wide step over documents carries (id, source, size), never texts; texts meet their rate through
a per-source table that is broadcast after its row count was checked, and through a skew-splittable join otherwise. The
per-source table itself may be of any length: sources are numbered by range partitions and counts of these, and the targets'
level is found by a few aggregations, so that no window spans all sources.

Defined results: a null or blank text has size 0 and is never counted; null is a source of its own and comes last; a
source of size 0 has target 0 and rate 0; an empty table gives an empty result; repeated rows of one doc_id draw alike;
a null doc_id draws by the text's digest; other columns pass through ``mix`` untouched, but for one called ``copy``, which
gives way to the copy's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, broadcast_if_small, join_small, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources (source, ...) with ``turn``: the place of each in code-point order from 0, null last."""
    order = F.col("source").asc_nulls_last()
    dealt = scratch.save(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    per = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = per.select(F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("local", local).join(F.broadcast(before), F.col("part") == F.col("b_part")).withColumn("turn", F.col("before") + F.col("local")).drop("part", "b_part", "before", "local")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in code-point order, null last, take the weights in turn. Targets share the total by weight, but stop at
    max_repeats times the source's size; the excess goes to the others by weight until none is above. That is a water
    level: (total - what the capped take) / (weights of the others), raised until it caps no more of them.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = scratch.save(ranked(by_source, scratch).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).drop("turn"))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("w")
        now = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if now[0] == capped or not now[2]:
            break
        capped, level = now[0], (total - now[1]) / now[2]
    return rows.select("source", "source_size", F.round(F.least(F.col("cap"), F.lit(level) * F.col("w")), 6).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the seed and the document fix."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(size: Column, target: Column, source_size: Column, u: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies. Texts are scanned once; sizes are kept in a table."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u")))
    targets = scratch.save(source_targets(sizes, weights, max_repeats))
    return join_small(sizes, targets, "source").select("doc_id", "source", "size", "source_size", "target", copies(F.col("size"), F.col("target"), F.col("source_size"), F.col("u")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of docs as often as its rate and draw say, with all its columns and ``copy`` from 1."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("copy")
    source, rate, n = (next(f"{name}{i}" for i in range(len(docs.columns) + 1) if f"{name}{i}" not in docs.columns) for name in ("source of rate ", "rate ", "copies "))
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = scratch.save(source_targets(sizes, weights, max_repeats).select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate)))
    rated = docs.join(broadcast_if_small(targets), docs["source"].eqNullSafe(targets[source]))
    more = F.when(draw(docs["doc_id"], docs["text"], seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    return rated.withColumn(n, (F.floor(rate) + more).cast("int")).filter(F.col(n) > 0).select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, md5(COALESCE(text, '')))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents),
ranked AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM ranked),
sums AS (
  SELECT *, (SUM(source_size) OVER ())::DOUBLE AS total, SUM(w) OVER () AS w_all,
         COALESCE(SUM(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         COALESCE(SUM(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS w_before
  FROM weighed),
levels AS (SELECT *, (total - cap_before) / (w_all - w_before) AS level FROM sums),
water AS (SELECT arg_min(level, (cap / w, turn)) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT l.source, l.source_size, ROUND(LEAST(l.cap, COALESCE(water.level * l.w, l.cap)), 6) AS target FROM levels l LEFT JOIN water ON TRUE),
rated AS (
  SELECT s.doc_id, s.size, s.u, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (FLOOR(rate) + CASE WHEN u < rate - FLOOR(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM counted
"""
