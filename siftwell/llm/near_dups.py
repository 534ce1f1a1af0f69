"""Operator 3: near-duplicate documents by min-max hashing.

Every document is the set of its distinct word shingles. Under each of PERMUTATIONS random orders the signature keeps
both the least and the greatest shingle hash, so that one evaluation gives two values; bands of ROWS values, drawn from
different permutations, are the join keys. With 2 * PERMUTATIONS = 96 values in BANDS = 24 bands of 4, two sets of
Jaccard similarity 0.8 miss every band with a probability of about 3e-6. Candidates are confirmed on the full sets.

Documents of equal sets are one class from the start (groups of copies never pair). Links are only needed as far as they
connect, so that a bucket never emits its pairs: (1) each class is checked against the least class it shares a bucket with; (2) each
class in a bucket that still holds more than one component is checked against a pivot, the class of such a bucket with
the fewest shingles of its own; (3) what then still lies apart is joined on the rarest shingles, one pair between any two
components first, then all that are still needed: sets of n shingles that
reach p percent have one in common among their n - ceil(n * p / 100) + 1 rarest, so that this join is exact, and the many
loose copies of one text, whose rarest shingles are their own edits, meet hardly anything. The place of the first shingle in
common, or the number of own shingles, bounds a pair's similarity from above before it is checked. Every class that shares a bucket with a class of another component goes
through (3), so that no link between candidates is lost. Buckets are found with aggregates and skew-splittable joins,
never with windows or lists over a bucket.

Sets are of 64-bit hashes of shingles (two different ones among a thousand are taken for one with a chance of about 3e-14),
and their classes go by 128-bit digests.

Defined results: null, empty and wordless texts have an empty set, link with nothing and are their own component; rows
that repeat a doc_id are rows of their own (equal texts link, and a component's id is its least doc_id); a null doc_id
never becomes a component's id unless the component has no other (then null, and kept); other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, semi_join, ship, table
from .graph import components
from .token_output import slices

#: Words of a shingle; a contract may ask for another number.
SHINGLE = 5
MIN_PERCENT = 80
PERMUTATIONS, ROWS, BANDS = 48, 4, 24
KEPT = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (all words as one, if fewer; none without words)."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _scramble(out * _MIX[4] + h[i : i + n] * _MIX[i % 4] + np.uint64(i))
    return np.unique(out)


class Signer:
    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS, bands: int = BANDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
        # Value i of band j: consecutive minima first, then maxima, so that a band never holds both of a permutation.
        self.use = np.arange(rows * bands).reshape(bands, rows) % (2 * permutations)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        for i in range(0, len(shingles), 512):
            v = np.multiply.outer(self.a, shingles[i : i + 512])
            v += self.b[:, None]
            np.minimum(low, v.min(1), out=low)
            np.maximum(high, v.max(1), out=high)
        values = np.concatenate([low, high])[self.use]
        key = self.salt
        for i in range(values.shape[1]):
            key = _scramble(key * _MIX[0] + values[:, i])
        return key.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes | None:
    """A 128-bit name of a set: that any two of 10^12 sets share one has a chance of about 10^-15."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signatures(shingle: int, carried: list[str] = []):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for part in slices(batch, 2 << 20):
                sets = [shingle_set(t, shingle) for t in part["text"].to_pylist()]
                prints = [_digest(s) for s in sets]
                keys = [signer.bands(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(part[c] for c in carried)], names=["doc_id", "n_shingles", "print", "keys", *carried])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                sets = [shingle_set(t, shingle) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["print", "shingles"])

    return run


def signatures(docs: DataFrame, shingle: int = SHINGLE, carried: list[str] = []) -> DataFrame:
    """doc_id, n_shingles, print (128-bit digest of the set; null if empty), keys (one per band) of each row, and the carried
    columns (whole numbers)."""
    ship(docs.sparkSession)
    more = [F.col(c).cast("long").alias(c) for c in carried]
    schema = ", ".join(["doc_id long, n_shingles long, print binary, keys array<long>", *(f"`{c}` long" for c in carried)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(_signatures(shingle, carried), schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the percentage of similarity."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.filter(100 * F.col("n") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "c_node"), F.col("cls") == F.col("c_node"), "left").withColumn("comp", F.coalesce("least", "cls")).drop("c_node", "least")


def _apart(rows: DataFrame, comp: DataFrame, by: str = "cls") -> DataFrame:
    """The rows (cls, key) of buckets that hold more than one component, with comp and a pivot of the bucket: the class
    with the fewest shingles of its own (by u) or the least name."""
    labelled = _labelled(rows, comp)
    pivot = F.min(F.struct(F.col(by).alias("by"), *[c for c in ("cls", "n", "u", "comp") if c in labelled.columns])).alias("pivot")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"), pivot).filter("c_lo <> c_hi").select(F.col("key").alias("a_key"), "pivot")
    return labelled.join(mixed, F.col("key") == F.col("a_key")).drop("a_key")


def _can_link(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls) of the rows' classes, without those that have so many shingles in no other of them that they can't reach
    the wanted similarity with any."""
    own = sets.join(rows.select("cls").distinct(), "cls")
    once = own.select("cls", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("cls").alias("l_cls")).filter("c = 1")
    alone = once.groupBy("l_cls").agg(F.count("*").alias("u"))
    counted = own.select("cls", F.size("shingles").alias("n")).join(alone, F.col("cls") == F.col("l_cls"), "left")
    return counted.filter(100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n")).select("cls")


def _prefixes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls, n, u, prefix) of the rows' classes: n shingles, u of them in no other of these classes, and the rarest ones,
    so many that two sets of the wanted similarity have one of them in common."""
    shingles = sets.join(rows, "cls").select("cls", F.explode("shingles").alias("s"))
    common = shingles.groupBy("s").agg(F.count("*").alias("c")).withColumnRenamed("s", "c_s")
    by_class = shingles.join(common, F.col("s") == F.col("c_s")).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("r")).withColumn("n", F.size("r"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    return by_class.select("cls", "n", F.size(F.filter("r", lambda x: x["c"] == 1)).alias("u"), F.transform(F.slice("r", F.lit(1), length), lambda x: x["s"]).alias("prefix"))


def _bound(na: Column, ua: Column, nb: Column, ub: Column, percent: int) -> Column:
    """Whether sets of these sizes and numbers of shingles of their own can be similar enough: what they share is no more
    than what is not their own, and their union no less than the one and the other's own."""
    return (100 * (na - ua) >= percent * (na + ub)) & (100 * (nb - ub) >= percent * (nb + ua)) & (100 * na >= percent * nb) & (100 * nb >= percent * na)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = MIN_PERCENT, carried: list[str] = []) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. With carried columns also these and comp, the number of the
    component (null if the set is empty), which names components where ids are null or repeat.

    Wants 100 * intersection >= percent * union on sets of shingles of so many words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dups")
    signed = scratch.save(signatures(docs, shingle, carried).withColumn("row", F.monotonically_increasing_id()))
    # Rows of equal sets are one class, named by a row of its own, so that all that follows goes by a number.
    one = signed.filter("print is not null").groupBy("print").agg(F.min("row").alias("cls"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.save(one)
    rows = classes.select("cls", "n", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select(F.col("key").alias("s_key"), "lo")
    members = scratch.save(rows.join(shared, F.col("key") == F.col("s_key")).select("cls", "n", "key", "lo"))

    # One text for each class, by its least id; texts that only repeat an id drop out as their own digest isn't wanted.
    wanted = scratch.save(classes.select("cls", "print", "doc_id").join(members.select("cls").distinct(), "cls", "left_semi"))
    texts = semi_join(docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").cast("string").alias("text")), wanted.select("doc_id").distinct(), "t_id", "doc_id")
    made = texts.select("text").mapInArrow(_sets(shingle), "print binary, shingles array<long>")
    sets = scratch.save(made.join(wanted.select("cls", F.col("print").alias("w_print")), F.col("print") == F.col("w_print")).groupBy("cls").agg(F.first("shingles").alias("shingles")))

    first = members.filter("cls <> lo").groupBy("cls").agg(F.min("lo").alias("a")).select("a", F.col("cls").alias("b"))
    comp = components(verified(first, sets, percent), scratch)
    open_rows, n_open = scratch.save_counted(_apart(members, comp))
    if n_open:
        comp = _join_apart(open_rows, comp, sets, percent, scratch)
    of_class = classes.select("cls", "print", "doc_id").join(comp.withColumnRenamed("node", "c_node"), F.col("cls") == F.col("c_node"), "left").select("print", "doc_id", F.coalesce("least", "cls").alias("comp"))
    ids = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    more = [*carried, "comp"] if carried else []
    labels = of_class.select("print", "comp").join(ids, "comp").select(F.col("print").alias("l_print"), "component_id", *more[-1:])
    out = signed.select("doc_id", "n_shingles", "print", *carried).join(labels, F.col("print") == F.col("l_print"), "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *more)


def _join_apart(open_rows: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components with the links that are still missing between the classes of buckets that hold several components."""

    def linked(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        new, n = scratch.save_counted(verified(pairs, sets, percent))
        return components(new.unionByName(comp.select(F.col("node").alias("a"), F.col("least").alias("b"))), scratch) if n else comp

    able = scratch.save(_can_link(open_rows, sets, percent))
    ranked, n_ranked = scratch.save_counted(_prefixes(able, sets, percent))
    if not n_ranked:
        return comp
    near = open_rows.select("cls", "key").join(ranked.select(F.col("cls").alias("o_cls"), "n", "u"), F.col("cls") == F.col("o_cls")).drop("o_cls")
    rows = _apart(near, comp, "u").filter(F.col("comp") != F.col("pivot.comp")).filter(_bound(F.col("n"), F.col("u"), F.col("pivot.n"), F.col("pivot.u"), percent))
    comp = linked(rows.groupBy("cls").agg(F.min("pivot").alias("pivot")).select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b")).distinct(), comp)

    rows = _labelled(ranked, comp).select("cls", "n", "comp", F.posexplode("prefix").alias("at", "s"))
    mixed = rows.groupBy("s").agg(F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi")).filter("c_lo <> c_hi").select(F.col("s").alias("m_s"))
    rows, n_rows = scratch.save_counted(rows.join(mixed, F.col("s") == F.col("m_s"), "left_semi"))
    if not n_rows:
        return comp
    left = rows.select("s", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "at", "comp")])
    right = rows.select(F.col("s").alias("s_b"), *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "at", "comp")])
    # What stands before the first shingle in common isn't shared, and what stands from there on bounds what is. At later ones
    # the bound is too low, but a pair that reaches the bar gets through at its first.
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    close = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    joint = left.join(right, (F.col("s") == F.col("s_b")) & (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & close)
    apart, n_apart = scratch.save_counted(joint.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.max(most / (F.col("n_a") + F.col("n_b") - most)).alias("bound"), F.min("comp_a").alias("ca"), F.min("comp_b").alias("cb")))
    if not n_apart:
        return comp
    # Of the pairs between two components one link is enough: the most promising first, then those still needed.
    comp = linked(apart.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b"), comp)
    label = comp.withColumnRenamed("node", "c_node")
    still = apart.join(label, F.col("a") == F.col("c_node"), "left").select("a", "b", F.coalesce("least", "a").alias("ca"))
    return linked(still.join(label, F.col("b") == F.col("c_node"), "left").filter(F.col("ca") != F.coalesce("least", "b")).select("a", "b"), comp)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """docs with exactly one row of each component: the one with the least id (nulls last), then by a hash of the text, then
    by its place. Rows of an empty set all stay. docs is read twice and its rows must lie alike both times, as in a table
    that is stored."""
    place = "__row"
    named = docs.withColumn(place, F.monotonically_increasing_id())
    found = near_duplicates(named.withColumn("__hash", F.xxhash64("text")), shingle, percent, [place, "__hash"]).filter("comp is not null").select(place, "comp", F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "__hash", place).alias("by"))
    found = Scratch(docs.sparkSession, "one-of-each").save(found)
    first = found.groupBy("comp").agg(F.min("by").alias("by")).select(F.col(f"by.{place}").alias(place))
    gone = found.select(place).join(first, place, "left_anti")
    return named.join(gone, place, "left_anti").select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, MIN(reach.b)::BIGINT AS component_id, sets.doc_id = MIN(reach.b) AS kept
FROM sets JOIN reach ON sets.doc_id = reach.a GROUP BY sets.doc_id, s
"""
