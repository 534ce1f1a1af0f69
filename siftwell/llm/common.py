"""Helpers that the training-data operators share: reading tables, scratch tables, size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: ASCII white space as the contracts define it; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A table may be broadcast if it has at most this many rows (each a few short columns).
BROADCAST_ROWS = 50_000
_shipped: set[int] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't see it on their path."""
    sc = spark.sparkContext
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in seen or id(sc) in _shipped:
        return
    _shipped.add(id(sc))
    path = Path(tempfile.mkdtemp(prefix="siftwell-")) / "siftwell.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "siftwell").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run on
    this machine. On a cluster without one, scratch tables would be torn apart over local disks: an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-shared-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """Tables of one run, written to a folder of their own under the shared root; they cut lineage, survive a lost
    executor, and can be dropped once nothing reads them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/siftwell/{what}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def save_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The saved table and its number of rows, counted as it is written."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        path = self.paths.get(id(df))
        if path:
            self._delete(path)

    def drop_all(self) -> None:
        """Removes all tables of the run; for those that nothing reads any more."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if a count shows at most so many rows; its columns must be of a bounded width."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Null-safe join with a table that is expected to be small: broadcast if a count shows that it is, else shuffled."""
    key = small.withColumnRenamed(on, "__key")
    if key.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        key = F.broadcast(key)
    return big.join(key, big[on].eqNullSafe(key["__key"]), how).drop("__key")


def semi_join(big: DataFrame, ids: DataFrame, left: str, right: str, most: int = 2 * BROADCAST_ROWS) -> DataFrame:
    """The rows of big whose column is among the ids (one number each), null-safe: ids are broadcast if a count shows that
    they are few, so that the rows stay where they are, else both sides are shuffled."""
    key = ids.select(F.col(right).alias("__key"))
    if key.limit(most + 1).count() <= most:
        key = F.broadcast(key)
    return big.join(key, big[left].eqNullSafe(key["__key"]), "left_semi")
