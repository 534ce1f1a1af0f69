"""A store of derived tables: versions that become visible as a whole, replacement and removal by key.

All tables of a commit are written beside those that readers see; then a manifest, which names the folders of every
table, takes its place by one rename that fails if the version is there already. Readers go by the latest manifest, so
that they see all tables of a run or none; what a broken run has written is named nowhere.

Rows are dealt to buckets by a hash of their key. A commit replaces the rows of its keys: buckets that hold any of them are
rewritten without them by an anti-join, others only get a folder more, so that new keys cost no rewriting; a bucket
of many folders is written anew. The driver sees folder names, bounded by buckets times folders a bucket. A key on very many rows is
split over files by the rebalancing of the write.

Defined results: a null key is a key; a table that a commit doesn't name only loses the rows of the commit's keys; reading a table that
was never written is an error, one that was emptied has its schema. Renames must be atomic where the store lies (HDFS,
local disks), as for Spark's own checkpoints.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a bucket after which it is written anew.
MOST_FOLDERS = 16


class Conflict(RuntimeError):
    """Another commit took the version."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of this machine only where all run on it and none is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-shared-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, key: str = "paper_id", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _publish(self, text: str, name: str) -> None:
        temp, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{name}")
        fs = temp.getFileSystem(self._conf)
        out = fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self._conf).rename(fs.makeQualified(temp), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(final):
                raise Conflict(name) from e
            raise

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The latest manifest, or that of a version; an empty one before the first commit."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "batches": {}, "tables": {}}
        path = self._path(f"manifests/v{found[-1] if version is None else version:010d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        text = self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        stream.close()
        return json.loads(bytes(text).decode())

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def batch(self, name: str) -> int:
        """The last batch of a stream that was committed; -1 before the first."""
        return self.manifest()["batches"].get(name, -1)

    def _rows(self, of: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(of["schema"])
        folders = [f"{self.root}/{p}" for b, ps in of["buckets"].items() if buckets is None or b in buckets for p in ps]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        of = self.manifest(version)["tables"]
        if table not in of:
            raise KeyError(table)
        return self._rows(of[table])

    # Commits

    def bucket(self) -> Column:
        """The bucket of a row, by its key."""
        return F.coalesce(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.withColumn("__bucket", self.bucket()).hint("rebalance", "__bucket").write.mode("append").partitionBy("__bucket").parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame] | Iterable[dict[str, DataFrame]], keys: DataFrame | None, batch: tuple[str, int] | None = None) -> int:
        """Replaces all rows of the keys by those given, in all tables at once; keys None: all rows. keys: a table with the key column,
        read several times, so a stored one. tables: by name, or parts that add up, with the same tables each; a part is written
        before the next one is asked for, so that what it was made from may go then. The number of the new version."""
        now = self.manifest()
        version, folder = now["version"] + 1, f"data/{now['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
        new = {"version": version, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {}), "tables": {}}
        gone = None if keys is None else keys.select(F.col(self.key).alias("gone_key")).distinct()
        parts = iter([tables] if isinstance(tables, dict) else tables)
        first = next(parts, {})
        olds, anews, schemas = {}, {}, {}
        for name in sorted({*now["tables"], *first}):
            olds[name] = old = {} if keys is None else now["tables"].get(name, {}).get("buckets", {})
            kept = now["tables"].get(name, {"schema": None})
            fresh = first.get(name)
            schemas[name] = fresh.schema.jsonValue() if fresh is not None else kept["schema"]
            anew = [b for b, ps in old.items() if len(ps) > MOST_FOLDERS]
            if any(old.values()):
                held = self._rows(kept).select(self.key)
                hit = held.join(gone, held[self.key].eqNullSafe(F.col("gone_key")), "left_semi").select(self.bucket().cast("string").alias("b")).distinct()
                anew = sorted({*anew, *(r["b"] for r in hit.collect())})
            anews[name] = anew
            rows = [] if fresh is None else [fresh]
            if anew:
                rest = self._rows(kept, anew)
                rows.append(rest.join(gone, rest[self.key].eqNullSafe(F.col("gone_key")), "left_anti"))
            if rows:
                both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1], allowMissingColumns=True)
                schemas[name] = both.schema.jsonValue()
                self._write(both, f"{folder}/{name}")
        for part in parts:
            for name, fresh in sorted(part.items()):
                # Columns and their types are those of the first part's rows, which may have had old ones beside them.
                self._write(fresh.unionByName(self._rows(now["tables"][name], []), allowMissingColumns=True) if anews[name] else fresh, f"{folder}/{name}")
        for name, old in olds.items():
            buckets = {b: ([] if b in anews[name] else list(ps)) for b, ps in old.items()}
            for b in (n.partition("=")[2] for n in self._names(f"{folder}/{name}") if n.startswith("__bucket=")):
                buckets.setdefault(b, []).append(f"{folder}/{name}/__bucket={b}")
            new["tables"][name] = {"schema": schemas[name], "buckets": {b: ps for b, ps in buckets.items() if ps}}
        self._publish(json.dumps(new), f"v{version:010d}.json")
        return version

    def reset(self, keys: DataFrame) -> int:
        """Removes the rows of the keys from all tables."""
        return self.commit({}, keys)

    def reset_all(self) -> int:
        """Empties all tables; their schemas stay."""
        return self.commit({}, None)

    def expire(self, keep: int = 2) -> int:
        """Removes the manifests before the last ``keep`` and the runs' folders that no manifest left names; how many of these. Not while
        a commit is under way."""
        found = self.versions()
        last = found[-keep:]
        named = {p.split("/")[1] for v in last for t in self.manifest(v)["tables"].values() for ps in t["buckets"].values() for p in ps}
        fs = self._path().getFileSystem(self._conf)
        for v in found[:-keep]:
            fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        old = [n for n in self._names("data") if n not in named]
        for n in old:
            fs.delete(self._path(f"data/{n}"), True)
        return len(old)
