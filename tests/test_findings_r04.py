"""Each finding of round 4, with what failed before."""

import time
from pathlib import Path

from pyspark.sql import functions as F
from tests.test_reindex import BODY, rows_of

from siftwell.operators import indexing, reindex
from siftwell.sources.store import IndexStore

SCHEMA = "paper_id long, text string"
DOCS = [(i, f"{BODY}Results\nWe show that update {i} improves accuracy by {i} % over the baseline of the first table.\n") for i in range(24)] + [(None, BODY), (90, " "), (91, None), (3, "Abstract\nAnother text of a key that is there.")]


def tables_of(store):
    return {t: rows_of(df := store.read(t), *df.columns) for t in store.tables()}


def staged(folder):
    return sorted(p.relative_to(folder).parts[0] for p in Path(folder).rglob("*.parquet"))


def test_staged_tables_go_as_a_slice_is_written_and_slices_change_no_row(spark, tmp_path, monkeypatch):
    """reindexed_documents: all forms of all texts stayed staged beside the store, until after the run."""
    seen, publish = [], IndexStore._publish
    monkeypatch.setattr(IndexStore, "_publish", lambda self, *a: (seen.append(staged(f"{tmp_path}/{where}")), publish(self, *a)))
    stores = []
    monkeypatch.setattr(reindex, "MOST_SLICES", 2, raising=False)
    for where, size in (("one", 1 << 28), ("two", 600)):
        monkeypatch.setattr(reindex, "SLICE_BYTES", size, raising=False)
        store = IndexStore(spark, f"{tmp_path}/{where}-store", buckets=8)
        go = lambda rows: reindex.reindex(store, spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/{where}")  # noqa: E731, B023
        stores.append([go(DOCS), tables_of(store), go([(1, BODY + "More words for it.\n"), (90, BODY), *DOCS[2:9]]), tables_of(store)])
        assert staged(f"{tmp_path}/{where}") == []
    assert stores[0] == stores[1] and stores[0][0] == {"succeeded": 24, "failed": 3, "unchanged": 0}
    # Where the version becomes visible, only keys are left: no text, segment or chunk.
    assert len(seen) == 4 and all(set(x) <= {"given", "taken"} for x in seen)


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    """reindexed_documents: shuffled texts stayed on disk until the driver collected its garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in (p.rpartition("/")[2] for p in blocks.getAllFiles().mkString("\n").split("\n")) if x.startswith("shuffle_")}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        before = shuffled()
        reindex.reindex(IndexStore(spark, f"{tmp_path}/s"), spark.createDataFrame(DOCS, SCHEMA), f"{tmp_path}/w")
        until = time.time() + 20
        while (left := shuffled() - before) and time.time() < until:
            time.sleep(0.2)
        assert not left
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    with indexing.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == was


def test_a_second_run_shuffles_no_text(spark, tmp_path):
    """reindexed_documents: to find that nothing changed, all texts were shuffled and staged once more."""
    store = IndexStore(spark, f"{tmp_path}/s")
    docs = spark.createDataFrame(DOCS, SCHEMA)
    reindex.reindex(store, docs, f"{tmp_path}/one")
    made, keep = {}, indexing.stored
    reindex.stored = lambda rows, path: made.setdefault(path.rpartition("/")[2], keep(rows, path))
    try:
        assert reindex.reindex(store, docs, f"{tmp_path}/two")["unchanged"] == 27
    finally:
        reindex.stored = keep
    assert set(made) == {"given", "taken"} and all("text" not in df.columns for df in made.values())


def test_a_commit_in_parts_is_one_commit(spark, tmp_path):
    """reindexed_documents: parts add up to one version, beside rows that stay and with columns that come and go."""
    one = lambda rows: spark.createDataFrame(rows, "paper_id long, v int, old string")
    new = lambda rows: spark.createDataFrame(rows, "paper_id long, v long, new string")
    old, fresh = [(i, i, "o") for i in range(40)], [(i, 100 + i, "n") for i in range(0, 60, 3)]
    keys = new(fresh).select("paper_id").unionByName(one([(1, 0, "")]).select("paper_id"))
    found = []
    for n in (0, 1, 4):
        store = IndexStore(spark, f"{tmp_path}/s{n}", buckets=8)
        store.commit({"a": one(old), "b": one(old)}, one(old).select("paper_id"))
        rows = new(fresh)
        parts = {"a": rows} if not n else ({"a": rows.filter(F.pmod(store.bucket(), F.lit(n)) == i)} for i in range(n))
        assert store.commit(parts, keys) == 2
        found.append((store.read("a").dtypes, rows_of(store.read("a"), "paper_id", "v", "old", "new"), store.read("b").dtypes, rows_of(store.read("b"), "paper_id", "v", "old")))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 20 + 40 - 14 - 1
