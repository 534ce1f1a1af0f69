"""The store, re-indexing with failures kept apart, ingestion as a stream, chunks in true tokens."""

import random

import pytest
from pyspark.sql import functions as F
from tests.fixtures import PAGES

from siftwell.functions.tokens import TokenCounter
from siftwell.operators import documents, parsing, reindex
from siftwell.sources.store import Conflict, IndexStore
from siftwell.streaming.ingest import index_stream

BODY = "Abstract\nWe propose a novel update rule. It reduces the number of trained weights by a factor of ten thousand on all tasks we tried so far.\nMethod\nThe method freezes all weights and trains two small matrices whose product is added to them in each layer of the model.\n"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_commits_replace_and_remove_keys(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/s", buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "paper_id long, v string")
    with pytest.raises(KeyError):
        store.read("a")
    assert store.commit({"a": make([(i, "x") for i in range(20)] + [(None, "n")]), "b": make([(1, "b")])}, make([(i, "") for i in range(20)])) == 1
    folders = {b: ps for b, ps in store.manifest()["tables"]["a"]["buckets"].items()}
    store.commit({"a": make([(100, "new")])}, make([(100, "")]))
    # A new key rewrites nothing: the old folders are still named.
    assert all(p in store.manifest()["tables"]["a"]["buckets"][b] for b, ps in folders.items() for p in ps)
    store.commit({"a": make([(1, "y"), (1, "z"), (None, "m")])}, make([(1, ""), (2, ""), (None, "")]))
    want = [(i, "x") for i in (0, *range(3, 20))] + [(100, "new"), (1, "y"), (1, "z"), (None, "m")]
    assert rows_of(store.read("a"), "paper_id", "v") == sorted(want, key=repr) and store.read("b").count() == 0
    assert store.read("a", version=1).count() == 21
    store.reset(make([(3, ""), (100, "")]))
    assert store.read("a").count() == len(want) - 2
    store.reset_all()
    assert store.read("a").count() == 0 and store.read("a").columns == ["paper_id", "v"] and store.tables() == ["a", "b"]
    assert store.expire(keep=1) > 0 and store.versions() == [5] and store.read("a").count() == 0


def test_many_small_commits_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siftwell.sources.store.MOST_FOLDERS", 3)
    store = IndexStore(spark, f"{tmp_path}/s", buckets=1)
    for i in range(7):
        rows = spark.createDataFrame([(i,)], "paper_id long")
        store.commit({"a": rows}, rows)
        assert max(len(ps) for ps in store.manifest()["tables"]["a"]["buckets"].values()) <= 4
    assert rows_of(store.read("a"), "paper_id") == [(i,) for i in range(7)]


def test_a_failure_between_two_tables_is_not_seen_and_versions_are_taken_once(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/s")
    one = spark.createDataFrame([(1, "x")], "paper_id long, v string")
    store.commit({"a": one, "b": one}, one)
    broken = one.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.commit({"a": one.withColumn("v", F.lit("y")), "b": broken}, one)
    assert rows_of(store.read("a"), "v") == [("x",)] and rows_of(store.read("b"), "v") == [("x",)] and store.versions() == [1]
    store.commit({"a": one.withColumn("v", F.lit("y")), "b": one}, one)
    assert rows_of(store.read("a"), "v") == [("y",)]
    with pytest.raises(Conflict):
        store._publish("{}", "v0000000002.json")
    assert rows_of(store.read("a"), "v") == [("y",)]


class Picky:
    """Counts words; fails on one of them."""

    def __call__(self, text):
        if "poison" in text:
            raise ValueError("bad unit")
        return len(text.split())


def picky_vectors(texts):
    if any("unembeddable" in t for t in texts):
        raise RuntimeError("no vector")
    return [[float(len(t)), 1.0] for t in texts]


def test_a_failing_document_costs_only_itself(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/s", buckets=3)
    runs = iter(range(99))
    go = lambda rows, **k: reindex.reindex(store, spark.createDataFrame(rows, "paper_id long, text string"), f"{tmp_path}/{next(runs)}", count=Picky(), embed=picky_vectors, **k)
    docs = [(1, BODY), (2, BODY + "poison"), (3, BODY + "unembeddable"), (4, " \n"), (5, None), (None, BODY), (6, BODY), (6, BODY + "twice"), (None, "x")]
    assert go(docs) == {"succeeded": 2, "failed": 5, "unchanged": 0}
    assert rows_of(store.read("quarantine"), "paper_id", "step", "error") == sorted(
        [(2, "chunk", "ValueError: bad unit"), (3, "vector", "chunks: RuntimeError: no vector"), (4, "read", "no text"), (5, "read", "no text"), (None, "read", "no id")], key=repr
    )
    for t in ("sections", "subsections", "chunks", "domains"):
        assert {r["paper_id"] for r in store.read(t).select("paper_id").collect()} == {1, 6}
    assert all(len(r["embedding"]) == 2 for r in store.read("chunks").collect()) and store.read("chunks").count() >= 2
    # Again: nothing changed; then one document changes, one is mended, one is asked for, one isn't there.
    assert go(docs) == {"succeeded": 0, "failed": 0, "unchanged": 7} and store.versions() == [1]
    assert go([(1, BODY + "More words for it.\n"), (2, BODY), (3, BODY + "unembeddable"), (6, BODY + "twice")], retry=True)["failed"] == 1
    ok = {r["paper_id"] for r in store.read("documents").filter("status = 'indexed'").collect()}
    assert ok == {1, 2, 6} and {r["paper_id"] for r in store.read("quarantine").collect()} == {3, 4, 5, None}
    only = spark.createDataFrame([(1,), (77,)], "paper_id long")
    assert go([(1, BODY), (2, "Abstract\nOther")], only=only) == {"succeeded": 1, "failed": 1, "unchanged": 0}
    assert ("not found",) in rows_of(store.read("quarantine").filter("paper_id = 77"), "error")
    assert go([(8, BODY), (9, "poison")], rebuild=True) == {"succeeded": 1, "failed": 1, "unchanged": 0}
    assert {r["paper_id"] for r in store.read("documents").collect()} == {8, 9} and {r["paper_id"] for r in store.read("chunks").collect()} == {8}


def test_pages_bring_tables_and_vectors_into_the_index(spark, tmp_path):
    blocks = spark.createDataFrame([(9, p, i, t) for p, texts in PAGES for i, t in enumerate(texts)], "paper_id long, page_number int, block_index int, text string")
    docs = spark.createDataFrame([(9, None), (10, BODY)], "paper_id long, text string")
    store = IndexStore(spark, f"{tmp_path}/s")
    assert reindex.reindex(store, docs, f"{tmp_path}/w", blocks=blocks) == {"succeeded": 2, "failed": 0, "unchanged": 0}
    found = store.read("tables").collect()
    assert [r["paper_id"] for r in found] == [9] * len(found) and len(found) >= 1 and found[0]["table_label"] == "Table 1" and len(found[0]["embedding"]) == 64
    names = {r["section_name"] for r in store.read("sections").filter("paper_id = 9").collect()}
    assert {"abstract", "introduction", "method", "results", "references"} <= names
    row = store.read("documents").filter("paper_id = 9").first()
    assert row["n_tables"] == len(found) and row["n_sections"] == len(names) and row["n_raw_chunks"] >= row["n_chunks"] > 0
    assert reindex.reindex(store, docs, f"{tmp_path}/w2", blocks=blocks) == {"succeeded": 0, "failed": 0, "unchanged": 2}


def test_a_stream_gives_the_rows_of_one_run_after_a_restart(spark, tmp_path, monkeypatch):
    schema = "paper_id long, text string"
    store = IndexStore(spark, f"{tmp_path}/s")
    run = lambda: index_stream(spark, f"{tmp_path}/in", schema, store, f"{tmp_path}/w", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(1, BODY), (2, BODY)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    with monkeypatch.context() as m:  # the process ends after all tables are written, before they are seen
        m.setattr(IndexStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    assert store.versions() == []
    run()
    want = {t: store.read(t).count() for t in store.tables()}
    assert store.batch("ingest") == 0 and want["documents"] == 2
    # A batch that was committed runs again: its checkpoint's commit was lost.
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    run()
    assert store.versions() == [1] and {t: store.read(t).count() for t in store.tables()} == want
    spark.createDataFrame([(2, BODY + "More.\n"), (3, BODY)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r["paper_id"] for r in store.read("documents").collect()) == [1, 2, 3] and store.batch("ingest") == 1


# Chunks in true tokens


def plain_pack(units, most, overlap):
    out, held, size = [], [], 0

    def flush():
        nonlocal held, size
        out.append(("\n".join(u for u, _ in held), size))
        keep, kept = [], 0
        for u, n in reversed(held):
            if keep and kept + n > overlap:
                break
            keep.insert(0, (u, n))
            kept += n
        held, size = keep, kept

    for unit, n in units:
        if n >= most:
            out.append((unit, n))
            held, size = [], 0
            continue
        if held and size + n > most:
            flush()
        held.append((unit, n))
        size += n
    if held:
        flush()
    return out


def test_chunk_ends_by_search_are_those_of_a_plain_greedy_version():
    rng = random.Random(4)
    for _ in range(3000):
        most = rng.choice([3, 10, 40])
        units = [(f"u{i}", rng.choice([0, 1, 2, 5, 9, 10, 39, 50]) if rng.random() < 0.7 else rng.randrange(most + 2)) for i in range(rng.randrange(0, 25))]
        overlap = rng.choice([0, 1, 5, most])
        assert documents.pack_units(units, most, overlap) == plain_pack(units, most, overlap)


def test_chunks_count_the_tokens_of_a_given_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tests.conftest import SF
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    count = lambda u: len(library.encode(u, add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    segs = docs.select("doc_id", F.lit(0).alias("section_order"), F.lit("method").alias("section_name"), F.lit(None).cast("string").alias("subsection_name"), F.col("text").alias("content"))
    got = parsing.chunk_sections(segs, "doc_id", count=TokenCounter(path)).collect()
    want = []
    for r in docs.collect():
        units = [(u, count(u)) for u in parsing.merge_units(parsing.text_units((r["text"] or "").replace("\x00", "")))]
        want += [(r["doc_id"], i, c, n) for i, (c, n) in enumerate(plain_pack(units, 400, 50))]
    assert sorted((r["doc_id"], r["chunk_index"], r["content"], r["token_count"]) for r in got) == sorted(want)
