"""Each stage of the pipeline against a plain version, on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_llm import DOCS, ODD, check_packing, plain_components, plain_secrets, plain_shingles

from siftwell.llm import packing, quality


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    # 1: documents go by the classifier's word; clean labelled ones stay.
    assert set(kept[0]) <= set(given)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good - {r[0] for r in kept[0]}) <= 0.05 * len(good)
    # 2: one of each group stays.
    sets = {r[0]: plain_shingles(r[1], 5) for r in kept[0]}
    names = list(sets)
    links = [(a, b) for i, a in enumerate(names) for b in names[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = plain_components(names, links)
    assert {r[0] for r in kept[1]} == {i for i in names if comp[i] == i}
    # 3: nothing goes, spans are masked.
    assert {r[0] for r in kept[2]} == {r[0] for r in kept[1]}
    before = {r[0]: r[1] for r in kept[1]}
    for r in kept[2]:
        assert (r[1] == before[r[0]]) == (not plain_secrets(before[r[0]])) and not plain_secrets(r[1])
    # 4: copies of what was there, three at most.
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 3
    # 5: every copy is packed.
    check_packing(kept[3], [r for r in docs.collect()], packing.CAPACITY)


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    docs.collect()
    nothing = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_near_duplicates_go_by_row(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdef"]
    rows = [(None, long[0]), (None, long[0]), (None, long[0] + " more"), (3, long[1]), (3, long[1]), (1, long[2]), (4, long[2]), (4, long[3]), (None, long[4]), (9, long[4] + " x"), (None, ""), (None, None), (7, " "), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3).cache()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    lost = [r for r in got if r[0] is None and r[1] and r[1].startswith("a0 ")]
    assert len(lost) == 1 and lost[0] in rows
    rest = [(3, long[1]), (1, long[2]), (4, long[3]), (9, long[4] + " x"), (None, ""), (None, None), (7, " "), (7, " ")]
    assert Counter(got) == Counter(lost + rest)


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).filter(F.col("bin_id").isNotNull()).count() > 0
