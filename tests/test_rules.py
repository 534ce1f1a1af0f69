"""Rules on small inputs with results worked out by hand."""

from pyspark.sql import functions as F

from siftwell.functions import queries as Q
from siftwell.functions import structure as S
from siftwell.functions import text as T
from siftwell.operators import documents, evidence, retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_intents(spark):
    ask = lambda q: one(spark, Q.intent(F.col("q")), q=q)
    assert ask("How is LoRA better than retraining all the weights?") == "method"
    assert ask("What problem is LoRA trying to solve?") == "definition"
    assert ask("Nothing here") == "method"


def test_follow_ups(spark):
    ask = lambda q: one(spark, Q.is_follow_up(F.col("q")), q=q)
    assert ask("How does it work?") and ask("What about latency?") and ask("They did what exactly in the final set of all experiments")
    assert not ask("Which datasets are used for the evaluation of the model?") and not ask("  ")


def test_complexity(spark):
    q = "Compare LoRA and full fine-tuning, and explain why limitations, if any, affect reproducibility."
    assert one(spark, Q.complexity_label(Q.complexity_score(F.col("q"))), q=q) == "complex"


def test_section_names_and_headings(spark):
    assert one(spark, T.section_name(F.col("s")), s="Works Cited") == "references"
    assert one(spark, T.section_name(F.col("s")), s="Proposed_Method") == "proposed_method"
    assert one(spark, documents.heading(F.col("s")), s="3.1 Results") == "results"
    assert one(spark, documents.heading(F.col("s")), s="Model weights are shared") == "method"
    assert one(spark, documents.heading(F.col("s")), s="Weights are shared") is None


def test_rerank_and_confidence(spark):
    assert one(spark, S.rerank(F.col("s"), F.lit("evaluation"), F.lit("evaluation"), F.lit(0.5)), s=0.8) == 0.8
    assert one(spark, evidence.claim_confidence(F.col("s"), F.lit(0.6), F.lit(0.5), F.lit(1.0), F.lit(0.0)), s=0.7) == 0.7
    assert one(spark, evidence.reproducibility(F.lit(None).cast("boolean"), F.lit(0), F.col("m"), F.lit(0.25)), m=0.5) == 0.3375


def test_table_type_order(spark):
    assert one(spark, T.table_type(F.col("t")), t="Table 2: Ablation\nAccuracy") == "ablation"


def test_summary_keeps_whole_sentences(spark):
    assert one(spark, S.summary(F.col("t")), t="One is here. Two is there.") == "One is here. Two is there."
    long = "A" + "b" * 99 + ". " + "C" + "d" * 99 + ". " + "E" + "f" * 199 + "."
    assert one(spark, S.summary(F.col("t")), t=long) == long[:203] + "..."


def test_pending_units_are_lost_before_an_oversize_one():
    assert documents.pack_units([("short", 5), ("huge", 400)], 400, 50) == [("huge", 400)]
    assert documents.pack_units([("a", 300), ("b", 60), ("c", 100)], 400, 50) == [("a\nb", 360), ("b\nc", 160)]
    assert documents.pack_units([], 400, 50) == []


def test_scope_with_null_subsections(spark):
    rows = spark.createDataFrame([(1, "m", "a", [1.0, 0.0]), (2, "m", None, [0.0, 1.0]), (3, "m", "b", [1.0, 1.0])], "chunk_id long, section_name string, subsection_name string, embedding array<double>")
    got = retrieval.search(rows, F.array(F.lit(1.0), F.lit(0.0)), 5, subsections=["a", None]).collect()
    assert [r["chunk_id"] for r in got] == [1, 2]


def test_gate_keeps_all_when_none_passes(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0, False), (2, 0.8, 1.0, False)], "chunk_id long, score double, quality_score double, quality_pass boolean")
    assert retrieval.gate(rows).count() == 2


def test_similarity_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r["similarity"] for r in evidence.similarity(rows, "a", "b").collect()] == [0.75, 0.0]


def test_claims_meet_every_document(spark):
    import re

    from siftwell import lexicons as L

    words = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in L.STOPWORDS}
    claims = [(1, "Rank decomposition of weights"), (2, "weights weights matter"), (2, "other claim here"), (3, ""), (4, None), (None, "lost rank")]
    docs = [(i, "weights everywhere") for i in range(40, 50)] + [(200, "Rank of a matrix"), (987, "decomposition; weights, RANK"), (987, "matter"), (None, "claim"), (5, None), (6, "nothing shared")]
    want = [(i, d, round(len(words(c) & words(t)) / len(words(c)), 6)) for i, c in claims for d, t in docs if words(c) & words(t)]
    for hot, most in ((3, 200_000), (3, 2), (50_000, 200_000)):
        got = evidence.claim_overlaps(spark.createDataFrame(claims, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), hot, most)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_supporters_hold_their_share_of_a_claim(spark):
    import random
    import re

    from siftwell import lexicons as L

    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(12)]
    text = lambda most: " ".join(rng.choices(vocabulary, [40, 20, 10, *[2] * 9], k=rng.randint(0, most)))
    claims = [(i // 2, text(9)) for i in range(30)] + [(None, "w1 w5"), (3, None), (4, ""), (5, "the of"), (6, "unheard words only"), (6, "unheard w0")]
    docs = [(i // 2, text(14)) for i in range(60)] + [(None, "w1 w5 w5"), (7, None), (8, ""), (9, "w0 w1 w2"), (9, "w0 w1 w2"), (10, "w2 of W1; w0"), (11, "w4 " * 5000)]
    words = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in L.STOPWORDS}
    rows = [spark.createDataFrame([(*r, 1, "x") for r in part], f"{key} long, text string, n int, print string") for part, key in ((claims, "item_id"), (docs, "doc_id"))]
    for percent, hot, most in ((50, 50_000, 200_000), (40, 2, 3), (100, 50_000, 200_000)):
        want = [(i, d, round(len(words(c) & words(t)) / len(words(c)), 6)) for i, c in claims for d, t in docs if words(c) and 100 * len(words(c) & words(t)) >= percent * len(words(c))]
        got = evidence.claim_supporters(*rows, percent, hot, most)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert evidence.claim_supporters(rows[0].limit(0), rows[1]).count() == evidence.claim_supporters(rows[0], rows[1].limit(0)).count() == 0


def test_claim_query_leaves_out_no_document(spark):
    from siftwell.plans import catalog
    from tests.conftest import SF

    got = {(r["item_id"], r["doc_id"]): r["overlap"] for r in catalog.QUERIES["claim_overlap_all"](spark, SF).collect()}
    assert any(i % 40 != d % 40 for i, d in got)


def test_buckets_drop_repeated_summaries_only(spark):
    same = "A passage that many chunks of a paper open with, "
    rows = [(1, same + "first.", 0.9), (2, same + "second.", 0.8), (3, (same + "FIRST.").upper(), 0.7), (4, "   ", 0.9), (5, None, 0.9), *((10 + i, f"Number {i}.", 0.5 - i / 100) for i in range(9))]
    got = retrieval.buckets(spark.createDataFrame([(i, "methods", t, w, 0.5) for i, t, w in rows] + [(50, None, "no bucket", 1.0, 1.0)], "chunk_id long, bucket string, content string, importance double, role_confidence double"))
    assert sorted(r["chunk_id"] for r in got.collect()) == [1, 2, 10, 11, 12, 13]


def test_questions_grow_by_their_kind(spark):
    from siftwell.functions import queries

    asked = {"the  formula": "the formula | focus on equation; mathematical formulation; objective; notation", "a table": "a table | focus on caption; results; metrics", "what else": "what else", "": "", None: None}
    rows = spark.createDataFrame([(a,) for a in asked], "q string").select("q", queries.expanded_by_mode(F.col("q")).alias("e"))
    assert {r["q"]: r["e"] for r in rows.collect()} == asked
