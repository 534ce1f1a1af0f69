"""Tests for the findings of round 3; each would have failed before."""

from pyspark.sql import functions as F

from siftwell.functions import gates as G
from siftwell.functions import structure as S
from siftwell.functions import text as T
from siftwell.operators import claims, retrieval
from siftwell.plans import sql as X

_SUMMARY = "Des ßßver das enüungsch auen äbe enungungä erlichach...."


def test_verbs_of_the_gate_end_where_those_of_its_sql_do(spark, duck):
    """candidate_scores: "äbe" holds the verb "be", as words are of ASCII in the SQL."""
    rows = [(_SUMMARY, "method", 0.9), ("Des ßßver das enüungsch auen xbe enungungä erlichach....", "method", 0.9)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, role string, sure double").select(G.quality_chunk(F.col("s"), F.col("role"), F.col("sure"))).collect()]
    want = [duck.execute(f"SELECT {X.quality_chunk('$s', '$role', '$sure')}", {"s": s, "role": role, "sure": sure}).fetchone()[0] for s, role, sure in rows]
    assert got == want == [True, False]


def test_structural_words_end_where_those_of_the_sql_do(spark):
    """relevant_chunks: "ñif" and "tableß" count; "ñif" is no word of Java's."""
    rows = spark.createDataFrame([("ñif",), ("tableß",), ("xif",)], "t string")
    assert [r[0] for r in rows.select(claims.structural_score(F.col("t"))).collect()] == [2, 2, 0]


def test_rank_scores_round_as_their_sql_does(spark, duck):
    """retrieve_chunks, retrieve_formulas: halves of the last place go by the binary value."""
    rows = [(0.22322, "theory", 0.4837, 1.0), (-0.06586, "theory", 0.5114, 0.8)]
    want = [duck.execute("SELECT round(0.5::DOUBLE * ?::DOUBLE + 0.3::DOUBLE * 0.0::DOUBLE + 0.2::DOUBLE * ?::DOUBLE + 0.18::DOUBLE * ?::DOUBLE, 4)", [s, i, b]).fetchone()[0] for s, _, i, b in rows]
    texts = ["é objective", ""]
    made = spark.createDataFrame([(s, role, i, t) for (s, role, i, _), t in zip(rows, texts)], "score double, role string, importance double, content string")
    got = [r["rerank_score"] for r in retrieval.rerank(made, "method", True).collect()]
    assert got == want == [0.3883, 0.2134]
    plain = spark.range(400).select((F.col("id") / 100000 - 0.00201).alias("x"))
    for x, y in plain.select("x", T.nearest(F.col("x"), 4)).collect():
        assert y == duck.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0]
    score = S.rerank(F.col("score"), F.lit("method"), F.col("role"), F.col("importance"))
    assert made.select(score).first()[0] == duck.execute("SELECT round(0.5::DOUBLE * 0.22322::DOUBLE + 0.2::DOUBLE * 0.4837::DOUBLE, 4)").fetchone()[0]


def test_formula_letters_end_where_those_of_the_sql_do(spark, duck):
    """retrieve_formulas: "äh" holds the letter h."""
    rows = [("äh",), ("xh",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.formula_candidate_bonus(F.lit("theory"), F.col("t"))).collect()]
    want = [duck.execute(f"SELECT {X.formula_bonus(X.q('theory'), '$t')}", {"t": t}).fetchone()[0] for (t,) in rows]
    assert got == want == [1.0, 0.8]


def test_batches_are_taken_apart_in_bounded_pieces():
    """chunk_tokens, chunk_pack: Python holds what it makes of so many bytes of text, not of a whole batch."""
    import pyarrow as pa

    from siftwell.functions.batches import slices

    sizes = [10, None, 500, 500, 5000, 0, 900, 200]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "n": pa.array(sizes, pa.int32())})
    got = [p.column("i").to_pylist() for p in slices(batch, "n", 1000)]
    assert got == [[0, 1, 2], [3], [4], [5, 6], [7]]
    assert list(slices(batch.slice(0, 0), "n")) == []


def test_chunks_leave_tasks_piece_by_piece(spark, monkeypatch):
    """chunk_tokens, chunk_pack: one batch of texts comes out as several, with all rows, null keys and names kept."""
    from pyspark.sql import DataFrame

    from siftwell.operators import documents, parsing

    seen, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: (seen.append((f, self)), real(self, f, *a, **k))[1])
    text = "One sentence stands here. " * 40
    rows = [(i if i % 7 else None, 0, "method" if i % 2 else None, None, text if i % 5 else None) for i in range(3000)]
    segs = spark.createDataFrame(rows, "k long, section_order int, section_name string, subsection_name string, content string").coalesce(1)
    chunks = parsing.chunk_sections(segs, "k", 50, 5)
    packed = documents.pack_chunks(segs, "k", "content", 50, 5)
    assert chunks.count() == packed.count() > 2400
    assert {(r["k"] is None, r["section_name"]) for r in chunks.select("k", "section_name").distinct().collect()} == {(a, b) for a in (True, False) for b in ("method", None)}
    for f, given in seen:
        parts = list(f(iter(given.toArrow().combine_chunks().to_batches())))
        assert len(parts) > 1 and max(p.nbytes for p in parts) < 8 << 20


def test_equations_of_chunks_are_those_of_the_plain_patterns(spark, duck):
    """chunk_equations: the linear pattern finds what the plain one does, and long runs of letters don't hold it up."""
    import random
    import time

    from siftwell import lexicons as L
    from siftwell.operators import equations
    from siftwell.plans import catalog, records  # noqa: F401

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "B", "b7", "(", ")", " ", "  ", "\n", "=", " = ", "-", ".", ";", "x'", "word", "é", "O("]) for _ in range(r.randint(0, 120))) for _ in range(1500)]
    texts += ["x = " + "a" * 200 + " = bcdefgh and more", "f(x) y = 123456", "(a b) = 1234567", "foo f(x) = abcdef = ghijklm", "= 1234567", "a=b=c=d=efghijk", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["m"], x["n"]) for x in docs.select("doc_id", equations.chunk_equations(F.col("text")).alias("e")).select("doc_id", F.md5(F.array_join("e", "|")).alias("m"), F.size("e").alias("n")).collect()}
    con = duck.cursor()
    con.register("given", docs.toPandas())
    sql = catalog.SQL["chunk_equations"].replace("FROM documents", "FROM given")
    assert got == {d: (m, n) for d, m, n in con.execute(sql).fetchall()}
    assert L.CHUNK_EQUATIONS[0].startswith("[A-Za-z0-9")
    began = time.time()
    spark.createDataFrame([("a" * 20_000,)], "t string").select(F.size(equations.chunk_equations(F.col("t")))).collect()
    assert time.time() - began < 20


def test_chunks_are_dealt_by_paper_before_they_are_annotated(spark):
    """discussion_fallback: roles and summaries are found after the one exchange by paper, not in the tasks that read the few files with the chunks."""
    from pyspark.sql import Window

    from siftwell.plans import catalog
    from tests.conftest import SF

    rows = catalog._annotated(spark, SF).select("paper_id", "chunk_id", "role", "summary")
    plan = rows.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_id")))._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange hashpartitioning(paper_id")
    assert "f_parts" in before and "f_parts" not in after and "Exchange hashpartitioning(paper_id" not in after


_BITS = ["EQUATION:", "equation:  ", "table:", "Table 1", "Figure", "MS rate", "xms rate", "1/2 x", "X n +", "SubSampling", "=", "= ", "O(", "o(", r"\frac", "[", "{", ")", "\x00", "\t", "  ", "\n", "\x0b", "é", "İ", "K", "ß", "Theorem", "lemma", "5 %", "x5%", "3.2", ":", ". A", ".  b", "word", "wort ", "Ours 4.2\n", "WER"]


def random_texts(n, seed, bits=_BITS):
    import random

    r = random.Random(seed)
    return ["".join(r.choice([b, b, "a ", " "]) for b in r.choices(bits, k=r.randint(0, 30))) + r.choice(["", "", "x" * r.choice([49, 50, 79, 80])]) for _ in range(n)] + ["", None]


def test_what_is_looked_for_first_changes_no_result(spark, monkeypatch):
    """reindexed_documents: patterns that are only tried where they can match give what they give everywhere."""
    from siftwell import lexicons as L
    from siftwell.operators import annotate, documents, parsing

    t, low = F.col("t"), F.lower("t")
    count = lambda w: ((F.length("t") - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("int")
    fragment, prefix = F.lit(False), F.lit(False)
    for p in L.BANNED_FRAGMENTS:
        fragment = fragment | t.rlike(T.ascii_edges("(?i)" + p))
    for p in L.BANNED_STARTS:
        prefix = prefix | F.lower(F.trim("t")).startswith(p)
    markers = T.matches(low, T.ascii_edges(r"\[equation\]|=|o\(|\\[a-z]+|\bfrac\b"))
    brackets = F.length("t") - F.length(F.translate("t", "()[]{}", ""))
    pairs = {
        "count": (T.kwcount(t, "= "), count("= ")), "fragment": (G.banned_fragment(t), fragment), "prefix": (G.banned_prefix(t), prefix),
        "heavy": (G.heavy(t), t.rlike(G.ONLY_SYMBOLS) | fragment | ((markers >= 3) & (T.letters(t) < 50)) | ((brackets >= 12) & (T.letters(t) < 80))),
        "equation": (T.equation_signal(t), low.rlike(T.ascii_edges(r"\b(theorem|lemma|proof|corollary|equation)\b")) | (count("=") >= 2) | F.contains(t, F.lit("O("))),
        "metric": (T.metric_signal(t), T.contains_any(low, L.METRICS) | t.rlike(T.ascii_edges(r"\b[0-9]+(\.[0-9]+)?\s*%")) | (t.rlike(T.ascii_edges(r"\b[0-9]+(\.[0-9]+)?\b")) & T.contains_any(low, ["table", "figure"]))),
    }
    texts = spark.createDataFrame([(x,) for x in random_texts(4000, 8)], "t string")
    rows = texts.select("t", *[F.struct(a.alias("got"), b.alias("want")).alias(n) for n, (a, b) in pairs.items()]).collect()
    assert [(r["t"], n) for r in rows for n in pairs if r[n]["got"] != r[n]["want"]] == []
    assert all({r[n]["got"] for r in rows} >= {True, False} for n in pairs if n != "count") and len({r["count"]["got"] for r in rows}) > 3
    raw = T.squeeze(F.translate("t", "\x00", " "))
    made = annotate.with_clean(texts, "t").select("t", "f_raw", "f_marked", raw.alias("raw"), T.squeeze(F.regexp_replace(raw, T.ascii_edges(r"(?i)\bEQUATION:\s*"), "[equation] ")).alias("marked")).collect()
    assert [r["t"] for r in made if (r["f_raw"], r["f_marked"]) != (r["raw"], r["marked"])] == []

    bits = [*L.SECTION_ALIASES, *[a.title() for a in L.SECTION_ALIASES], "1 ", "2.3", " 4. ", "\t", "  ", ": ", " - ", "K", "İ", "related\twork", "more words"]
    lines = spark.createDataFrame([("".join(x.split("x")[:1]),) for x in random_texts(3000, 9, bits) if x is not None] + [(b + e,) for b in bits for e in ("", " a", ":b")], "t string")
    found = lambda: lines.select("t", parsing.primary_heading(t).alias("p"), documents.heading(t).alias("h")).collect()
    short = found()
    monkeypatch.setattr(documents, "may_open", lambda line, aliases: F.lit(True))
    assert short == found() and sum(r["p"] is not None for r in short) > 100


def test_sections_are_parsed_in_one_pass(spark, duck):
    """reindexed_documents: lines are made and compared once; before, once more for the sections and once for documents of headings only."""
    from siftwell.operators import documents, parsing
    from siftwell.plans import analysis, catalog

    texts = ["Abstract", "Abstract\n\nMethod\n", "\n", " ", "", None, "Abstract\nA text.\n\nResults\n", "1 Method\n\n Upper Case Words\n", "free text\nDiscussion: it goes on", "\t", "Method\nMethod\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, "Results"), (100, "x\n\n\nAbstract")], "doc_id long, text string")
    lines = documents.document_lines(docs, "doc_id", "text").withColumn("page_number", (F.floor(F.col("pos") / 3) + 1).cast("int"))
    made = parsing.parse_sections(lines, "doc_id", analysis._ALIASES)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    con = duck.cursor()
    con.register("given", docs.toPandas())
    got = sorted(map(tuple, made.withColumn("content", F.md5("content")).collect()), key=repr)
    assert got == sorted(con.execute(catalog.SQL["parse_sections"].replace("FROM documents", "FROM given")).fetchall(), key=repr)
    whole = {r["doc_id"]: (r["section_name"], r["subsection_name"], r["content"]) for r in parsing.parse_sections(lines, "doc_id").collect()}
    assert whole[1] == ("front_matter", None, "Abstract\n\nMethod\n") and whole[99] == ("front_matter", None, "Results") and 3 not in whole


def test_only_chunks_whose_role_may_pass_are_summarised(spark):
    """reindexed_documents: chunks that pass the gate are the same, with all columns; of the others no text is cleaned or summed up."""
    from siftwell.operators import annotate, indexing

    texts = ["We propose a method that uses an algorithm to reduce the loss on all tasks. It works well.", "Nothing of note stands in these words here and there, I think.", "Theorem 1 shows that y = W x = b holds for all x and all weights of the model.", None]
    rows = spark.createDataFrame([(i % 3, i, s, None, x) for i, (s, x) in enumerate((s, x) for s in ("method", "related work", None) for x in texts + random_texts(60, 5))], "k long, chunk_index int, section_name string, subsection_name string, content string")
    want = annotate.annotated(rows, ("k",)).filter("quality_pass").drop("n_candidates", "quality_score", "quality_pass")
    got = indexing.prepared(rows, "k")
    found = got.collect()
    assert got.columns == want.columns and sorted(map(tuple, found), key=repr) == sorted(map(tuple, want.collect()), key=repr) and len(found) > 0
    left = [r for r in annotate.gated(rows, ("k",)).collect() if r["role"] == "other" or r["role_confidence"] < 0.35]
    assert len(left) > 3 and not any(r["summary"] or r["quality_pass"] for r in left)


def test_vectors_of_sections_are_those_of_their_parts(spark):
    """reindexed_documents: words are hashed and counted once for sections and subsections; the sums are those of the joined texts."""
    from siftwell.functions.vectors import hashed_embedding
    from siftwell.operators import documents, reindex

    rows = [(1, 0, "method", None, "Two words ΑΣ"), (1, 1, "method", "Part", "The update rule K2 and words"), (1, 2, "method", None, "words again_and more"), (2, 0, "results", None, ""), (2, 1, "results", None, "é the")]
    segs = spark.createDataFrame(rows, "k long, section_order int, section_name string, subsection_name string, content string")
    counted = segs.withColumns({"counts": hashed_embedding(T.tokens(F.col("content"))), "words": T.word_count(F.col("content"))})
    for names in (("section_name",), ("section_name", "subsection_name")):
        want = reindex.with_vectors(documents.merged(segs, "k", *names).withColumn("token_count", T.word_count(F.col("content"))), "content")
        got = reindex.joined(counted, None, "k", *names)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
