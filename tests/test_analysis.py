"""Parsing, chunking, gates and selections against plain versions, on fixtures and on all test documents."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from siftwell import lexicons as L
from siftwell.functions import gates as G
from siftwell.operators import annotate, claims, documents, domains, indexing, parsing, retrieval
from siftwell.plans import catalog
from siftwell.sources import tables
from tests.conftest import SF
from tests.fixtures import PAGES


def texts_of(spark, name="documents", key="doc_id"):
    return {r[key]: r["text"] or "" for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


# Plain versions

ENDS = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\[])", re.ASCII)
squeeze = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
n_letters = lambda t: sum(c.isalpha() for c in t)


def plain_heavy(t):
    markers = len(re.findall(r"\[equation\]|=|o\(|\\[a-z]+|\bfrac\b", t.lower()))
    return bool(re.fullmatch(r"[0-9\s+\-*/^=<>()\[\]{}|.,:;%]+", t)) or any(re.search(p, t, re.I) for p in L.BANNED_FRAGMENTS) or (markers >= 3 and n_letters(t) < 50) or (sum(t.count(c) for c in "()[]{}") >= 12 and n_letters(t) < 80)


def plain_clean(text):
    raw = squeeze(text.replace("\x00", " "))
    banned = lambda t: t.strip().lower().startswith(tuple(L.BANNED_STARTS))
    if not raw or banned(raw):
        return None
    t = squeeze(re.sub(r"\bEQUATION:\s*", "[equation] ", raw, flags=re.I))
    if plain_heavy(t):
        return None
    if not re.match(r"[A-Z0-9\[]", t):
        m = ENDS.search(t)
        if not m:
            return None
        t = t[m.end() :]
    return None if banned(t) or plain_heavy(t) else t


def plain_summary(text, most=300):
    clean = plain_clean(text)
    parts = [s.strip() for s in ENDS.split(clean) if s.strip()] if clean else []
    if not parts:
        return None
    taken = []
    for s in parts:
        if len(" ".join([*taken, s])) > most:
            break
        taken.append(s)
        if len(" ".join(taken)) >= 140:
            break
    if not taken:
        return parts[0][: most - 3].rsplit(" ", 1)[0].strip() + "..."
    got = " ".join(taken)
    if len(taken) < len(parts):
        if len(got) > most - 3:
            got = got[: most - 3].rsplit(" ", 1)[0].strip()
        got += "" if got.endswith("...") else "..."
    return got[:most]


def plain_units(text):
    """Merging as it is told: each unit looks at all of what stands before it."""
    out = []
    for u in parsing.text_units(text):
        low, before = u.lower(), out[-1] if out else None
        formula = before is not None and ("equation:" in before.lower() or "=" in before or "o(" in before.lower())
        result = before is not None and any(h in before.lower() for h in ("result", "improves", "achieves", "outperforms"))
        if before is not None and (low.startswith(tuple(L.CONTINUATIONS)) or (formula and any(h in low for h in L.EXPLANATIONS)) or (result and any(m in low for m in L.CLAIM_METRICS))):
            out[-1] = f"{before} {u}"
        else:
            out.append(u)
    return out


# Summaries and chunks over all documents


def test_summaries_are_those_of_a_plain_version(spark):
    texts = texts_of(spark) | {-1: "x", -2: "", -3: "lower case only", -4: "A. " * 200, -5: "B" * 400 + ". Next one.", -6: "frag. " + "Word " * 100, -7: "(((((((())))))))", -8: "Figure 1. Something", -9: "ends here. [1] The rest = 1. " + "Go on. " * 60}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    got = {r["doc_id"]: (r["f_clean"], r["summary"]) for r in annotate.with_summary(rows).collect()}
    assert got == {i: (plain_clean(t), plain_summary(t)) for i, t in texts.items()}


def test_table_chunks_keep_their_telling_lines(spark):
    text = "TABLE: scores\nModel | Year\nOurs | 4.2%\nbaseline | 5\nplain | line\nx accuracy\ny 7 %\nz 8 %\nlast 9%"
    assert one(spark, G.table_snippet(F.col("t")), t=text) == "TABLE: scores Ours | 4.2% baseline | 5 x accuracy y 7 %"
    assert one(spark, G.table_snippet(F.col("t")), t="TABLE:\nno\nnumbers") is None


def test_units_are_merged_as_if_each_looked_back_at_all(spark):
    texts = [*texts_of(spark).values(), "\n\n".join("\n".join(b) for _, b in PAGES), "TABLE:\na | b\n\nEQUATION: x = 1\nx denotes y. Where it goes. On the test WER falls. The result holds. On A. The BLEU rises."]
    for t in texts:
        assert parsing.merge_units(parsing.text_units(t)) == plain_units(t)


def test_chunk_sections_cover_each_section(spark):
    from siftwell.plans import analysis

    segs = analysis._parsed(spark, SF).collect()
    want = {}
    for r in sorted(segs, key=lambda r: (r["doc_id"], r["section_order"])):
        units = [(u, len(u.split())) for u in plain_units(r["content"])]
        want.setdefault(r["doc_id"], []).extend((c, n, r["section_name"], r["subsection_name"]) for c, n in documents.pack_units(units, 120, 20))
    got = {}
    for r in catalog.QUERIES["chunk_sections"](spark, SF).orderBy("doc_id", "chunk_index").collect():
        assert r["chunk_index"] == len(got.get(r["doc_id"], []))
        got.setdefault(r["doc_id"], []).append((r["content"], r["token_count"], r["section_name"], r["subsection_name"]))
    assert got == {d: c for d, c in want.items() if c}


def test_packed_chunks_of_all_documents(spark):
    """chunk_pack: sentences within lines, packed by words."""
    word, want = re.compile(r"[^\W]+"), []
    for d, t in texts_of(spark).items():
        units = [s for line in re.split(r"\r\n|\n|\r", t) if (u := line.strip(" \t\n\x0b\x0c\r")) for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9])", u)]
        want += [(d, i, c, n) for i, (c, n) in enumerate(documents.pack_units([(u, len(word.findall(u))) for u in units], 400, 50))]
    assert sorted(map(tuple, catalog.QUERIES["chunk_pack"](spark, SF).collect())) == sorted(want)


def test_chunk_summary_of_all_documents(spark):
    for r in catalog.QUERIES["chunk_summary"](spark, SF).collect():
        t = squeeze(texts_of_cached(spark)[r["doc_id"]])
        parts = [s.strip() for s in ENDS.split(t) if s.strip()]
        got, done = "", False
        for s in parts:
            longer = f"{got} {s}".strip()
            if done or len(longer) > 300:
                done = True
                continue
            got, done = longer, len(longer) >= 140
        if not parts:
            want = None
        elif not got:
            want = re.sub(r"\s\S*$", "", parts[0][:297]) + "..."
        elif got == " ".join(parts):
            want = got
        else:
            want = re.sub(r"\s\S*$", "", got[:297]) + "..." if len(got) > 297 else got + "..."
        assert r["summary"] == want


_cache = {}


def texts_of_cached(spark):
    if not _cache:
        _cache.update(texts_of(spark))
    return _cache


def test_claim_unit_counts_of_all_documents(spark):
    want = {}
    for d, t in texts_of(spark).items():
        units = [s for line in re.split(r"\r\n|\n|\r", t) if (u := line.strip(" \t\n\x0b\x0c\r")) for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", u) if s]
        want[d] = sum(1 for i, u in enumerate(units) if i == 0 or u[0].isupper() or u[0] in "0123456789[")
    assert {r["doc_id"]: r["n_units"] for r in catalog.QUERIES["claim_units"](spark, SF).collect()} == want


def test_repository_scores_of_all_parts(spark):
    bonus = {0: L.REPO_SOURCE_BONUS["paper_link"], 1: L.REPO_SOURCE_BONUS["paperswithcode"], 2: L.REPO_SOURCE_BONUS["github_search"]}
    got = {r["p_partkey"]: r for r in catalog.QUERIES["repo_score"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/part.parquet").collect():
        k = p["p_partkey"] % 3
        title = difflib.SequenceMatcher(None, p["p_name"].lower(), p["p_type"].lower()).ratio()
        want = min(1.0, 0.25 + 0.45 * title + bonus[k]) + (min(0.15, p["p_size"] * 50 / 10000) if k == 2 else 0.0)
        assert got[p["p_partkey"]]["confidence"] == pytest.approx(min(1.0, want), abs=1.01e-4)
        assert got[p["p_partkey"]]["action"] == ("clone_existing_repo" if got[p["p_partkey"]]["confidence"] >= 0.75 else "review_repo_then_generate" if got[p["p_partkey"]]["confidence"] >= 0.55 else "use_generated_scaffold")


# Gate


def test_noun_phrases_and_quality(spark):
    ask = lambda s, role="method", c=0.6: one(spark, G.quality_chunk(F.col("s"), F.lit(role), F.lit(c)), s=s)
    assert one(spark, G.noun_phrase(F.col("s")), s="Speech") and one(spark, G.noun_phrase(F.col("s")), s="Rank Limited Speech Updates") and not one(spark, G.noun_phrase(F.col("s")), s="Updates are small")
    long = "The proposed update rule keeps most of the weights as they are."
    assert ask(long) and not ask(long, "other") and not ask(long, c=0.3) and not ask(long.lower()) and not ask("Figure 3 shows " + long) and not ask("We use subsampling here and " + long)
    assert ask("h = W x", "equation") and ask("5% WER", "evaluation") and ask("The loss.", "algorithm") and not ask("The end.", "algorithm")


def test_formula_mode_keeps_what_looks_like_a_formula(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0, True, "method", "Plain words."), (2, 0.8, -0.6, False, "equation", "h = W x"), (3, 0.7, -0.6, False, "equation", "h = W x"), (4, 0.85, -0.6, True, "method", "Poor.")], "chunk_id long, score double, quality_score double, quality_pass boolean, role string, content string")
    for group in ((), ("one",)):
        got = retrieval.gate(rows.withColumn("one", F.lit(1)), group, formula=True)
        assert {r["chunk_id"] for r in got.collect()} == {1, 2}
        assert {r["chunk_id"] for r in retrieval.gate(rows.withColumn("one", F.lit(1)), group).collect()} == {1}


def test_balanced_selection_fills_up_from_the_rest(spark):
    """Of the chain's own candidates: the wanted sections' best first, twelve at most, none twice, all of the paper."""
    found = {(r["paper_id"], r["chunk_id"]) for r in catalog.QUERIES["retrieve_chunks"](spark, SF).collect()}
    rows = catalog.QUERIES["balanced_chain"](spark, SF).collect()
    by_paper = {}
    for r in sorted(rows, key=lambda r: (r["paper_id"], r["place"])):
        by_paper.setdefault(r["paper_id"], []).append(r)
    assert by_paper and {(r["paper_id"], r["chunk_id"]) for r in rows} <= found
    for own in by_paper.values():
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 12 and len({r["chunk_id"] for r in own}) == len(own)
        assert [r["rerank_score"] for r in own] == sorted((r["rerank_score"] for r in own), reverse=True)


# Pages, sections, tables on the fixture paper


def blocks(spark):
    return spark.createDataFrame([(1, p, i, b) for p, bs in PAGES for i, b in enumerate(bs)], "id long, page_number int, block_index int, text string")


def test_sections_of_a_paper(spark):
    lines = spark.createDataFrame([(1, i, line, p) for i, (p, line) in enumerate((p, s) for p, bs in PAGES for b in bs for s in b.split("\n"))], "id long, pos int, line string, page_number int")
    got = [tuple(r)[1:6] for r in parsing.parse_sections(lines, "id").orderBy("section_order").collect()]
    # Without text of its own a heading opens nothing; a line that starts with an alias opens its section and goes on; a row of
    # capitalised words is a heading of its own.
    assert [g[1:3] for g in got if g[3] is None] == [("front_matter", "Front Matter"), ("abstract", "Abstract"), ("introduction", "1 Introduction"), ("method", "Model"), ("results", "Results"), ("method", "Model"), ("references", "References")]
    # The full stop after a single number isn't taken off, so that such a line opens a subsection.
    assert ("introduction", "1 Introduction", "2.1 Update Rule", 2) in [g[1:] for g in got] and [g[0] for g in got] == list(range(len(got)))


def test_tables_of_a_paper(spark):
    segs = spark.createDataFrame([(1, 3, 5, "results"), (1, 2, 3, "method")], "id long, page_number int, section_order int, section_name string")
    got = {r["table_index"]: r for r in parsing.table_artifacts(blocks(spark), segs).collect()}
    assert {i: (r["table_label"], r["caption"], r["table_type"], r["section_name"], r["linked_indexes"]) for i, r in got.items()} == {
        0: ("Table 1", "Table 1: WER on the test set", "results", "results", "3,4,5,6,7"), 1: ("Table 1", "Table 1: WER on the test set", "hyperparameter", "results", "3,4,5,6,7"),
    }
    assert got[0]["metric_names"] == ["WER"] and got[0]["model_names"] == ["Baseline", "Ours", "Large Conformer"]


def test_blocks_become_piped_rows(spark):
    ask = lambda t: one(spark, parsing.block_text(F.col("t")), t=t)
    assert ask("Model   WER\nOurs\t4.2\nBig   3.9   x") == "TABLE:\nModel | WER | \nOurs | 4.2 | \nBig | 3.9 | x"
    assert ask("a  plain   line\n\ny = 2 x") == "a plain line\nEQUATION: y = 2 x"
    assert one(spark, parsing.table_rows(F.col("t")), t=" a | b \n\n c|d ") == [["a", "b"], ["c", "d"]]


def test_neighbours_of_a_formula(spark):
    rows = [(i, 1, "m", None, i, "equation" if i == 2 else "method", "h = W x", 0.5, 0.3) for i in range(5)]
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_id long, section_name string, subsection_name string, chunk_index int, role string, content string, score double, importance double")
    seeds = chunks.filter("chunk_id in (2, 4)").withColumn("seed_rank", F.when(F.col("chunk_id") == 2, 1).otherwise(2))
    got = {r["chunk_id"]: (r["neighbor_for"], r["role"], r["importance"]) for r in claims.with_neighbors(seeds, chunks).collect()}
    assert got == {2: (None, "equation", 0.3), 4: (None, "method", 0.3), 1: (2, "neighbor_context", 0.25), 3: (2, "neighbor_context", 0.25)}


def test_last_duplicate_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, "d", 1)], "chunk_id long, content string, pos int")
    assert {(r["chunk_id"], r["content"]) for r in claims.last_of_each(rows, "chunk_id", "pos").collect()} == {(1, "b"), (2, "d")}


def test_architectures_suppress_what_they_specialise(spark):
    rows = spark.createDataFrame([(1, "We propose a novel Mask-Conformer, a conformer", "idea", "abstract"), (1, "compared with the transformer baseline", "evaluation", "results"), (1, "an LSTM", "other", "results")], "paper_id long, content string, role string, section_name string")
    got = domains.architectures(rows, "paper_id").first()
    assert got["proposed"] == ["Mask-Conformer"] and got["baseline"] == ["Transformer"] and got["mentioned"][0] == "Mask-Conformer"


def test_fields_given_as_json_or_text(spark):
    ask = lambda v: one(spark, domains.list_field(F.col("v")), v=v)
    assert ask('["a", " ", "b"]') == ["a", "b"] and ask("x, y") == ["x, y"] and ask('{"a": 1}') == ['{"a": 1}'] and ask(" ") is None and ask('"q"') == ["q"] and ask("[broken") == ["[broken"]
    assert one(spark, domains.mapping(F.col("v")), v='{"a": "1", "b": "2"}') == {"a": "1", "b": "2"} and one(spark, domains.mapping(F.col("v")), v="{bad") is None
    assert one(spark, domains.distinct_architectures(F.col("v")), v=["Transformer Model", "transformer", " My Net "]) == ["Transformer", "My Net"]


# Indexing, writing, resetting


def test_one_bad_document_does_not_hold_up_others(spark, tmp_path):
    text = "\n".join(s for _, bs in PAGES for s in bs)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, text)], "paper_id long, text string")
    index = indexing.build_index(docs, f"{tmp_path}/staging")
    assert {r["paper_id"]: r["error"] for r in index["status"].collect()} == {1: None, 2: "no text", 3: "no text", 4: None}
    assert {r["paper_id"] for r in index["chunks"].collect()} == {1, 4} and {r["paper_id"] for r in index["sections"].collect()} == {1, 4}
    assert {r["domain"] for r in index["domains"].collect()} <= set(L.PAPER_DOMAINS)
    path = f"{tmp_path}/sections"
    tables.write_index(index["sections"], path)
    tables.write_index(index["sections"].filter("paper_id = 1 and section_name = 'method'"), path)
    names = lambda: {(r["paper_id"], r["section_name"]) for r in spark.read.parquet(path).collect()}
    assert {n for p, n in names() if p == 1} == {"method"} and len({n for p, n in names() if p == 4}) > 3
    tables.reset_papers(spark, [path], [4])
    assert {p for p, _ in names()} == {1}
    tables.reset_all(spark, [path])
    assert names() == set()


def test_rows_without_a_vector_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 1)], "chunk_id long, paper_id long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id long, embedding array<double>")
    tables.write_embedded(rows, vectors, f"{tmp_path}/ok")
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 2
    with pytest.raises(Exception):
        tables.write_embedded(rows, vectors.limit(1), f"{tmp_path}/bad")
