"""Further registered queries: parsing, the retrieval chain, claims, equations, domain views, canonical names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..operators import annotate, claims, documents, domains, parsing, retrieval
from ..sources.tables import chunks, table
from . import sql as X
from .catalog import _IMPORTANCE, _LINES, _RANKED, _ROLE, ROLES, _annotated, query

# The real gate and the retrieval chain

_CLEANED = f"WITH {X.cleaned('documents', 'text')}"


@query(f"{_CLEANED} SELECT doc_id, md5(clean) AS clean_md5, summary FROM cleaned")
def clean_summary(spark, sf):
    return annotate.with_summary(table(spark, sf, "documents"), "text").select("doc_id", F.md5("f_clean").alias("clean_md5"), "summary")


def _ranked(source_where: str, group: str) -> str:
    """CTEs from scored texts to ``pick``: annotated anew within a group, with summary and quality_pass."""
    return _RANKED.replace(f"{X.TEXTS},", f"{X.TEXTS.replace('texts AS (', 'alltexts AS (')}, texts AS ({source_where}),").replace("PARTITION BY paper_id) AS n FROM roled", f"PARTITION BY {group}) AS n FROM roled") + f", {X.cleaned('ranked', 'content')}, pick AS (SELECT *, {X.quality_chunk('summary', 'role', 'role_confidence')} AS quality_pass FROM cleaned)"


_FETCH = "SELECT * EXCLUDE (f_score) FROM (SELECT *, " + X.score(0) + " AS f_score FROM alltexts) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY f_score DESC, chunk_id) <= 40"


def _gated(formula: bool) -> str:
    bonus = X.formula_bonus("role", "content")
    passes = f"(quality_pass OR {bonus} >= 0.75)" if formula else "quality_pass"
    near = f"AND NOT ({bonus} >= 0.75 AND score >= best - 0.12)" if formula else ""
    more = f" + 0.18::DOUBLE * {bonus}" if formula else ""
    match = "CASE WHEN role IN ('method', 'algorithm') THEN 1.0::DOUBLE WHEN role IN ('implementation', 'idea') THEN 0.3 ELSE 0.0 END"
    return f"""{_ranked(_FETCH, 'paper_id')}, g1 AS (SELECT * EXCLUDE (rerank_score), {passes} AS ok FROM pick), g2 AS (SELECT *, bool_or(ok) OVER (PARTITION BY paper_id) AS any_ok FROM g1), g3 AS (SELECT *, max(score) OVER (PARTITION BY paper_id) AS best FROM g2 WHERE ok OR NOT any_ok),
g4 AS (SELECT *, round(0.5::DOUBLE * score + 0.3::DOUBLE * {match} + 0.2::DOUBLE * importance{more}, 4) AS rerank_score FROM g3 WHERE NOT (((quality_score <= -0.5 AND score < best - 0.01) OR (quality_score <= -0.2 AND score < best - 0.05)) {near})),
g5 AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rerank_score DESC, score DESC, importance DESC, chunk_id) AS place FROM g4)"""


def _scored(spark, sf):
    rows = chunks(spark, sf)
    return retrieval.scored(rows, retrieval.query_vector(rows, 0, "chunk_id"))


def _retrieved(spark, sf, formula=False):
    return retrieval.retrieve(_scored(spark, sf), ("paper_id",), "method", 10, formula, L.TEST_ROLES, ROLES)


@query(f"{_gated(False)} SELECT paper_id, chunk_id, place::INTEGER AS place, role, importance, quality_score, rerank_score FROM g5 WHERE place <= 20")
def retrieve_chunks(spark, sf):
    return _retrieved(spark, sf).select("paper_id", "chunk_id", "place", "role", "importance", "quality_score", "rerank_score")


@query(f"{_gated(True)} SELECT paper_id, chunk_id, place::INTEGER AS place, rerank_score FROM g5 WHERE place <= 20")
def retrieve_formulas(spark, sf):
    return _retrieved(spark, sf, True).select("paper_id", "chunk_id", "place", "rerank_score")


@query(f"{_ranked(_FETCH, 'paper_id')}, m AS (SELECT *, min(score) OVER (PARTITION BY paper_id) AS lo, max(score) OVER (PARTITION BY paper_id) AS hi FROM pick) SELECT chunk_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 4) AS semantic_rank_score, quality_pass FROM m")
def candidate_scores(spark, sf):
    rows = retrieval.overfetched(_scored(spark, sf), ("paper_id",), 10)
    return retrieval.normalised(annotate.annotated(rows, ("paper_id",), L.TEST_ROLES, ROLES), ("paper_id",)).select("chunk_id", "semantic_rank_score", "quality_pass")


def _gate_only(fetched: int, where: str = "") -> str:
    fetch = _FETCH.replace("<= 40", f"<= {fetched}").replace("FROM alltexts)", f"FROM alltexts{where})")
    bonus = X.formula_bonus("role", "content")
    return f"""{_ranked(fetch, 'paper_id')}, g1 AS (SELECT *, quality_pass OR {bonus} >= 0.75 AS ok FROM pick), g2 AS (SELECT *, bool_or(ok) OVER (PARTITION BY paper_id) AS any_ok FROM g1), g3 AS (SELECT *, max(score) OVER (PARTITION BY paper_id) AS best FROM g2 WHERE ok OR NOT any_ok),
g4 AS (SELECT * FROM g3 WHERE NOT (((quality_score <= -0.5 AND score < best - 0.01) OR (quality_score <= -0.2 AND score < best - 0.05)) AND NOT ({bonus} >= 0.75 AND score >= best - 0.12)))"""


_SECTION_BONUS = f"CASE WHEN section_name IN ('method', 'theory') THEN 1.0::DOUBLE WHEN section_name IN ({', '.join(map(X.q, L.FORMULA_SECTIONS))}) THEN 0.6 WHEN section_name IN ('results', 'discussion') THEN 0.15 ELSE 0.0 END"
_SECTION_PRIOR = "CASE " + " ".join(f"WHEN section_name = {X.q(k)} THEN {v}::DOUBLE" for k, v in L.SECTION_PRIORS["method"].items()) + " ELSE 0.1 END"
_SECTION_WEIGHT = X.case("section_name", L.SECTION_WEIGHTS, "1.0")


@query(f"""{_gate_only(12)}, v AS (SELECT *, round(0.7::DOUBLE * score + 0.3::DOUBLE * {_SECTION_PRIOR} + 0.18::DOUBLE * {_SECTION_BONUS}, 6) AS value, {_SECTION_WEIGHT} AS weight FROM g4 WHERE section_name <> 'references'),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY paper_id, section_name ORDER BY value DESC, quality_score DESC, weight DESC, chunk_index, chunk_id) = 1)
SELECT paper_id, section_name, chunk_id, value FROM o QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY value DESC, quality_score DESC, weight DESC, chunk_index, chunk_id) <= 3""")
def retrieve_sections(spark, sf):
    rows = _scored(spark, sf).withColumn("section_order", F.col("chunk_index"))
    return retrieval.retrieve_sections(rows, ("paper_id",), "method", 3, True, False, L.TEST_ROLES, ROLES).select("paper_id", "section_name", "chunk_id", "value")


_ORDERED = ["method", "results", "theory"]
_SIGNAL = f"({X.any_of('lower(content)', ['equation', 'formula', 'objective', 'defined as', 'denotes'])} OR regexp_matches(content, '=|\\\\[a-zA-Z]+|O\\(|argmax|argmin'))"


@query(f"""{_gate_only(24, " WHERE section_name IN ('method', 'results', 'theory')")}, v AS (SELECT *, round(score * ({_SECTION_WEIGHT})::DOUBLE + 0.16::DOUBLE * least(1.0::DOUBLE, CASE WHEN {X.any_of("lower(coalesce(subsection_name, ''))", L.FORMULA_SUBSECTIONS)} THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN {_SIGNAL} THEN 0.6::DOUBLE ELSE 0 END), 6) AS value FROM g4),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section_name ORDER BY value DESC, quality_score DESC, chunk_id) AS r FROM v), t AS (SELECT *, CASE WHEN r <= 2 THEN list_position({X.arr(_ORDERED)}, section_name) - 1 ELSE 4 END AS tier FROM r)
SELECT paper_id, chunk_id, value FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY tier, value DESC, quality_score DESC, chunk_id) <= 6""")
def retrieve_subsections(spark, sf):
    return retrieval.retrieve_subsections(_scored(spark, sf), ("paper_id",), _ORDERED, 6, True, L.TEST_ROLES, ROLES).select("paper_id", "chunk_id", "value")


@query()
def balanced_chain(spark, sf):
    """Over-fetch, gate, rerank and balanced selection in one; compared with a plain version in tests."""
    return retrieval.select_balanced(_retrieved(spark, sf), ("paper_id",), ["method", "results", "theory"], "method", 12, 3).select("paper_id", "chunk_id", "place", "rerank_score")


@query(f"{_RANKED} SELECT chunk_id, CASE {' '.join(f'WHEN role = {X.q(r)} THEN {v}::DOUBLE' for r, v in L.INTENT_ROLE_WEIGHTS['method'].items())} ELSE 0.4 END AS intent_role_weight, {X.formula_bonus('role', 'content')} AS formula_bonus FROM ranked")
def role_weights(spark, sf):
    return _annotated(spark, sf).select("chunk_id", "intent_role_weight", T.formula_candidate_bonus(F.col("role"), F.col("content")).alias("formula_bonus"))


@query(f"{_RANKED} SELECT paper_id, floor(avg(0.7::DOUBLE * score + 0.3::DOUBLE * importance) * 10000 + 0.5::DOUBLE) / 10000 AS retrieval_confidence, floor(coalesce(avg(importance), 0) * 10000 + 0.5::DOUBLE) / 10000 AS average_importance FROM ranked GROUP BY paper_id")
def retrieval_confidence(spark, sf):
    return claims.retrieval_confidence(_annotated(spark, sf), "paper_id")


# Pages, sections, chunks, tables

_CELLS = r"list_filter(list_transform(string_split_regex(s, '\s{2,}|\t+'), lambda c: trim(c)), lambda c: c <> '')"
_MARKED = f"CASE WHEN {X.any_of('s', L.EQUATION_MARKS)} AND len(string_split({X.squeeze('s')}, ' ')) <= 40 THEN 'EQUATION: ' || s ELSE s END"


@query(f"""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls FROM documents), c AS (SELECT doc_id, list_filter(list_transform(list_filter(ls, lambda s: trim(s) <> ''), lambda s: {_CELLS}), lambda r: len(r) >= 2) AS rows,
  list_filter(list_transform(ls, lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'))), lambda s: s <> '') AS clean FROM l), w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM c)
SELECT doc_id, md5(CASE WHEN len(rows) >= 2 THEN 'TABLE:' || chr(10) || array_to_string(list_transform(rows, lambda r: array_to_string(list_resize(r, width, ''), ' | ')), chr(10)) ELSE array_to_string(list_transform(clean, lambda s: {_MARKED}), chr(10)) END) AS block_md5 FROM w""")
def block_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(parsing.block_text(F.col("text"))).alias("block_md5"))


@query("""WITH t AS (SELECT page_id, list_transform(list_filter(list_transform(string_split(replace(html, '<p>', chr(10) || '| '), chr(10)), lambda s: trim(s)), lambda s: s <> ''), lambda s: list_transform(string_split(s, '|'), lambda c: trim(c))) AS rows FROM pages)
SELECT page_id, len(rows)::INTEGER AS n_rows, list_max(list_transform(rows, lambda r: len(r)))::INTEGER AS width FROM t""")
def table_cells(spark, sf):
    rows = parsing.table_rows(F.replace("html", F.lit("<p>"), F.lit("\n| ")))
    return table(spark, sf, "pages").select("page_id", rows.alias("r")).select("page_id", F.size("r").alias("n_rows"), F.array_max(F.transform("r", lambda r: F.size(r))).alias("width"))


_ALIASES = {"the": "method", "und": "results", "license": "references", "les": "discussion"}
_BARE = "trim(regexp_replace(regexp_replace(lower(line), '^\\s*[0-9]+(\\.[0-9]+)*\\s*', ''), '\\s+', ' ', 'g'))"
_LED = lambda a: f"(starts_with(lower(trim(line)), '{a}:') OR starts_with(lower(trim(line)), '{a} '))"
_PRIMARY = "CASE WHEN trim(line) = '' THEN NULL " + " ".join(f"WHEN {_BARE} = '{a}' THEN '{n}'" for a, n in _ALIASES.items()) + " " + " ".join(f"WHEN {_LED(a)} THEN '{n}'" for a, n in _ALIASES.items()) + " END"
_REST = "CASE WHEN trim(line) = '' THEN NULL " + " ".join(f"WHEN {_BARE} = '{a}' THEN NULL" for a in _ALIASES) + " " + " ".join(f"WHEN {_LED(a)} THEN nullif(regexp_replace(substr(trim(line), {len(a) + 1}), '^[ :\\-\\t]+', ''), '')" for a in _ALIASES) + " END"
_HEAD = "CASE " + " ".join(f"WHEN {_BARE} = '{a}' THEN trim(line)" for a in _ALIASES) + " " + " ".join(f"WHEN {_LED(a)} THEN '{a.title()}'" for a in _ALIASES) + " END"
_SUB = r"""(trim(line) <> '' AND length(trim(line)) <= 100 AND (regexp_matches(trim(line), '^[0-9]+\.\s+.+') OR regexp_matches(trim(line), '^[0-9]+(\.[0-9]+)+\s+.+') OR regexp_matches(trim(line), '^[IVXLC]+\.?\s+.+') OR regexp_matches(trim(line), '^[A-Z]\.\s+.+')
 OR (NOT regexp_matches(trim(line), '[,\[\]"“”:]|\.$') AND NOT contains(lower(trim(line)), 'et al') AND regexp_matches(trim(line), '^\p{Lu}[^\p{Lu}\s]*( \p{Lu}[^\p{Lu}\s]*){1,5}$'))))"""


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, pos, rtrim(line) AS line FROM lines), p AS (SELECT *, {_PRIMARY} AS prim, {_REST} AS rest, {_HEAD} AS head FROM m), s AS (SELECT *, CASE WHEN prim IS NULL AND {_SUB} THEN trim(line) END AS sub FROM p),
r AS (SELECT *, (prim IS NOT NULL OR sub IS NOT NULL) AS opens, sum((prim IS NOT NULL OR sub IS NOT NULL)::INT) OVER w AS run, sum((prim IS NOT NULL)::INT) OVER w AS sec FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, sec, run, max(prim) AS prim, max(head) FILTER (prim IS NOT NULL) AS head, max(sub) AS sub, arg_min(pos // 3 + 1, pos) FILTER (trim(line) <> '') AS page, coalesce(string_agg(CASE WHEN opens THEN rest ELSE line END, chr(10) ORDER BY pos) FILTER (CASE WHEN opens THEN rest IS NOT NULL ELSE trim(line) <> '' END), '') AS content FROM r GROUP BY doc_id, sec, run),
n AS (SELECT *, max(prim) OVER (PARTITION BY doc_id, sec) AS own, max(head) OVER (PARTITION BY doc_id, sec) AS own_head FROM g), k AS (SELECT * FROM n WHERE trim(content) <> ''),
o AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INTEGER AS section_order, coalesce(own, 'front_matter') AS section_name, coalesce(own_head, 'Front Matter') AS section_heading, sub AS subsection_name, page::INTEGER AS page_number, content FROM k),
w AS (SELECT doc_id, 0 AS section_order, 'front_matter' AS section_name, 'Front Matter' AS section_heading, NULL AS subsection_name, 1 AS page_number, string_agg(line, chr(10) ORDER BY pos) AS content FROM m WHERE doc_id NOT IN (SELECT doc_id FROM o) GROUP BY doc_id HAVING trim(string_agg(line, chr(10) ORDER BY pos)) <> ''),
u AS (SELECT * FROM o UNION ALL SELECT * FROM w) SELECT doc_id, section_order::INTEGER AS section_order, section_name, section_heading, subsection_name, page_number::INTEGER AS page_number, md5(content) AS content_md5 FROM u""")
def parse_sections(spark, sf):
    return _parsed(spark, sf).withColumn("content_md5", F.md5("content")).drop("content")


def _parsed(spark, sf):
    lines = documents.document_lines(table(spark, sf, "documents"), "doc_id", "text").withColumn("page_number", (F.floor(F.col("pos") / 3) + 1).cast("int"))
    return parsing.parse_sections(lines, "doc_id", _ALIASES)


@query()
def chunk_sections(spark, sf):
    """Sections to chunks with an index through each document; compared with a plain version in tests."""
    return parsing.chunk_sections(_parsed(spark, sf), "doc_id", 120, 20)


_TABLE = "'TABLE:' || chr(10) || 'Model | WER' || chr(10) || url || ' | 5.1' || chr(10) || 'Our big model | 4'"
_NAMED = "[" + ", ".join(f"CASE WHEN contains(lower(whole), {X.q(w)}) THEN {X.q(w.upper() if len(w) <= 4 else w.title())} END" for w in L.TABLE_METRICS) + "]"


@query(f"""WITH b AS (SELECT page_id AS id, (page_id % 3 + 1)::INTEGER AS page_number, 'Table ' || (page_id % 4)::VARCHAR || ': benchmark results' AS caption, 'Table ' || (page_id % 4)::VARCHAR AS table_label, {_TABLE} AS raw, url FROM pages), w AS (SELECT *, caption || chr(10) || raw AS whole FROM b)
SELECT id, 0 AS table_index, table_label, caption, page_number, md5(whole) AS text_md5, 'results' AS table_type, array_to_string(list_filter({_NAMED}, lambda x: x IS NOT NULL), ',') AS metric_names, array_to_string(list_filter(['Model', trim(url), 'Our big model'], lambda c: length(c) >= 2 AND NOT (regexp_matches(c, '[0-9]') AND len(string_split({X.squeeze('c')}, ' ')) <= 2)), ',') AS model_names,
 CASE page_number WHEN 1 THEN 'method' ELSE 'results' END AS section_name, CASE page_number WHEN 1 THEN '0,1,2' WHEN 2 THEN '0,1,2,3' END AS linked_indexes FROM w""")
def table_artifacts(spark, sf):
    p = table(spark, sf, "pages").withColumn("page_number", (F.col("page_id") % 3 + 1).cast("int"))
    caption = F.concat(F.lit("Table "), (F.col("page_id") % 4).cast("string"), F.lit(": benchmark results"))
    body = F.concat(F.lit("TABLE:\nModel | WER\n"), "url", F.lit(" | 5.1\nOur big model | 4"))
    blocks = p.select(F.col("page_id").alias("id"), "page_number", F.posexplode(F.array(caption, body, F.lit("plain"))).alias("block_index", "text"))
    segs = p.select(F.col("page_id").alias("id"), F.inline(F.array(*[F.struct(F.lit(n).alias("page_number"), F.lit(n - 1).alias("section_order"), F.lit(s).alias("section_name")) for n, s in ((1, "method"), (2, "results"))])))
    rows = parsing.table_artifacts(blocks, segs)
    return rows.select("id", "table_index", "table_label", "caption", "page_number", F.md5("normalized_table_text").alias("text_md5"), "table_type", F.array_join("metric_names", ",").alias("metric_names"), F.array_join("model_names", ",").alias("model_names"), "section_name", "linked_indexes")


# Claims and evidence

_CLAIMS = "cl AS (SELECT item_id AS claim_id, text AS claim_text, [item_id * 3 % 400, item_id * 7 % 450, item_id * 11 % 700] AS ids, (item_id % 5) / 5.0::DOUBLE AS cov, (item_id % 4) / 10.0::DOUBLE AS con FROM benchmark)"


@query(f"""{_RANKED}, {_CLAIMS}, nm AS (SELECT claim_id, list_distinct({X.tokens('claim_text')}) AS own, unnest(ids) AS cid, cov, con FROM cl), mt AS (SELECT nm.*, r.content, r.score, r.rerank_score FROM nm JOIN ranked r ON r.chunk_id = nm.cid),
st AS (SELECT claim_id, count(*) AS n, avg(score) AS s, avg(rerank_score) AS r FROM mt GROUP BY claim_id), tk AS (SELECT claim_id, count(DISTINCT t) AS shared FROM (SELECT claim_id, unnest(list_intersect(own, {X.tokens('content')})) AS t FROM mt) GROUP BY claim_id),
j AS (SELECT cl.claim_id, cov, con, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s, coalesce(r, 0.0) AS r, len(list_distinct({X.tokens('claim_text')})) AS size, coalesce(shared, 0) AS shared FROM cl LEFT JOIN st USING (claim_id) LEFT JOIN tk USING (claim_id)),
o AS (SELECT *, CASE WHEN size = 0 THEN 0.0 ELSE shared / size::DOUBLE END AS ov FROM j)
SELECT claim_id, n AS n_supports, round(ov, 6) AS overlap, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * s + 0.2::DOUBLE * r + 0.2::DOUBLE * ov + 0.1::DOUBLE * cov + 0.1::DOUBLE * (1 - con))), 4) AS confidence, round(least(1.0::DOUBLE, n / 3.0::DOUBLE), 4) AS evidence_coverage,
 ceil(n * con)::INTEGER AS contradiction_count, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * s + 0.5::DOUBLE * r)), 4) AS support_strength, CASE WHEN n > 0 AND ov >= 0.05 THEN 'supported' ELSE 'weak' END AS support_status FROM o""")
def claim_grounding(spark, sf):
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(i.alias("claim_id"), F.col("text").alias("claim_text"), F.array(i * 3 % 400, i * 7 % 450, i * 11 % 700).alias("supporting_chunk_ids"), ((i % 5) / 5.0).alias("cov"), ((i % 4) / 10.0).alias("con"))
    return claims.ground(rows, _annotated(spark, sf), F.col("cov"), F.col("con"))


_KEYS = ["key_ideas", "methods", "results", "discussion"]
_CUES = {"key_ideas": ["the", "token"], "methods": ["und", "license"], "results": ["que", "les"], "discussion": ["ment", "der"]}
_CAVEATS = ["and", "und"]
_CUE_WORDS = sorted({w for ws in _CUES.values() for w in ws})


@query(f"""{_RANKED}, a AS (SELECT paper_id, {X.arr(_KEYS)}[(chunk_id % 4 + 1)::INTEGER] AS section_key, count(*) AS n_chunks, avg(role_confidence) AS c, avg(importance) AS i, sum({X.kwsum('lower(content)', _CAVEATS)})::BIGINT AS caveats, bool_or(coalesce(section_name IN ('conclusion', 'results'), FALSE)) AS closing,
 {', '.join(f"max(contains(lower(content), {X.q(w)})::INT) AS w_{k}" for k, w in enumerate(_CUE_WORDS))} FROM ranked GROUP BY ALL),
h AS (SELECT *, CASE {' '.join(f"WHEN section_key = {X.q(k)} THEN {' + '.join(f'w_{_CUE_WORDS.index(w)}' for w in ws)}" for k, ws in _CUES.items())} END AS hits FROM a),
s AS (SELECT *, n_chunks >= 2 AND c >= 0.45 AND i >= 0.25 AND CASE WHEN section_key IN ('results', 'methods') THEN hits >= 1 WHEN section_key = 'discussion' THEN hits >= 1 OR closing ELSE TRUE END AS sufficient FROM h)
SELECT paper_id, section_key, n_chunks, round(c, 6) AS avg_confidence, round(i, 6) AS avg_importance, hits::INTEGER AS keyword_hits, caveats, sufficient, c >= 0.4 AND caveats <= greatest(3, n_chunks * 2) AS trustworthy, (NOT sufficient OR hits = 0) AND n_chunks < 6 AS retrieve_more FROM s""")
def section_assessment(spark, sf):
    rows = _annotated(spark, sf).withColumn("section_key", F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("chunk_id") % 4 + 1).cast("int"))).withColumn("confidence", F.col("role_confidence"))
    return claims.assess_sections(rows, "paper_id", "section_key", cues=_CUES, caveats=_CAVEATS)


@query(f"""{_RANKED}, b AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS seed_rank FROM ranked ORDER BY score DESC, chunk_id LIMIT 30),
x AS (SELECT *, unnest(range(CASE WHEN role IN ('equation', 'formula', 'evaluation') THEN -1 ELSE 0 END, 2)) AS d FROM b WHERE role IN ('evaluation', 'method', 'problem')),
f AS (SELECT c.chunk_id, x.seed_rank, x.chunk_id AS seed_id, x.score, greatest(0.2::DOUBLE, x.importance - 0.05::DOUBLE) AS importance FROM x JOIN ranked c ON c.paper_id = x.paper_id AND c.chunk_index = x.chunk_index + x.d AND c.section_name IS NOT DISTINCT FROM x.section_name AND c.subsection_name IS NOT DISTINCT FROM x.subsection_name WHERE c.chunk_id NOT IN (SELECT chunk_id FROM b)),
m AS (SELECT chunk_id, min(seed_rank) AS seed_rank, arg_min(seed_id, seed_rank) AS neighbor_for, arg_min(score, seed_rank) AS score, arg_min(importance, seed_rank) AS importance, 'neighbor_context' AS role FROM f GROUP BY chunk_id)
SELECT chunk_id, seed_rank::INTEGER AS seed_rank, NULL::BIGINT AS neighbor_for, score, round(importance, 6) AS importance, role FROM b UNION ALL SELECT chunk_id, seed_rank::INTEGER, neighbor_for, score, round(importance, 6), role FROM m""")
def neighbor_roles(spark, sf):
    rows = _annotated(spark, sf)
    seeds = retrieval.top(rows, 30, F.desc("score"), F.asc("chunk_id")).withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    got = claims.with_neighbors(seeds, chunks(spark, sf, text=False), F.col("role").isin("evaluation", "method", "problem"))
    return got.select("chunk_id", "seed_rank", "neighbor_for", "score", F.round("importance", 6).alias("importance"), "role")


@query(f"SELECT chunk_id, (role IN ('equation', 'formula') OR (role = 'evaluation' AND ({X.any_of('lower(content)', ['wer', 'cer', 'bleu', 'rouge', 'f1', 'accuracy', 'latency', 'error rate', 'perplexity'])} OR regexp_matches(content, '\\b[0-9]+(\\.[0-9]+)?\\s*%'))) OR (role IN ('method', 'algorithm', 'theory') AND len({X.tokens('content')}) <= 40 AND {X.any_of('lower(content)', ['objective', 'loss', 'denotes', 'represents', 'defined as'])})) AS wants FROM (WITH {_ROLE} SELECT * FROM roled)")
def neighbor_seeds(spark, sf):
    return _annotated(spark, sf).select("chunk_id", claims.wants_neighbors(F.col("role"), F.col("content")).alias("wants"))


@query(f"{_ranked('SELECT * FROM alltexts', 'paper_id')}, e AS (SELECT *, bool_or(quality_pass) OVER (PARTITION BY paper_id) AS any_ok, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS nn FROM pick WHERE section_name <> 'references'), s AS (SELECT *, len(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{7,}}'))) + {X.count('content', r'[=<>+\-*/^]|O\(')} + 2 * {X.count('lower(content)', r'\b(for each|while|if|algorithm|procedure|return)\b')} + 2 * {X.count('lower(content)', r'\b(results?|benchmark|comparison|ablation|table|figure)\b')} AS structural FROM e WHERE quality_pass OR NOT any_ok) SELECT paper_id, chunk_id, structural::INTEGER AS structural FROM s QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY importance DESC, structural DESC, chunk_index) <= 12")
def relevant_chunks(spark, sf):
    return claims.relevant_chunks(_annotated(spark, sf), "paper_id").select("paper_id", "chunk_id", "structural")


_FALLBACK = ["token", "license", "und "]


@query(f"{_ranked('SELECT * FROM alltexts', 'paper_id')}, f AS (SELECT *, lower(trim(coalesce(nullif(summary, ''), content))) AS norm FROM pick WHERE section_name IN ('discussion', 'conclusion') OR {X.any_of('lower(content)', _FALLBACK)}), o AS (SELECT * FROM f WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, norm ORDER BY importance DESC, role_confidence DESC, chunk_id) = 1) SELECT paper_id, chunk_id FROM o QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY importance DESC, role_confidence DESC, chunk_id) <= 3")
def discussion_fallback(spark, sf):
    rows = _annotated(spark, sf).withColumn("confidence", F.col("role_confidence"))
    return claims.discussion_fallback(rows, "paper_id", cues=_FALLBACK).select("paper_id", "chunk_id")


@query(f"WITH {X.CHUNKS}, s AS (SELECT chunk_id, {X.score(9)} AS score FROM chunks WHERE paper_id = 1 ORDER BY score DESC, chunk_id LIMIT 12) SELECT chunk_id, score FROM s WHERE chunk_id % 3 <> 0 ORDER BY score DESC, chunk_id LIMIT 5")
def additional_chunks(spark, sf):
    rows = chunks(spark, sf, text=False)
    found = retrieval.scored(rows.filter("paper_id = 1"), retrieval.query_vector(rows, 9, "chunk_id"))
    return claims.additional_chunks(found, rows.filter(F.col("chunk_id") % 3 == 0).select("chunk_id")).select("chunk_id", "score")


# Equations

_LATEX = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' = ' || p_type WHEN 1 THEN 'h + ' || p_name WHEN 2 THEN p_name ELSE '' END"
_EQ = f"""e AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'introduction' ELSE 'results' END AS section_name, {_LATEX} AS latex, (p_size % 7) / 2.0::DOUBLE AS quality_score FROM part)"""
_EQ_SCORE = """round(quality_score + CASE WHEN contains(latex, '=') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(latex, '[+Δ∆×*∈≪≤≥/^]') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(latex), '\\b(w0|ba|ax|h)\\b') THEN 1.4::DOUBLE ELSE 0 END
 + CASE WHEN regexp_matches(lower(latex), 'where |defined as|denotes|represents|composition') THEN 0.7::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(latex, '[A-Za-zΔ∆αβσ_''\\s0-9]+') THEN 0.9::DOUBLE ELSE 0 END, 4)"""


def _equations(spark, sf):
    k = F.col("p_partkey")
    latex = F.when(k % 4 == 0, F.concat("p_name", F.lit(" = "), "p_type")).when(k % 4 == 1, F.concat(F.lit("h + "), "p_name")).when(k % 4 == 2, F.col("p_name")).otherwise("")
    name = F.when(k % 3 == 0, "method").when(k % 3 == 1, "introduction").otherwise("results")
    return table(spark, sf, "part").select("p_partkey", "p_brand", name.alias("section_name"), latex.alias("latex"), ((F.col("p_size") % 7) / 2.0).alias("quality_score"))


@query(f"""WITH {_EQ}, s AS (SELECT *, {_EQ_SCORE} AS equation_score FROM e WHERE trim(latex) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY equation_score DESC, contains(latex, '=')::INT DESC, length(latex) DESC, latex) AS place, max(equation_score) OVER (PARTITION BY p_brand) AS best FROM s)
SELECT p_brand, place::INTEGER AS place, latex, equation_score FROM r WHERE place <= 4 AND (equation_score >= best - 1.5 OR place <= 3)""")
def preferred_equations(spark, sf):
    return claims.preferred_equations(_equations(spark, sf), "p_brand").select("p_brand", "place", "latex", "equation_score")


@query(f"""WITH {_EQ}, s AS (SELECT p_brand, section_name, latex, round(quality_score + CASE section_name WHEN 'method' THEN 0.45 WHEN 'introduction' THEN 0.2 ELSE 0 END::DOUBLE, 4) AS q, lower(trim(latex)) AS norm FROM e),
o AS (SELECT * FROM s WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY p_brand, norm ORDER BY q DESC, contains(latex, '=')::INT DESC, length(latex) DESC, latex, section_name) = 1)
SELECT p_brand, latex, q AS quality_score FROM o QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, contains(latex, '=')::INT DESC, length(latex) DESC, latex, section_name) <= 8""")
def section_equations(spark, sf):
    return claims.equations_by_section(_equations(spark, sf), "p_brand", {"method": 0.45, "introduction": 0.2}).select("p_brand", "latex", "quality_score")


@query("WITH w AS (SELECT doc_id, string_split(text, '.') AS ws FROM documents) SELECT doc_id, len(ws) > 0 AND len(list_filter(ws, lambda s: contains(s, '=') OR regexp_matches(s, '[Δ∆∈×]'))) >= greatest(1, len(ws) // 2) AS equation_like FROM w")
def equation_entries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", claims.look_like_equations(F.split("text", r"\.")).alias("equation_like"))


@query(f"SELECT conv_id, turn, ({X.any_of('lower(text)', ['what is', 'explain', 'overview', 'background', 'in general', 'generally', 'how does'])} OR (NOT {X.any_of('lower(text)', L.FORMULA_QUERY)} AND (turn % 10) / 10.0::DOUBLE < 0.35)) AS allowed FROM conversations")
def background_allowed(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", claims.allows_background(F.col("text"), (F.col("turn") % 10) / 10.0).alias("allowed"))


# Domain views and names

_ARCH = {"Alpha": [r"\bthe\b", r"\balpha\b"], "Beta": [r"\bder\b"], "Gamma": [r"\bque\b"], "Delta": [r"\bles\b"]}
_PROPOSE, _COMPARE = [r"\bof\b", r"\bund\b", r"\blos\b"], [r"\bin\b", r"\bdes\b"]
_BONUS, _STOP = {"Alpha": 0.45, "Gamma": 0.3}, {"Alpha": ["Beta"], "Gamma": ["Delta"]}
# Spark's word boundaries know all letters, DuckDB's only those of ASCII: they are spelled out.
_ANY = lambda ps: "regexp_matches(lower(content), '" + "|".join("(?:" + p.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])", 1)[:-2] + r"(?:[^\p{L}\p{N}_]|$))" for p in ps) + "')"
_LISTED = lambda test: f"coalesce(list(name ORDER BY place) FILTER ({test}), [])"


@query(f"""WITH {_ROLE}, i AS (SELECT section_name, 1.0::DOUBLE + CASE WHEN role IN ('idea', 'method', 'algorithm') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN section_name IN ('abstract', 'introduction', 'method') THEN 0.25::DOUBLE ELSE 0 END AS boost, {_ANY(_PROPOSE)} AS proposes, {_ANY(_COMPARE)} AS compares,
 unnest([{', '.join(f"CASE WHEN {_ANY(ps)} THEN {{'i': {k}, 'name': '{n}', 'bonus': {_BONUS.get(n, 0.0)}::DOUBLE}} END" for k, (n, ps) in enumerate(_ARCH.items()))}]) AS h FROM roled),
s AS (SELECT section_name, h.i AS i, h.name AS name, round(sum(boost + h.bonus), 6) AS m, round(sum(CASE WHEN proposes THEN 1.6::DOUBLE + boost + h.bonus ELSE 0 END), 6) AS p, round(sum(CASE WHEN compares THEN 1.2::DOUBLE + boost ELSE 0 END), 6) AS b FROM i WHERE h IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY round(p * 2 + m - b, 6) DESC, m DESC, i) AS place, p > 0 AND p >= b AS o FROM s), f AS (SELECT *, o OR (NOT bool_or(o) OVER (PARTITION BY section_name) AND place = 1) AS offered FROM r),
k AS (SELECT f.*, offered AND NOT EXISTS (SELECT 1 FROM f g WHERE g.section_name = f.section_name AND g.offered AND g.place < f.place AND ((g.name = 'Alpha' AND f.name = 'Beta') OR (g.name = 'Gamma' AND f.name = 'Delta'))) AS kept FROM f)
SELECT section_name, array_to_string(({_LISTED('kept')})[1:3], ',') AS proposed, array_to_string(({_LISTED('NOT kept AND b > p')})[1:3], ',') AS baseline, array_to_string((list(name ORDER BY place))[1:5], ',') AS mentioned FROM k GROUP BY section_name""")
def architectures(spark, sf):
    rows = domains.architectures(_annotated(spark, sf), "section_name", _ARCH, _PROPOSE, _COMPARE, _BONUS, _STOP)
    return rows.select("section_name", *[F.array_join(c, ",").alias(c) for c in ("proposed", "baseline", "mentioned")])


_KINDS = {"datasets": ["License", "Token", "Absent"], "losses": ["und", "que"], "optimizers": ["ment", "los"]}


@query(f"""WITH v AS (SELECT source, {', '.join(f"list_filter([{', '.join(f'CASE WHEN bool_or(contains(lower(text), {X.q(n.lower())})) THEN {X.q(n)} END' for n in ns)}], lambda x: x IS NOT NULL) AS {k}" for k, ns in _KINDS.items())} FROM documents GROUP BY source)
SELECT source, array_to_string(datasets, ',') AS datasets, nullif(concat_ws(' ', 'Optimizes ' || losses[1], 'with ' || optimizers[1], 'on ' || datasets[1]), '') AS training_objective FROM v""")
def domain_view(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.col("text").alias("content"))
    return domains.training_view(domains.names_view(rows, "source", _KINDS)).select("source", F.array_join("datasets", ",").alias("datasets"), "training_objective")


_SNIP = {"licences": (r"(license[^.]*\.)", 4), "tokens": (r"(token[^.]*\.)", 3)}


@query(f"""WITH h AS ({' UNION ALL '.join(f"SELECT lang, doc_id, '{k}' AS kind, {n} AS most, regexp_extract_all(text, '(?i){p}', 1) AS ms FROM documents" for k, (p, n) in _SNIP.items())}), u AS (SELECT lang, doc_id, kind, most, trim(unnest(ms)) AS m, generate_subscripts(ms, 1) AS i FROM h),
o AS (SELECT lang, kind, most, m, min((doc_id, i)) AS place FROM u WHERE m <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY place, m) AS r FROM o) SELECT lang, kind, md5(string_agg(m, '|' ORDER BY r)) AS snippets_md5 FROM r WHERE r <= most GROUP BY lang, kind""")
def snippets(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "doc_id", F.col("text").alias("content"))
    return domains.snippets(rows, "lang", "doc_id", _SNIP).select("lang", "kind", F.md5(F.array_join("snippets", "|")).alias("snippets_md5"))


_FIRST = lambda text, kinds, default: "CASE " + " ".join(f"WHEN {X.any_of(text, ws)} THEN '{k}'" for k, ws in kinds.items()) + f" ELSE '{default}' END"
_FED = "lower(concat_ws(' ', CASE p_partkey % 9 WHEN 0 THEN 'LSTM' WHEN 1 THEN 'Conformer-L' WHEN 2 THEN 'multi-head Attention' WHEN 3 THEN 'ResNet' WHEN 4 THEN 'speech' WHEN 5 THEN 'BLEU' END, p_name))"
_LOSS = "lower(trim(CASE p_partkey % 7 WHEN 0 THEN 'Cross-Entropy' WHEN 1 THEN ' CTC loss ' WHEN 2 THEN 'my bce' WHEN 3 THEN 'RNNT' WHEN 4 THEN 'L2 loss' WHEN 5 THEN 'AdamW' ELSE 'rmsprop' END))"
_IN = lambda col, words: f"{col} IN ({', '.join(map(X.q, words))})"


@query(f"""WITH n AS (SELECT p_partkey, p_name, {_FED} AS t, {_LOSS} AS l FROM part) SELECT p_partkey, {_FIRST('t', L.MODEL_FAMILIES, 'mlp')} AS model_family, {_FIRST('t', L.TASK_TYPES, 'generic_supervised')} AS task_type,
CASE {' '.join(f"WHEN {_IN('l', [c, *a])} THEN '{c}'" for c, a in L.LOSS_ALIASES.items())} WHEN contains(l, 'ctc') THEN 'ctc' WHEN contains(l, 'bce') THEN 'bce_with_logits' WHEN contains(l, 'mse') THEN 'mse' ELSE 'cross_entropy' END AS loss,
CASE WHEN contains(l, 'adamw') THEN 'adamw' WHEN contains(l, 'sgd') THEN 'sgd' WHEN contains(l, 'rmsprop') THEN 'rmsprop' ELSE 'adam' END AS optimizer,
coalesce(nullif(array_to_string(list_transform(list_filter(string_split(regexp_replace(string_split_regex(trim(p_name), '[:.,;]\\s*')[1], '[^0-9a-zA-Z]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ''), ''), 'GeneratedModel') AS identifier FROM n""")
def canonical_names(spark, sf):
    k = F.col("p_partkey")
    fed = F.when(k % 9 == 0, "LSTM").when(k % 9 == 1, "Conformer-L").when(k % 9 == 2, "multi-head Attention").when(k % 9 == 3, "ResNet").when(k % 9 == 4, "speech").when(k % 9 == 5, "BLEU")
    loss = F.when(k % 7 == 0, "Cross-Entropy").when(k % 7 == 1, " CTC loss ").when(k % 7 == 2, "my bce").when(k % 7 == 3, "RNNT").when(k % 7 == 4, "L2 loss").when(k % 7 == 5, "AdamW").otherwise("rmsprop")
    return table(spark, sf, "part").select("p_partkey", domains.model_family(fed, F.col("p_name")).alias("model_family"), domains.task_type(fed, F.lit(None).cast("string"), F.col("p_name")).alias("task_type"), domains.loss_name(loss).alias("loss"), domains.optimizer_name(loss).alias("optimizer"), domains.identifier(F.col("p_name")).alias("identifier"))


_DOMAIN = "CASE WHEN lower(coalesce(lang, 'general')) IN ('en', 'de') THEN 'ml' WHEN lang = 'fr' THEN 'Systems' ELSE lang END"
_SAFE = f"(CASE WHEN lower(coalesce({_DOMAIN}, 'general')) IN ({', '.join(map(X.q, L.PAPER_DOMAINS))}) THEN lower({_DOMAIN}) ELSE 'general' END)"
_FILE = "CASE doc_id % 4 WHEN 0 THEN '2301.' || lpad(doc_id::VARCHAR, 5, '0') || 'v2' WHEN 1 THEN 'a_b ' || lang WHEN 2 THEN 'Two words' ELSE 'single' END"
_IS_FILE = f"(regexp_matches(t, {X.q(L.FILE_TITLE)}) OR contains(t, '_') OR len(string_split({X.squeeze('t')}, ' ')) <= 1)"


@query(f"""WITH n AS (SELECT doc_id, {_SAFE} AS domain, {_FILE} AS t, text FROM documents), f AS (SELECT *, (list_filter(list_transform({X.lines('text')}, lambda s: {X.squeeze('s')}), lambda s: length(s) BETWEEN 12 AND 200 AND lower(s) NOT IN ('abstract', 'introduction') AND NOT regexp_matches(s, '[@{{]') AND {X.letters('s')} >= 10))[1] AS found FROM n)
SELECT doc_id, domain, CASE WHEN domain = 'ml' THEN 'Machine Learning' ELSE upper(domain[1]) || domain[2:] END AS label, {_IS_FILE} AS file_title, CASE WHEN found IS NOT NULL AND ({_IS_FILE} OR length(found) > length(t)) THEN found WHEN NOT {_IS_FILE} THEN t ELSE 'Conformer' END AS search_title FROM f""")
def titles_and_domains(spark, sf):
    k, lang = F.col("doc_id"), F.col("lang")
    domain = F.when(F.lower(F.coalesce(lang, F.lit("general"))).isin("en", "de"), "ml").when(lang == "fr", "Systems").otherwise(lang)
    t = F.when(k % 4 == 0, F.concat(F.lit("2301."), F.lpad(k.cast("string"), 5, "0"), F.lit("v2"))).when(k % 4 == 1, F.concat(F.lit("a_b "), "lang")).when(k % 4 == 2, "Two words").otherwise("single")
    return table(spark, sf, "documents").select("doc_id", domains.domain_name(domain).alias("domain"), domains.domain_label(domain).alias("label"), domains.file_title(t).alias("file_title"), domains.search_title(t, F.col("text"), F.lit("Conformer")).alias("search_title"))


@query(r"""SELECT page_id, regexp_extract(u, '^https?://[^/]+/([^/]+)/([^/]+)/?$', 1) AS owner, regexp_extract(u, '^https?://[^/]+/([^/]+)/([^/]+)/?$', 2) AS name FROM (SELECT page_id, trim(url) AS u FROM pages) WHERE regexp_matches(u, '^https?://[^/]+/([^/]+)/([^/]+)/?$')""")
def repository_slugs(spark, sf):
    slug = domains.repository_slug(F.col("url"), "[^/]+")
    return table(spark, sf, "pages").select("page_id", slug.alias("s")).filter("s is not null").select("page_id", "s.owner", "s.name")


_RAW = """CASE event_id % 5 WHEN 0 THEN '["a", " ", "b' || event_id::VARCHAR || '"]' WHEN 1 THEN props WHEN 2 THEN 'plain, text' WHEN 3 THEN '' ELSE '"quoted"' END"""


@query(f"""WITH r AS (SELECT event_id, {_RAW} AS v, props FROM events) SELECT event_id, array_to_string(CASE WHEN trim(v) = '' THEN NULL WHEN starts_with(v, '[') THEN list_filter(json_extract_string(v, '$[*]'), lambda x: trim(x) <> '') WHEN starts_with(v, '"') THEN [json_extract_string(v, '$')] ELSE [v] END, '|') AS items,
array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)), ' ') AS flat FROM r""")
def list_fields(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.concat(F.lit('["a", " ", "b'), k.cast("string"), F.lit('"]'))).when(k % 5 == 1, F.col("props")).when(k % 5 == 2, "plain, text").when(k % 5 == 3, "").otherwise('"quoted"')
    return table(spark, sf, "events").select("event_id", F.array_join(domains.list_field(raw), "|").alias("items"), domains.flattened(F.col("props")).alias("flat"))


# Listings


@query("WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS domain FROM customer), l AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey, coalesce(domain, 'general') AS domain, o_orderkey AS analysis FROM n LEFT JOIN l ON o_custkey = c_custkey")
def papers_with_latest(spark, sf):
    papers = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("domain"))
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("analysis"))
    return papers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("domain", F.lit("general")).alias("domain"), "analysis")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 42")
def get_paper(spark, sf):
    return table(spark, sf, "part").filter("p_partkey = 42").select("p_partkey", "p_name", "p_retailprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_partkey = 7 ORDER BY l_discount DESC, l_orderkey, l_linenumber")
def stored_repositories(spark, sf):
    return table(spark, sf, "lineitem").filter("l_partkey = 7").orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS papers FROM nation WHERE n_nationkey % 6 <> 0 GROUP BY n_regionkey")
def papers_by_domain(spark, sf):
    return table(spark, sf, "nation").filter("n_nationkey % 6 <> 0").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("papers"))


@query("WITH p AS (SELECT o_custkey, avg(o_totalprice) AS a, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) SELECT count(*) AS n_papers, sum(n)::BIGINT AS n_repositories, round(avg(a), 4) AS mean_of_means FROM p")
def nested_overview(spark, sf):
    per = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("a"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_papers"), F.sum("n").alias("n_repositories"), F.round(F.avg("a"), 4).alias("mean_of_means"))
