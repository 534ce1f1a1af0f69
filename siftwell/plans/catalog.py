"""The registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import queries as Q
from ..functions import structure as S
from ..functions import text as T
from ..operators import annotate, conversation, documents, evidence, retrieval
from ..sources.tables import chunks, section_of, table
from . import sql as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROLES = list(L.TEST_ROLES)
MARKERS = ["the", "und", "les"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Vector search


@query(f"WITH {X.CHUNKS} SELECT chunk_id, section_name, {X.score(0)} AS score FROM chunks ORDER BY score DESC, chunk_id LIMIT 20")
def semantic_search(spark, sf):
    rows = chunks(spark, sf, text=False)
    return retrieval.search(rows, retrieval.query_vector(rows, 0, "chunk_id"), 20).select("chunk_id", "section_name", "score")


@query(f"""WITH {X.CHUNKS} SELECT chunk_id, section_name, subsection_name, {X.score(7)} AS score FROM chunks
WHERE section_name IN ('method', 'results') AND (subsection_name IN ('part 1') OR subsection_name IS NULL) ORDER BY score DESC, chunk_id LIMIT 10""")
def scoped_semantic_search(spark, sf):
    rows = chunks(spark, sf, text=False)
    return retrieval.search(rows, retrieval.query_vector(rows, 7, "chunk_id"), 10, sections=["method", "results"], subsections=["part 1", None]).select("chunk_id", "section_name", "subsection_name", "score")


@query(f"WITH {X.CHUNKS} SELECT chunk_id, chunk_index, {X.score(3)} AS score FROM chunks WHERE paper_id = 2 ORDER BY score DESC, chunk_id LIMIT 6")
def paper_search(spark, sf):
    rows = chunks(spark, sf, text=False)
    return retrieval.search(rows, retrieval.query_vector(rows, 3, "chunk_id"), 6, paper_id=2).select("chunk_id", "chunk_index", "score")


@query(f"""WITH {X.CHUNKS}, found AS (SELECT *, {X.score(0)} AS score FROM chunks ORDER BY score DESC, chunk_id LIMIT 20),
subs AS (SELECT paper_id, section_name, subsection_name, min(chunk_index // 5 + 1)::INTEGER AS page_number FROM chunks GROUP BY ALL)
SELECT f.chunk_id, f.score, s.page_number FROM found f LEFT JOIN subs s ON f.paper_id = s.paper_id AND f.section_name IS NOT DISTINCT FROM s.section_name AND f.subsection_name IS NOT DISTINCT FROM s.subsection_name""")
def search_with_page(spark, sf):
    rows = chunks(spark, sf, text=False)
    subs = rows.select("paper_id", "section_name", "subsection_name", (F.floor(F.col("chunk_index") / 5) + 1).cast("int").alias("page_number"))
    return retrieval.with_page(retrieval.search(rows, retrieval.query_vector(rows, 0, "chunk_id"), 20), subs).select("chunk_id", "score", "page_number")


_PRIOR = "CASE " + " ".join(f"WHEN section_name = {X.q(k)} THEN {v}::DOUBLE" for k, v in L.SECTION_PRIORS["method"].items()) + " ELSE 0.1 END"


@query(f"""WITH {X.CHUNKS}, s AS (SELECT *, {X.score(0)} AS score FROM chunks), v AS (SELECT *, round(0.7::DOUBLE * score + 0.3::DOUBLE * {_PRIOR}, 6) AS value FROM s WHERE section_name <> 'references')
SELECT chunk_id, section_name, score, value FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY section_name ORDER BY value DESC, chunk_id) = 1) ORDER BY value DESC, chunk_id LIMIT 3""")
def section_topk(spark, sf):
    rows = chunks(spark, sf, text=False)
    return retrieval.best_sections(retrieval.scored(rows, retrieval.query_vector(rows, 0, "chunk_id")), "method", 3).select("chunk_id", "section_name", "score", "value")


_WEIGHT = X.case("section_name", L.SECTION_WEIGHTS, "1.0")


@query(f"""WITH {X.CHUNKS}, s AS (SELECT *, {X.score(0)} AS score FROM chunks), w AS (SELECT *, round(score * ({_WEIGHT})::DOUBLE, 6) AS weighted FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY section_name ORDER BY weighted DESC, chunk_id) > 2)::INTEGER AS extra FROM w)
SELECT chunk_id, section_name, weighted, extra FROM r ORDER BY extra, weighted DESC, chunk_id LIMIT 24""")
def subsection_quota(spark, sf):
    rows = chunks(spark, sf, text=False)
    return retrieval.quota(retrieval.scored(rows, retrieval.query_vector(rows, 0, "chunk_id")), 2, 24).select("chunk_id", "section_name", "weighted", "extra")


_TYPE = "CASE " + " ".join(f"WHEN {X.any_of('lower(content)', w)} THEN {X.q(t)}" for t, w in L.TABLE_TYPES.items()) + " ELSE 'other' END"


@query(f"""WITH {X.TEXTS}, t AS (SELECT chunk_id AS table_id, {X.score(5)} AS score, 'Table ' || (chunk_id % 9)::VARCHAR AS table_label, CASE WHEN chunk_id % 4 = 0 THEN 'c' END AS caption, {_TYPE} AS table_type, content AS text FROM texts),
v AS (SELECT *, round(score + CASE WHEN lower(table_label) = 'table 2' THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN table_type = 'results' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN caption IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END, 6) AS value FROM t)
SELECT table_id, table_label, table_type, value FROM v ORDER BY value DESC, length(text) DESC, table_id LIMIT 12""")
def table_rank(spark, sf):
    rows = chunks(spark, sf)
    scored = retrieval.scored(rows, retrieval.query_vector(rows, 5, "chunk_id"))
    tables = scored.select(F.col("chunk_id").alias("table_id"), "score", F.concat(F.lit("Table "), (F.col("chunk_id") % 9).cast("string")).alias("table_label"), F.when(F.col("chunk_id") % 4 == 0, "c").alias("caption"), T.table_type(F.col("content")).alias("table_type"), F.col("content").alias("text"))
    return retrieval.rank_tables(tables, "Which benchmark results are in Table 2?", 12).select("table_id", "table_label", "table_type", "value")


# Text features


@query(f"WITH d AS (SELECT doc_id, text, {X.words('text')} AS n_words, {X.citations('text')} AS cite, {X.table_density('text')} AS rows FROM documents) SELECT doc_id, n_words::INTEGER AS n_words, {X.quality('text')} AS quality_score FROM d")
def quality_score(spark, sf):
    rows = annotate.with_quality(annotate.text_features(table(spark, sf, "documents"), "text"), "text")
    return rows.select("doc_id", F.col("f_words").alias("n_words"), "quality_score")


@query(f"SELECT doc_id, round({X.citations('text')}, 6) AS citation_density FROM documents")
def citation_density(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.citation_density(F.col("text")), 6).alias("citation_density"))


@query(f"SELECT doc_id, round({X.table_density('text')}, 6) AS table_density FROM documents")
def table_density(spark, sf):
    return annotate.text_features(table(spark, sf, "documents"), "text").select("doc_id", F.round("f_table", 6).alias("table_density"))


@query(f"SELECT doc_id, round({X.technical('text')}, 6) AS technical_density FROM documents")
def technical_density(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.technical_density(F.col("text")), 6).alias("technical_density"))


_S = X.signals("text")


@query(f"SELECT doc_id, {_S['equation']} AS equation, {_S['pseudo']} AS pseudocode, {_S['result']} AS result, {_S['metric']} AS metric FROM documents")
def content_signals(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.equation_signal(t).alias("equation"), T.pseudocode_signal(t).alias("pseudocode"), T.result_signal(t).alias("result"), T.metric_signal(t).alias("metric"))


@query(f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages),
l AS (SELECT *, {X.lines('t')} AS ls FROM h), n AS (SELECT *, len(list_filter(ls, lambda r: length(r) <= 18)) AS short FROM l)
SELECT page_id, CASE WHEN t = '' THEN FALSE WHEN starts_with(t, 'TABLE:') THEN TRUE WHEN len(ls) < 6 THEN FALSE ELSE short >= greatest(4, len(ls) // 2) AND ({X.digits('t')} >= 4 OR regexp_matches(lower(ls[1]), '\\btable\\s+[0-9]+')) END AS table_like,
CASE {" ".join(f"WHEN {X.any_of('lower(t)', w)} THEN {X.q(k)}" for k, w in L.TABLE_TYPES.items())} ELSE 'other' END AS table_type FROM n""")
def table_payload(spark, sf):
    t = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "\n"), r"^\s+|\s+$", "")
    return table(spark, sf, "pages").select("page_id", T.table_payload(t).alias("table_like"), T.table_type(t).alias("table_type"))


_LEX = ["the", "und", "que", "license", "token", "absent"]


@query(f"SELECT doc_id, array_to_string(list_filter({X.arr(_LEX)}, lambda w: contains(lower(text), w)), ',') AS hits FROM documents")
def lexicon_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.lexicon_hits(F.col("text"), _LEX), ",").alias("hits"))


@query("""SELECT DISTINCT label, CASE label WHEN 0 THEN 'references' WHEN 1 THEN 'related_work' ELSE 'proposed_method_' || label::VARCHAR END AS name FROM embeddings""")
def section_names(spark, sf):
    raw = F.when(F.col("label") == 0, " Works  Cited").when(F.col("label") == 1, "Related_Works").otherwise(F.concat(F.lit("Proposed  METHOD "), F.col("label").cast("string")))
    return table(spark, sf, "embeddings").select("label").distinct().select("label", T.section_name(raw).alias("name"))


# Roles, importance, rerank, selection

_AT = "coalesce(CASE WHEN subsection_name IS NOT NULL THEN replace(subsection_name, ' ', '_') END, section_name)"
_ROLE = f"""{X.TEXTS}, sc AS (SELECT *, {_AT} AS eff, {X.roles('content', _AT, L.TEST_ROLES)} FROM texts),
rk AS (SELECT *, list_reverse_sort([{", ".join("s_" + r for r in ROLES)}]) AS ranked FROM sc),
cf AS (SELECT *, greatest(0.2::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + (ranked[1] - ranked[2]) + least(0.35::DOUBLE, ranked[1] / 4))) AS conf, {X.first_best([(r, "s_" + r) for r in ROLES])} AS top,
  CASE {" ".join(f"WHEN eff = {X.q(k)} THEN " + X.first_best([(n, "s_" + n if n in ROLES else "0.0::DOUBLE") for n in names]) for k, names in L.SECTION_ROLE_PRIORS.items())} END AS prior FROM rk),
roled AS (SELECT *, CASE WHEN coalesce(eff = 'related_work', FALSE) OR ranked[1] <= 0.01 THEN 'other' WHEN conf < 0.6 AND prior IS NOT NULL THEN prior ELSE top END AS role,
  round(CASE WHEN coalesce(eff = 'related_work', FALSE) OR ranked[1] <= 0.01 THEN 0.25::DOUBLE WHEN conf < 0.6 AND prior IS NOT NULL THEN greatest(conf, 0.45::DOUBLE) ELSE conf END, 4) AS role_confidence FROM cf)"""
_C = X.signals("content")
_IMPORTANCE = f"""weighed AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN section_name IN ('abstract', 'introduction', 'conclusion', 'discussion') THEN 0.45::DOUBLE WHEN section_name IN ('method', 'methodology', 'algorithm', 'evaluation', 'results', 'experiment') THEN 0.37 ELSE 0.25 END
  + CASE WHEN chunk_index / greatest(1, n - 1)::DOUBLE <= 0.15 THEN 0.15::DOUBLE WHEN chunk_index / greatest(1, n - 1)::DOUBLE >= 0.9 THEN 0.12 ELSE 0 END + least(0.3::DOUBLE, {X.technical('content')} * 0.6::DOUBLE)
  + CASE WHEN {_C['equation']} THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {_C['pseudo']} THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {_C['result']} THEN 0.08::DOUBLE ELSE 0 END)), 4) AS importance FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS n FROM roled))"""
_MATCH = "CASE WHEN role IN ('method', 'algorithm') THEN 1.0::DOUBLE WHEN role IN ('implementation', 'idea') THEN 0.3 ELSE 0.0 END"
_RANKED = f"""WITH {_ROLE}, {_IMPORTANCE}, feat AS (SELECT *, {X.score(0)} AS score, {X.words('content')} AS n_words, {X.citations('content')} AS cite, {X.table_density('content')} AS rows FROM weighed),
ranked AS (SELECT * EXCLUDE (ranked), {X.quality('content')} AS quality_score, round(0.5::DOUBLE * score + 0.3::DOUBLE * {_MATCH} + 0.2::DOUBLE * importance, 4) AS rerank_score FROM feat)"""


def _annotated(spark, sf):
    rows = chunks(spark, sf)
    # Dealt by paper, for the window over its few chunks, before all that is costly: a broadcast join leaves the chunks in the few files
    # that hold their ids, and the work with them in as few tasks.
    scored = retrieval.scored(rows, retrieval.query_vector(rows, 0, "chunk_id")).repartition("paper_id")
    return retrieval.rerank(annotate.annotated(scored, ("paper_id",), L.TEST_ROLES, ROLES), "method")


@query(f"WITH {_ROLE} SELECT chunk_id, role, role_confidence FROM roled")
def chunk_role(spark, sf):
    return _annotated(spark, sf).select("chunk_id", "role", "role_confidence")


@query(f"WITH {_ROLE}, {_IMPORTANCE} SELECT chunk_id, importance FROM weighed")
def chunk_importance(spark, sf):
    return _annotated(spark, sf).select("chunk_id", "importance")


@query(f"{_RANKED} SELECT chunk_id, role, score, importance, rerank_score FROM ranked ORDER BY rerank_score DESC, score DESC, importance DESC, chunk_index, chunk_id LIMIT 36")
def rerank_score(spark, sf):
    order = [F.desc("rerank_score"), F.desc("score"), F.desc("importance"), F.asc("chunk_index"), F.asc("chunk_id")]
    return retrieval.top(_annotated(spark, sf), 36, *order).select("chunk_id", "role", "score", "importance", "rerank_score")


@query(f"""{_RANKED}, p AS (SELECT *, role <> 'other' AND n_words >= 40 AS ok FROM ranked), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY paper_id) AS any_ok FROM p),
k AS (SELECT * FROM a WHERE ok OR NOT any_ok), b AS (SELECT *, max(score) OVER (PARTITION BY paper_id) AS best FROM k)
SELECT chunk_id, paper_id, score, quality_score FROM b WHERE NOT ((quality_score <= -0.5 AND score < best - 0.01) OR (quality_score <= -0.2 AND score < best - 0.05))""")
def quality_gate(spark, sf):
    rows = _annotated(spark, sf).withColumn("quality_pass", (F.col("role") != "other") & (T.word_count(F.col("content")) >= 40))
    return retrieval.gate(rows, group=("paper_id",)).select("chunk_id", "paper_id", "score", "quality_score")


@query(f"""{_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY rerank_score DESC, score DESC, importance DESC, chunk_index, chunk_id) AS sr, max(rerank_score) OVER (PARTITION BY section_name) AS sb FROM ranked),
t AS (SELECT *, CASE WHEN sr <= 3 AND rerank_score >= sb - 0.12::DOUBLE AND quality_score > -0.2 THEN 0 WHEN quality_score > -0.1 AND importance > 0.1 THEN 1 END AS tier FROM r)
SELECT chunk_id, section_name, tier, rerank_score FROM t WHERE tier IS NOT NULL ORDER BY tier, rerank_score DESC, score DESC, importance DESC, chunk_index, chunk_id LIMIT 40""")
def balanced_select(spark, sf):
    return retrieval.balanced_select(_annotated(spark, sf), 40).select("chunk_id", "section_name", "tier", "rerank_score")


@query(f"WITH {_ROLE} SELECT role, count(*) AS n, round(avg(role_confidence), 6) AS avg_confidence FROM roled GROUP BY role")
def role_histogram(spark, sf):
    return _annotated(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("role_confidence"), 6).alias("avg_confidence"))


_BUCKET = {"problem": "key_ideas", "idea": "key_ideas", "method": "methods", "theory": "methods", "evaluation": "results", "discussion": "discussion"}


@query()
def inferred_buckets_by_summary(spark, sf):
    """Chunks of one summary count once."""
    return retrieval.buckets(_annotated(spark, sf).withColumn("bucket", T.lookup(F.col("role"), _BUCKET, None))).select("bucket", "chunk_id", "importance")


# Documents

_LINES = "lines AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) - 1 AS pos FROM documents)"
_OPENS = "(starts_with(line, 'The ') OR starts_with(line, 'Und ') OR contains(line, 'icense'))"
_NAME = "CASE WHEN starts_with(line, 'The ') THEN 'method' WHEN starts_with(line, 'Und ') THEN 'results' ELSE 'references' END"
_SEGMENTS = f"""{_LINES}, m AS (SELECT doc_id, pos, rtrim(line) AS line, {_OPENS} AS opens FROM lines),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run, CASE WHEN opens THEN {_NAME} END AS name FROM m),
g AS (SELECT doc_id, run, max(name) AS name, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT opens AND trim(line) <> ''), '') AS content FROM r GROUP BY doc_id, run),
seg AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INTEGER AS section_order, coalesce(name, 'front_matter') AS section_name, content FROM g WHERE trim(content) <> '')"""


def _segments(spark, sf):
    line = F.col("line")
    opens = line.startswith("The ") | line.startswith("Und ") | F.contains(line, F.lit("icense"))
    name = F.when(line.startswith("The "), "method").when(line.startswith("Und "), "results").otherwise("references")
    return documents.segments(documents.document_lines(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", opens, name)


@query(f"WITH {_SEGMENTS} SELECT doc_id, section_order, section_name, md5(content) AS content_md5 FROM seg")
def segment_lines(spark, sf):
    return _segments(spark, sf).select("doc_id", "section_order", "section_name", F.md5("content").alias("content_md5"))


@query(f"WITH {_SEGMENTS} SELECT doc_id, section_name, min(section_order)::INTEGER AS first_order, count(*) AS n_parts, md5(string_agg(content, chr(10) || chr(10) ORDER BY section_order)) AS content_md5 FROM seg GROUP BY doc_id, section_name")
def section_merge(spark, sf):
    return documents.merged(_segments(spark, sf), "doc_id", "section_name").select("doc_id", "section_name", "first_order", "n_parts", F.md5("content").alias("content_md5"))


@query(f"WITH {_SEGMENTS}, s AS (SELECT *, CASE WHEN section_order % 3 > 0 THEN 'sub ' || (section_order % 3)::VARCHAR END AS sub FROM seg) SELECT doc_id, section_name, sub, min(section_order)::INTEGER AS first_order, count(*) AS n_parts FROM s GROUP BY ALL")
def subsection_merge(spark, sf):
    rows = _segments(spark, sf).withColumn("sub", F.when(F.col("section_order") % 3 > 0, F.concat(F.lit("sub "), (F.col("section_order") % 3).cast("string"))))
    return documents.merged(rows, "doc_id", "section_name", "sub").select("doc_id", "section_name", "sub", "first_order", "n_parts")


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(rtrim(line), 'icense|token') THEN rtrim(line) END AS l FROM lines)
SELECT doc_id, pos::INTEGER AS pos, md5(coalesce(lag(l, 4) OVER w, lag(l, 3) OVER w, lag(l, 2) OVER w, lag(l, 1) OVER w, lead(l, 1) OVER w, lead(l, 2) OVER w, lead(l, 3) OVER w, lead(l, 4) OVER w)) AS caption_md5 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def caption_window(spark, sf):
    rows = documents.captions(documents.document_lines(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "pos", "line", "icense|token")
    return rows.select("doc_id", "pos", F.md5("caption").alias("caption_md5"))


_PAGED = f"{_SEGMENTS}, s AS (SELECT doc_id AS id, (section_order * 2) % 7 + section_order // 2 AS page_number, section_order, section_name FROM seg), t AS (SELECT doc_id AS id, doc_id AS table_id, doc_id % 9 AS page_number FROM documents)"


def _paged(spark, sf):
    segs = _segments(spark, sf).select(F.col("doc_id").alias("id"), ((F.col("section_order") * 2) % 7 + F.floor(F.col("section_order") / 2)).alias("page_number"), "section_order", "section_name")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("table_id"), (F.col("doc_id") % 9).alias("page_number")), segs


@query(f"""WITH {_PAGED}, j AS (SELECT t.id, t.table_id, t.page_number, s.page_number AS sp, s.section_order, s.section_name FROM t LEFT JOIN s ON t.id = s.id AND s.page_number <= t.page_number)
SELECT table_id, coalesce(arg_min(section_name, section_order) FILTER (sp = page_number), arg_max(section_name, section_order)) AS section_name FROM j GROUP BY table_id""")
def table_location_asof(spark, sf):
    tables, segs = _paged(spark, sf)
    return documents.locate(tables, segs).select("table_id", "section_name")


@query(f"""WITH {_PAGED}, o AS (SELECT DISTINCT t.table_id, greatest(0, s.section_order + d.d) AS o FROM t JOIN s ON t.id = s.id AND t.page_number = s.page_number, (SELECT unnest(range(-2, 3)) AS d) d)
SELECT table_id, string_agg(o::VARCHAR, ',' ORDER BY o) AS linked_indexes FROM o GROUP BY table_id""")
def linked_indexes(spark, sf):
    tables, segs = _paged(spark, sf)
    return documents.linked(tables, segs).select("table_id", "linked_indexes")


@query()
def chunk_pack(spark, sf):
    return documents.pack_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunk_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.summary(F.col("text")).alias("summary"))


@query(r"""WITH e AS (SELECT doc_id, list_concat(regexp_extract_all(text, '([A-Za-z0-9_]+\s*=\s*[^.;\n]{6,180})', 1), regexp_extract_all(text, '(O\([^)]{1,80}\))', 1)) AS f FROM documents),
u AS (SELECT doc_id, list_filter(list_transform(f, lambda x: lower(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ ,;:]+|[ ,;:]+$', '', 'g'))), lambda x: x <> '') AS f FROM e)
SELECT doc_id, len(list_distinct(f))::INTEGER AS n, f[1] AS first FROM u WHERE len(f) > 0""")
def equation_extract(spark, sf):
    found = evidence.equations(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", found.alias("f")).filter(F.size("f") > 0).select("doc_id", F.size("f").alias("n"), F.element_at("f", 1).alias("first"))


# Evidence

_SEEDS = f"{X.CHUNKS}, s AS (SELECT *, {X.score(0)} AS score FROM chunks), seeds AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS seed_rank FROM s ORDER BY score DESC, chunk_id LIMIT 30)"


@query(f"""WITH {_SEEDS}, f AS (SELECT c.chunk_id, x.seed_rank, x.chunk_id AS seed_id FROM seeds x JOIN chunks c ON c.paper_id = x.paper_id AND c.chunk_index BETWEEN x.chunk_index - 5 AND x.chunk_index + 5 AND c.subsection_name IS NOT DISTINCT FROM x.subsection_name AND c.section_name IS NOT DISTINCT FROM x.section_name
WHERE c.chunk_id NOT IN (SELECT chunk_id FROM seeds)) SELECT chunk_id, arg_min(seed_id, seed_rank) AS seed_id FROM f GROUP BY chunk_id""")
def neighbor_expand(spark, sf):
    rows = chunks(spark, sf, text=False)
    best = retrieval.search(rows, retrieval.query_vector(rows, 0, "chunk_id"), 30)
    seeds = best.withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    return retrieval.neighbors(seeds, rows, 5, 5)


@query("""WITH w AS (SELECT user_id, event_id, sum(value::INTEGER % 97 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events) SELECT * FROM w WHERE running <= 300""")
def context_budget(spark, sf):
    e = table(spark, sf, "events").withColumn("tokens", F.rint("value").cast("int") % 97 + 1)
    return retrieval.within_budget(e, ("user_id",), [F.asc("ts"), F.asc("event_id")], F.col("tokens"), 300).select("user_id", "event_id", "running")


_COVER = {f: f"max((role IN ({', '.join(map(X.q, L.EVIDENCE[f]['roles']))}) OR section_name IN ({', '.join(map(X.q, L.EVIDENCE[f]['sections']))}) OR {X.any_of('lower(content)', L.EVIDENCE[f]['keywords'])})::INT)" for f in ("methodology", "limitations")}


@query(f"""{_RANKED}, a AS (SELECT paper_id, count(*) AS n_chunks, avg(score) AS s, avg(len({X.tokens('content')})) AS w, count(DISTINCT section_name) AS ns, count(DISTINCT role) AS nr, sum({X.kwsum('lower(content)', MARKERS)}) AS h, {_COVER['methodology']} + {_COVER['limitations']} AS c FROM ranked GROUP BY paper_id),
d AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s * 0.55::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, w / 90.0::DOUBLE)) * 0.45::DOUBLE)) AS density,
 least(1.0::DOUBLE, 0.5::DOUBLE * least(1.0::DOUBLE, ns / 3.0::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, nr / 4.0::DOUBLE)) AS diversity, least(1.0::DOUBLE, h / greatest(1, n_chunks * 3)::DOUBLE) AS contradiction, c / 2.0::DOUBLE AS coverage FROM a)
SELECT paper_id, n_chunks, round(density, 4) AS density, round(diversity, 4) AS diversity, round(contradiction, 4) AS contradiction, round(coverage, 4) AS coverage,
 round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * s + 0.25::DOUBLE * diversity + 0.15::DOUBLE * (1 - contradiction))), 4) AS strength, (density < 0.45 OR coverage < 1 OR contradiction > 0.3) AS wants_retry FROM d""")
def evidence_diagnostics(spark, sf):
    return evidence.diagnostics(_annotated(spark, sf), "paper_id", ["methodology", "limitations"], 3, MARKERS)


@query()
def claim_overlap_all(spark, sf):
    """Every claim against every document; the pairs that share a token."""
    return evidence.claim_overlaps(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query(f"""WITH c AS (SELECT item_id, list_distinct({X.tokens('text')}) AS own FROM benchmark), d AS (SELECT doc_id, list_distinct({X.tokens('text')}) AS has FROM documents),
p AS (SELECT item_id, doc_id, len(own) AS n, len(list_intersect(own, has)) AS shared FROM c, d)
SELECT item_id, doc_id, round(shared / n::DOUBLE, 6) AS overlap FROM p WHERE n > 0 AND 100 * shared >= 50 * n""")
def claim_supporters(spark, sf):
    """Every claim against every document; the pairs that share half the claim's words."""
    return evidence.claim_supporters(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query(f"""{_RANKED}, a AS (SELECT paper_id, section_name, avg(score) AS s, avg(rerank_score) AS r, avg(importance) AS o FROM ranked GROUP BY paper_id, section_name)
SELECT paper_id, section_name, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * s + 0.2::DOUBLE * r + 0.2::DOUBLE * o + 0.1::DOUBLE * 0.5::DOUBLE + 0.1::DOUBLE * (1 - 0.25::DOUBLE))), 4) AS confidence FROM a""")
def claim_confidence(spark, sf):
    a = _annotated(spark, sf).groupBy("paper_id", "section_name").agg(F.avg("score").alias("s"), F.avg("rerank_score").alias("r"), F.avg("importance").alias("o"))
    return a.select("paper_id", "section_name", evidence.claim_confidence(F.col("s"), F.col("r"), F.col("o"), F.lit(0.5), F.lit(0.25)).alias("confidence"))


@query("""WITH s AS (SELECT p_partkey, p_size % 4 AS missing, p_size % 5 + 1 AS required, (p_size % 11) / 10.7::DOUBLE AS supported, (p_partkey % 7) / 6.3::DOUBLE AS confidence, p_partkey % 3 AS subtasks, p_partkey % 3 + 1 AS level, (p_partkey % 9) / 8.9::DOUBLE AS coverage, (p_partkey % 5) / 10.3::DOUBLE AS contradiction, p_partkey % 2 = 0 AS addressed FROM part),
a AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - missing / greatest(1, required)::DOUBLE)) AS comp, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * supported + 0.4::DOUBLE * confidence)) AS grd FROM s),
b AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * subtasks + 0.25::DOUBLE * level / 3 + 0.25::DOUBLE * comp)) AS dep, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN addressed THEN 1 - contradiction ELSE 0.8::DOUBLE - 0.5::DOUBLE * contradiction END)) AS han FROM a),
c AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * grd + 0.35::DOUBLE * coverage + 0.25::DOUBLE * han)) AS rig FROM b)
SELECT p_partkey, round(comp, 4) AS completeness, round(grd, 4) AS grounding, round(dep, 4) AS depth, round(han, 4) AS handling, round(rig, 4) AS rigor,
 CASE WHEN grd < 0.45 OR coverage < 0.45 THEN 'insufficient' WHEN grd < 0.6 OR coverage < 0.6 OR comp < 0.6 THEN 'needs_review' WHEN grd < 0.75 OR rig < 0.7 THEN 'sufficient' ELSE 'strong' END AS status FROM c""")
def answer_evaluation(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    cols = evidence.evaluation(size % 4, size % 5 + 1, (size % 11) / 10.7, (k % 7) / 6.3, k % 3, k % 3 + 1, (k % 9) / 8.9, (k % 5) / 10.3, k % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", *cols)


# Questions and conversations

_INTENTS = {"definition": ["the ", "what is"], "method": ["and ", "how"], "evaluation": ["in ", "en "], "theory": ["que", "der "], "comparison": ["of ", "und "]}


@query("SELECT item_id, " + f"CASE WHEN {' + '.join(X.kwsum('lower(text)', w) for w in _INTENTS.values())} = 0 THEN 'method' ELSE {X.first_best([(k, X.kwsum('lower(text)', w)) for k, w in _INTENTS.items()])} END AS intent FROM benchmark")
def query_intent(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", Q.intent(F.col("text"), _INTENTS).alias("intent"))


_CX = f"""(len({X.tokens('text')}) >= 14)::INT + (len({X.tokens('text')}) >= 24)::INT + ({X.kwsum('lower(text)', L.CLAUSES)} >= 1)::INT + ({X.kwsum('lower(text)', L.CLAUSES)} >= 2)::INT + ({X.kwsum('lower(text)', L.COMPARISONS)} > 0)::INT + ({X.kwsum('lower(text)', L.CRITIQUES)} > 0)::INT + ({X.count('text', '[,:;]')} >= 2)::INT"""


@query(f"WITH s AS (SELECT conv_id, turn, text, {_CX} AS complexity FROM conversations WHERE role = 'user') SELECT conv_id, turn, complexity::INTEGER AS complexity, CASE WHEN complexity >= 5 THEN 'complex' WHEN complexity >= 3 THEN 'medium' ELSE 'simple' END AS label FROM s")
def query_complexity(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'").withColumn("complexity", Q.complexity_score(F.col("text")))
    return c.select("conv_id", "turn", "complexity", Q.complexity_label(F.col("complexity")).alias("label"))


@query(f"""WITH k AS (SELECT doc_id, lower(text) AS low, CASE doc_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'evaluation' WHEN 2 THEN 'comparison' ELSE 'theory' END AS kind FROM documents),
l AS (SELECT doc_id, list_concat(CASE WHEN kind = 'method' THEN ['methodology'] WHEN kind = 'evaluation' THEN ['evaluation', 'dataset'] WHEN kind = 'comparison' THEN ['comparison', 'evaluation'] ELSE [] END,
 CASE WHEN {X.any_of('low', ['dataset', 'benchmark', 'corpus'])} AND kind <> 'evaluation' THEN ['dataset'] ELSE [] END, CASE WHEN {X.any_of('low', ['reproduc', 'repository', 'code'])} THEN ['reproducibility'] ELSE [] END, CASE WHEN {X.any_of('low', ['limitation', 'weakness', 'future work'])} THEN ['limitations'] ELSE [] END) AS r FROM k)
SELECT doc_id, array_to_string(CASE WHEN len(r) = 0 THEN ['evaluation'] ELSE r END, ',') AS required FROM l""")
def required_evidence(spark, sf):
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "method").when(k == 1, "evaluation").when(k == 2, "comparison").otherwise("theory")
    return table(spark, sf, "documents").select("doc_id", F.array_join(Q.required_evidence(F.col("text"), kind), ",").alias("required"))


_KEPT = "k AS (SELECT conv_id, turn, lower(trim(role)) AS role, text FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant') AND " + X.squeeze("text") + " <> '')"
_SAID = lambda who: f"last_value(CASE WHEN role = '{who}' THEN {X.truncate('text', 420)} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {_KEPT}, b AS (SELECT *, {_SAID('user')} AS u, {_SAID('assistant')} AS a FROM k), f AS (SELECT conv_id, turn, {X.squeeze('text')} AS t, u, a, {X.follow_up('text')} AND (u IS NOT NULL OR a IS NOT NULL) AS follows FROM b WHERE role = 'user')
SELECT conv_id, turn, follows AS is_follow_up, CASE WHEN follows THEN concat_ws(' | ', 'Previous question: ' || u, CASE WHEN {X.any_of('lower(t)', L.REFERENCED_ANSWER)} THEN 'Referenced answer: ' || {X.truncate('a', 240)} END, 'Follow-up question: ' || t) ELSE t END AS rewritten FROM f""")
def followup_rewrite(spark, sf):
    return conversation.rewrite_follow_ups(table(spark, sf, "conversations"))


# Analysis

_DOM = {d: f"round(sum({X.kwsum('lower(text)', w)} / {float(len(w))}::DOUBLE)" + (f" + {L.DOMAIN_ROLE_PRIORS[d][1]}::DOUBLE * avg((role = '{L.DOMAIN_ROLE_PRIORS[d][0]}')::INT::DOUBLE)" if d in L.DOMAIN_ROLE_PRIORS else "") + f", 6) AS k_{d}" for d, w in L.TEST_DOMAINS.items()}
_RANK = "list_reverse_sort([0.25::DOUBLE, " + ", ".join(f"k_{d}" for d in L.TEST_DOMAINS) + "])"


@query(f"""WITH r AS (SELECT source, text, CASE doc_id % 3 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'theory' ELSE 'discussion' END AS role FROM documents), s AS (SELECT source, {', '.join(_DOM.values())} FROM r GROUP BY source)
SELECT source, CASE WHEN ({_RANK})[1] < 0.4 THEN 'general' ELSE {X.first_best([('general', '0.25::DOUBLE')] + [(d, f'k_{d}') for d in L.TEST_DOMAINS])} END AS domain, round(CASE WHEN ({_RANK})[1] < 0.4 THEN 0.35::DOUBLE ELSE greatest(0.2::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + ({_RANK})[1] - ({_RANK})[2])) END, 4) AS confidence FROM s""")
def domain_detect(spark, sf):
    k = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select("source", "text", F.when(k == 0, "evaluation").when(k == 1, "theory").otherwise("discussion").alias("role"))
    return evidence.detect_domain(rows, "source", L.TEST_DOMAINS)


@query("""SELECT p_partkey, round(0.2::DOUBLE * CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE + 0.25::DOUBLE * (p_size % 2)::DOUBLE + 0.2::DOUBLE * ((p_partkey % 5) / 4.0::DOUBLE) + 0.2::DOUBLE * ((p_partkey % 5) / 4.0::DOUBLE) + 0.15::DOUBLE * ((p_partkey % 3) / 2.0::DOUBLE), 4) AS overall FROM part""")
def repro_score(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    dataset = F.when(size % 3 == 1, F.lit(True)).when(size % 3 == 2, F.lit(False))
    return table(spark, sf, "part").select("p_partkey", evidence.reproducibility(dataset, size % 2, (k % 5) / 4.0, (k % 3) / 2.0).alias("overall"))


@query(r"""WITH u AS (SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '(https?://[^\s<>"'']+)', 1), lambda u: regexp_replace(u, '[.,);\]]+$', '')))) AS urls FROM pages) SELECT page_id, len(urls)::INTEGER AS n_urls, array_to_string(urls, ' ') AS urls FROM u""")
def url_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", evidence.urls(F.col("html")).alias("u")).select("page_id", F.size("u").alias("n_urls"), F.array_join("u", " ").alias("urls"))


@query(r"""WITH r AS (SELECT regexp_replace(url || CASE WHEN page_id % 3 = 0 THEN '.' WHEN page_id % 3 = 1 THEN ');' ELSE '' END, '[.,);\]]+$', '') AS url, CASE page_id % 3 WHEN 0 THEN 'paper_link' WHEN 1 THEN 'paperswithcode' ELSE 'github_search' END AS source, (page_id % 11) / 10.0::DOUBLE AS confidence, page_id AS seq FROM pages)
SELECT url, source, confidence FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY confidence DESC, seq) = 1""")
def repo_url_dedupe(spark, sf):
    k = F.col("page_id") % 3
    rows = table(spark, sf, "pages").select(F.concat("url", F.when(k == 0, ".").when(k == 1, ");").otherwise("")).alias("url"), F.when(k == 0, "paper_link").when(k == 1, "paperswithcode").otherwise("github_search").alias("source"), ((F.col("page_id") % 11) / 10.0).alias("confidence"), F.col("page_id").alias("seq"))
    return evidence.dedupe_repositories(rows)


@query()
def repo_score(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 3).alias("k"), (F.col("p_size") * 50).alias("stars"))
    both = evidence.similarity(rows, "p_name", "p_type", "title")
    source = F.when(F.col("k") == 0, "paper_link").when(F.col("k") == 1, "paperswithcode").otherwise("github_search")
    score = evidence.repo_confidence(F.col("title"), F.lit(0.0), source, F.col("stars"))
    return both.select("p_partkey", score.alias("confidence"), evidence.recommend(score).alias("action"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_analysis(spark, sf):
    return retrieval.latest(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH d AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS domain) SELECT d.domain, count(x.doc_id) AS n FROM d LEFT JOIN documents x ON x.lang = d.domain GROUP BY d.domain")
def domain_counts(spark, sf):
    wanted = spark.createDataFrame([(d,) for d in ("en", "de", "fr", "es", "it")], "domain string")
    found = table(spark, sf, "documents").groupBy("lang").agg(F.count("doc_id").alias("n"))
    return wanted.join(found, F.col("domain") == F.col("lang"), "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def paginate(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(10).select("o_orderkey", "o_orderdate")


@query("SELECT source, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS avg_quality, round(avg(n_chars), 4) AS avg_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def corpus_overview(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', doc_id::VARCHAR, lang, source, text)), 'token')")
def text_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.contains(F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source", "text")), F.lit("token"))).select("doc_id")


# Further operators

_QF, _QT = X.any_of("lower(text)", L.FORMULA_QUERY), X.any_of("lower(text)", L.TABLE_QUERY)
_LACK = lambda terms: f"list_filter({X.arr(terms)}, lambda t: NOT contains(lower({X.squeeze('text')}), t))[1:4]"


@query(f"""SELECT conv_id, turn, CASE WHEN {_QF} THEN 'equation_extraction' WHEN {_QT} THEN 'table_extraction' WHEN {X.any_of('lower(text)', L.LITERAL_QUERY)} THEN 'literal_extraction' ELSE 'standard' END AS mode, {X.any_of('lower(text)', L.REFERENCE_QUERY)} AS about_references,
CASE WHEN {X.squeeze('text')} <> '' AND len({_LACK(L.TABLE_EXPANSION)}) > 0 THEN {X.squeeze('text')} || ' | focus on ' || array_to_string({_LACK(L.TABLE_EXPANSION)}, '; ') ELSE {X.squeeze('text')} END AS expanded FROM conversations""")
def query_modes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.response_mode(t).alias("mode"), Q.is_reference_query(t).alias("about_references"), Q.expanded(t, F.lit(True), L.TABLE_EXPANSION).alias("expanded"))


_MORE = lambda terms: f"{X.squeeze('text')} || CASE WHEN trim({X.squeeze('text')}) <> '' AND len({_LACK(terms)}) > 0 THEN ' | focus on ' || array_to_string({_LACK(terms)}, '; ') ELSE '' END"
#: Questions of each kind, made of benchmark texts, as conversations hold hardly any.
_ASKED = "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Which formula, or objective: ' WHEN 1 THEN 'Show me the table of ' ELSE '' END || text AS text FROM benchmark"


@query(f"""WITH asked AS ({_ASKED} UNION ALL SELECT conv_id + 1000000, text FROM conversations WHERE role = 'user')
SELECT item_id, CASE WHEN {_QF} THEN {_MORE(L.FORMULA_EXPANSION)} WHEN {_QT} THEN {_MORE(L.TABLE_EXPANSION)} ELSE {X.squeeze('text')} END AS expanded FROM asked""")
def expanded_questions(spark, sf):
    """Benchmark texts asked as questions, and all questions of conversations, expanded by their kind."""
    kind = F.when(F.col("item_id") % 3 == 0, "Which formula, or objective: ").when(F.col("item_id") % 3 == 1, "Show me the table of ").otherwise("")
    asked = table(spark, sf, "benchmark").select("item_id", F.concat(kind, "text").alias("text"))
    turns = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") + 1000000).alias("item_id"), "text")
    return asked.unionByName(turns).select("item_id", Q.expanded_by_mode(F.col("text")).alias("expanded"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform({X.lines('text')}, lambda s: {X.squeeze('s')}), lambda s: length(s) BETWEEN 12 AND 200 AND lower(s) NOT IN ('abstract', 'introduction') AND NOT regexp_matches(s, '[@{{]') AND {X.letters('s')} >= 10) AS t FROM documents) SELECT doc_id, t[1] AS title FROM l""")
def title_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


@query(f"""WITH s AS (SELECT doc_id, {X.squeeze("regexp_replace(replace(text, chr(0), ' '), '(?i)' || chr(92) || 'bEQUATION:' || chr(92) || 's*', '[equation] ', 'g')")} AS s FROM documents),
m AS (SELECT doc_id, s, regexp_replace(s, '([.!?]) ([A-Z0-9\\[])', '\\1' || chr(1) || '\\2') AS x FROM s),
a AS (SELECT doc_id, CASE WHEN regexp_matches(s, '^[A-Z0-9\\[]') THEN s WHEN instr(x, chr(1)) > 0 THEN substr(x, instr(x, chr(1)) + 1) END AS a FROM m)
SELECT doc_id, md5(CASE WHEN NOT ({' OR '.join(f"starts_with(lower(a), {X.q(p)})" for p in ('figure', 'fig.', 'table', 'eq.', 'equation:', 'index terms:'))}) AND NOT regexp_matches(a, '^[0-9\\s+\\-*/^=<>()\\[\\]{{}}|.,:;%]+$') THEN a END) AS content_md5 FROM a""")
def chunk_sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.sanitized(F.col("text"))).alias("content_md5"))


@query()
def claim_units(spark, sf):
    return table(spark, sf, "documents").select("doc_id", documents.claim_units(F.col("text")).alias("units")).select("doc_id", F.size("units").alias("n_units"))


_SEEN = ["license", "token", "the", "und", "que", "ment"]


@query(f"""WITH h AS (SELECT source, doc_id AS o, unnest(range(1, {len(_SEEN) + 1})) AS i, lower(text) AS low FROM documents), f AS (SELECT source, {X.arr(_SEEN)}[i] AS w, min((o, i)) AS m FROM h WHERE contains(low, {X.arr(_SEEN)}[i]) GROUP BY ALL)
SELECT source, array_to_string((list(w ORDER BY m))[1:4], ',') AS found FROM f GROUP BY source""")
def metric_first_seen(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return evidence.first_seen(rows, "source", F.col("doc_id"), _SEEN, 4)


@query(f"""{_RANKED}, u AS (SELECT chunk_id, importance, role_confidence, score FROM ranked WHERE section_name IN ('results', 'method') UNION ALL SELECT chunk_id, importance, role_confidence, score FROM ranked WHERE role = 'evaluation'),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY importance DESC, role_confidence DESC, score DESC, chunk_id) = 1) SELECT chunk_id, importance, score FROM o ORDER BY importance DESC, role_confidence DESC, score DESC, chunk_id LIMIT 10""")
def merge_evidence(spark, sf):
    rows = _annotated(spark, sf).select("chunk_id", "section_name", "role", "importance", "role_confidence", "score")
    # Both parts are of the same rows, which are annotated once.
    parts = [rows.filter(F.col("section_name").isin("results", "method") | (F.col("role") == "evaluation"))]
    return evidence.merge_ranked(parts, "chunk_id", [F.desc("importance"), F.desc("role_confidence"), F.desc("score"), F.asc("chunk_id")], 10).select("chunk_id", "importance", "score")


@query("""WITH i AS (SELECT page_id AS item_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS chunk_id, page_id % 20 AS chunk_index, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 = 1 THEN '' END AS text FROM pages), x AS (SELECT doc_id % 25 AS k, arg_min(text, doc_id) AS t FROM documents GROUP BY 1)
SELECT i.item_id, md5(coalesce(nullif(i.text, ''), d.text, x.t)) AS text_md5 FROM i LEFT JOIN documents d ON d.doc_id = i.chunk_id LEFT JOIN x ON x.k = i.chunk_index""")
def hydrate_items(spark, sf):
    p = F.col("page_id")
    items = table(spark, sf, "pages").select(p.alias("item_id"), F.when(p % 2 == 0, p).alias("chunk_id"), (p % 20).alias("chunk_index"), F.when(p % 5 == 0, F.col("url")).when(p % 5 == 1, "").alias("text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("c"), (F.col("doc_id") % 25).alias("chunk_index"), F.col("text").alias("content")).withColumnRenamed("c", "chunk_id")
    return evidence.hydrate(items, rows).select("item_id", F.md5("text").alias("text_md5"))


@query("""SELECT source, count(*) AS n, count_if(doc_id % 3 <> 0) AS n_ok, CASE WHEN count_if(doc_id % 3 <> 0) = count(*) THEN 'success' WHEN count_if(doc_id % 3 <> 0) > 0 THEN 'partial_failure' ELSE 'failed' END AS status FROM documents GROUP BY source""")
def analysis_status(spark, sf):
    a = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 != 0).alias("n_ok"))
    return a.select("source", "n", "n_ok", evidence.status(F.col("n_ok"), F.col("n")).alias("status"))


@query("""SELECT p_partkey, round(least(1.0::DOUBLE, (p_size % 10) / 20.3::DOUBLE + CASE WHEN p_size % 3 = 0 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 300 > 50 THEN least(0.15::DOUBLE, (p_partkey % 300) / 5000.0::DOUBLE) ELSE 0 END), 4) AS trust FROM part""")
def repo_trust(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    value = evidence.trust((size % 10) / 20.3, F.when(size % 3 == 0, 1.0).otherwise(0.0), F.lit(0.0), k % 4 == 0, F.lit(False), k % 5 == 0, k % 7 == 0, k % 300)
    return table(spark, sf, "part").select("p_partkey", value.alias("trust"))


@query(r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(lower(props), '([0-9]+(\.[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM events""")
def parse_number(spark, sf):
    return table(spark, sf, "events").select("event_id", T.number(F.col("props"), r"([0-9]+(\.[0-9]+)?)").alias("number"))


@query("""SELECT p_partkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN p_size % 6 = 5 THEN p_size / 40.0::DOUBLE END, CASE p_size % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.2 END::DOUBLE, 0.5::DOUBLE))) AS confidence FROM part""")
def coerce_confidence(spark, sf):
    k = F.col("p_size") % 6
    said = F.when(k == 0, " Very High").when(k == 1, "high").when(k == 2, "MEDIUM").when(k == 3, "very low").when(k == 5, (F.col("p_size") / 40.0).cast("string"))
    return table(spark, sf, "part").select("p_partkey", T.confidence(said).alias("confidence"))


from . import analysis, records  # noqa: E402,F401  (register their queries)
