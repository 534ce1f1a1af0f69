"""Registered queries on stored records: re-indexing, chunks in tokens, equations, nested values, scores, hydration, views, plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import nested as N
from ..operators import assess, equations, parsing, reindex
from ..sources.store import IndexStore, shared_folder
from ..sources.tables import table
from . import sql as X
from .catalog import query

# Re-indexing


@query(r"""WITH one AS (SELECT doc_id, max(sha256(coalesce(text, ''))) AS digest, max_by(text, sha256(coalesce(text, ''))) AS text FROM documents GROUP BY doc_id)
SELECT doc_id, digest, CASE WHEN doc_id IS NOT NULL AND regexp_matches(coalesce(text, ''), '\S') THEN 'indexed' ELSE 'failed' END AS status FROM one""")
def reindexed_documents(spark, sf):
    """All documents indexed into a store of their own under the shared folder; a second run finds nothing to do."""
    base = f"{shared_folder(spark)}/siftwell/index-{uuid.uuid4().hex}"
    store = IndexStore(spark, f"{base}/store", key="doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    reindex.reindex(store, docs, f"{base}/one")
    again = reindex.reindex(store, docs, f"{base}/two")
    if again["succeeded"] or again["failed"]:
        raise RuntimeError(f"indexed twice: {again}")
    return store.read("documents").select("doc_id", "digest", "status")


@query()
def chunk_tokens(spark, sf):
    """Chunks of all documents of at most 400 tokens of a public tokenizer."""
    import public_tokenizers

    from ..functions.tokens import TokenCounter

    docs = table(spark, sf, "documents").filter("text is not null")
    none = F.lit(None).cast("string")
    segs = docs.select("doc_id", F.lit(0).alias("section_order"), F.lit("front_matter").alias("section_name"), none.alias("subsection_name"), F.col("text").alias("content"))
    made = parsing.chunk_sections(segs, "doc_id", count=TokenCounter(public_tokenizers.path("word_bpe_49k.json")))
    return made.select("doc_id", "chunk_index", "token_count", F.md5("content").alias("content_md5"))


# Equations


@query()
def section_text_equations(spark, sf):
    """Documents with formulas of their own added, as the corpus has next to none."""
    k = F.col("doc_id").cast("string")
    own = F.concat(F.lit("\nEQUATION: y = W"), k, F.lit(" x + b, where b denotes the shift\nSo h = W0x + "), k, F.lit(" BAx holds; rank = 3\nlearning rate = 0.1"))
    docs = table(spark, sf, "documents").filter("doc_id is not null").select("doc_id", F.concat(F.coalesce("text", F.lit("")), own).alias("text"))
    return equations.section_text_equations(docs.groupBy("doc_id").agg(F.max("text").alias("text")), "doc_id", "text")


_NEAT = "list_filter(list_transform(e, lambda x: trim(replace({}, '[equation]', ''), ' ,;:')), lambda x: x <> '')".format(X.squeeze("x"))


@query(f"""WITH f AS (SELECT doc_id, list_concat({', '.join(f"regexp_extract_all(text, {X.q(p)})" for p in L.CHUNK_EQUATIONS)}) AS e FROM documents), n AS (SELECT doc_id, {_NEAT} AS e FROM f), l AS (SELECT doc_id, e, list_transform(e, lambda x: lower(x)) AS low FROM n)
SELECT doc_id, md5(array_to_string(list_filter(e, lambda x, i: list_position(low, lower(x)) = i), '|')) AS equations_md5, len(list_distinct(low)) AS n FROM l""")
def chunk_equations(spark, sf):
    found = table(spark, sf, "documents").withColumn("e", equations.chunk_equations(F.col("text")))
    return found.select("doc_id", F.md5(F.array_join("e", "|")).alias("equations_md5"), F.size("e").cast("long").alias("n"))


# Nested values

_VALUE = ["{\"id\":", "event_id", ",\"props\":[", "props", ",{\"deep\":{\"list\":[", "props", ",[],null,true,\"a \\\\ \\\"b\\\"\",", "value", "]}},{}],\"type\":\"", "event_type", "\"}"]


@query(f"""WITH v AS (SELECT event_id, concat({', '.join(X.q(x) if i % 2 == 0 else ("coalesce(props, 'null')" if x == 'props' else x if x == 'event_type' else f'floor({x})::BIGINT') for i, x in enumerate(_VALUE))}) AS v FROM events),
l AS (SELECT event_id, j.id AS i, CASE WHEN j.type = 'BOOLEAN' THEN CASE WHEN j.atom::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN j.type IN ('NULL', 'ARRAY', 'OBJECT') THEN '' WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' ELSE j.atom::VARCHAR END AS t FROM v, json_tree(v.v) j WHERE j.type NOT IN ('ARRAY', 'OBJECT') OR j.value::VARCHAR IN ('[]', '{{}}'))
SELECT event_id, md5(string_agg(t, ' ' ORDER BY i)) AS text_md5 FROM l GROUP BY event_id""")
def nested_text(spark, sf):
    cols = [F.lit(x) if i % 2 == 0 else (F.coalesce("props", F.lit("null")) if x == "props" else F.col(x) if x == "event_type" else F.floor(x).cast("string") if x == "value" else F.col(x).cast("string")) for i, x in enumerate(_VALUE)]
    return table(spark, sf, "events").select("event_id", F.md5(N.flattened(F.concat(*cols))).alias("text_md5"))


@query()
def nested_markdown(spark, sf):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('[" a ","",'), F.coalesce("props", F.lit("null")), F.lit(",2]"))).otherwise(F.concat(F.lit("  "), "event_type"))
    return e.select("event_id", N.markdown(value).alias("markdown"))


_SYNTHESES = [
    '{"key_ideas":" text ","methods":{"synthesis":" s ","confidence":"","review_score":3,"review_issues":["a"," ","b "],"warning":" w"},"results":{"fabrication_flagged":true},"discussion":"d"}',
    '{"key_ideas":null,"methods":{"confidence":"high","evidence_chunk_count":7},"results":[1],"discussion":4}',
    '{"methods":null}',
    '["no object"]',
    "no json {",
]


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN ([{', '.join(X.q(v) for v in _SYNTHESES)}])[1 + doc_id % 7] END AS v FROM documents), o AS (SELECT doc_id, CASE WHEN json_valid(v) AND json_type(v) = 'OBJECT' THEN v::JSON END AS v FROM v),
s AS (SELECT doc_id, v, list_filter([{', '.join(f"CASE WHEN json_type(v, '$.{n}') IN ('VARCHAR', 'OBJECT') THEN '{n}' END" for n in L.SYNTHESIS_SECTIONS)}], lambda x: x IS NOT NULL) AS ok FROM o)
SELECT doc_id, CASE WHEN len(ok) = 4 THEN 'success' WHEN len(ok) > 0 THEN 'partial_failure' ELSE 'failed' END AS status, array_to_string(ok, ',') AS ok,
 CASE WHEN json_type(v, '$.methods') = 'OBJECT' THEN trim(coalesce(v ->> '$.methods.synthesis', '')) || '|' || coalesce(nullif(v ->> '$.methods.confidence', ''), 'low') || '|' || coalesce(v ->> '$.methods.review_score', '0') || '|' || coalesce(v ->> '$.methods.evidence_chunk_count', '0') END AS methods FROM s""")
def synthesis_sections(spark, sf):
    value = F.when(F.col("doc_id") % 7 < 5, F.element_at(F.array(*map(F.lit, _SYNTHESES)), (F.col("doc_id") % 7 + 1).cast("int")))
    found = table(spark, sf, "documents").select("doc_id", N.section_syntheses(value, L.SYNTHESIS_SECTIONS).alias("s"))
    status = N.synthesis_status(F.col("s"), L.SYNTHESIS_SECTIONS)
    m = F.col("s.methods")
    told = F.when(m.isNotNull(), F.concat(m["synthesis"], F.lit("|"), m["confidence"], F.lit("|"), m["review_score"].cast("string"), F.lit("|"), m["evidence_chunk_count"].cast("string")))
    return found.withColumn("t", status).select("doc_id", F.col("t.status").alias("status"), F.array_join("t.successful_sections", ",").alias("ok"), told.alias("methods"))


# Reproducibility by domain

_FIELDS = {"training_details": "text", "optimizer": "CASE WHEN doc_id % 3 = 0 THEN source END", "loss": "CASE WHEN doc_id % 4 = 0 THEN lang ELSE ' ' END", "dataset": "CASE doc_id % 5 WHEN 0 THEN 'ImageNet test' WHEN 1 THEN 'own corpus' WHEN 2 THEN '  ' END", "evaluation_metrics": "CASE WHEN doc_id % 2 = 0 THEN 'WER' END", "contributions": "CASE WHEN doc_id % 6 = 0 THEN 'We outperform the baseline by 3.1% and 2% on 7 tasks' END", "architectures": "CASE WHEN doc_id % 7 = 0 THEN 'Transformer' END", "context": "text", "domain": "CASE WHEN doc_id % 2 = 0 THEN 'ML' WHEN doc_id % 3 = 0 THEN 'theory' END", "has_repo": "doc_id % 3 = 1", "has_ideas": "doc_id % 2 = 1", "has_methods": "doc_id % 5 = 3", "has_discussion": "CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 = 2 END"}


def _signal(names: list[str], words: list[str]) -> str:
    if not words:
        return "(" + " OR ".join(f"trim(coalesce({n}, '')) <> ''" for n in names) + ")"
    return X.any_of("lower(concat_ws(' ', " + ", ".join(f"coalesce({n}, '')" for n in names) + "))", words)


def _share(group: str, more: dict[str, str] | None = None) -> str:
    tests = {n: _signal(*rule) for n, rule in L.REPRODUCIBILITY[group].items()}
    for n, t in (more or {}).items():
        tests[n] = t.format(tests.get(n, ""))
    return "round((" + " + ".join(f"({t})::INT" for t in tests.values()) + f") / {len(tests)}.0::DOUBLE, 4)"


_BASE = f"""WITH f AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM documents), t AS (SELECT *, lower(concat_ws(' ', coalesce(contributions, ''), substr(coalesce(context, ''), 1, 2500))) AS results FROM f),
s AS (SELECT *, CASE WHEN trim(coalesce(dataset, '')) <> '' THEN {X.any_of('lower(trim(dataset))', L.PUBLIC_DATASETS)} END AS dataset_available, coalesce(has_repo, FALSE) AS code_available, lower(coalesce(domain, 'general')) = 'ml' AS ml, {_share('hyperparameters')} AS h, {_share('training')} AS t, {_share('evaluation')} AS e,
 {_share('methodology', {'problem_or_idea_present': 'coalesce(has_ideas, FALSE)', 'method_present': 'coalesce(has_methods, FALSE) OR {}', 'limitations_or_discussion': 'coalesce(has_discussion, FALSE) OR {}'})} AS methodology_score,
 {_share('results', {'quantitative_results_present': f"len(regexp_extract_all(regexp_replace(results, '[^{chr(92)}x00-{chr(92)}x7F]', 'x', 'g'), {X.q(L.NUMBERS)})) >= 3".replace('{', '{{').replace('}', '}}')})} AS results_score FROM t),
k AS (SELECT *, CASE WHEN dataset_available IS NULL THEN 0.5 WHEN dataset_available THEN 1.0 ELSE 0.0 END::DOUBLE AS known, code_available::INT::DOUBLE AS c FROM s),
b AS (SELECT *, round(CASE WHEN ml THEN 0.7::DOUBLE * h + (1 - 0.7::DOUBLE) * methodology_score ELSE methodology_score END, 4) AS hyperparameter_completeness, round(CASE WHEN ml THEN 0.7::DOUBLE * t + (1 - 0.7::DOUBLE) * methodology_score ELSE methodology_score END, 4) AS training_detail_score, round(CASE WHEN ml THEN 0.6::DOUBLE * e + (1 - 0.6::DOUBLE) * results_score ELSE results_score END, 4) AS evaluation_protocol_score FROM k)
SELECT doc_id, dataset_available, code_available, round(c * 0.6::DOUBLE + known * 0.4::DOUBLE, 4) AS artifact_score, methodology_score, results_score, hyperparameter_completeness, training_detail_score, evaluation_protocol_score,
 floor((known * 0.2::DOUBLE + c * 0.25::DOUBLE + hyperparameter_completeness * 0.2::DOUBLE + training_detail_score * 0.2::DOUBLE + evaluation_protocol_score * 0.15::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000 AS overall_score FROM b"""


@query(_BASE)
def reproducibility_scores(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", *[F.expr(v).alias(k) for k, v in _FIELDS.items()])
    return assess.reproducibility_scores(rows, ["doc_id"])


# Stored structure

_ITEM = {"paper_id": "doc_id % 40", "id": "CASE WHEN doc_id % 3 = 0 THEN (doc_id - doc_id % 80)::VARCHAR WHEN doc_id % 3 = 1 THEN 'gone' END", "chunk_index": "CASE WHEN doc_id % 5 > 0 THEN (doc_id % 11)::VARCHAR ELSE 'x' END", "text": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'said ' WHEN 2 THEN 'own text' END", "summary": "CASE WHEN doc_id % 4 < 3 THEN ' said' END", "source": "CASE WHEN doc_id % 6 = 0 THEN 'stored' END"}
_CHUNK = {"paper_id": "doc_id % 40", "chunk_id": "doc_id", "chunk_index": "doc_id % 7", "content": "text"}
_BTRIM = "trim(coalesce({}, ''), chr(9) || chr(10) || chr(13) || ' ')"


@query(f"""WITH i AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _ITEM.items())} FROM documents), c AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CHUNK.items())} FROM documents WHERE doc_id % 40 <> 7 AND doc_id IS NOT NULL),
x AS (SELECT paper_id, chunk_index, max(chunk_id) AS chunk_id, arg_max(content, chunk_id) AS content FROM c GROUP BY ALL), j AS (SELECT i.*, a.chunk_id AS a_id, a.content AS a_text, x.chunk_id AS x_id, x.content AS x_text, i.paper_id IN (SELECT paper_id FROM c) AS has FROM i LEFT JOIN c a ON a.paper_id = i.paper_id AND a.chunk_id::VARCHAR = i.id LEFT JOIN x ON x.paper_id = i.paper_id AND x.chunk_index = TRY_CAST(i.chunk_index AS BIGINT)),
m AS (SELECT *, a_id IS NOT NULL OR x_id IS NOT NULL AS met, {_BTRIM.format('text')} AS t, {_BTRIM.format('summary')} AS s, trim(coalesce(CASE WHEN a_id IS NOT NULL THEN a_text ELSE x_text END, ''), chr(9) || chr(10) || chr(13) || ' ') AS whole FROM j)
SELECT doc_id, CASE WHEN met THEN coalesce(a_id, x_id)::VARCHAR ELSE id END AS id, md5(CASE WHEN has THEN coalesce(nullif(CASE WHEN met AND (t = '' OR t = s) THEN whole ELSE t END, ''), s) ELSE text END) AS text_md5, CASE WHEN has THEN coalesce(source, CASE WHEN met THEN 'extracted' ELSE 'inferred' END) ELSE source END AS source FROM m""")
def hydrate_structure(spark, sf):
    docs = table(spark, sf, "documents")
    of = lambda x: F.expr(x.replace("::VARCHAR", "::STRING"))
    items = docs.select("doc_id", *[of(v).alias(k) for k, v in _ITEM.items()])
    chunks = docs.filter("doc_id % 40 <> 7").select(*[of(v).alias(k) for k, v in _CHUNK.items()])
    return assess.hydrate_structure(items, chunks).select("doc_id", "id", F.md5("text").alias("text_md5"), "source")


@query()
def domain_views(spark, sf):
    """Views of papers made of documents, the domain by the source, with words of the corpus in place of cue words."""
    names = list(L.DOMAIN_VIEWS)
    domain = F.element_at(F.array(*map(F.lit, [*names, "general"])), (F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(6)) + 1).cast("int"))
    rows = table(spark, sf, "documents").select(F.pmod(F.col("doc_id"), F.lit(300)).alias("paper_id"), "doc_id", domain.alias("domain"), F.col("text").alias("content"), F.lit("method").alias("role"), F.lit("method").alias("section_name"))
    one = rows.withColumn("domain", F.first("domain").over(Window.partitionBy("paper_id").orderBy("doc_id")))
    kinds = {"theorems": (r"(license[^.]*\.)", 4), "system_components": (r"(token[^.]*\.)", 3)}
    return assess.domain_views(one, "paper_id", "doc_id", kinds=kinds, contributions=(r"(copyright[^.]*\.|reserved[^.]*\.)", 5)).select("paper_id", "view", "field", F.md5(F.array_join("items", "|")).alias("items_md5"))


# Repositories, questions, numbers


@query("""WITH r AS (SELECT p_brand, p_partkey AS seq, rtrim('https://github.com/a/' || (p_partkey % 13) || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END, '/') AS url, p_type AS source, (p_size % 10) / 10.0::DOUBLE AS confidence FROM part),
o AS (SELECT p_brand, url, min(seq) AS first, arg_max(struct_pack(source := source, confidence := confidence, seq := seq), (confidence, -seq)) AS m FROM r GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS place FROM o QUALIFY place <= 5),
t AS (SELECT *, round(least(1.0::DOUBLE, m.confidence + (m.seq % 7) / 10.0::DOUBLE), 4) AS trust FROM f), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY trust DESC, place) = 1), a AS (SELECT p_brand, string_agg(url, ' ' ORDER BY trust DESC, place) AS urls FROM t GROUP BY p_brand)
SELECT b.p_brand, a.urls, b.url AS primary_repo, CASE WHEN trust >= 0.75 THEN 'clone_existing_repo' WHEN trust >= 0.55 THEN 'review_repo_then_generate' ELSE 'use_generated_scaffold' END AS recommended_action FROM b JOIN a USING (p_brand)""")
def recommended_repositories(spark, sf):
    url = F.concat(F.lit("https://github.com/a/"), (F.col("p_partkey") % 13).cast("string"), F.when(F.col("p_size") % 2 == 0, "/").otherwise(""))
    rows = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("seq"), url.alias("url"), F.col("p_type").alias("source"), ((F.col("p_size") % 10) / 10.0).alias("confidence"))
    trust = F.round(F.least(F.lit(1.0), F.col("confidence") + (F.col("seq") % 7) / 10.0), 4)
    found = assess.recommend_repositories(rows, "p_brand", trust)
    return found.select("p_brand", F.array_join(F.transform("repositories", lambda x: x["url"]), " ").alias("urls"), "primary_repo", "recommended_action")


_WANTED = ["methodology", "dataset", "comparison", "limitations", "evaluation", "reproducibility", "other"]


@query(f"""WITH w AS (SELECT conv_id, turn, text, list_filter([{', '.join(f"CASE WHEN ((conv_id + turn) >> {i}) % 2 = 1 THEN '{n}' END" for i, n in enumerate(_WANTED))}], lambda x: x IS NOT NULL) AS e, CASE WHEN turn % 3 = 0 THEN 'simple' ELSE 'medium' END AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN c = 'simple' THEN 'direct' ELSE 'guided' END AS strategy, array_to_string(list_transform(e, lambda x, i: 'task_' || i || ':' || coalesce({X.case('x', L.SUBTASK_TITLES, 'NULL')}, upper(x[1]) || substr(x, 2)) || ':' || x || ':' || CASE WHEN i <= 2 THEN 'high' ELSE 'medium' END), ';') AS subtasks, {X.any_of('lower(text)', L.CODE_INTENT)} AS code_intent FROM w""")
def default_plan(spark, sf):
    t = table(spark, sf, "conversations")
    wanted = F.filter(F.array(*[F.when(F.shiftright(F.col("conv_id") + F.col("turn"), i) % 2 == 1, F.lit(n)) for i, n in enumerate(_WANTED)]), lambda x: x.isNotNull())
    plan = assess.default_plan(F.col("text"), F.when(F.col("turn") % 3 == 0, "simple").otherwise("medium"), wanted)
    line = lambda s: F.concat_ws(":", s["subtask_id"], s["title"], s["evidence_types"][0], s["priority"])
    return t.withColumn("plan", plan).select("conv_id", "turn", F.col("plan.strategy").alias("strategy"), F.array_join(F.transform("plan.subtasks", line), ";").alias("subtasks"), assess.has_code_intent(F.col("text")).alias("code_intent"))


@query(r"""SELECT p_partkey, coalesce(nullif(TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+)\s*(?:wpm|word pieces|wordpiece|vocabulary)', 1), '') AS INT), 0), CASE WHEN NOT contains(lower(p_brand), 'speech') AND NOT contains(lower(p_type), 'asr') THEN 10 END) AS width FROM (SELECT *, p_name || CASE p_partkey % 4 WHEN 0 THEN ' a vocabulary' WHEN 1 THEN ' with ' || p_partkey || ' word pieces' WHEN 2 THEN ' 0 WPM' ELSE '' END AS t FROM part)""")
def output_width(spark, sf):
    k = F.col("p_partkey")
    text = F.concat("p_name", F.when(k % 4 == 0, " a vocabulary").when(k % 4 == 1, F.concat(F.lit(" with "), k.cast("string"), F.lit(" word pieces"))).when(k % 4 == 2, " 0 WPM").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", assess.output_width(text, F.col("p_brand"), F.col("p_type")).alias("width"))


# Rules and words that occur in the invented corpus.
_RULES = [(["password", "secret"], "hinge", 0.9, "of secrets"), (["license"], "contrastive", 0.75, "of licences"), ([" der ", " que "], "masked language", 0.5, "of words")]
_MADE = ["license", "copyright", "token", "de la"]


@query(f"""WITH d AS (SELECT doc_id, source, lang, text, CASE WHEN doc_id % 7 = 0 THEN 'CTC' END AS loss, CASE WHEN doc_id % 2 = 0 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS sure, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS low FROM documents),
m AS (SELECT *, CASE WHEN loss IS NOT NULL THEN 0 {' '.join(f"WHEN {X.any_of('low', r[0])} THEN {i}" for i, r in enumerate(_RULES, 1))} END AS rule FROM d),
f AS (SELECT *, CASE rule WHEN 0 THEN loss {' '.join(f"WHEN {i} THEN '{r[1]}'" for i, r in enumerate(_RULES, 1))} END AS found FROM m), o AS (SELECT *, lower(coalesce(source || ' ', '') || coalesce(lang, '') || ' ' || coalesce(found, '')) AS told FROM f)
SELECT doc_id, found AS loss, coalesce(rule > 0, false) AS loss_inferred, CASE rule WHEN 0 THEN CASE WHEN sure = 0 THEN 1.0::DOUBLE ELSE sure END {' '.join(f"WHEN {i} THEN {r[2]}::DOUBLE" for i, r in enumerate(_RULES, 1))} END AS loss_confidence,
array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(coalesce(text, '')), {X.q(w)}) THEN {X.q(w.title())} END" for w in _MADE)}], lambda x: x IS NOT NULL), ',') AS augmentations,
CASE WHEN contains(told, 'speech') THEN '{L.SPEECH_OBJECTIVE}' WHEN contains(told, 'contrastive') THEN '{L.CONTRASTIVE_OBJECTIVE}' WHEN contains(told, 'mask') AND contains(told, 'language') THEN '{L.MASKED_OBJECTIVE}' WHEN found IS NOT NULL THEN '{L.OTHER_OBJECTIVE}' || found END AS objective FROM o""")
def training_details(spark, sf):
    """Losses, augmentations and objectives told by whole texts, some of the losses stated."""
    none, k = F.lit(None).cast("string"), F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(k % 7 == 0, "CTC").alias("loss"), F.lit(None).cast("boolean").alias("loss_inferred"), F.when(k % 2 == 0, 0.0).otherwise(0.6).alias("loss_confidence"), none.alias("architecture"),
        F.array_compact(F.array("source")).alias("proposed"), none.alias("details"), F.col("lang").alias("dataset"), none.alias("objective"), "text",
    )
    found = assess.training_details(rows, _RULES, _MADE, None)
    return found.select("doc_id", "loss", "loss_inferred", "loss_confidence", F.array_join("augmentations", ",").alias("augmentations"), "objective")
