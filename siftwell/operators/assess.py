"""Reproducibility by domain, hydration of stored structure, domain views, repositories, the plan of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from . import domains, evidence

# Reproducibility


def signals(fields: dict[str, Column], rules: dict) -> dict[str, dict[str, Column]]:
    """Per group of rules, its signals: whether any of the fields holds any of the words, or, without words, anything at all."""
    def one(names: list[str], words: list[str]) -> Column:
        if not words:
            return T.total([(F.trim(F.coalesce(fields[n].cast("string"), F.lit(""))) != "").cast("int") for n in names]) > 0
        return T.contains_any(F.lower(F.concat_ws(" ", *[F.coalesce(fields[n].cast("string"), F.lit("")) for n in names])), words)

    return {group: {name: one(*rule) for name, rule in of.items()} for group, of in rules.items()}


def share(of: dict[str, Column]) -> Column:
    return F.round(T.total([c.cast("int") for c in of.values()]) / len(of), 4)


def reproducibility_scores(rows: DataFrame, keep: list[str], context: int = 2500) -> DataFrame:
    """rows (domain, training_details, optimizer, loss, dataset, evaluation_metrics, contributions, architectures, context as text; has_repo,
    has_ideas, has_methods, has_discussion as truth) with every part of the score and the total. For papers on machine
    learning, the parts blend their own signals with those that hold for all. What is missing is no text, or false."""
    f = {c: F.col(c) for c in ("training_details", "optimizer", "loss", "dataset", "evaluation_metrics", "contributions", "architectures")}
    told = F.concat_ws(" ", F.coalesce("contributions", F.lit("")), F.substring(F.coalesce("context", F.lit("")), 1, context))
    f["results"] = F.lower(told)
    found = signals(f, L.REPRODUCIBILITY)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    found["methodology"] = {
        "problem_or_idea_present": flag("has_ideas"), "method_present": flag("has_methods") | found["methodology"]["method_present"], "implementation_clues": found["methodology"]["implementation_clues"],
        "limitations_or_discussion": flag("has_discussion") | found["methodology"]["limitations_or_discussion"],
    }
    found["results"]["quantitative_results_present"] = T.matches(f["results"], L.NUMBERS) >= 3
    dataset = F.trim(F.coalesce("dataset", F.lit("")))
    available = F.when(dataset != "", T.contains_any(F.lower(dataset), L.PUBLIC_DATASETS))
    known = F.when(available.isNull(), 0.5).when(available, 1.0).otherwise(0.0)
    parts = {n: share(of) for n, of in found.items()}
    one = rows.withColumns({"dataset_available": available, "code_available": flag("has_repo"), **{f"{n}_score": c for n, c in parts.items()}})
    ml = F.lower(F.coalesce("domain", F.lit("general"))) == "ml"
    blend = lambda own, common, a: F.round(F.when(ml, a * F.col(own) + (1 - a) * F.col(common)).otherwise(F.col(common)), 4)
    two = one.withColumns({
        "artifact_score": F.round(F.col("code_available").cast("double") * 0.6 + known * 0.4, 4), "hyperparameter_completeness": blend("hyperparameters_score", "methodology_score", 0.7),
        "training_detail_score": blend("training_score", "methodology_score", 0.7), "evaluation_protocol_score": blend("evaluation_score", "results_score", 0.6),
    })
    total = known * 0.2 + F.col("code_available").cast("double") * 0.25 + F.col("hyperparameter_completeness") * 0.2 + F.col("training_detail_score") * 0.2 + F.col("evaluation_protocol_score") * 0.15
    names = ["dataset_available", "code_available", "artifact_score", "methodology_score", "results_score", "hyperparameter_completeness", "training_detail_score", "evaluation_protocol_score"]
    return two.select(*keep, *names, T.rounded(total, 4).alias("overall_score"))


# Stored structure


def hydrate_structure(items: DataFrame, chunks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Items (key, id, chunk_index, text, summary, source and others) with the full text of their chunk (key, chunk_id, chunk_index,
    content) of the same paper: that of their id, else that of their index. It takes the place of a text that is missing or no more than
    the summary. Items of a paper without chunks stay as they are; of chunks with one index the one with the greatest id counts."""
    by_id = chunks.groupBy(F.col(key).alias("i_key"), F.col("chunk_id").cast("string").alias("i_id")).agg(F.max("content").alias("i_text"))
    by_index = chunks.groupBy(F.col(key).alias("x_key"), F.col("chunk_index").cast("long").alias("x_index")).agg(F.max_by(F.struct(F.col("chunk_id").cast("string").alias("id"), "content"), "chunk_id").alias("x"))
    papers = chunks.select(F.col(key).alias("p_key")).distinct().withColumn("p_has", F.lit(True))
    at = F.col("chunk_index").cast("string").try_cast("long")
    found = items.join(by_id, (F.col(key) == F.col("i_key")) & (F.col("id").cast("string") == F.col("i_id")), "left").join(by_index, (F.col(key) == F.col("x_key")) & (at == F.col("x_index")), "left").join(papers, F.col(key) == F.col("p_key"), "left")
    met = F.col("i_id").isNotNull() | F.col("x").isNotNull()
    bare = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" \t\n\r"))
    whole = F.btrim(F.when(F.col("i_id").isNotNull(), F.coalesce("i_text", F.lit(""))).otherwise(F.coalesce("x.content", F.lit(""))), F.lit(" \t\n\r"))
    full = F.when(met & ((bare("text") == "") | (bare("text") == bare("summary"))), whole).otherwise(bare("text"))
    out = found.withColumns({
        "id": F.when(met, F.coalesce("i_id", "x.id")).otherwise(F.col("id").cast("string")), "text": F.when(F.col("p_has"), F.coalesce(F.nullif(full, F.lit("")), bare("summary"))).otherwise(F.col("text")),
        "source": F.when(F.col("p_has"), F.coalesce(F.nullif("source", F.lit("")), F.when(met, "extracted").otherwise("inferred"))).otherwise(F.col("source")),
    })
    return out.select(*items.columns)


# Domain views


def domain_views(chunks: DataFrame, key: str, order: str, views: dict[str, str] = L.DOMAIN_VIEWS, kinds: dict = L.SNIPPETS, names: dict[str, list[str]] = L.ML_NAMES, contributions: tuple[str, int] = L.CONTRIBUTIONS, **architecture) -> DataFrame:
    """(key, view, field, items) of chunks (key, domain, order, content, role, section_name): each paper goes to the view of its domain, and
    a view's fields are lists of texts, empty ones left out. Papers of no view's domain have none. One scan of the chunks
    for the snippets of all views, one for the names and architectures of the papers on machine learning."""
    routed = chunks.withColumn("view", T.lookup(F.lower(F.coalesce("domain", F.lit("general"))), views, None)).filter("view is not null").withColumn("content", F.coalesce("content", F.lit("")))
    of = {"theory": ("theorems", "proofs", "complexity_claims"), "systems": ("system_components", "performance_claims", "benchmarks"), "ml": ("contributions",)}
    every = kinds | {"contributions": contributions}
    parts = [domains.snippets(routed.filter(F.col("view") == v).withColumn("v_key", F.struct(key, "view")), "v_key", order, {n: every[n] for n in fields if n in every}) for v, fields in of.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    out = found.select(f"v_key.{key}", "v_key.view", F.col("kind").alias("field"), F.col("snippets").alias("items"))
    ml = routed.filter("view = 'ml'")
    first = lambda c: F.slice(F.col(c), 1, 1)
    wide = domains.training_view(domains.names_view(ml, key, names)).join(domains.architectures(ml, key, **architecture).withColumnRenamed(key, "a_key"), F.col(key) == F.col("a_key"), "left")
    fields = {
        "architectures_proposed": F.col("proposed"), "architectures_baseline": F.col("baseline"), "datasets": F.slice("datasets", 1, 5), "loss_primary": first("losses"), "losses_auxiliary": F.slice("losses", 2, 3), "optimizer_primary": first("optimizers"),
        "optimizers_baseline": F.slice("optimizers", 2, 3), "evaluation_metrics": F.slice(F.transform("metrics", lambda m: F.when(m == "wer", F.upper(m)).otherwise(m)), 1, 8), "training_objective": F.filter(F.array("training_objective"), lambda x: x.isNotNull()),
    }
    rows = wide.select(key, F.lit("ml").alias("view"), F.inline(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("items")) for n, c in fields.items()])))
    return out.unionByName(rows.filter(F.size("items") > 0))


# Repositories


def recommend_repositories(rows: DataFrame, key: str, trust: Column, most: int = 5) -> DataFrame:
    """Per key of found repositories (seq, url, source, confidence): the first ``most`` different ones by trust, the best of them and what
    to do. Of one address (a slash at its end aside) the most confident counts, at the place of the first."""
    one = rows.withColumn("url", F.rtrim(F.col("url"), F.lit("/"))).groupBy(key, "url").agg(F.min("seq").alias("first"), F.max_by(F.struct("source", "confidence", "seq"), F.struct("confidence", -F.col("seq"))).alias("m")).select(key, "url", "first", "m.source", "m.confidence", "m.seq")
    few = one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first"))).filter(F.col("place") <= most).withColumn("trust_score", trust)
    listed = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("trust_score")).alias("less"), "place", "url", "source", "confidence", "trust_score"))).alias("all"))
    best = F.col("all")[0]
    return listed.select(key, F.transform("all", lambda x: F.struct(x["url"].alias("url"), x["source"].alias("source"), x["confidence"].alias("confidence"), x["trust_score"].alias("trust_score"))).alias("repositories"), best["url"].alias("primary_repo"), evidence.recommend(best["trust_score"]).alias("recommended_action"))


# Questions and numbers


def default_plan(query: Column, complexity: Column, required: Column) -> Column:
    """struct(strategy, complexity, required_evidence, subtasks): a subtask for each kind of evidence, in order, the first two of high priority."""
    title = lambda e: T.lookup(e, L.SUBTASK_TITLES, None)
    task = lambda e, i: F.struct(F.concat(F.lit("task_"), (i + 1).cast("string")).alias("subtask_id"), F.coalesce(title(e), F.initcap(e)).alias("title"), query.alias("question"), F.array(e).alias("evidence_types"), F.when(i < 2, "high").otherwise("medium").alias("priority"))
    return F.struct(F.when(complexity == "simple", "direct").otherwise("guided").alias("strategy"), complexity.alias("complexity"), required.alias("required_evidence"), F.transform(required, task).alias("subtasks"))


def has_code_intent(query: Column, words: list[str] = L.CODE_INTENT) -> Column:
    return T.contains_any(F.lower(query), words)


def primary(several: Column, single: Column) -> Column:
    """The first of several that isn't blank, else the single one."""
    return F.coalesce(F.try_element_at(F.filter(several, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(1)), single)


def output_width(training: Column, metrics: Column, architecture: Column) -> Column:
    """The size of a stated vocabulary; none for speech; else 10."""
    stated = F.regexp_extract(training, L.VOCABULARY, 1).try_cast("int")
    speech = F.contains(F.lower(F.coalesce(metrics, F.lit(""))), F.lit("speech")) | F.contains(F.lower(F.coalesce(architecture, F.lit(""))), F.lit("asr"))
    return F.coalesce(F.nullif(stated, F.lit(0)), F.when(~speech, 10))


# Training details


def augmentations(details: Column, text: Column, words: list[str] = L.AUGMENTATIONS) -> Column:
    """Names of the augmentations that stored details or the text speak of, in the order of the words."""
    low = F.lower(F.concat_ws("\n", F.coalesce(details, F.lit("")), F.coalesce(text, F.lit(""))))
    named = [F.when(F.contains(low, F.lit(w)), F.lit(L.AUGMENTATION_NAMES.get(w, w.title()))) for w in words]
    return F.array_distinct(F.array_compact(F.array(*named)))


def training_objective(stated: Column, proposed: Column, dataset: Column, loss: Column) -> Column:
    """The stated objective, else one told by the first architecture, the dataset and the loss."""
    first = F.try_element_at(proposed, F.lit(1))
    low = F.lower(F.concat_ws(" ", first, F.coalesce(dataset, F.lit("")), F.coalesce(loss, F.lit(""))))
    has = lambda w: F.contains(low, F.lit(w))
    told = F.when(has("speech") | has("librispeech"), L.SPEECH_OBJECTIVE).when(has("contrastive"), L.CONTRASTIVE_OBJECTIVE).when(has("mask") & has("language"), L.MASKED_OBJECTIVE)
    told = told.when(F.coalesce(loss, F.lit("")) != "", F.concat(F.lit(L.OTHER_OBJECTIVE), loss))
    return F.coalesce(F.nullif(stated, F.lit("")), told)


def training_details(rows: DataFrame, rules: list = L.LOSS_RULES, words: list[str] = L.AUGMENTATIONS, opening: int | None = 2000) -> DataFrame:
    """rows (loss, loss_inferred, loss_confidence, architecture, proposed, details, dataset, objective, text) with loss, loss_inferred,
    loss_confidence, loss_inference, augmentations and objective filled in: a stated loss stays, else the first rule counts of
    which a word stands in the architectures, the details or the text's opening (None: the whole text).

    One projection, nothing is shuffled. Defined results: nulls count as empty; a blank loss isn't stated; a stated confidence of
    nothing is 1; where no rule is met, loss, confidence and inference are null; other columns stay."""
    text = F.coalesce("text", F.lit(""))
    opened = text if opening is None else F.substring(text, 1, opening)
    low = F.lower(F.concat_ws(" ", F.coalesce("architecture", F.lit("")), F.array_join(F.coalesce("proposed", F.array().cast("array<string>")), " "), F.coalesce("details", F.lit("")), opened))
    met = None
    for markers, loss, sure, why in rules:
        got = F.struct(F.lit(loss).alias("loss"), F.lit(float(sure)).alias("sure"), F.lit(why).alias("why"))
        met = (F if met is None else met).when(T.contains_any(F.col("f_opened"), markers), got)
    stated = F.coalesce(F.col("loss"), F.lit("")) != ""
    told = rows.withColumn("f_opened", low).withColumns({"f_stated": stated, "f_met": F.lit(None).cast("struct<loss:string,sure:double,why:string>") if met is None else met})
    filled = told.withColumns(
        {
            "loss": F.when(F.col("f_stated"), F.col("loss")).otherwise(F.col("f_met.loss")),
            "loss_inferred": F.when(F.col("f_stated"), F.coalesce("loss_inferred", F.lit(False))).otherwise(F.col("f_met").isNotNull()),
            "loss_confidence": F.when(F.col("f_stated"), F.coalesce(F.nullif("loss_confidence", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("f_met.sure")),
            "loss_inference": F.when(~F.col("f_stated"), F.col("f_met.why")),
            "augmentations": augmentations(F.col("details"), F.col("text"), words),
        }
    )
    return filled.withColumn("objective", training_objective(F.col("objective"), F.col("proposed"), F.col("dataset"), F.col("loss"))).drop("f_opened", "f_stated", "f_met")
