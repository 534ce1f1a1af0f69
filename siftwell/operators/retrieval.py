"""Vector search with scopes, quality gate, reranking, balanced selection, neighbours, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import structure as S
from ..functions import text as T
from ..functions.vectors import cosine, literal
from . import annotate as A


def query_vector(vectors: DataFrame, vec_id: int, key: str = "vec_id") -> Column:
    row = vectors.filter(F.col(key) == vec_id).select("embedding").first()
    return literal(row["embedding"])


def scored(chunks: DataFrame, query: Column) -> DataFrame:
    return chunks.withColumn("score", F.round(cosine(F.col("embedding"), query), 6)).drop("embedding")


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows: a heap per partition, then one merge (TakeOrderedAndProject)."""
    return rows.orderBy(*order).limit(k)


def search(chunks: DataFrame, query: Column, k: int, sections: list | None = None, subsections: list | None = None, paper_id: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Top k by cosine. Scopes filter before scoring; a None among the subsections also admits rows without one."""
    if paper_id is not None:
        chunks = chunks.filter(F.col("paper_id") == paper_id)
    if sections:
        chunks = chunks.filter(F.col("section_name").isin(sections))
    if subsections:
        named = [s for s in subsections if s is not None]
        test = F.col("subsection_name").isin(named) if named else F.lit(False)
        chunks = chunks.filter(test | F.col("subsection_name").isNull() if None in subsections else test)
    return top(scored(chunks, query), k, F.desc("score"), F.asc(key))


def with_page(chunks: DataFrame, subsections: DataFrame) -> DataFrame:
    """chunks with the page of their subsection; names compare null-safe."""
    pages = subsections.groupBy(F.col("paper_id").alias("p_paper"), F.col("section_name").alias("p_section"), F.col("subsection_name").alias("p_subsection")).agg(F.min("page_number").alias("page_number"))
    on = (F.col("paper_id") == F.col("p_paper")) & F.col("section_name").eqNullSafe(F.col("p_section")) & F.col("subsection_name").eqNullSafe(F.col("p_subsection"))
    return chunks.join(pages, on, "left").drop("p_paper", "p_section", "p_subsection")


def _with_stat(rows: DataFrame, group: tuple[str, ...], name: str, stat: Column) -> DataFrame:
    """rows with an aggregate of their group; without a group, of all rows: one number, joined, not a window over all."""
    if group:
        return rows.withColumn(name, stat.over(Window.partitionBy(*group)))
    whole = rows.agg(stat.alias(name)).withColumn("g_one", F.lit(1))
    return rows.withColumn("g_one", F.lit(1)).join(F.broadcast(whole), "g_one").drop("g_one")


def gated(rows: DataFrame, group: tuple[str, ...] = (), formula: bool = False, among: Column | None = None) -> DataFrame:
    """rows with g_stay: whether a candidate gets through the gate of its group. among: rows that are candidates at all; the others
    don't count and never stay."""
    passes, inside = F.col("quality_pass"), F.lit(True) if among is None else among
    if formula:
        rows = rows.withColumn("g_formula", T.formula_candidate_bonus(F.col("role"), F.col("content")) >= 0.75)
        passes = passes | F.col("g_formula")
    counted = _with_stat(rows.withColumn("g_pass", F.when(inside, passes)), group, "g_any", F.max(F.col("g_pass").cast("int")))
    passed = counted.withColumn("g_passed", F.coalesce(inside & (F.col("g_pass") | (F.col("g_any") == 0)), F.lit(False)))
    best = _with_stat(passed, group, "g_best", F.max(F.when(F.col("g_passed"), F.col("score"))))
    poor = ((F.col("quality_score") <= -0.5) & (F.col("score") < F.col("g_best") - 0.01)) | ((F.col("quality_score") <= -0.2) & (F.col("score") < F.col("g_best") - 0.05))
    if formula:
        poor = poor & ~(F.col("g_formula") & (F.col("score") >= F.col("g_best") - 0.12))
    return best.withColumn("g_stay", F.coalesce(F.col("g_passed") & ~poor, F.lit(False))).drop("g_pass", "g_any", "g_passed", "g_best", "g_formula")


def gate(rows: DataFrame, group: tuple[str, ...] = (), formula: bool = False) -> DataFrame:
    """Keeps candidates that pass, or all of a group in which none does; then drops poor ones that score below the best. In
    formula mode (rows with role, content) what looks like a formula also passes, and stays if it scores near the best."""
    return gated(rows, group, formula).filter("g_stay").drop("g_stay")


def rerank(rows: DataFrame, kind: str, formula: bool = False) -> DataFrame:
    """rows with role_match_weight, intent_role_weight and rerank_score."""
    value = 0.5 * F.col("score") + 0.3 * S.role_match(F.lit(kind), F.col("role")) + 0.2 * F.col("importance")
    if formula:
        value = value + 0.18 * T.formula_candidate_bonus(F.col("role"), F.col("content"))
    return rows.withColumns({"role_match_weight": S.role_match(F.lit(kind), F.col("role")), "intent_role_weight": S.role_weight(F.lit(kind), F.col("role")), "rerank_score": T.nearest(value, 4)})


def normalised(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """rows with semantic_rank_score: the place of a score between the least and the greatest of its group; 1 if all are equal."""
    w = Window.partitionBy(*group)
    span = F.max("score").over(w) - F.min("score").over(w)
    return rows.withColumn("semantic_rank_score", T.nearest(F.when(span > 0, (F.col("score") - F.min("score").over(w)) / span).otherwise(1.0), 4))


def overfetched(rows: DataFrame, key: tuple[str, ...], k: int, least: int = 40, tie: str = "chunk_id") -> DataFrame:
    """The best of each query's scored rows, several times as many as are wanted, since the gate will drop some."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc(tie))
    return rows.withColumn("fetched", F.row_number().over(order)).filter(F.col("fetched") <= max(4 * k, least)).drop("fetched")


RANKED = ("rerank_score", "score", "importance")


def retrieve(rows: DataFrame, key: tuple[str, ...], kind: str, k: int = 18, formula: bool = False, keywords: dict | None = None, roles: list | None = None) -> DataFrame:
    """The chain for scored rows of any number of queries (key): over-fetch, annotate, gate, rerank, the best 2 k of each. All but the
    first step see candidates only. What importance is made of stays (annotate.PARTS), for selections that place candidates anew."""
    found = normalised(A.annotated(overfetched(rows, key, k), key, keywords, roles, parts=True), key)
    ranked = rerank(gate(found, key, formula), kind, formula)
    order = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in RANKED], F.coalesce(F.nullif("page_number", F.lit(0)), F.lit(10**6)) if "page_number" in rows.columns else F.asc("chunk_id"), F.asc("chunk_id"))
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * k)


def rerank_group(rows: DataFrame, group: tuple[str, ...], kind: str, formula: bool = False, among: Column | None = None) -> DataFrame:
    """Rows of a retrieve ranked anew within groups: importance by the places of the group, g_stay by its gate, place among those that
    stay. Roles, quality and summaries don't depend on the group and are taken as they are."""
    ranked = rerank(gated(A.placed(rows, group), group, formula, among), kind, formula)
    order = Window.partitionBy(*group).orderBy(F.desc("g_stay"), *[F.desc(c) for c in RANKED], F.asc("chunk_index"), F.asc("chunk_id"))
    return ranked.withColumn("place", F.when(F.col("g_stay"), F.row_number().over(order)))


def select_balanced(rows: DataFrame, key: tuple[str, ...], sections: list[str], kind: str, k: int = 12, per_section: int = 3, formula: bool = False) -> DataFrame:
    """Of each query's candidates (a retrieve's rows, chunk_id unique per query): the selected sections' best few near their best, then the best of the rest
    where these are fewer than k; ranked anew, k in all. Windows within a query only: its candidates are shuffled once, for
    the fetch, and annotated once."""
    named = rows.withColumn("section_name", F.coalesce("section_name", F.lit("unknown")))
    by_section = (*key, "section_name")
    own = rerank_group(named, by_section, kind, formula, F.col("section_name").isin(sections))
    few = F.coalesce(F.col("place") <= per_section, F.lit(False))
    near = F.col("rerank_score") >= F.max(F.when(few, F.col("rerank_score"))).over(Window.partitionBy(*by_section)) - 0.12
    first = own.withColumn("g_first", few & near & (F.col("quality_score") > -0.2)).drop("g_stay")
    every = rerank_group(first, key, kind, formula)
    tiers = every.withColumn("g_rest", F.col("g_stay") & (F.col("quality_score") > -0.1) & (F.col("importance") > 0.1)).drop("g_stay")
    enough = F.count(F.when(F.col("g_first"), 1)).over(Window.partitionBy(*key)) >= k
    merged = tiers.withColumn("g_enough", enough).filter("g_first or (g_rest and not g_enough)").drop("g_first", "g_rest", "g_enough")
    return A.plain(rerank_group(merged, key, kind, formula).filter(F.col("place") <= k).drop("g_stay"))


def retrieve_sections(rows: DataFrame, key: tuple[str, ...], kind: str, k: int = 3, formula: bool = False, references: bool = False, keywords: dict | None = None, roles: list | None = None) -> DataFrame:
    """Scored sections (content, section_name, section_order) of any number of queries: over-fetch, gate, 0.7 score + 0.3 prior (and a bonus
    in formula mode), one of each name, the best k of each query."""
    found = gate(A.annotated(overfetched(rows, key, k, 3), key, keywords, roles), key, formula)
    if not references:
        found = found.filter(~F.coalesce(T.section_name(F.col("section_name")) == "references", F.lit(False)))
    value = 0.7 * F.col("score") + 0.3 * S.section_prior(F.lit(kind), F.col("section_name"))
    if formula:
        value = value + 0.18 * T.formula_section_bonus(F.col("section_name"))
    named = found.withColumns({"value": T.nearest(value, 6), "weight": S.section_weight(F.col("section_name")), "norm": F.coalesce(T.section_name(F.col("section_name")), F.lit(""))})
    order = [F.desc("value"), F.desc("quality_score"), F.desc("weight"), F.asc("section_order"), F.asc("chunk_id")]
    one = named.withColumn("r", F.row_number().over(Window.partitionBy(*key, "norm").orderBy(*order))).filter("r = 1").drop("r")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= k).drop("norm", "weight")


def retrieve_subsections(rows: DataFrame, key: tuple[str, ...], sections: list[str], k: int = 6, formula: bool = False, keywords: dict | None = None, roles: list | None = None) -> DataFrame:
    """Scored subsections of the given sections: over-fetch, gate, each section's share of k by weighted score in the order of the
    sections, then the best of the rest, k in all for each query."""
    wanted = rows.filter(F.col("section_name").isin(sections)) if sections else rows
    found = gate(A.annotated(overfetched(wanted, key, k, 6), key, keywords, roles), key, formula)
    value = F.col("score") * S.section_weight(F.col("section_name"))
    if formula:
        value = value + 0.16 * G.formula_subsection_bonus(F.col("subsection_name"), F.col("content"))
    page = F.coalesce(F.nullif("page_number", F.lit(0)), F.lit(10**6)) if "page_number" in rows.columns else F.lit(0)
    order = [F.desc("value"), F.desc("quality_score"), page.asc(), F.asc("chunk_id")]
    ranked = found.withColumn("value", T.nearest(value, 6)).withColumn("r", F.row_number().over(Window.partitionBy(*key, "section_name").orderBy(*order)))
    share = max(1, k // max(1, len(sections)))
    at = T.lookup(F.col("section_name"), {s: i for i, s in enumerate(sections)}, len(sections)) if sections else F.lit(0)
    tier = F.when(F.col("r") <= share, at).otherwise(len(sections) + 1)
    return ranked.withColumn("tier", tier).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("tier", *order))).filter(F.col("place") <= k).drop("r", "tier")


def balanced_select(rows: DataFrame, k: int, per_section: int = 3, near: float = 0.12) -> DataFrame:
    """Each section's best few near its best, then the best of the rest until k are found."""
    order = [F.desc("rerank_score"), F.desc("score"), F.desc("importance"), F.asc("chunk_index"), F.asc("chunk_id")]
    w = Window.partitionBy("section_name")
    ranked = rows.withColumn("section_rank", F.row_number().over(w.orderBy(*order))).withColumn("section_best", F.max("rerank_score").over(w))
    first = (F.col("section_rank") <= per_section) & (F.col("rerank_score") >= F.col("section_best") - near) & (F.col("quality_score") > -0.2)
    rest = (F.col("quality_score") > -0.1) & (F.col("importance") > 0.1)
    tier = F.when(first, 0).when(rest, 1)
    return top(ranked.withColumn("tier", tier).filter("tier is not null"), k, F.asc("tier"), *order).drop("section_rank", "section_best")


def quota(rows: DataFrame, per_section: int, k: int) -> DataFrame:
    """At most so many rows of a section by weighted score, then the others, k in all."""
    weighted = T.nearest(F.col("score") * S.section_weight(F.col("section_name")), 6)
    order = [F.desc("weighted"), F.asc("chunk_id")]
    ranked = rows.withColumn("weighted", weighted).withColumn("r", F.row_number().over(Window.partitionBy("section_name").orderBy(*order)))
    return top(ranked.withColumn("extra", (F.col("r") > per_section).cast("int")), k, F.asc("extra"), *order).drop("r")


def best_sections(rows: DataFrame, kind: str, k: int, references: bool = False) -> DataFrame:
    """One row per section name by 0.7 score + 0.3 prior, the k best."""
    if not references:
        rows = rows.filter(~F.coalesce(T.section_name(F.col("section_name")) == "references", F.lit(False)))
    rows = rows.withColumn("value", T.nearest(0.7 * F.col("score") + 0.3 * S.section_prior(F.lit(kind), F.col("section_name")), 6))
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy("section_name").orderBy(F.desc("value"), "chunk_id"))).filter("r = 1").drop("r")
    return top(one, k, F.desc("value"), F.asc("chunk_id"))


def neighbors(seeds: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Chunks beside each seed in its paper, section and subsection; a neighbour of several goes to the first."""
    at = seeds.select(F.col("chunk_id").alias("seed_id"), F.col("seed_rank"), F.col("paper_id").alias("s_paper"), F.col("section_name").alias("s_section"), F.col("subsection_name").alias("s_sub"), F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)).alias("s_index"))
    on = (F.col("paper_id") == F.col("s_paper")) & (F.col("chunk_index") == F.col("s_index")) & F.col("section_name").eqNullSafe(F.col("s_section")) & F.col("subsection_name").eqNullSafe(F.col("s_sub"))
    found = chunks.join(at, on).filter(F.col("chunk_id") != F.col("seed_id"))
    found = found.join(seeds.select(F.col("chunk_id").alias("own")), F.col("chunk_id") == F.col("own"), "left_anti")
    return found.groupBy("chunk_id").agg(F.min(F.struct("seed_rank", "seed_id")).alias("m")).select("chunk_id", F.col("m.seed_id").alias("seed_id"))


def within_budget(rows: DataFrame, group: tuple, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """The leading rows of each group whose running sum of tokens stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(w)).filter(F.col("running") <= budget)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("r = 1").drop("r")


def rank_tables(rows: DataFrame, query: str, k: int) -> DataFrame:
    """Score plus boosts for the asked label, kind and a caption; the longer text on ties."""
    import re

    low = query.lower()
    label = re.search(r"\btable\s+(\d+)\b", low)
    value = F.col("score")
    if label:
        value = value + F.when(F.lower("table_label") == f"table {label[1]}", 0.45).otherwise(0.0)
    if any(w in low for w in ("result", "benchmark", "metric")):
        value = value + F.when(F.col("table_type") == "results", 0.18).otherwise(0.0)
    if "ablation" in low:
        value = value + F.when(F.col("table_type") == "ablation", 0.14).otherwise(0.0)
    value = value + F.when(F.coalesce(F.length("caption"), F.lit(0)) > 0, 0.12).otherwise(0.0)
    return top(rows.withColumn("value", T.nearest(value, 6)), k, F.desc("value"), F.desc(F.length("text")), F.asc("table_id"))


def buckets(rows: DataFrame, most: int = 6) -> DataFrame:
    """The best rows (chunk_id, bucket, content, importance, role_confidence) of each bucket, of those with the same summary
    in lower case only the best; rows without a summary are left out."""
    order = [F.desc("importance"), F.desc("role_confidence"), F.asc("chunk_id")]
    named = rows.filter("bucket is not null").withColumn("norm", F.trim(F.lower(S.summary(F.col("content"))))).filter("norm <> ''")
    once = named.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "norm").orderBy(*order))).filter("r = 1")
    return once.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("r") <= most).drop("r", "norm")
