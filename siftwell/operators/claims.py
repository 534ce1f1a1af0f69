"""Claims and their supporting chunks, sections of evidence, neighbours by role, equations, selections for analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import queries as Q
from ..functions import text as T
from . import evidence
from .evidence import clip


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order; rows without a key are left out."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("m")).select(key, "m.*")


def ground(claims: DataFrame, chunks: DataFrame, coverage: Column, contradiction: Column, supports: str = "supporting_chunk_ids") -> DataFrame:
    """Claims (claim_id, claim_text, supporting ids, and what coverage and contradiction refer to) by the chunks (chunk_id,
    content, score, rerank_score) that they name: confidence, coverage, contradictions, strength and status. Ids of no chunk drop
    out; a claim without any is weak. The tokens of a claim's supports are counted by join, not gathered."""
    n_known = F.least(F.lit(3), F.lit(chunks.limit(3).count()))
    own = claims.select("*", F.array_distinct(T.tokens(F.col("claim_text"))).alias("g_own"), coverage.cast("double").alias("g_coverage"), contradiction.cast("double").alias("g_contradiction"))
    named = own.select("claim_id", "g_own", F.explode(supports).alias("g_chunk"))
    met = named.join(chunks.select(F.col("chunk_id").alias("g_id"), "content", "score", F.coalesce("rerank_score", "score").alias("rerank")), F.col("g_chunk") == F.col("g_id"))
    strength = met.groupBy("claim_id").agg(F.count("*").alias("n_supports"), F.avg("score").alias("g_score"), F.avg("rerank").alias("g_rerank"))
    shared = met.select("claim_id", F.explode(F.array_intersect("g_own", T.tokens(F.col("content")))).alias("token")).groupBy("claim_id").agg(F.count_distinct("token").alias("g_shared"))
    out = own.drop(supports).join(strength, "claim_id", "left").join(shared, "claim_id", "left")
    out = out.withColumns({"n_supports": F.coalesce("n_supports", F.lit(0)), "g_score": F.coalesce("g_score", F.lit(0.0)), "g_rerank": F.coalesce("g_rerank", F.lit(0.0)), "overlap": F.when(F.size("g_own") == 0, 0.0).otherwise(F.coalesce("g_shared", F.lit(0)) / F.size("g_own"))})
    confidence = evidence.claim_confidence(F.col("g_score"), F.col("g_rerank"), F.col("overlap"), F.col("g_coverage"), F.col("g_contradiction"))
    return out.select(
        "claim_id", "n_supports", F.round("overlap", 6).alias("overlap"), confidence.alias("confidence"), F.round(clip(F.col("n_supports") / F.greatest(F.lit(1), n_known)), 4).alias("evidence_coverage"),
        F.ceil(F.col("n_supports") * F.col("g_contradiction")).cast("int").alias("contradiction_count"), F.round(clip(0.5 * F.col("g_score") + 0.5 * F.col("g_rerank")), 4).alias("support_strength"),
        F.when((F.col("n_supports") > 0) & (F.col("overlap") >= 0.05), "supported").otherwise("weak").alias("support_status"),
    )


SECTION_CUES = {"key_ideas": ["propose", "novel", "contribution", "motivation", "outperform"], "methods": ["model", "architecture", "algorithm", "module", "approach"], "results": ["results", "benchmark", "metric", "accuracy", "evaluation"], "discussion": ["limitation", "future work", "conclusion", "caveat", "discussion"]}
CAVEATS = ["however", "but", "although", "in contrast", "whereas", "limitation", "limitations"]


def assess_sections(rows: DataFrame, *key: str, cues: dict[str, list[str]] = SECTION_CUES, caveats: list[str] = CAVEATS) -> DataFrame:
    """Per key (section_key among it) of chunks (content, section_name, confidence, importance): whether its evidence is
    sufficient and trustworthy, and whether more should be retrieved."""
    low = F.lower("content")
    words = sorted({w for ws in cues.values() for w in ws})
    seen = {w: F.max(F.contains(low, F.lit(w)).cast("int")).alias(f"w_{i}") for i, w in enumerate(words)}
    name = T.section_name(F.col("section_name"))
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("n_chunks"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"), F.avg(F.coalesce("importance", F.lit(0.0))).alias("avg_importance"), F.sum(T.kwsum(low, caveats)).alias("caveats"),
        F.max(F.coalesce(name.isin("conclusion", "results"), F.lit(False)).cast("int")).alias("closing"), *seen.values(),
    )
    hits = None
    for k, ws in cues.items():
        value = T.total([F.col(f"w_{words.index(w)}") for w in ws])
        hits = F.when(F.col("section_key") == k, value) if hits is None else hits.when(F.col("section_key") == k, value)
    out = agg.withColumn("keyword_hits", F.coalesce(hits, F.lit(0)))
    base = (F.col("n_chunks") >= 2) & (F.col("avg_confidence") >= 0.45) & (F.col("avg_importance") >= 0.25)
    more = F.when(F.col("section_key").isin("results", "methods"), F.col("keyword_hits") >= 1).when(F.col("section_key") == "discussion", (F.col("keyword_hits") >= 1) | (F.col("closing") == 1)).otherwise(True)
    out = out.withColumn("sufficient", base & more).withColumn("trustworthy", (F.col("avg_confidence") >= 0.4) & (F.col("caveats") <= F.greatest(F.lit(3), F.col("n_chunks") * 2)))
    out = out.withColumn("retrieve_more", (~F.col("sufficient") | (F.col("keyword_hits") == 0)) & (F.col("n_chunks") < 6))
    return out.select(*key, "n_chunks", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_importance", 6).alias("avg_importance"), "keyword_hits", "caveats", "sufficient", "trustworthy", "retrieve_more")


# Neighbours by role


def wants_neighbors(role: Column, content: Column) -> Column:
    low = F.lower(content)
    metric = T.contains_any(low, ["wer", "cer", "bleu", "rouge", "f1", "accuracy", "latency", "error rate", "perplexity"]) | content.rlike(T.ascii_edges(r"\b[0-9]+(\.[0-9]+)?\s*%"))
    explains = (F.size(T.tokens(content)) <= 40) & T.contains_any(low, ["objective", "loss", "denotes", "represents", "defined as"])
    return role.isin("equation", "formula") | ((role == "evaluation") & metric) | (role.isin("method", "algorithm", "theory") & explains)


def with_neighbors(seeds: DataFrame, chunks: DataFrame, wants: Column | None = None) -> DataFrame:
    """Seeds (seed_rank, chunk_id, paper_id, section_name, subsection_name, chunk_index, role, content, score, importance) and the
    chunks beside those that want them: one before and after for formulas and results, one after for others. A neighbour takes
    its first seed's score, a little less of its importance, and is ordered beside it."""
    w = wants_neighbors(F.col("role"), F.col("content")) if wants is None else wants
    before = F.when(F.col("role").isin("equation", "formula", "evaluation"), 1).otherwise(0)
    at = seeds.filter(w).select(F.col("chunk_id").alias("seed_id"), "seed_rank", F.col("paper_id").alias("s_paper"), F.col("section_name").alias("s_section"), F.col("subsection_name").alias("s_sub"), "score", F.greatest(F.lit(0.2), F.col("importance") - 0.05).alias("importance"), F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + 1)).alias("s_index"))
    on = (F.col("paper_id") == F.col("s_paper")) & (F.col("chunk_index") == F.col("s_index")) & F.col("section_name").eqNullSafe(F.col("s_section")) & F.col("subsection_name").eqNullSafe(F.col("s_sub"))
    found = chunks.select("chunk_id", "paper_id", "section_name", "subsection_name", "chunk_index").join(at, on).join(seeds.select(F.col("chunk_id").alias("own")), F.col("chunk_id") == F.col("own"), "left_anti")
    near = found.groupBy("chunk_id").agg(F.min(F.struct("seed_rank", "seed_id", "score", "importance", "section_name", "chunk_index")).alias("m"))
    near = near.select("chunk_id", "m.seed_rank", F.col("m.seed_id").alias("neighbor_for"), "m.section_name", "m.chunk_index", "m.score", "m.importance", F.lit("neighbor_context").alias("role"))
    return seeds.select("chunk_id", "seed_rank", F.lit(None).cast(near.schema["neighbor_for"].dataType).alias("neighbor_for"), "section_name", "chunk_index", "score", "importance", "role").unionByName(near)


# Equations


def equation_score(latex: Column, quality: Column) -> Column:
    low = F.lower(latex)
    out = F.coalesce(quality, F.lit(0.0)) + F.when(F.contains(latex, F.lit("=")), 2.0).otherwise(0.0)
    out = out + F.when(T.contains_any(latex, ["+", "Δ", "∆", "×", "*", "∈", "≪", "≤", "≥", "/", "^"]), 0.8).otherwise(0.0) + F.when(low.rlike(T.ascii_edges(r"\b(?:w0|ba|ax|h)\b")), 1.4).otherwise(0.0)
    out = out + F.when(T.contains_any(low, ["where ", "defined as", "denotes", "represents", "composition"]), 0.7).otherwise(0.0) - F.when(latex.rlike(r"^[A-Za-zΔ∆αβσ_'\s0-9]+$"), 0.9).otherwise(0.0)
    return F.round(out, 4)


def preferred_equations(items: DataFrame, key: str, limit: int = 4, near: float = 1.5, enough: int = 3) -> DataFrame:
    """The best equations (latex, quality_score) of each key: by score, then those with an equals sign, then the longer; those near the
    best, or the first few."""
    rows = items.withColumn("latex", F.trim("latex")).filter(F.col("latex") != "").withColumn("equation_score", equation_score(F.col("latex"), F.col("quality_score")))
    order = [F.desc("equation_score"), F.desc(F.contains("latex", F.lit("=")).cast("int")), F.desc(F.length("latex")), F.asc("latex")]
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= limit)
    best = F.max("equation_score").over(Window.partitionBy(key))
    return ranked.withColumn("best", best).filter((F.col("equation_score") >= F.col("best") - near) | (F.col("place") <= enough)).drop("best")


def equations_by_section(items: DataFrame, key: str, bonus: dict[str, float], limit: int = 8) -> DataFrame:
    """Equations (latex, quality_score, section_name) of each key over all its sections: a bonus by section, one of each text
    (case aside), the best few."""
    scored = items.withColumn("quality_score", F.round(F.col("quality_score") + F.coalesce(T.lookup(F.lower(F.trim("section_name")), bonus, 0.0), F.lit(0.0)), 4)).withColumn("norm", F.lower(F.trim("latex"))).filter("norm <> ''")
    order = [F.desc("quality_score"), F.desc(F.contains("latex", F.lit("=")).cast("int")), F.desc(F.length("latex")), F.asc("latex"), F.asc("section_name")]
    once = scored.withColumn("r", F.row_number().over(Window.partitionBy(key, "norm").orderBy(*order))).filter("r = 1").drop("r", "norm")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= limit)


def look_like_equations(entries: Column) -> Column:
    n = F.size(F.filter(entries, lambda e: F.contains(e, F.lit("=")) | T.contains_any(e, ["Δ", "∆", "∈", "×"])))
    return (F.size(entries) > 0) & (n >= F.greatest(F.lit(1), F.floor(F.size(entries) / 2)))


# Selections


def structural_score(content: Column) -> Column:
    """How much of a text is technical: long words, signs, cues of algorithms and results."""
    low = F.lower(content)
    return T.matches(content, T.TECHNICAL) + T.matches(content, r"[=<>+\-*/^]|O\(") + 2 * T.matches(low, T.ascii_edges(r"\b(for each|while|if|algorithm|procedure|return)\b")) + 2 * T.matches(low, T.ascii_edges(r"\b(results?|benchmark|comparison|ablation|table|figure)\b"))


def relevant_chunks(rows: DataFrame, key: str, k: int = 12) -> DataFrame:
    """Per key, the k most important chunks (section_name, importance, quality_pass, content, chunk_index) outside the references that
    pass the gate, or of all where none does; in reading order by chunk_index."""
    kept = rows.filter(~F.coalesce(T.section_name(F.col("section_name")) == "references", F.lit(False)))
    kept = kept.withColumn("any_pass", F.max(F.col("quality_pass").cast("int")).over(Window.partitionBy(key))).filter(F.col("quality_pass") | (F.col("any_pass") == 0)).drop("any_pass")
    order = [F.desc("importance"), F.desc("structural"), F.asc("chunk_index")]
    return kept.withColumn("structural", structural_score(F.col("content"))).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= k)


FALLBACK_CUES = ["future work", "future direction", "limitation", "limitations", "threats to validity", "in conclusion", "we conclude", "we presented", "we introduced"]


def discussion_fallback(rows: DataFrame, key: str, most: int = 3, cues: list[str] = FALLBACK_CUES) -> DataFrame:
    """Per key, the best chunks that discuss: by section or cue, one of each summary (the text where there is none)."""
    at = T.section_name(F.col("section_name"))
    some = rows.filter(F.coalesce(at.isin("discussion", "conclusion"), F.lit(False)) | T.contains_any(F.lower("content"), cues)).withColumn("norm", F.lower(F.trim(F.coalesce(F.nullif("summary", F.lit("")), "content")))).filter("norm <> ''")
    order = [F.desc("importance"), F.desc("confidence"), F.asc("chunk_id")]
    once = some.withColumn("r", F.row_number().over(Window.partitionBy(key, "norm").orderBy(*order))).filter("r = 1").drop("r", "norm")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def additional_chunks(found: DataFrame, seen: DataFrame, most: int = 5, over: int = 12) -> DataFrame:
    """The first few of the best ``over`` rows (score, chunk_id) that aren't among the seen ids."""
    best = found.orderBy(F.desc("score"), "chunk_id").limit(over)
    fresh = best.join(seen.select(F.col("chunk_id").alias("a_id")).distinct(), F.col("chunk_id") == F.col("a_id"), "left_anti")
    return fresh.orderBy(F.desc("score"), "chunk_id").limit(most)


def retrieval_confidence(rows: DataFrame, key: str) -> DataFrame:
    """Mean of 0.7 score + 0.3 importance per key."""
    return rows.groupBy(key).agg(T.rounded(F.avg(0.7 * F.col("score") + 0.3 * F.col("importance")), 4).alias("retrieval_confidence"), T.rounded(F.coalesce(F.avg("importance"), F.lit(0.0)), 4).alias("average_importance"))


def allows_background(query: Column, strength: Column) -> Column:
    asked = T.contains_any(F.lower(query), ["what is", "explain", "overview", "background", "in general", "generally", "how does"])
    return asked | (~Q.is_formula_query(query) & (F.coalesce(strength, F.lit(0.0)) < 0.35))
