"""Evidence diagnostics, claims, evaluation, domains, reproducibility, repositories."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def covers(field: str, rules: dict = L.EVIDENCE) -> Column:
    """Whether a chunk (role, section_name, content) covers an evidence field."""
    r = rules[field]
    return F.coalesce(F.col("role").isin(r["roles"]), F.lit(False)) | F.coalesce(F.lower("section_name").isin(r["sections"]), F.lit(False)) | F.coalesce(T.contains_any(F.lower("content"), r["keywords"]), F.lit(False))


def diagnostics(rows: DataFrame, key: str, required: list[str], n_sections: int, markers: list[str] = L.CONTRADICTIONS) -> DataFrame:
    """Per key of rows (score, content, section_name, role): density, diversity, contradiction, coverage, strength."""
    n = F.count("*")
    agg = rows.groupBy(key).agg(
        n.alias("n_chunks"), F.avg("score").alias("avg_score"), F.avg(F.size(T.tokens(F.col("content")))).alias("avg_words"),
        F.count_distinct(F.coalesce("section_name", F.lit("unknown"))).alias("n_sections"), F.count_distinct(F.coalesce("role", F.lit("other"))).alias("n_roles"),
        F.sum(T.kwsum(F.lower("content"), markers)).alias("hits"), *[F.max(covers(f).cast("int")).alias(f"has_{f}") for f in required],
    )
    density = clip(F.col("avg_score") * 0.55 + clip(F.col("avg_words") / 90.0) * 0.45)
    diversity = clip(0.5 * clip(F.col("n_sections") / F.lit(max(1, n_sections))) + 0.5 * clip(F.col("n_roles") / 4.0))
    contradiction = clip(F.col("hits") / F.greatest(F.lit(1), F.col("n_chunks") * 3))
    coverage = clip(T.total([F.col(f"has_{f}") for f in required]) / len(required)) if required else clip(F.col("n_sections") / 3.0)
    out = agg.withColumn("density", density).withColumn("diversity", diversity).withColumn("contradiction", contradiction).withColumn("coverage", coverage)
    out = out.withColumn("strength", clip(0.6 * F.col("avg_score") + 0.25 * F.col("diversity") + 0.15 * (1 - F.col("contradiction"))))
    weak = (F.col("density") < 0.45) | (F.col("coverage") < 0.55) | (F.col("contradiction") > 0.3) | (F.col("coverage") < (1.0 if required else 0.0))
    return out.select(key, "n_chunks", *[F.round(c, 4).alias(c) for c in ("density", "diversity", "contradiction", "coverage", "strength")], weak.alias("wants_retry"))


def overlap(claim: Column, support: Column) -> Column:
    """Share of a claim's distinct tokens that occur in the support."""
    own = F.array_distinct(T.tokens(claim))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, T.tokens(support))) / F.size(own))


def _few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _spread(freq: DataFrame, hot: int) -> DataFrame:
    """(h_token, salts) of the tokens that more than ``hot`` documents hold."""
    return freq.filter(F.col("docs") > hot).select(F.col("token").alias("h_token"), F.ceil(F.col("docs") / hot).alias("salts"))


def _meeting(posted: DataFrame, asked: DataFrame, spread: DataFrame, few: bool, row: str) -> DataFrame:
    """posted (token, row and others) joined with asked (c_token and others) on the token; hot tokens go by several keys. There
    are no more hot tokens than asked tokens, so that few of these bound the broadcast."""
    hint = F.broadcast if few else lambda rows: rows
    salted = posted.join(hint(spread), F.col("token") == F.col("h_token"), "left").withColumn("salt", F.pmod(F.xxhash64(row), F.coalesce("salts", F.lit(1)))).drop("h_token", "salts")
    dealt = asked.join(hint(spread), F.col("c_token") == F.col("h_token"), "left").withColumn("c_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("h_token", "salts")
    return salted.join(dealt, (F.col("token") == F.col("c_token")) & (F.col("salt") == F.col("c_salt"))).drop("salt", "c_salt")


def _asked(claims: DataFrame) -> DataFrame:
    """(c_row, item_id, n, c_token) of the distinct tokens of claims (item_id, text); claims without any drop out."""
    own = claims.select(F.monotonically_increasing_id().alias("c_row"), "item_id", F.array_distinct(T.tokens(F.col("text"))).alias("own"))
    return own.select("c_row", "item_id", F.size("own").alias("n"), F.explode("own").alias("c_token"))


def _posted(documents: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """(d_row, doc_id, token) of the distinct tokens of documents (doc_id, text) that some claim has."""
    # The row is named before the texts are exploded; in one select the name would come after.
    d = documents.select(F.monotonically_increasing_id().alias("d_row"), "doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("has")).select("d_row", "doc_id", F.explode("has").alias("token"))
    vocabulary = asked.select("c_token").distinct()
    return d.join(F.broadcast(vocabulary) if few else vocabulary, F.col("token") == F.col("c_token"), "left_semi")


def claim_overlaps(claims: DataFrame, documents: DataFrame, hot: int = 50_000, most: int = 200_000) -> DataFrame:
    """(item_id, doc_id, overlap) for each pair of a row of claims (item_id, text) and a row of documents (doc_id, text) that
    share a token: the share of the claim's distinct tokens that occur in the document. All rows of both take part; rows that
    repeat an id, or have none, are rows of their own. A token of more than ``hot`` documents is spread over several keys; claims
    of up to ``most`` tokens in all are broadcast. A pair for any word in common is much: ``claim_supporters`` wants a share."""
    c = _asked(claims)
    few = _few(c, most)
    d = _posted(documents, c, few)
    pairs = _meeting(d, c, _spread(d.groupBy("token").agg(F.count("*").alias("docs")), hot), few, "d_row")
    return pairs.groupBy("c_row", "item_id", "n", "d_row", "doc_id").agg(F.count("*").alias("shared")).select("item_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))


def claim_supporters(claims: DataFrame, documents: DataFrame, percent: int = 50, hot: int = 50_000, most: int = 200_000) -> DataFrame:
    """(item_id, doc_id, overlap) for each row of claims (item_id, text) and row of documents (doc_id, text) that holds at least
    so many percent (1 to 100) of the claim's distinct tokens; exact, and without the pairs that share only a common word.

    Claims of the same tokens are one class, as are documents with the same ones of the claims' tokens, so that copies are compared
    once; classes are named by their tokens, which holds when a lost task runs again. A class that holds k of a claim's n tokens holds one of its n - k + 1 rarest: only these are joined
    on, and what meets there is counted in full. Claims of up to ``most`` tokens in all are broadcast; else all goes by shuffles,
    and a token of more than ``hot`` classes by several keys.

    Defined results: claims and documents that are null, empty or without tokens give no row; rows that repeat an id, or have
    none, are rows of their own; other columns are left out."""
    named = claims.select("item_id", F.array_sort(F.array_distinct(T.tokens(F.col("text")))).alias("own")).filter(F.size("own") > 0).withColumn("c_row", F.md5(F.array_join("own", " ")))
    asks = named.groupBy("c_row").agg(F.first("own").alias("own"))
    c = asks.select("c_row", F.size("own").alias("n"), F.explode("own").alias("c_token"))
    few = _few(c, most)
    hint = F.broadcast if few else lambda rows: rows
    held = _posted(documents, c, few).groupBy("d_row", "doc_id").agg(F.array_sort(F.collect_list("token")).alias("has")).withColumn("print", F.md5(F.array_join("has", " ")))
    classes = held.groupBy("print").agg(F.first("has").alias("has"))
    posted = classes.select("print", F.explode("has").alias("token"))
    freq = posted.groupBy("token").agg(F.count("*").alias("docs"))
    ranked = c.join(freq, F.col("c_token") == F.col("token"), "left").withColumn("place", F.row_number().over(Window.partitionBy("c_row").orderBy(F.coalesce("docs", F.lit(0)), "c_token")))
    rare = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("c_row", "c_token")
    met = posted.join(F.broadcast(rare), F.col("token") == F.col("c_token")) if few else _meeting(posted, rare, _spread(freq, hot), few, "print")
    pairs = met.select("c_row", "print").distinct().join(hint(asks), "c_row").join(classes, "print")
    counted = pairs.select("c_row", "print", F.size("own").alias("n"), F.size(F.array_intersect("own", "has")).alias("shared")).filter(100 * F.col("shared") >= percent * F.col("n"))
    ids = counted.join(named.select("c_row", "item_id"), "c_row").join(held.select("print", "doc_id"), "print")
    return ids.select("item_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))


def claim_confidence(score: Column, rerank: Column, shared: Column, coverage: Column, contradiction: Column) -> Column:
    return F.round(clip(0.4 * score + 0.2 * rerank + 0.2 * shared + 0.1 * coverage + 0.1 * (1 - contradiction)), 4)


def evaluation(missing: Column, required: Column, supported: Column, confidence: Column, subtasks: Column, level: Column, coverage: Column, contradiction: Column, addressed: Column) -> list[Column]:
    """completeness, grounding, depth, handling, rigor and the status band."""
    completeness = clip(1 - missing / F.greatest(F.lit(1), required))
    grounding = clip(0.6 * supported + 0.4 * confidence)
    depth = clip(0.35 + 0.15 * subtasks + 0.25 * level / 3 + 0.25 * completeness)
    handling = clip(F.when(addressed, 1 - contradiction).otherwise(0.8 - 0.5 * contradiction))
    rigor = clip(0.4 * grounding + 0.35 * coverage + 0.25 * handling)
    band = F.when((grounding < 0.45) | (coverage < 0.45), "insufficient").when((grounding < 0.6) | (coverage < 0.6) | (completeness < 0.6), "needs_review").when((grounding < 0.75) | (rigor < 0.7), "sufficient").otherwise("strong")
    named = {"completeness": completeness, "grounding": grounding, "depth": depth, "handling": handling, "rigor": rigor}
    return [F.round(c, 4).alias(n) for n, c in named.items()] + [band.alias("status")]


def detect_domain(rows: DataFrame, key: str, domains: dict[str, list[str]] = L.DOMAINS, priors: dict = L.DOMAIN_ROLE_PRIORS) -> DataFrame:
    """Per key of rows (text, role): domain and confidence; weak signals are general."""
    low = F.lower("text")
    sums = [F.sum(T.kwsum(low, words) / len(words)).alias(f"k_{d}") for d, words in domains.items()]
    shares = [F.avg((F.col("role") == priors[d][0]).cast("double")).alias(f"r_{d}") for d in domains if d in priors]
    agg = rows.groupBy(key).agg(*sums, *shares)
    scores = [("general", F.lit(0.25))] + [(d, F.round(F.col(f"k_{d}") + (priors[d][1] * F.col(f"r_{d}") if d in priors else 0.0), 6)) for d in domains]
    structs = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (d, s) in enumerate(scores)])
    best = F.element_at(F.sort_array(structs, asc=False), 1)
    second = F.element_at(F.sort_array(structs, asc=False), 2)
    weak = F.col("b.s") < 0.4
    out = agg.select(key, best.alias("b"), second.alias("t"))
    return out.select(key, F.when(weak, "general").otherwise(F.col("b.d")).alias("domain"), F.round(F.when(weak, 0.35).otherwise(clip(0.35 + F.col("b.s") - F.col("t.s"), 0.2)), 4).alias("confidence"))


def reproducibility(dataset: Column, code: Column, method: Column, results: Column) -> Column:
    """The overall score without a domain's own signals; dataset is true, false or unknown."""
    known = F.when(dataset.isNull(), 0.5).when(dataset, 1.0).otherwise(0.0)
    return F.round(0.2 * known + 0.25 * code.cast("double") + 0.2 * method + 0.2 * method + 0.15 * results, 4)


def similarity(rows: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Ratcliff-Obershelp ratio of two text columns, in Arrow batches; only these two go through Python."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")

    return rows.withColumn(out, ratio(left, right))


def repo_confidence(title: Column, architecture: Column, source: Column, stars: Column) -> Column:
    base = F.round(F.least(F.lit(1.0), 0.25 + 0.45 * title + 0.2 * architecture + T.lookup(source, L.REPO_SOURCE_BONUS, 0.0)), 4)
    return F.round(F.least(F.lit(1.0), base + F.when(source == "github_search", F.least(F.lit(0.15), stars / 10000.0)).otherwise(0.0)), 4)


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,);\]]+$", "")


def urls(text: Column, pattern: str = r"https?://[^\s<>\"']+") -> Column:
    """Distinct URLs of a text, sorted, without trailing punctuation."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda u: normalize_url(u))))


def dedupe_repositories(rows: DataFrame) -> DataFrame:
    """One row per normalised URL (url, source, confidence, seq): the highest confidence, the first on ties."""
    return rows.withColumn("url", normalize_url(F.col("url"))).groupBy("url").agg(F.max(F.struct("confidence", (-F.col("seq")).alias("s"), "source")).alias("m")).select("url", F.col("m.source").alias("source"), F.col("m.confidence").alias("confidence"))


def equations(text: Column) -> Column:
    """Assignments and O(...) terms of a text, squeezed, first seen first, case aside."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+\s*=\s*[^.;\n]{6,180})"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(O\([^)]{1,80}\))"), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(found, lambda e: F.lower(F.regexp_replace(T.squeeze(e), r"^[ ,;:]+|[ ,;:]+$", ""))), lambda e: e != ""))


def recommend(score: Column) -> Column:
    return F.when(score >= 0.75, "clone_existing_repo").when(score >= 0.55, "review_repo_then_generate").otherwise("use_generated_scaffold")


def merge_ranked(parts: list[DataFrame], key: str, order: list[Column], k: int) -> DataFrame:
    """The union of parts, one row per key (the first in order), the k first in order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("r = 1").drop("r")
    return once.orderBy(*order).limit(k)


def hydrate(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (item_id, chunk_id, chunk_index, text) whose missing text is that of their chunk, by id first, then by index."""
    by_id = chunks.select(F.col("chunk_id").alias("i_id"), F.col("content").alias("i_text"))
    by_index = chunks.groupBy(F.col("chunk_index").alias("x_index")).agg(F.min_by("content", "chunk_id").alias("x_text"))
    found = items.join(by_id, F.col("chunk_id") == F.col("i_id"), "left").join(by_index, F.col("chunk_index") == F.col("x_index"), "left")
    return found.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "i_text", "x_text")).drop("i_id", "i_text", "x_index", "x_text")


def first_seen(rows: DataFrame, key: str, order: Column, words: list[str], most: int = 8) -> DataFrame:
    """Per key, the words that its texts (content) hold, in the order in which they are first seen, at most so many."""
    hits = rows.select(key, order.alias("o"), F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.struct(i.alias("i"), F.element_at(F.array(*map(F.lit, words)), i + 1).alias("w"))), lambda x: F.contains(F.lower(F.col("content")), x["w"]))).alias("h"))
    seen = hits.groupBy(key, "h.w").agg(F.min(F.struct("o", "h.i")).alias("m"))
    return seen.groupBy(key).agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("m", "w"))), lambda x: x["w"]), 1, most), ",").alias("found"))


def status(ok: Column, n: Column) -> Column:
    return F.when((ok == n) & (n > 0), "success").when(ok > 0, "partial_failure").otherwise("failed")


def trust(base: Column, title: Column, architecture: Column, readme_title: Column, readme_architecture: Column, trains: Column, environment: Column, stars: Column) -> Column:
    """A repository's score after verification: what was found adds to its base, up to 1."""
    out = base + F.when(title >= 0.55, 0.18).otherwise(0.0) + F.when(architecture >= 0.55, 0.12).otherwise(0.0) + F.when(readme_title, 0.2).otherwise(0.0) + F.when(readme_architecture, 0.12).otherwise(0.0)
    out = out + F.when(trains, 0.08).otherwise(0.0) + F.when(environment, 0.05).otherwise(0.0) + F.when(stars > 50, F.least(F.lit(0.15), stars / 5000.0)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), out), 4)
