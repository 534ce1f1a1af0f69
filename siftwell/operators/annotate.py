"""Features, roles, importance and quality of texts, as steps that compute each costly expression once.

A step is a projection of its own: what later steps refer to more than once stays a column, so that Catalyst doesn't
repeat it in every branch that needs it. Working columns start with ``f_`` or ``s_`` and are dropped at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import gates as G
from ..functions import structure as S
from ..functions import text as T
from ..functions.queries import first_best


def text_features(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows with f_low, f_words, f_letters, f_digits, f_size, f_lines, f_squeezed, f_technical, f_cite, f_table of a text column."""
    t = F.col(text)
    first = rows.withColumns({"f_low": F.lower(t), "f_words": T.word_count(t), "f_letters": T.letters(t), "f_digits": T.digits(t), "f_size": F.greatest(F.lit(1), F.length(t)), "f_lines": T.lines(t), "f_squeezed": T.squeeze(t)})
    words = F.greatest(F.lit(1), F.col("f_words"))
    technical = T.matches(t, T.TECHNICAL) + 2 * T.matches(t, T.SYMBOLS)
    noisy = F.size(F.filter("f_lines", T.noisy_line)) / F.size("f_lines")
    return first.withColumns(
        {
            "f_technical": F.when(F.col("f_words") == 0, 0.0).otherwise(F.least(F.lit(1.0), technical / F.col("f_words"))),
            "f_cite": T.total([T.matches(F.col("f_low"), p) for p in L.CITATIONS]) / words,
            "f_table": F.when(F.size("f_lines") == 0, 0.0).otherwise(noisy),
        }
    )


def with_signals(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows (with f_low) with f_equation, f_pseudo, f_result, f_metric."""
    t, low = F.col(text), F.col("f_low")
    return rows.withColumns({"f_equation": T.equation_signal(t, low), "f_pseudo": T.pseudocode_signal(t, low), "f_result": T.result_signal(t, low), "f_metric": T.metric_signal(t, low=low)})


def with_quality(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows (with text_features) with quality_score."""
    n, low, size, s = F.col("f_words"), F.col("f_low"), F.col("f_size"), F.col("f_squeezed")
    cite, table = F.col("f_cite"), F.col("f_table")
    score = F.when(n >= 80, 1.0).when(n >= 40, 0.6).when(n >= 20, 0.2).otherwise(-0.4)
    score = score - F.when(F.col("f_letters") / size < 0.45, 0.6).otherwise(0.0)
    score = score - F.when(cite > 0.03, 1.35).when(cite > 0.015, 0.7).otherwise(0.0)
    score = score - F.when(table > 0.6, 1.0).when(table > 0.35, 0.7).otherwise(0.0)
    score = score - F.when((F.col("f_digits") / size > 0.18) & (T.kwcount(F.col(text), "\n") / F.greatest(F.lit(1), n) > 0.12), 0.8).otherwise(0.0)
    score = score - F.when(F.length(s) < 20, 1.0).when(n <= 4, 0.8).otherwise(0.0)
    score = score - F.when(low.startswith("table ") | low.startswith("figure ") | low.startswith("equation:"), 0.8).otherwise(0.0)
    score = score + F.when(T.contains_any(low, ["we propose", "our proposed", "in this work"]), 0.3).otherwise(0.0)
    return rows.withColumn("quality_score", F.round(F.when(n == 0, -2.0).otherwise(score), 4))


def with_role(rows: DataFrame, keywords: dict[str, list[str]] = L.ROLE_KEYWORDS, roles: list[str] = L.ROLES) -> DataFrame:
    """rows (content, section_name, subsection_name, signals) with role and role_confidence: a score per role, the first of
    equals wins, an unsure one gives way to the section's prior."""
    rows = rows.withColumn("f_at", F.coalesce(T.section_name(F.col("subsection_name")), T.section_name(F.col("section_name"))))
    rows = rows.withColumn("f_hint", T.lookup(F.col("f_at"), L.SECTION_ROLE_HINTS, None))
    scores = {}
    for i, r in enumerate(roles):
        s = F.when(F.col("f_hint") == r, 1.0).otherwise(0.0) + T.kwsum(F.col("f_low"), keywords.get(r, [])) * 0.18
        for test, more in S.ROLE_BONUS.get(r, []):
            s = s + F.when(F.col(f"f_{test}"), more).otherwise(0.0)
        scores[f"s_{i}"] = F.round(s, 6)
    by_name = {r: F.col(f"s_{i}") for i, r in enumerate(roles)}
    rows = rows.withColumns(scores).withColumn("f_ranked", F.sort_array(F.array(*by_name.values()), asc=False))
    best, second = F.element_at("f_ranked", 1), F.element_at("f_ranked", 2)
    prior = None
    for section, names in L.SECTION_ROLE_PRIORS.items():
        value = first_best([(n, by_name.get(n, F.lit(0.0))) for n in names])
        prior = F.when(F.col("f_at") == section, value) if prior is None else prior.when(F.col("f_at") == section, value)
    rows = rows.withColumns({"f_top": first_best(list(by_name.items())), "f_sure": F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.35 + (best - second) + F.least(F.lit(0.35), best / 4))), "f_prior": prior})
    nothing = F.coalesce(F.col("f_at") == "related_work", F.lit(False)) | (best <= 0.01)
    unsure = (F.col("f_sure") < 0.6) & F.col("f_prior").isNotNull()
    return rows.withColumns(
        {
            "role": F.when(nothing, "other").when(unsure, F.col("f_prior")).otherwise(F.col("f_top")),
            "role_confidence": F.round(F.when(nothing, 0.25).when(unsure, F.greatest(F.col("f_sure"), F.lit(0.45))).otherwise(F.col("f_sure")), 4),
        }
    )


def with_importance(rows: DataFrame, n: Column) -> DataFrame:
    """rows (section_name, chunk_index, features, signals) with importance; n: the number of chunks that places count in."""
    at, position = T.section_name(F.col("section_name")), F.col("chunk_index") / F.greatest(F.lit(1), n - 1)
    out = F.when(at.isin("abstract", "introduction", "conclusion", "discussion"), 0.45).when(at.isin("method", "methodology", "algorithm", "evaluation", "results", "experiment"), 0.37).otherwise(0.25)
    out = out + F.when(position <= 0.15, 0.15).when(position >= 0.9, 0.12).otherwise(0.0)
    out = out + F.least(F.lit(0.3), F.col("f_technical") * 0.6)
    for test in ("f_equation", "f_pseudo", "f_result"):
        out = out + F.when(F.col(test), 0.08).otherwise(0.0)
    return rows.withColumn("importance", T.rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 4))


#: What importance is made of beside places.
PARTS = ["f_technical", "f_equation", "f_pseudo", "f_result"]


def placed(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """rows (section_name, chunk_index, PARTS) with importance; places count among the candidates of the group."""
    return with_importance(rows.withColumn("n_candidates", F.count("*").over(Window.partitionBy(*group))), F.col("n_candidates"))


def annotated(rows: DataFrame, group: tuple[str, ...], keywords: dict | None = None, roles: list | None = None, parts: bool = False) -> DataFrame:
    """rows (content, section_name, subsection_name, chunk_index) with role, role_confidence, importance, quality_score, summary,
    quality_pass. The position basis is the number of candidates of the group. parts: PARTS stay."""
    extra = {"keywords": keywords, "roles": roles} if keywords else {}
    out = with_summary(with_quality(with_role(with_signals(text_features(rows)), **extra)), "content", "summary").withColumn("summary", F.coalesce("summary", F.lit("")))
    out = out.withColumn("quality_pass", G.quality_chunk(F.col("summary"), F.col("role"), F.col("role_confidence")))
    # The count comes after all that is costly: filters on roles or quality stop at its window and don't repeat what they are made of.
    return plain(placed(out, group), PARTS if parts else [])


def gated(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """``annotated`` rows for those that only want what passes the gate: without quality_score; a row whose role or confidence fails has
    an empty summary, as nothing of its text can matter then."""
    roled = with_role(with_signals(rows.withColumn("f_low", F.lower("content"))))
    out = with_summary(roled.withColumn("f_text", F.when(G.may_pass(F.col("role"), F.col("role_confidence")), F.col("content"))), "f_text", "summary")
    out = out.withColumns({"summary": F.coalesce("summary", F.lit("")), "f_technical": T.technical_density(F.col("f_text"))})
    return plain(placed(out.withColumn("quality_pass", G.quality_chunk(F.col("summary"), F.col("role"), F.col("role_confidence"))), group))


def with_clean(rows: DataFrame, text: str = "content", out: str = "f_clean") -> DataFrame:
    """rows with a chunk's text as it is indexed: from its first sentence start on, a table's header with its telling lines, or
    null for captions, formulas, diagrams and texts without a sentence start."""
    t = F.col(text)
    # Squeezed as by T.squeeze, but that only texts with runs of blanks, or marks, are taken apart.
    flat = rows.withColumn("f_flat", F.translate(t, "\x00\t\n\x0b\f\r", " " * 6))
    first = flat.withColumn("f_raw", F.trim(F.when(F.contains("f_flat", F.lit("  ")), F.regexp_replace("f_flat", " {2,}", " ")).otherwise(F.col("f_flat"))))
    marks = T.squeeze(F.regexp_replace("f_raw", T.ascii_edges(r"(?i)\bEQUATION:\s*"), "[equation] "))
    second = first.withColumn("f_marked", F.when(F.contains("f_raw", F.lit(":")), marks).otherwise(F.col("f_raw")))
    third = second.withColumn("f_start", F.regexp_instr("f_marked", F.lit(r"[.!?]\s+[A-Z0-9\[]")))
    marked = F.col("f_marked")
    fourth = third.withColumn("f_advanced", F.when(marked.rlike(r"^[A-Z0-9\[]"), marked).when(F.col("f_start") > 0, F.ltrim(marked.substr(F.col("f_start") + 1, F.length(marked)))))
    moved = F.col("f_advanced") != marked
    good = (F.col("f_raw") != "") & ~G.banned_prefix(F.col("f_raw")) & ~G.heavy(marked) & ~G.banned_prefix(F.col("f_advanced")) & ~(moved & G.heavy(F.col("f_advanced")))
    return fourth.withColumn(out, F.when(F.lower(F.substring("f_raw", 1, 24)).startswith("table:"), G.table_snippet(t)).when(good, F.col("f_advanced")))


def with_summary(rows: DataFrame, text: str = "content", out: str = "summary", most: int = 300, enough: int = 140) -> DataFrame:
    """rows with whole sentences from the start of the clean text, as many as make ``enough`` characters, never over ``most``;
    an ellipsis if any are left out; null without a clean text."""
    clean = with_clean(rows, text, "f_clean")
    # A sentence takes two characters at least, with its blank, so that no more of them can matter.
    parts = clean.withColumn("f_parts", F.slice(S.sentences(F.col("f_clean")), 1, most // 2 + 2))
    # Sizes of growing prefixes, blanks between sentences included: how many fit, and how many don't make enough.
    none = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("fit"), F.lit(0).alias("few"))

    def add(acc: Column, s: Column) -> Column:
        size = acc["size"] + 1 + F.length(s)
        return F.struct(size.alias("size"), (acc["fit"] + (size <= most).cast("int")).alias("fit"), (acc["few"] + (size < enough).cast("int")).alias("few"))

    sized = parts.withColumn("f_sizes", F.aggregate("f_parts", none, add))
    fitting, done = F.col("f_sizes.fit"), F.col("f_sizes.few") + 1
    taken = sized.withColumn("f_taken", F.least(fitting, done, F.size("f_parts"))).withColumn("f_packed", F.array_join(F.slice("f_parts", F.lit(1), F.greatest("f_taken", F.lit(1))), " "))
    packed = F.col("f_packed")
    cut = F.trim(F.regexp_replace(F.substring(packed, 1, most - 3), r" [^ ]*$", ""))
    short = F.when(F.length(packed) > most - 3, cut).otherwise(packed)
    ends = F.when(short.endswith("..."), short).otherwise(F.concat(short, F.lit("...")))
    return taken.withColumn(out, F.when(F.size("f_parts") > 0, F.substring(F.when(F.col("f_taken") < F.size("f_parts"), ends).otherwise(packed), 1, most)))


def plain(rows: DataFrame, but: list[str] = []) -> DataFrame:
    """rows without working columns."""
    return rows.drop(*[c for c in rows.columns if c.startswith(("f_", "s_")) and c not in but])
