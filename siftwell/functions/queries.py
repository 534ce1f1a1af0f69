"""Column functions on questions: intent, follow-ups, complexity, evidence that an answer needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .text import contains_any, kwsum, matches, squeeze, tokens, total


def first_best(scores: list[tuple[str, Column]]) -> Column:
    """The name of the highest score; the first of equals."""
    best = F.array_max(F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores)]))
    return best["n"]


def intent(query: Column, keywords: dict[str, list[str]] = L.INTENT_KEYWORDS, default: str = "method") -> Column:
    low = F.lower(query)
    scores = [(k, kwsum(low, words)) for k, words in keywords.items()]
    return F.when(total([s for _, s in scores]) == 0, default).otherwise(first_best(scores))


def is_formula_query(query: Column) -> Column:
    return contains_any(F.lower(query), L.FORMULA_QUERY)


def is_table_query(query: Column) -> Column:
    return contains_any(F.lower(query), L.TABLE_QUERY)


def is_reference_query(query: Column) -> Column:
    return contains_any(F.lower(query), L.REFERENCE_QUERY)


def response_mode(query: Column) -> Column:
    return F.when(is_formula_query(query), "equation_extraction").when(is_table_query(query), "table_extraction").when(contains_any(F.lower(query), L.LITERAL_QUERY), "literal_extraction").otherwise("standard")


def is_follow_up(query: Column) -> Column:
    low = squeeze(F.lower(query))
    words = F.split(low, " ")
    out = F.element_at(words, 1).isin(L.FOLLOW_UP_STARTERS) | ((F.size(words) <= 7) & F.arrays_overlap(words, F.array(*map(F.lit, ["it", "that", "this", "they", "them"]))))
    for p in L.FOLLOW_UP_PATTERNS:
        out = out | low.rlike(p)
    return (low != "") & out


def complexity_score(query: Column) -> Column:
    low, n = F.lower(query), F.size(tokens(query))
    clauses = kwsum(low, L.CLAUSES)
    parts = [n >= 14, n >= 24, clauses >= 1, clauses >= 2, kwsum(low, L.COMPARISONS) > 0, kwsum(low, L.CRITIQUES) > 0, matches(query, "[,:;]") >= 2]
    return total([p.cast("int") for p in parts])


def complexity_label(score: Column) -> Column:
    return F.when(score >= 5, "complex").when(score >= 3, "medium").otherwise("simple")


def required_evidence(query: Column, kind: Column) -> Column:
    low = F.lower(query)
    when = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(
        F.concat(
            when(kind == "method", "methodology"), when(kind == "evaluation", "evaluation", "dataset"), when(kind == "comparison", "comparison", "evaluation"),
            when(contains_any(low, ["dataset", "benchmark", "corpus"]), "dataset"), when(contains_any(low, ["reproduc", "repository", "code"]), "reproducibility"), when(contains_any(low, ["limitation", "weakness", "future work"]), "limitations"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("evaluation"))).otherwise(found)


def expanded(query: Column, applies: Column, terms: list[str]) -> Column:
    """A query with those of its kind's terms that it lacks, four at most."""
    s = squeeze(query)
    lacking = F.slice(F.filter(F.array(*map(F.lit, terms)), lambda t: ~F.contains(F.lower(s), t)), 1, 4)
    return F.when(applies & (s != "") & (F.size(lacking) > 0), F.concat(s, F.lit(" | focus on "), F.array_join(lacking, "; "))).otherwise(s)


def expanded_by_mode(query: Column) -> Column:
    """A question for formulas with their terms, one for tables with theirs, any other squeezed; null stays null."""
    return F.when(is_formula_query(query), expanded(query, F.lit(True), L.FORMULA_EXPANSION)).otherwise(expanded(query, is_table_query(query), L.TABLE_EXPANSION))
