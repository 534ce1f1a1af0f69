"""Column functions on chunks: role with confidence, importance, summary, quality gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from . import text as T


#: What signals of a text add to the score of a role.
ROLE_BONUS = {"equation": [("equation", 0.75)], "formula": [("equation", 0.55)], "theory": [("equation", 0.35)], "algorithm": [("equation", 0.12), ("pseudo", 0.35)], "implementation": [("pseudo", 0.15)], "evaluation": [("result", 0.35), ("metric", 0.45)], "discussion": [("result", 0.1)]}


def role_match(kind: Column, role_name: Column) -> Column:
    out = None
    for k in L.INTENT_ROLE_MATCHES:
        value = F.when(role_name.isin(L.INTENT_ROLE_MATCHES[k]), 1.0).when(role_name.isin(L.INTENT_ROLE_NEUTRALS[k]), 0.3).otherwise(0.0)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(0.0)


def role_weight(kind: Column, role_name: Column) -> Column:
    out = None
    for k, weights in L.INTENT_ROLE_WEIGHTS.items():
        value = T.lookup(role_name, weights, 0.4)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(0.4)


def section_prior(kind: Column, section: Column) -> Column:
    at, out = T.section_name(section), None
    for k, priors in L.SECTION_PRIORS.items():
        value = T.lookup(at, priors, 0.1)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return F.when(at.isNull(), 0.0).otherwise(out.otherwise(0.1))


def section_weight(section: Column) -> Column:
    return F.coalesce(T.lookup(T.section_name(section), L.SECTION_WEIGHTS, 1.0), F.lit(1.0))


def rerank(score: Column, kind: Column, role_name: Column, weight: Column) -> Column:
    return T.nearest(0.5 * score + 0.3 * role_match(kind, role_name) + 0.2 * weight, 4)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\[])"), lambda s: F.trim(s)), lambda s: s != "")


def summary(text: Column, most: int = 300, enough: int = 140) -> Column:
    """Whole sentences from the start, up to ``enough`` characters and never more than ``most``; an ellipsis if any are left out."""
    parts = sentences(T.squeeze(text))
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.trim(F.concat(acc["s"], F.lit(" "), s))
        fits = ~acc["done"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["s"]).alias("s"), (acc["done"] | ~fits | (F.length(longer) >= enough)).alias("done"))

    got = F.aggregate(parts, start, add, lambda acc: acc["s"])
    cut = F.concat(F.regexp_replace(F.substring(got, 1, most - 3), r"\s\S*$", ""), F.lit("..."))
    whole = got == F.array_join(parts, " ")
    first = F.concat(F.regexp_replace(F.substring(F.element_at(parts, 1), 1, most - 3), r"\s\S*$", ""), F.lit("..."))
    return F.when(F.size(parts) == 0, F.lit(None)).when(got == "", first).when(whole, got).otherwise(F.when(F.length(got) > most - 3, cut).otherwise(F.concat(got, F.lit("..."))))
