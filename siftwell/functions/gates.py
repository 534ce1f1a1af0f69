"""Column functions of the quality gate: noise, short but telling chunks, noun phrases, formula bonuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from . import text as T

ONLY_SYMBOLS = r"^[0-9\s+\-*/^=<>()\[\]{}|.,:;%]+$"
STARTS_WELL = r"^[A-Z0-9\[]"
#: Where one of the fragments stands, whatever stands beside it: one pass that stops at letters that can begin one.
_BARE = [p.replace(r"\b", "") for p in L.BANNED_FRAGMENTS]
_FRAGMENT = "(?i)(?=[" + "".join(sorted({p[0] for p in _BARE})) + "])(?:" + "|".join(_BARE) + ")"
VERB = T.ascii_edges(r"(?i)\b(" + "|".join(L.VERBS) + r")\b")


def banned_prefix(text: Column) -> Column:
    # Of a long text only as much is lower-cased as the longest start has, and more.
    low, out = F.lower(F.substring(F.trim(text), 1, 4 * max(map(len, L.BANNED_STARTS)))), F.lit(False)
    for p in L.BANNED_STARTS:
        out = out | low.startswith(p)
    return out


def banned_fragment(text: Column) -> Column:
    out = F.lit(False)
    for p in L.BANNED_FRAGMENTS:
        out = out | text.rlike(T.ascii_edges("(?i)" + p))
    return text.rlike(_FRAGMENT) & out


def heavy(text: Column) -> Column:
    """Whether a text is symbols only, a known bit of noise, or mostly formula or diagram."""
    markers = T.matches(F.lower(text), T.ascii_edges(r"\[equation\]|=|o\(|\\[a-z]+|\bfrac\b"))
    brackets = F.length(text) - F.length(F.translate(text, "()[]{}", ""))
    few = (~T.has_letters(text, 50) & (markers >= 3)) | (brackets >= 12)
    # Texts of 80 letters, nearly all, are looked at no further.
    return text.rlike(ONLY_SYMBOLS) | banned_fragment(text) | (~T.has_letters(text, 80) & few)


def metric_line(line: Column) -> Column:
    low = F.lower(line)
    named = low.rlike(T.ascii_edges(r"\b(test|dev|baseline|ablation|ours|proposed)\b")) & line.rlike(T.ascii_edges(r"\b[0-9]+(\.[0-9]+)?\b"))
    return T.contains_any(low, L.METRICS) | line.rlike(T.ascii_edges(r"\b[0-9]+(\.[0-9]+)?\s*%")) | named


def table_snippet(text: Column, most: int = 4) -> Column:
    """A table's first line with the first lines that hold a metric; null if none does."""
    rows = T.lines(text)
    found = F.slice(F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), metric_line), 1, most)
    return F.when(F.size(found) > 0, T.squeeze(F.array_join(F.concat(F.slice(rows, 1, 1), found), "\n")))


def short_but_telling(text: Column, role: Column, confidence: Column) -> Column:
    s = F.trim(text)
    low, n = F.lower(s), T.word_count(s)
    formula = role.isin("equation", "formula", "theory") & (F.contains(s, F.lit("=")) | F.contains(low, F.lit("[equation]")))
    result = (role == "evaluation") & T.metric_signal(s)
    method = role.isin("method", "algorithm") & T.contains_any(low, ["objective", "loss", "defined as", "denotes", "represents"])
    return (n > 0) & (n <= 40) & (confidence >= 0.35) & (formula | result | method)


def noun_phrase(text: Column) -> Column:
    """Two to five words without a verb, or one at most."""
    n = T.matches(text, r"\b[A-Za-z][A-Za-z\-]*\b")
    return (n <= 1) | ((n <= 5) & ~text.rlike(VERB))


def may_pass(role: Column, confidence: Column) -> Column:
    """What ``quality_chunk`` asks of a chunk whatever its text."""
    return (role != "other") & (confidence >= 0.35)


def quality_chunk(summary: Column, role: Column, confidence: Column) -> Column:
    """Whether a chunk's summary says enough to be evidence."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    good = (role != "other") & (F.length(s) >= 40) & s.rlike(STARTS_WELL) & ~banned_prefix(s) & ~s.rlike(ONLY_SYMBOLS) & ~banned_fragment(s) & (T.letters(s) >= 20) & ~noun_phrase(s)
    return (confidence >= 0.35) & (short_but_telling(s, role, confidence) | good)


def formula_subsection_bonus(subsection: Column, text: Column) -> Column:
    named = T.contains_any(F.lower(F.coalesce(subsection, F.lit(""))), L.FORMULA_SUBSECTIONS)
    return F.least(F.lit(1.0), F.when(named, 0.8).otherwise(0.0) + F.when(T.formula_signal(text), 0.6).otherwise(0.0))
