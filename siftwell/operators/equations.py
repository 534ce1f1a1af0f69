"""Equations of a section's raw text: candidates of several patterns, normal forms, scores, the best of each text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T

_ASSIGNMENT = re.compile(L.ASSIGNMENT)
_TARGETED = [re.compile(p, re.IGNORECASE) for p in L.TARGETED_EQUATIONS]
#: L.CHUNK_EQUATIONS for Java, with the same matches in linear time: what stands before an equals sign can be read in one way only, so
#: that nothing is tried twice, and a first match starts where a run of letters does or where the last match ended.
_LETTER = "[A-Za-z0-9˜′'`_]"
_CHUNK_EQUATIONS = [rf"(?:(?<!{_LETTER})|\G){_LETTER}++\s*+[A-Za-z0-9˜′'`_()]*+\s*+=\s*[^.;\n]{{6,180}}", L.CHUNK_EQUATIONS[1]]
_MARK = re.compile(r"\bequation:\s*", re.IGNORECASE)


def candidates(text: str) -> list[tuple[str, str, float]]:
    """(normal form, what stands around it, bonus) in the order in which they are found: marked lines and assignments line by
    line, then the targeted patterns over the whole text."""
    lines = [s for s in map(str.strip, text.splitlines()) if s]
    found = []
    for i, line in enumerate(lines):
        around = " ".join(lines[max(0, i - 1) : i + 2])
        own = [_MARK.sub("", line)] if "equation:" in line.lower() else []
        found += [(c, around, 0.0) for c in (*own, *(m[0] for m in _ASSIGNMENT.finditer(line)))]
    whole = " ".join(lines)
    found += [(m[0], whole[max(0, m.start() - 120) : m.end() + 120], 2.0) for p in _TARGETED for m in p.finditer(whole)]
    return [(unicodedata.normalize("NFKC", " ".join(c.split())).strip(" ,;:."), around, bonus) for c, around, bonus in found]


def signal(latex: Column) -> Column:
    """How much a candidate looks like an equation."""
    low = F.lower(latex)
    letters, digits = F.length(F.regexp_replace(latex, f"[^{L.EQUATION_LETTERS}]", "")), F.length(F.regexp_replace(latex, r"\P{Nd}", ""))
    out = F.when(F.contains(latex, F.lit("=")), 2.0).otherwise(0.0) + F.when(T.contains_any(latex, L.EQUATION_SYMBOLS), 1.0).otherwise(0.0)
    out = out + F.when(low.rlike(r"\b(?:w0|ba|ax|h)\b"), 1.5).otherwise(0.0) + F.when(T.contains_any(low, L.EQUATION_WORDS), 0.8).otherwise(0.0)
    out = out - F.when((digits > 0) & (digits > letters * 2), 1.2).otherwise(0.0)
    return out - F.when(latex.rlike(f"^[{L.EQUATION_LETTERS}_'\\s0-9]+$"), 0.6).otherwise(0.0)


def cut_latex(latex: Column) -> Column:
    """A candidate without the prose that follows it."""
    s = F.regexp_replace(latex, r"(?s)\b(?:We|Figure|Fig\.|Table|Algorithm)\b.*", "")
    return F.btrim(s, F.lit(" ,;:."))


def plain_value(latex: Column) -> Column:
    """Whether an assignment only gives a number to a short name."""
    left = F.regexp_replace(F.substring_index(latex, "=", 1), r"[^\p{L}\p{N}_]+", "")
    right = F.regexp_replace(F.substr(latex, F.instr(latex, "=") + 1), r"[\s,.;:()]+", "")
    return F.contains(latex, F.lit("=")) & (F.length(left) <= 3) & right.rlike(r"^[-+]?[0-9]+$")


def section_text_equations(rows: DataFrame, key: str, text: str, near: float = 1.25, enough: int = 3, limit: int = 8) -> DataFrame:
    """(key, place, latex, description, quality_score) of the equations of each key's text (one row a key): those within ``near`` of
    the best and the first ``enough``, ``limit`` at most. Null and blank texts have none."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, *c) for k, t in zip(pdf[key], pdf[text]) if t for i, c in enumerate(candidates(t))]
            yield pd.DataFrame(out, columns=[key, "at", "latex", "around", "bonus"])

    some = rows.select(key, text).filter(F.col(text).rlike(r"(?i)=|equation:|\bBA"))
    found = some.mapInPandas(run, f"`{key}` {kind}, at int, latex string, around string, bonus double")
    letters, digits = F.length(F.regexp_replace("latex", f"[^{L.EQUATION_LETTERS}]", "")), F.length(F.regexp_replace("latex", r"\P{Nd}", ""))
    fit = (F.length("latex") >= 8) & (letters >= 2) & ~T.contains_any(F.lower("latex"), L.NO_EQUATION) & ~((digits > letters * 3) & F.contains("latex", F.lit("=")))
    scored = found.filter(fit).withColumn("quality_score", F.round(signal(F.col("latex")) + F.col("bonus"), 4)).filter("quality_score >= 1.2")
    first = Window.partitionBy(key, F.lower("latex")).orderBy("at")
    once = scored.withColumn("r", F.row_number().over(first)).filter("r = 1").withColumn("latex", cut_latex(F.col("latex")))
    once = once.filter(~plain_value(F.col("latex")) & ~T.contains_any(F.lower("latex"), L.NO_FORMULA) & (F.length("latex") >= 12) & (F.length(F.regexp_replace("latex", "[^A-Za-z]", "")) >= 4))
    order = Window.partitionBy(key).orderBy(F.desc("quality_score"), F.desc(F.contains("latex", F.lit("=")).cast("int")), F.desc(F.length("latex")), "at")
    ranked = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    best = F.max("quality_score").over(Window.partitionBy(key))
    kept = ranked.withColumn("best", best).filter((F.col("quality_score") >= F.col("best") - near) | (F.col("place") <= enough))
    return kept.select(key, "place", "latex", F.substring("around", 1, 220).alias("description"), "quality_score")


def chunk_equations(text: Column) -> Column:
    """The assignments and O(...) terms of a chunk, squeezed, one of each (case aside), in the order in which they are found."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in _CHUNK_EQUATIONS])
    neat = F.filter(F.transform(found, lambda e: F.btrim(F.replace(T.squeeze(e), F.lit("[equation]"), F.lit("")), F.lit(" ,;:"))), lambda e: e != "")
    both = T.bind(neat, lambda e: F.struct(e.alias("e"), F.transform(e, lambda x: F.lower(x)).alias("low")))
    return T.bind(both, lambda b: F.filter(F.transform(b["e"], lambda x, i: F.when(F.array_position(b["low"], F.lower(x)) == i + 1, x)), lambda x: x.isNotNull()))
