"""Column functions on values given as JSON of any depth. Leaves are found by patterns in the order of the text, so that no depth
needs recursion; escapes are put out of the way first, so that patterns take linear time and constant stack."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

#: Stand for an escaped backslash and quote while leaves are looked for; no text has these code points, which aren't characters.
_BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1"
#: A key (without a group), or a leaf: text, number, true, false, null, an empty list or object.
_LEAF = r'"[^"]*+"\s*+:|("[^"]*+"|-?[0-9][0-9.eE+\-]*+|true|false|null|\[\s*+\]|\{\s*+\})'


def leaves(value: Column) -> Column:
    """The leaves of a JSON text as JSON, in order; null if it isn't JSON."""
    plain = F.replace(F.replace(value, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    found = F.filter(F.regexp_extract_all(plain, F.lit(_LEAF), F.lit(1)), lambda x: x != "")
    whole = F.transform(found, lambda x: F.replace(F.replace(x, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\")))
    return F.when(F.try_parse_json(value).isNotNull(), whole)


def texts(found: Column) -> Column:
    """Leaves as text: true and false as True and False, null and what is empty as no text, numbers as they are written."""
    said = F.transform(found, lambda x: F.when(x == "true", '"True"').when(x == "false", '"False"').when((x == "null") | x.rlike(r"^[\[{]"), '""').otherwise(x))
    return F.from_json(F.concat(F.lit("["), F.array_join(said, ","), F.lit("]")), "array<string>")


def flattened(value: Column) -> Column:
    """All leaves of a JSON value parted by blanks; other text as it is; null as no text."""
    return F.coalesce(F.array_join(texts(leaves(value)), " "), value, F.lit(""))


def _indented(value: Column) -> Column:
    @F.pandas_udf("string")
    def indented(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, indent=2))

    return indented(value)


def markdown(value: Column) -> Column:
    """A value as it is shown: text trimmed, a list as bullets of its items that aren't blank, an object as indented JSON."""
    s = F.btrim(value, F.lit(" \t\n\r"))
    kind = F.when(F.try_parse_json(s).isNotNull(), F.substring(s, 1, 1))
    items = F.filter(F.transform(F.from_json(F.when(kind == "[", s), "array<string>"), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x.isNotNull() & (x != ""))
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    quoted = F.btrim(F.from_json(F.concat(F.lit("["), F.when(kind == '"', s), F.lit("]")), "array<string>")[0], F.lit(" \t\n\r"))
    return F.when(s.isNull() | (s == "null"), "").when(kind == "[", bullets).when(kind == "{", _indented(F.when(kind == "{", s))).when(kind == '"', quoted).otherwise(s)


def section_syntheses(value: Column, sections: list[str]) -> Column:
    """Per section of a JSON object, what is known of its synthesis with defaults, null where there is none: text alone counts as of
    high confidence, an object gives what it has."""
    v = F.try_parse_json(value)

    def one(name: str) -> Column:
        path = f"$.{name}"
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        get = lambda field, as_: F.try_variant_get(v, f"{path}.{field}", as_)
        text = lambda c: F.trim(F.coalesce(c, F.lit("")))
        number = lambda field: F.coalesce(get(field, "bigint"), F.lit(0))
        issues = F.filter(F.transform(F.coalesce(get("review_issues", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        whole = {
            "synthesis": text(get("synthesis", "string")), "confidence": F.coalesce(F.nullif(get("confidence", "string"), F.lit("")), F.lit("low")), "warning": F.nullif(F.trim(get("warning", "string")), F.lit("")),
            "fabrication_flagged": F.coalesce(get("fabrication_flagged", "boolean"), F.lit(False)), "retrieval_rounds": number("retrieval_rounds"), "rewrite_rounds": number("rewrite_rounds"),
            "review_score": number("review_score"), "review_issues": issues, "evidence_chunk_count": number("evidence_chunk_count"),
        }
        none = F.array().cast("array<string>")
        bare = {"synthesis": text(F.try_variant_get(v, path, "string")), "confidence": F.lit("high"), "warning": F.lit(None).cast("string"), "fabrication_flagged": F.lit(False), "review_issues": none}
        made = lambda fields: F.struct(*[fields.get(n, F.lit(0).cast("bigint")).alias(n) for n in whole])
        return F.when(kind == "STRING", made(bare)).when(F.startswith(kind, F.lit("OBJECT")), made(whole)).alias(name)

    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.struct(*[one(n) for n in sections]))


def synthesis_status(found: Column, sections: list[str]) -> Column:
    """struct(status, successful_sections, failed_sections) of section_syntheses."""
    have = F.filter(F.array(*[F.when(found[n].isNotNull(), F.lit(n)) for n in sections]), lambda x: x.isNotNull())
    status = lambda ok: F.when(F.size(ok) == len(sections), "success").when(F.size(ok) > 0, "partial_failure").otherwise("failed")
    return bind(have, lambda ok: F.struct(status(ok).alias("status"), ok.alias("successful_sections"), F.array_except(F.array(*map(F.lit, sections)), ok).alias("failed_sections")))
