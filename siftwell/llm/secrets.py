"""Operator 4: secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex runs) are reported as they stand. Parts that mean little alone
(a 40-character key-like string, an endpoint address) are weak candidates: an interval join within a scope of SCOPE
characters of the same text reports a weak secret only when an access identifier stands within the scope, and an endpoint
only when both an access identifier and a weak secret do.

The scan finds parts per text, batch by batch. Linking is a Spark join of weak parts with the parts that complete them:
both sides carry the scope-wide bin they lie in (the weak side its bin and both neighbours), the join key is (row, bin), a
distance condition makes it exact, and it is a semi join, so that no pairs are made, however many parts a text holds. Only
texts that hold a weak part and an access identifier take part, and only they are shuffled where columns are carried along.
All patterns take linear time, also on long lines.

Defined results: a null or empty text has no spans and the digest of the empty string; rows that repeat a doc_id, or have
none, are scanned each for themselves; offsets are code points, ends exclusive; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table
from .token_output import slices

SCOPE = 400
BASE = ("assign", "access", "hex")
WEAK = ("secret", "endpoint")
KINDS = BASE + WEAK
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_URL = re.compile(r"https?://[^\s\"'<>]+")
#: Whole runs of what host names are made of, each looked at once.
_HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9][A-Za-z0-9.-]*+")
_SUFFIX = ".amazonaws.com"
_HEX_BYTES = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = b"x" * 24
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strong kinds: leftmost, non-overlapping per kind; matches too short for their kind are dropped. Cheap
    tests for what every match must hold come before the patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _RUN in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("secret", *m.span()) for m in _SECRET.finditer(text)] + [("endpoint", *m.span()) for m in _URL.finditer(text)]
    taken = [m for _, *m in out if _ == "endpoint"]
    for m in _HOST.finditer(text) if _SUFFIX in text.lower() else ():
        end = m[0].lower().rfind(_SUFFIX) + len(_SUFFIX)
        if end > len(_SUFFIX) and not m[0][end : end + 1].isalnum():
            # A host within a URL is part of it.
            at = bisect_right(taken, [m.start(), len(text)]) - 1
            if at < 0 or taken[at][1] <= m.start():
                out.append(("endpoint", m.start(), m.start() + end))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(columns: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base, weak = [], []
                for t in part["text"].to_pylist():
                    found = base_spans(t) if t else []
                    base.append([dict(zip(("kind", "start", "end"), s)) for s in ordered(found)])
                    # A weak part counts only beside an access identifier, so that other texts need no look.
                    look = any(s[0] == "access" for s in found)
                    weak.append([dict(zip(("kind", "start", "end"), s)) for s in ordered(weak_spans(t))] if look else [])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(base, _SPAN_TYPE), pa.array(weak, _SPAN_TYPE)], names=[*columns, "base", "weak"])

    return scan


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs, ``base`` (strong spans) and ``weak`` (candidates) of each text."""
    ship(docs.sparkSession)
    given = docs.select(*dict.fromkeys([*columns, "text"])).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{c}` {t}" for c, t in given.select(*columns).dtypes)
    return given.mapInArrow(_scan(columns), f"{schema}, base {SPANS}, weak {SPANS}")


def near(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The rows of weak (row, kind, start, end) that have a part (row, start, end) at most scope characters away."""
    here = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor((F.col("end") - 1) / scope) + 1)))
    there = parts.select(F.col("row").alias("p_row"), F.col("start").alias("p_start"), F.col("end").alias("p_end")).withColumn("p_bin", F.explode(F.sequence(F.floor(F.col("p_start") / scope), F.floor((F.col("p_end") - 1) / scope))))
    close = (F.col("p_start") <= F.col("end") + scope) & (F.col("start") <= F.col("p_end") + scope)
    return here.join(there, (F.col("row") == F.col("p_row")) & (F.col("bin") == F.col("p_bin")) & close, "left_semi").select("row", "kind", "start", "end").distinct()


def link(scanned: DataFrame, scratch: Scratch, scope: int = SCOPE) -> DataFrame:
    """(l_row, linked): the weak spans of each row that complementary parts complete. scanned: row, base, weak."""
    weak = scratch.save(scanned.select("row", F.inline("weak")))
    access = scratch.save(scanned.select("row", F.inline("base")).filter("kind = 'access'"))
    secret = scratch.save(near(weak.filter("kind = 'secret'"), access, scope))
    endpoint = near(near(weak.filter("kind = 'endpoint'"), access, scope), secret, scope)
    return secret.unionByName(endpoint).groupBy(F.col("row").alias("l_row")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def find_secrets(docs: DataFrame, columns: list[str], scope: int = SCOPE) -> DataFrame:
    """The named columns of docs with ``base`` and ``spans`` (base and linked weak ones, by start and kind) per row; columns
    of docs that are called so give way."""
    scratch = Scratch(docs.sparkSession, "secrets")
    given = [c for c in columns if c not in ("base", "spans")]
    inner = {c: f"given {i}" for i, c in enumerate(given)}
    found = scratch.save(scan(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col("text")), list(inner.values())).withColumn("row", F.monotonically_increasing_id()))
    some = found.filter(F.size("weak") > 0)
    linked = link(some.select("row", "base", "weak"), scratch, scope).withColumn("linked", F.transform("linked", lambda s: F.struct(s["kind"], s["start"], s["end"])).cast(SPANS))
    joined = some.join(linked, F.col("row") == F.col("l_row"), "left").drop("l_row")
    both = found.filter(F.size("weak") == 0).withColumn("linked", F.lit(None).cast(SPANS)).unionByName(joined)
    by = F.transform(F.concat("base", F.coalesce("linked", F.array().cast(SPANS))), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(by), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select(*[F.col(f"`{n}`").alias(c) for c, n in inner.items()], "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[dict], mask: str) -> str:
    """The text with each stretch that spans (by start) cover replaced by a mask."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], mask]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def _mask(columns: list[str], mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, lengths = part["text"].to_pylist(), part["spans"].value_lengths().to_pylist()
                for i in [i for i, n in enumerate(lengths) if n]:
                    texts[i] = masked(texts[i], part["spans"][i].as_py(), mask)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part[c] for c in columns], names=columns)

    return run


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each found span replaced by a mask (overlapping spans by one), and n_chars brought in line if there. Each text is
    cut at its spans once, whatever their number."""
    columns = docs.columns
    renamed = docs.withColumnsRenamed({c: f"own {c}" for c in ("base", "spans") if c in columns})
    found = find_secrets(renamed, renamed.columns)

    columns_in = found.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    out = found.mapInArrow(_mask(columns_in, mask), schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.drop("base", "spans").withColumnsRenamed({f"own {c}": c for c in ("base", "spans")}).select(*columns)


def _equals(kind: str):
    return lambda x: x == kind


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    n = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _equals(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
