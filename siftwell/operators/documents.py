"""Documents to segments, sections, tables and chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions.batches import slices


def may_open(line: Column, aliases: dict[str, str]) -> Column:
    """Whether a line begins, numbering aside, with the first word of an alias; no other line need be compared with all of them."""
    words = "|".join(rf"\Q{w}\E" for w in sorted({a.split(" ")[0] for a in aliases}))
    return line.rlike(rf"^(?iu)\s*(?:[0-9]+(?:\.[0-9]+)*\s*)?(?:{words})")


def heading(line: Column, aliases: dict[str, str] = L.SECTION_ALIASES) -> Column:
    """The section that a line opens: an alias, numbering aside, or a line that starts with one; null otherwise."""
    bare = T.squeeze(F.regexp_replace(F.lower(line), r"^\s*[0-9]+(\.[0-9]+)*\s*", ""))
    low = F.trim(F.lower(line))
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), bare)
    # One constant list of aliases: nested choices, one for each, would take planning ages.
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in aliases.items()])
    led = F.filter(known, lambda x: F.startswith(low, F.concat(x["alias"], F.lit(":"))) | F.startswith(low, F.concat(x["alias"], F.lit(" "))))
    return F.when(may_open(line, aliases), F.coalesce(name, F.try_element_at(led, F.lit(1))["name"]))


def subheading(line: Column) -> Column:
    s = F.trim(line)
    numbered = s.rlike(r"^[0-9]+\.\s+.+") | s.rlike(r"^[0-9]+(\.[0-9]+)+\s+.+") | s.rlike(r"^[IVXLC]+\.?\s+.+") | s.rlike(r"^[A-Z]\.\s+.+")
    titled = ~s.rlike(r"[,\[\]\"“”:]|\.$") & ~F.contains(F.lower(s), F.lit("et al")) & s.rlike(r"^\p{Lu}[^\p{Lu}\s]*( \p{Lu}[^\p{Lu}\s]*){1,5}$")
    return (s != "") & (F.length(s) <= 100) & (numbered | titled)


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line), without the NUL character or trailing blanks."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\x00"), F.lit("")), r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", F.rtrim("line"))


def segments(lines: DataFrame, id_col: str, opens: Column, name: Column, first: str = "front_matter") -> DataFrame:
    """Runs of lines between headings: id, section_order, section_name, content.

    opens: whether a line is a heading; name: the section it opens. Heading lines aren't part of the content; runs
    without content give no segment. The window is over the lines of one document.
    """
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("int")).over(w)).withColumn("name", F.when(F.col("opens"), name))
    body = F.array_sort(F.collect_list(F.when(~F.col("opens") & (F.trim("line") != ""), F.struct("pos", "line"))))
    runs = marked.groupBy(id_col, "run").agg(F.max("name").alias("name"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content")).filter(F.trim("content") != "")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("run")) - 1
    return runs.withColumn("section_order", order).select(id_col, "section_order", F.coalesce("name", F.lit(first)).alias("section_name"), "content")


def merged(parts: DataFrame, *key: str, order: str = "section_order", content: str = "content", **more: Column) -> DataFrame:
    """Segments of one key joined in order by a blank line, with the first order and the number of parts; a null name is a key. more:
    further aggregates by name."""
    return parts.groupBy(*key).agg(
        F.min(order).alias("first_order"), F.count("*").alias("n_parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n\n").alias("content"),
        *[c.alias(name) for name, c in more.items()],
    )


def captions(blocks: DataFrame, id_col: str, index: str, text: str, pattern: str, span: int = 4) -> DataFrame:
    """The caption of each block: the first labelled block among span..1 before, then 1..span after."""
    w = Window.partitionBy(id_col).orderBy(index)
    labelled = F.when(F.col(text).rlike(pattern), F.col(text))
    marked = blocks.withColumn("labelled", labelled)
    around = [F.lag("labelled", i).over(w) for i in range(span, 0, -1)] + [F.lead("labelled", i).over(w) for i in range(1, span + 1)]
    return marked.withColumn("caption", F.coalesce(*around)).drop("labelled")


def locate(tables: DataFrame, segs: DataFrame) -> DataFrame:
    """tables (id, table_id, page_number) with the section they lie in: the first segment of the page, else the last at or before it."""
    on = (F.col("id") == F.col("s_id")) & (F.col("s_page") <= F.col("page_number"))
    s = segs.select(F.col("id").alias("s_id"), F.col("page_number").alias("s_page"), F.col("section_order").alias("s_order"), F.col("section_name").alias("s_name"))
    found = tables.join(s, on, "left")
    same = F.min(F.when(F.col("s_page") == F.col("page_number"), F.struct("s_order", "s_name")))
    return found.groupBy("id", "table_id", "page_number").agg(F.coalesce(same, F.max(F.struct("s_order", "s_name"))).alias("m")).select("id", "table_id", "page_number", F.col("m.s_name").alias("section_name"))


def linked(tables: DataFrame, segs: DataFrame, span: int = 2) -> DataFrame:
    """Segment orders within span of any segment on a table's page, sorted."""
    s = segs.select(F.col("id").alias("s_id"), F.col("page_number").alias("s_page"), F.explode(F.sequence(F.col("section_order") - span, F.col("section_order") + span)).alias("o"))
    found = tables.join(s, (F.col("id") == F.col("s_id")) & (F.col("page_number") == F.col("s_page")))
    return found.groupBy("id", "table_id").agg(F.array_join(F.array_sort(F.collect_set(F.greatest(F.col("o"), F.lit(0)))), ",").alias("linked_indexes"))


def pack_ranges(counts: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy chunks of units of so many tokens each, as ranges: at most ``most`` tokens, each repeating the last units of the one
    before up to ``overlap`` tokens (one unit at least). A unit too large for a chunk is one by itself, and units then pending
    are lost. Ends and overlaps are found by search among the cumulative counts."""
    total = [0, *accumulate(counts)]
    large = [i for i, n in enumerate(counts) if n >= most]
    out, start, new, n = [], 0, 0, len(counts)  # start: first unit held; new: first one that no chunk has yet
    while start < n:
        k = bisect_left(large, new)
        wall = large[k] if k < len(large) else n
        end = min(max(bisect_right(total, total[start] + most) - 1, new + 1), wall)
        if end < wall:
            out.append((start, end))
            start, new = max(start, min(bisect_left(total, total[end] - overlap), end - 1)), end
        elif wall < n:
            out.append((wall, wall + 1))
            start = new = wall + 1
        else:
            out.append((start, n))
            break
    return out


def pack_units(units: list[tuple[str, int]], most: int, overlap: int) -> list[tuple[str, int]]:
    """pack_ranges of (text, tokens), as texts of joined lines with their tokens."""
    return [("\n".join(u for u, _ in units[a:b]), sum(n for _, n in units[a:b])) for a, b in pack_ranges([n for _, n in units], most, overlap)]


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, most: int = 400, overlap: int = 50) -> DataFrame:
    """Chunks of each text: id, chunk_index, content, token_count. Units are sentences within lines; tokens are words."""
    units = F.flatten(F.transform(T.lines(F.col(text_col)), lambda s: F.split(s, r"(?<=[.!?])\s+(?=[A-Z0-9])")))
    kept = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), units.alias("units"), F.octet_length(text_col).alias("c_bytes")).withColumn("sizes", F.transform("units", lambda u: T.word_count(u)))

    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for at, (us, ns) in enumerate(zip(part.column("units").to_pylist(), part.column("sizes").to_pylist())):
            rows += [(at, i, c, n) for i, (c, n) in enumerate(pack_units(list(zip(us, ns)), most, overlap))]
        at, *made = zip(*rows) if rows else [()] * 4
        own = part.column(id_col).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([own, *map(pa.array, made, [pa.int32(), pa.string(), pa.int32()])], [id_col, "chunk_index", "content", "token_count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(packed, slices(batch, "c_bytes"))

    return kept.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, chunk_index int, content string, token_count int")


def claim_units(text: Column) -> Column:
    """Sentences of a text, each one that goes on from the one before (no capital at its start) merged into it. The places where
    units start cut the list of sentences, so that each is looked at once."""
    units = F.filter(F.flatten(F.transform(T.lines(text), lambda s: F.split(s, r"(?<=[.!?])\s+"))), lambda u: u != "")

    def cut(u: Column) -> Column:
        starts = F.filter(F.transform(u, lambda s, i: F.when((i == 0) | s.rlike(r"^[\p{Lu}0-9\[]"), i + 1)), lambda i: i.isNotNull())
        return T.bind(F.struct(starts.alias("at"), F.size(u).alias("n")), lambda x: F.transform(x["at"], lambda s, k: F.array_join(F.slice(u, s, F.coalesce(F.try_element_at(x["at"], k + 2), x["n"] + 1) - s), " ")))

    return T.bind(units, cut)
