"""Page blocks and lines to section segments, text units, chunks and tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions.batches import slices
from . import documents

TABLE_LABEL = r"(?i)\btable\s+([0-9]+)\b"
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


# Blocks


def clean_lines(text: Column) -> Column:
    """Lines with runs of blanks and tabs squeezed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " "))), lambda s: s != "")


def table_block(lines: Column) -> Column:
    """Lines of at least two cells (parted by a tab or two blanks) as piped rows of one width; null unless there are two such lines."""
    cells = lambda s: F.filter(F.transform(F.split(s, r"\s{2,}|\t+"), lambda c: F.trim(c)), lambda c: c != "")
    rows = F.filter(F.transform(lines, cells), lambda r: F.size(r) >= 2)

    def piped(x: Column) -> Column:
        return F.transform(x["rows"], lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), x["width"] - F.size(r))), " | "))

    wide = lambda r: F.struct(r.alias("rows"), F.array_max(F.transform(r, lambda c: F.size(c))).alias("width"))
    made = T.bind(T.bind(rows, wide), lambda x: F.when(F.size(x["rows"]) >= 2, F.array_join(piped(x), "\n")))
    return F.concat(F.lit("TABLE:\n"), made)


def equation_line(line: Column, marks: list[str] = L.EQUATION_MARKS) -> Column:
    s = F.trim(line)
    return (s != "") & T.contains_any(s, marks) & (F.size(F.split(T.squeeze(s), " ")) <= 40)


def block_text(text: Column) -> Column:
    """A block as it is stored: a table's piped rows, else its lines with formulas marked."""
    raw = F.filter(F.split(text, r"\r\n|\n|\r"), lambda s: F.trim(s) != "")
    marked = F.transform(clean_lines(text), lambda s: F.when(equation_line(s), F.concat(F.lit("EQUATION: "), s)).otherwise(s))
    return F.coalesce(table_block(raw), F.array_join(marked, "\n"))


def table_rows(text: Column) -> Column:
    """A table's text as rows of cells."""
    return F.transform(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.transform(F.split(s, r"\|"), lambda c: F.trim(c)))


def page_text(blocks: Column) -> Column:
    """A page's blocks joined by blank lines, without the NUL character."""
    return F.translate(F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"), "\x00", "")


# Sections


def primary_heading(line: Column, aliases: dict[str, str] = L.SECTION_ALIASES) -> Column:
    """struct(name, heading, rest) of a line that opens a section: an alias, numbering aside, or a line that starts with one and
    goes on (rest); null otherwise."""
    bare = T.squeeze(F.regexp_replace(F.lower(line), r"^\s*[0-9]+(\.[0-9]+)*\s*", ""))
    s = F.trim(line)
    low = F.lower(s)
    made = lambda name, heading, rest: F.struct(name.alias("name"), heading.alias("heading"), rest.alias("rest"))
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), bare)
    # The aliases are one constant; the first that the line starts with counts.
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name"), F.lit(a.title()).alias("title")) for a, n in aliases.items()])
    first = F.try_element_at(F.filter(known, lambda x: F.startswith(low, F.concat(x["alias"], F.lit(":"))) | F.startswith(low, F.concat(x["alias"], F.lit(" ")))), F.lit(1))
    led = T.bind(first, lambda x: F.when(x.isNotNull(), made(x["name"], x["title"], F.nullif(F.regexp_replace(F.substr(s, F.length(x["alias"]) + 1), r"^[ :\-\t]+", ""), F.lit("")))))
    return F.when(documents.may_open(line, aliases), F.when(name.isNotNull(), made(name, s, F.lit(None).cast("string"))).otherwise(led))


def parse_sections(lines: DataFrame, id_col: str, aliases: dict[str, str] = L.SECTION_ALIASES, subsections: bool = True) -> DataFrame:
    """Segments of (id, pos, line, page_number): id, section_order, section_name, section_heading, subsection_name, page_number,
    content. A primary heading opens a section, another heading a subsection of it; heading lines aren't content, what
    follows an alias on its line is. Runs without content give no segment; a document without any gives one of all its text."""
    marked = lines.withColumn("primary", F.when(F.trim("line") != "", primary_heading(F.col("line"), aliases)))
    sub = F.col("primary").isNull() & (documents.subheading(F.col("line")) if subsections else F.lit(False))
    marked = marked.withColumn("sub", F.when(sub, F.trim("line"))).withColumn("opens", F.col("primary").isNotNull() | F.col("sub").isNotNull())
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("run", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("section", F.sum(F.col("primary").isNotNull().cast("int")).over(so_far))
    text = F.when(F.col("opens"), F.col("primary.rest")).otherwise(F.when(F.trim("line") != "", F.col("line")))
    body = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("text")))))
    first = F.min(F.when(F.trim("line") != "", F.struct("pos", "page_number")))
    joined = lambda of, field: F.array_join(F.transform(of, lambda x: x[field]), "\n")
    # Lines that aren't content go along, as those of a document that has nothing else are its content: headings and blank lines.
    rest = F.collect_list(F.when(text.isNull(), F.struct("pos", "line")))
    found = runs.groupBy(id_col, "section", "run").agg(F.max("primary").alias("opener"), F.max("sub").alias("subsection_name"), first["page_number"].alias("page_number"), joined(body, "text").alias("content"), rest.alias("rest"))
    full, ids = F.trim("content") != "", Window.partitionBy(id_col)
    named = found.withColumn("own", F.max("opener").over(Window.partitionBy(id_col, "section"))).withColumn("bare", ~F.max(full).over(ids)).filter(full | F.col("bare"))
    placed = named.withColumn("section_order", F.row_number().over(ids.orderBy("run")) - 1).withColumn("all", F.collect_list(F.when(F.col("bare"), F.col("rest"))).over(ids))
    placed = placed.filter(~F.col("bare") | (F.col("section_order") == 0))
    own = lambda column, other: F.when(F.col("bare"), other).otherwise(column)
    front, title = F.lit("front_matter"), F.lit("Front Matter")
    out = placed.select(id_col, "section_order", own(F.coalesce("own.name", front), front).alias("section_name"), own(F.coalesce("own.heading", title), title).alias("section_heading"), own(F.col("subsection_name"), None).alias("subsection_name"), own(F.col("page_number"), 1).cast(lines.schema["page_number"].dataType).alias("page_number"), own(F.col("content"), joined(F.array_sort(F.flatten("all")), "line")).alias("content"))
    return out.filter(F.trim("content") != "")


# Units and chunks: a small helper for each text, in Arrow batches


def text_units(text: str) -> list[str]:
    """Table rows and formula lines as they stand, sentences of all other lines."""
    units: list[str] = []
    for paragraph in (p.strip() for p in text.split("\n\n")):
        lines = [s for s in (x.strip() for x in paragraph.splitlines()) if s]
        if paragraph.startswith("TABLE:"):
            units += lines
            continue
        for line in lines:
            units += [line] if line.startswith("EQUATION:") else [s for s in (x.strip() for x in _SENTENCE.split(line)) if s]
    return units


def merge_units(units: list[str]) -> list[str]:
    """Units with those that go on from what stands before them joined to it: by how they begin, as what explains a formula, or
    as the terms of a result. What a joined unit holds of formulas and results is kept along, so that work is linear."""
    out: list[list[str]] = []
    formula = result = False
    for unit in filter(None, (u.strip() for u in units)):
        low = unit.lower()
        goes_on = low.startswith(tuple(L.CONTINUATIONS)) or (formula and any(h in low for h in L.EXPLANATIONS)) or (result and any(m in low for m in L.CLAIM_METRICS))
        if not out or not goes_on:
            out.append([])
            formula = result = False
        out[-1].append(unit)
        formula = formula or "equation:" in low or "=" in unit or "o(" in low
        result = result or any(h in low for h in ("result", "improves", "achieves", "outperforms"))
    return [" ".join(u) for u in out]


def count_words(text: str) -> int:
    return len(text.split())


def chunk_sections(sections: DataFrame, id_col: str, most: int = 400, overlap: int = 50, count: Callable[[str], int] = count_words, guard: bool = False) -> DataFrame:
    """Chunks of segments (id, section_order, section_name, subsection_name, content): with chunk_index through each document,
    content, token_count. ``count`` gives a unit's tokens (words unless a tokenizer is brought, ``functions.tokens``). With
    guard, a segment that it fails on gives one row with its ``error`` and without content, and the others go on."""
    kind = dict(sections.dtypes)[id_col]
    names = [id_col, "section_order", "section_name", "subsection_name"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.string()]

    def chunked(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []  # of the segment's place in the part, its chunk's place, content, tokens, error
        for at, text in enumerate(part.column("content").to_pylist()):
            try:
                units = merge_units(text_units((text or "").replace("\x00", "")))
                sizes = count.many(units) if hasattr(count, "many") else [count(u) for u in units]
                rows += [(at, i, c, n, None) for i, (c, n) in enumerate(documents.pack_units(list(zip(units, sizes)), most, overlap))]
            except Exception as e:
                if not guard:
                    raise
                rows.append((at, 0, None, 0, f"{type(e).__name__}: {e}"))
        at, *made = zip(*rows) if rows else [()] * 5
        own = part.select(names).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, made, types)], [*names, "local", "content", "token_count", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(chunked, slices(batch, "c_bytes"))

    kept = sections.select(id_col, F.col("section_order").cast("int").alias("section_order"), "section_name", "subsection_name", "content", F.octet_length("content").alias("c_bytes"))
    made = kept.mapInArrow(run, f"`{id_col}` {kind}, section_order int, section_name string, subsection_name string, local int, content string, token_count int, error string")
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("section_order", "local")) - 1
    return made.withColumn("chunk_index", index).select(id_col, "chunk_index", "section_name", "subsection_name", "content", "token_count", *(["error"] if guard else []))


# Tables


def names_in(text: Column, words: list[str]) -> Column:
    """The words that a text holds, short ones in capitals and others with one."""
    shown = [w.upper() if len(w) <= 4 else w.title() for w in words]
    return F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(s)) for w, s in zip(words, shown)]), lambda x: x.isNotNull())


def model_names(text: Column) -> Column:
    """First cells of the rows after the header, five at most, without short ones that hold a digit."""
    cells = F.transform(F.slice(T.lines(text), F.lit(2), F.lit(5)), lambda s: F.trim(F.split(s, r"\|")[0]))
    kept = F.filter(cells, lambda c: (F.length(c) >= 2) & ~(c.rlike("[0-9]") & (F.size(F.split(T.squeeze(c), " ")) <= 2)))
    places = F.transform(kept, lambda c, i: F.when(F.array_position(F.transform(kept, lambda d: F.lower(d)), F.lower(c)) == i + 1, c))
    return F.filter(places, lambda c: c.isNotNull())


def table_artifacts(blocks: DataFrame, segs: DataFrame, label: str = TABLE_LABEL, page: tuple = ("id", "page_number")) -> DataFrame:
    """Tables among page blocks (id, page_number, block_index, text): those that look like one and have a caption beside them or
    a label of their own, one for each label, page and text, in reading order."""
    text = F.regexp_replace(F.regexp_replace(F.translate("text", "\x00", ""), r"[ \t]+(\n|$)", "$1"), r"^\s+|\s+$", "")
    w = Window.partitionBy(*page).orderBy("block_index")
    labelled = F.when(F.col("text").rlike(label), F.col("text"))
    rows = blocks.withColumn("text", text).withColumn("labelled", labelled)
    around = [F.lag("labelled", i).over(w) for i in range(4, 0, -1)] + [F.lead("labelled", i).over(w) for i in range(1, 5)]
    rows = rows.withColumn("caption", F.coalesce(*around))
    number = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("caption", F.lit("")), label, 1), F.lit("")), F.nullif(F.regexp_extract(F.split("text", "\n")[0], label, 1), F.lit("")))
    rows = rows.withColumn("table_label", F.concat(F.lit("Table "), number)).withColumn("payload", T.table_payload(F.col("text")))
    found = rows.filter(F.col("payload") & (F.col("caption").isNotNull() | F.col("table_label").isNotNull()))
    full = F.regexp_replace(F.concat_ws("\n", F.coalesce("caption", F.lit("")), "text"), r"^\s+|\s+$", "")
    found = found.withColumn("normalized_table_text", full)
    same = Window.partitionBy(page[0], "table_label", page[1], "normalized_table_text").orderBy("block_index")
    once = found.withColumn("r", F.row_number().over(same)).filter("r = 1")
    index = F.row_number().over(Window.partitionBy(page[0]).orderBy(page[1], "block_index")) - 1
    out = once.withColumn("table_index", index).withColumn("table_id", F.col("table_index"))
    out = out.select("id", "table_id", "table_index", "table_label", "caption", "page_number", F.col("text").alias("raw_table_text"), "normalized_table_text", T.table_type(F.concat_ws("\n", F.coalesce("caption", F.lit("")), "text")).alias("table_type"), names_in(F.col("normalized_table_text"), L.TABLE_METRICS).alias("metric_names"), T.lexicon_hits(F.col("normalized_table_text"), L.TABLE_DATASETS).alias("dataset_names"), model_names(F.col("text")).alias("model_names"))
    keys = out.select("id", "table_id", "page_number")
    at = documents.locate(keys, segs).select(F.col("id").alias("l_id"), F.col("table_id").alias("l_table"), "section_name")
    links = documents.linked(keys, segs).select(F.col("id").alias("k_id"), F.col("table_id").alias("k_table"), "linked_indexes")
    out = out.join(at, (F.col("id") == F.col("l_id")) & (F.col("table_id") == F.col("l_table")), "left").join(links, (F.col("id") == F.col("k_id")) & (F.col("table_id") == F.col("k_table")), "left")
    return out.drop("l_id", "l_table", "k_id", "k_table", "table_id")
