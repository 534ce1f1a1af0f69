"""The whole ingestion job: documents or pages to sections, subsections, chunks, tables and domains with vectors, documents that
fail kept apart, and only what changed indexed again.

A document that makes a step fail costs only itself: it leaves all outputs and stands in ``quarantine`` with the step and the
error. ``documents`` holds a row for each document that was taken, with a digest of what it was made from, so that a later run
leaves out what hasn't changed. All outputs of a run go to the store by one commit.

Defined results: a null key stands in quarantine ("no id"), once for all its rows, and so does a null or blank text ("no text"); of several rows with one key,
that with the greatest digest counts; a key that was asked for and isn't there is "not found"; no documents make no version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions.vectors import hashed_embedding
from ..sources.store import IndexStore
from . import documents, parsing
from .indexing import cleaned, dropped, prepared, shuffles_dropped, stored, top_chunk_domains

STEPS = ["read", "parse", "chunk", "vector"]
#: Texts are indexed in slices of about so many bytes, by the store's buckets; the most slices of a run.
SLICE_BYTES, MOST_SLICES = 1 << 28, 4


def with_vectors(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with ``embedding`` of a text column and ``error``. embed: vectors of a list of texts; a batch that it fails on is
    gone through one by one, so that only what it can't do has an error. Without one, hashed tokens stand in for a model."""
    if embed is None:
        return rows.withColumn("embedding", hashed_embedding(T.tokens(F.col(text))).cast("array<float>")).withColumn("error", F.lit(None).cast("string"))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def one(value: str) -> tuple[list[float] | None, str | None]:
        try:
            return list(map(float, embed([value])[0])), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x or "" for x in pdf[text]]
            try:
                made = [(list(map(float, v)), None) for v in embed(texts)]
                if len(made) != len(texts):
                    raise ValueError(f"{len(made)} vectors of {len(texts)} texts")
            except Exception:
                made = [one(x) for x in texts]
            yield pdf.assign(embedding=[v for v, _ in made], error=[e for _, e in made])

    return rows.mapInPandas(run, f"{fields}, embedding array<float>, error string")


def joined(segs: DataFrame, embed, *key: str) -> DataFrame:
    """Segments of one key merged, with token_count, embedding and error; without ``embed``, by the segments' own counts and words."""
    if embed is not None:
        return with_vectors(documents.merged(segs, *key).withColumn("token_count", T.word_count(F.col("content"))), "content", embed)
    made = documents.merged(segs, *key, token_count=F.sum("words").cast("int"), counts=F.collect_list("counts"))
    total = F.aggregate(F.slice("counts", F.lit(2), F.size("counts")), F.col("counts")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return made.withColumn("embedding", total.cast("array<float>")).withColumn("error", F.lit(None).cast("string")).drop("counts")


def page_lines(blocks: DataFrame, key: str) -> DataFrame:
    """(key, pos, line, page_number) of page blocks (key, page_number, block_index, text): blocks of a page joined by blank lines."""
    order = F.array_sort(F.collect_list(F.struct("block_index", F.coalesce("text", F.lit("")).alias("text"))))
    pages = blocks.groupBy(key, "page_number").agg(parsing.page_text(F.transform(order, lambda b: b["text"])).alias("text"))
    lines = pages.select(key, "page_number", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    return lines.select(key, F.struct("page_number", "at").alias("pos"), F.rtrim("line").alias("line"), "page_number")


def digested(docs: DataFrame, key: str, blocks: DataFrame | None) -> DataFrame:
    """(key, text, digest) of all given rows; a key may have several."""
    made = docs.select(key, F.col("text").cast("string").alias("text"))
    if blocks is not None:
        order = F.array_sort(F.collect_list(F.struct("page_number", "block_index", F.coalesce("text", F.lit("")).alias("text"))))
        pages = blocks.groupBy(F.col(key).alias("b_key")).agg(F.concat_ws("\n", F.transform(order, lambda b: F.concat_ws(":", b["page_number"].cast("string"), b["text"]))).alias("pages"))
        made = made.join(pages, F.col(key) == F.col("b_key"), "left").select(key, F.coalesce("text", "pages").alias("text"))
    return made.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """The row (key, text, digest) with the greatest digest for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct("text", "digest"), "digest").alias("m")).select(key, "m.text", "m.digest")


def index_documents(taken: DataFrame, staging: str, key: str = "paper_id", blocks: DataFrame | None = None, embed=None, count: Callable[[str], int] = parsing.count_words, aliases: dict[str, str] = L.SECTION_ALIASES, most: int = 400, overlap: int = 50, parsed: Callable[[], None] = lambda: None) -> dict[str, DataFrame]:
    """All tables of an index of ``taken`` (key, text, digest; one row a key): sections, subsections, chunks and tables with vectors, domains,
    documents and quarantine. Intermediate tables are staged in a folder that all share, each text once in each form; ``parsed`` is called when
    ``taken`` isn't read any more."""
    bare = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    cause = F.when(F.col(key).isNull(), "no id").when(bare, "no text")
    read = stored(taken.select(key, "digest", cause.alias("error")), f"{staging}/read")
    unread = read.filter("error is not null").select(key, F.lit("read").alias("step"), "error")
    good = taken.filter(cause.isNull())
    lines = documents.document_lines(good, key, "text").withColumn("page_number", F.lit(None).cast("int"))
    if blocks is not None:
        own = blocks.join(read.filter("error is null").select(F.col(key).alias("g_key")), F.col(key) == F.col("g_key"), "left_semi").withColumn("page_number", F.col("page_number").cast("int"))
        paged = page_lines(own, key)
        plain = lines.join(own.select(F.col(key).alias("p_key")).distinct(), F.col(key) == F.col("p_key"), "left_anti")
        lines = paged.unionByName(plain.withColumn("pos", F.struct(F.lit(None).cast("int").alias("page_number"), F.col("pos").alias("at"))))
    segs = parsing.parse_sections(lines, key, aliases)
    if embed is None:  # counts of words are those of the parts added up, so that each text is counted once for all that it goes into
        segs = segs.withColumns({"counts": hashed_embedding(T.tokens(F.col("content"))), "words": T.word_count(F.col("content"))})
    segs = stored(segs, f"{staging}/segments")
    parsed()
    clean = stored(cleaned(parsing.chunk_sections(segs, key, most, overlap, count, guard=True)), f"{staging}/clean")
    made = {"sections": joined(segs, embed, key, "section_name"), "subsections": joined(segs, embed, key, "section_name", "subsection_name"), "chunks": with_vectors(prepared(clean.filter("error is null").drop("error"), key), "content", embed)}
    if blocks is not None:
        found = parsing.table_artifacts(own.withColumnRenamed(key, "id"), segs.withColumnRenamed(key, "id")).withColumnRenamed("id", key)
        made["tables"] = with_vectors(found.withColumn("token_count", T.word_count(F.col("normalized_table_text"))), "normalized_table_text", embed)
    # Without a model, sections are only joined and added up, where they are written; what they are made of is staged.
    out = {name: rows if embed is None and "sections" in name else stored(rows, f"{staging}/{name}") for name, rows in made.items()}
    failures = [unread, clean.filter("error is not null").select(key, F.lit("chunk").alias("step"), "error")]
    failures += [rows.filter("error is not null").select(key, F.lit("vector").alias("step"), F.concat_ws(": ", F.lit(name), "error").alias("error")) for name, rows in out.items()]
    every = failures[0]
    for f in failures[1:]:
        every = every.unionByName(f)
    place = T.lookup(F.col("step"), {s: i for i, s in enumerate(STEPS)}, len(STEPS))
    failed = stored(every.groupBy(key).agg(F.min_by(F.struct("step", "error"), F.struct(place, "error")).alias("m")).select(key, "m.step", "m.error"), f"{staging}/failed")
    gone = failed.select(F.col(key).alias("f_key"))
    out = {name: rows.drop("error").join(gone, F.col(key).eqNullSafe(F.col("f_key")), "left_anti") for name, rows in out.items()}
    out["domains"] = top_chunk_domains(out["chunks"], key)
    out["documents"] = _documents(read, clean, out, failed, key)
    out["quarantine"] = failed.join(read.select(F.col(key).alias("t_key"), "digest"), F.col(key).eqNullSafe(F.col("t_key")), "left").drop("t_key")
    out |= {name: stored(out[name], f"{staging}/{name}") for name in ("domains", "documents", "quarantine")}
    dropped(clean.sparkSession, f"{staging}/clean")
    return out


def _documents(read: DataFrame, raw: DataFrame, out: dict[str, DataFrame], failed: DataFrame, key: str) -> DataFrame:
    counts = [rows.groupBy(F.col(key).alias("n_key")).agg(F.count("*").alias("n")).withColumn("what", F.lit(f"n_{name}")) for name, rows in (("raw_chunks", raw.filter("error is null")), *((n, out[n]) for n in ("sections", "subsections", "chunks", "tables") if n in out))]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    names = ["n_raw_chunks", "n_sections", "n_subsections", "n_chunks", "n_tables"]
    wide = every.groupBy("n_key").agg(*[F.sum(F.when(F.col("what") == n, F.col("n")).otherwise(0)).alias(n) for n in names])
    marks = failed.select(F.col(key).alias("f_key"), F.lit(True).alias("failed"))
    both = read.select(key, "digest").join(marks, F.col(key).eqNullSafe(F.col("f_key")), "left").join(wide, F.col(key) == F.col("n_key"), "left")
    n = [F.when(F.col("failed").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in names]
    return both.select(key, "digest", F.when(F.col("failed"), "failed").otherwise("indexed").alias("status"), *n)


def unchanged(store: IndexStore, retry: bool) -> DataFrame | None:
    """(key, digest) of the documents that needn't be taken again; with retry, those that failed are."""
    if "documents" not in store.tables():
        return None
    known = store.read("documents")
    return (known.filter("status = 'indexed'") if retry else known).select(F.col(store.key).alias("k_key"), F.col("digest").alias("k_digest"))


def reindex(store: IndexStore, docs: DataFrame, staging: str, only: DataFrame | None = None, rebuild: bool = False, retry: bool = False, blocks: DataFrame | None = None, batch: tuple[str, int] | None = None, **how) -> dict[str, int]:
    """Indexes documents (key, text) anew: all that changed since they were indexed, or those of ``only`` whatever they were, or with
    ``rebuild`` all, in place of all that there was. Failed documents lose their old rows and are tried again when they
    change, or with ``retry``. blocks: page blocks (key, page_number, block_index, text) of documents that have them. Returns how many succeeded, failed and
    were left as they are."""
    with shuffles_dropped(docs.sparkSession):
        return _reindex(store, docs, staging, only, rebuild, retry, blocks, batch, how)


def _reindex(store: IndexStore, docs: DataFrame, staging: str, only: DataFrame | None, rebuild: bool, retry: bool, blocks: DataFrame | None, batch: tuple[str, int] | None, how: dict) -> dict[str, int]:
    """Only keys, digests and sizes are kept of what was given; texts are fetched for the documents that are taken, and indexed slice by
    slice, so that what is staged beside the store is a slice's."""
    key, spark = store.key, docs.sparkSession
    texts = digested(docs, key, blocks)
    given = stored(texts.groupBy(key).agg(F.max("digest").alias("digest"), F.max(F.octet_length("text").cast("long")).alias("size")), f"{staging}/given")
    wanted, known = given, None
    if only is not None:
        asked = only.select(F.col(key).alias("o_key")).distinct()
        there = given.join(asked, F.col(key).eqNullSafe(F.col("o_key")), "left_semi")
        absent = asked.join(given, F.col("o_key").eqNullSafe(F.col(key)), "left_anti").select(F.col("o_key").alias(key))
        wanted = there
    elif not rebuild and (known := unchanged(store, retry)) is not None:
        wanted = given.join(known, F.col(key).eqNullSafe(F.col("k_key")) & (F.col("digest") == F.col("k_digest")), "left_anti")
    taken = stored(wanted, f"{staging}/taken")
    lost = None if only is None else stored(absent, f"{staging}/absent")
    if not rebuild and not batch and taken.isEmpty() and (lost is None or lost.isEmpty()):
        left = given.count() if only is None else 0
        dropped(spark, *[f"{staging}/{x}" for x in ("given", "taken", "absent")])
        return {"succeeded": 0, "failed": 0, "unchanged": left}
    n_slices = min(MOST_SLICES, store.buckets, max(1, -(-(taken.agg(F.sum("size")).first()[0] or 0) // SLICE_BYTES)))
    if only is not None or known is not None:
        texts = texts.join(taken.select(F.col(key).alias("w_key")), F.col(key).eqNullSafe(F.col("w_key")), "left_semi")
    cut = one_each(texts, key).withColumn("slice", F.pmod(store.bucket(), F.lit(n_slices)))
    cut.write.mode("overwrite").partitionBy("slice").parquet(f"{staging}/texts")
    cut = spark.read.schema(cut.schema).parquet(f"{staging}/texts")
    n: dict[str, int] = {}

    def parts() -> Iterator[dict[str, DataFrame]]:
        for i in range(n_slices):
            part = f"{staging}/slice-{i}"
            out = index_documents(cut.filter(F.col("slice") == i).drop("slice"), part, key, blocks, parsed=lambda: dropped(spark, f"{staging}/texts/slice={i}"), **how)
            if lost is not None and i == 0:
                none = F.lit(None).cast("string")
                out["quarantine"] = out["quarantine"].unionByName(lost.select(key, F.lit("read").alias("step"), F.lit("not found").alias("error"), none.alias("digest")))
                out["documents"] = out["documents"].unionByName(lost.select(key, none.alias("digest"), F.lit("failed").alias("status"), *[F.lit(0).cast("long").alias(c) for c in out["documents"].columns[3:]]))
            for r in out["documents"].groupBy("status").agg(F.count("*").alias("n")).collect():
                n[r["status"]] = n.get(r["status"], 0) + r["n"]
            yield out
            dropped(spark, part)

    keys = taken.select(key) if lost is None else taken.select(key).unionByName(lost)
    store.commit(parts(), None if rebuild else keys, batch)
    done = n.get("indexed", 0) + n.get("failed", 0)
    left = given.count() - done if only is None else 0
    dropped(spark, *[f"{staging}/{x}" for x in ("given", "taken", "absent", "texts")])
    return {"succeeded": n.get("indexed", 0), "failed": n.get("failed", 0), "unchanged": left}
