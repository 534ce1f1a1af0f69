"""The ingestion job over any number of documents: segments, sections, subsections and chunks, failures kept apart by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from . import annotate, documents, evidence, parsing


def stored(rows: DataFrame, path: str) -> DataFrame:
    """rows written and read again: their lineage ends here, and all that follows reads them from there."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes what ``stored`` has written, once nothing reads it any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as it ends; else they stay until the driver happens to collect its garbage. For frames that
    are run once each, as those of ``stored`` are."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def build_index(docs: DataFrame, staging: str, id_col: str = "paper_id", text_col: str = "text", aliases: dict[str, str] = L.SECTION_ALIASES, most: int = 400, overlap: int = 50, count: Callable[[str], int] = parsing.count_words) -> dict[str, DataFrame]:
    """sections, subsections, chunks (clean, with role and importance, those that pass the gate), domains and status of documents
    (id, text). A document whose text is null or blank is marked in status and gives no other rows; the others aren't held up.
    Segments and clean chunks are staged in a folder that all share, so that texts are parsed once for all outputs."""
    good = docs.filter(F.trim(F.coalesce(text_col, F.lit(""))) != "")
    lines = documents.document_lines(good, id_col, text_col).withColumn("page_number", F.lit(None).cast("int"))
    segs = stored(parsing.parse_sections(lines, id_col, aliases), f"{staging}/segments")
    chunks = stored(prepared(stored(cleaned(parsing.chunk_sections(segs, id_col, most, overlap, count)), f"{staging}/clean"), id_col), f"{staging}/chunks")
    counts = segs.groupBy(F.col(id_col).alias("s_id")).agg(F.count("*").alias("n_segments"))
    status = docs.select(id_col).join(counts, F.col(id_col) == F.col("s_id"), "left").select(id_col, F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.when(F.col("n_segments").isNull(), "no text").alias("error"))
    return {
        "sections": documents.merged(segs, id_col, "section_name"), "subsections": documents.merged(segs, id_col, "section_name", "subsection_name"),
        "chunks": chunks, "domains": top_chunk_domains(chunks, id_col), "status": status,
    }


def cleaned(chunks: DataFrame) -> DataFrame:
    """Chunks with their clean text as content, null where nothing is left."""
    return annotate.plain(annotate.with_clean(chunks, "content", "f_clean").withColumn("content", F.col("f_clean")))


def prepared(chunks: DataFrame, id_col: str) -> DataFrame:
    """Clean chunks as they are indexed: with role, importance and summary, those that pass the gate; their index and its basis, the
    number of all chunks, stay."""
    return annotate.gated(chunks, (id_col,)).filter("quality_pass").drop("n_candidates", "quality_pass")


def top_chunk_domains(chunks: DataFrame, id_col: str, k: int = 20) -> DataFrame:
    """The domain of each document by its k longest chunks."""
    order = Window.partitionBy(id_col).orderBy(F.desc("token_count"), "chunk_index")
    best = chunks.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return evidence.detect_domain(best.select(id_col, F.col("content").alias("text"), "role"), id_col)
