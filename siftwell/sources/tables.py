"""Readers of the Parquet tables and of files, and atomic writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section names that vector labels stand for.
SECTIONS = ["abstract", "introduction", "method", "experiments", "results", "discussion", "conclusion", "related_work", "references", "theory"]
#: Chunks of a paper.
PER_PAPER = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section_of(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTIONS)), (label + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Embedded chunks: chunk_id, paper_id, chunk_index, section_name, subsection_name, embedding and, if wanted, content."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / PER_PAPER).alias("paper_id"), (F.col("vec_id") % PER_PAPER).cast("int").alias("chunk_index"), section_of(F.col("label")).alias("section_name"),
        F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("part "), (F.col("vec_id") % 3).cast("string"))).alias("subsection_name"), "embedding",
    )
    if not text:
        return e
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return e.join(d, "chunk_id")


def pages_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text files as documents: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_index(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Replaces the partitions of the papers in df, leaving all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_embedded(rows: DataFrame, vectors: DataFrame, path: str, on: str = "chunk_id", key: str = "paper_id") -> None:
    """write_index of rows with their vectors; a row without a vector, or a vector without a row, is an error, not a loss."""
    both = rows.join(vectors.select(on, "embedding"), on, "full")
    checked = both.withColumn("embedding", F.when(F.col("embedding").isNotNull() & F.col(key).isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no pair for "), F.col(on).cast("string")))))
    write_index(checked, path, key)


def reset_papers(spark: SparkSession, paths: list[str], papers: list, key: str = "paper_id") -> None:
    """Removes all that was derived for some papers from partitioned tables, leaving other papers as they are."""
    fs = None
    for path in paths:
        for paper in papers:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={paper}")
            fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(where, True)


def reset_all(spark: SparkSession, paths: list[str], key: str = "paper_id") -> None:
    """Empties derived tables; their schema stays readable."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(where):
            schema = spark.read.parquet(path).schema
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
