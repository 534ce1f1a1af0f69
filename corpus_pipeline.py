"""The training-data pipeline over ``documents``: each stage works on all that the one before it kept.

quality classifier (rejected documents go) -> near-duplicates (one document of each group stays) -> secret scan (found
spans are masked) -> mixing to target weights (documents repeat) -> best-fit packing (a row per packed piece).

Every stage goes by row: ids may be null or repeat. Columns beside those of documents are left out at each stage, whatever
their names. Null, empty and wordless texts, texts of any length, ties and empty tables have the results that each stage
states; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import mixing, near_dups, packing, quality, secrets
from siftwell.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold. Labels are those of the corpus; texts are the stage's input. A null or
    empty text has the score of a document without words and stays or goes by it; rows of one text share their fate; a score at
    the threshold stays; whole texts count, however long; without labels of both classes all get the share of label 1."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, COLUMNS).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the least id, of each group of near-duplicates, and all rows without words; it goes by row, as
    ids may be null or repeat: of exact copies under one id, or without any, one stays, and of two texts under one id only the
    copy goes. Ties go to the least hash of the text, then to the first row. The bar is five-word shingles at 80 percent."""
    return near_dups.one_of_each(docs.select(*COLUMNS), shingle=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row, with its secrets masked and n_chars brought in line; a null or empty text, and one without secrets,
    stays as it is. Spans that touch or overlap share one mask; repeated rows are masked alike."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as its source's rate and its draw say; some go, some come up to three times. A null source is one
    of its own; a source without words has rate 0, so that its rows, all wordless, go; rows of one id draw alike, those without
    an id by their text."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, copies apart (``copy`` counts rows of one id), into bins; a row per piece. A text longer than a bin is
    cut into full pieces and a rest; a null or blank one is a piece of size 0; equal texts and equal sources share no bin."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_documents),
]

#: No stage but the mixing can be told in SQL; tests/llm compares the others with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        last = docs
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(last)
    return docs
