"""Incremental ingestion: new documents become segments as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import document_lines, segments
from ..operators.reindex import reindex
from ..sources.store import IndexStore


def index_new_documents(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, opens: Column, name: Column, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Reads Parquet files as they appear and writes their segments, a batch at a time; a batch that runs again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        segments(document_lines(batch, id_col, text_col), id_col, opens, name).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(spark: SparkSession, source: str, schema: str, store: IndexStore, staging: str, checkpoint: str, name: str = "ingest", **how) -> StreamingQuery:
    """Reads Parquet files of documents (key, text) as they appear and brings each batch into the store: all tables by one commit,
    which also notes the batch, so that a batch that runs again after a restart is passed over if it was committed and gives the
    rows of one run if it wasn't. how: as for ``reindex``."""

    def write(batch: DataFrame, number: int) -> None:
        if store.batch(name) < number:
            reindex(store, batch, f"{staging}/{name}-{number}", batch=(name, number), **how)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
