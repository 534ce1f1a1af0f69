from pyspark.sql import functions as F

from siftwell.streaming.ingest import index_new_documents


def test_new_documents_are_indexed_once(spark, tmp_path):
    schema = "doc_id long, text string"
    run = lambda: index_new_documents(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp", F.col("line").startswith("# "), F.expr("substring(line, 3)")).awaitTermination()
    spark.createDataFrame([(1, "intro\n# a\nx\n\ny")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(2, "# b\nz")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "section_order", "section_name", "content").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "front_matter", "intro"), (1, 1, "a", "x\ny"), (2, 0, "b", "z")]
