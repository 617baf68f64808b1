"""The given tables reach the jobs in tasks of bounded size, wherever their rows lie."""

import glob

from pyspark.sql import functions as F

from corpusmill.plans import tables


def _one_file(spark, folder, rows):
    docs = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("src0").alias("source")
    )
    docs.orderBy("doc_id").coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_more_texts_make_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 10, raising=False)
    _one_file(spark, tmp_path, 400)
    spread = tables.spread_documents(spark, str(tmp_path))
    held = [r.n for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert spread.rdd.getNumPartitions() == 40
    assert sum(held) == 400 and max(held) < 40
    few = tables.spread_documents(spark, str(tmp_path)).where("doc_id < 5")
    assert sorted(r.doc_id for r in few.collect()) == list(range(5))


def test_a_delivery_of_rows_from_one_file_is_read_by_all_tasks(spark, tmp_path):
    _one_file(spark, tmp_path, 600)
    docs = tables.documents(spark, str(tmp_path)).select("ord", "text")
    cores, seen = spark.sparkContext.defaultParallelism, 0
    for step, path in enumerate(tables.arrivals(docs, "deliveries"), 1):
        files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
        assert len(files) == cores * step
        rows = spark.read.parquet(path)
        found = sorted(r.ord for r in rows.collect())
        assert found == list(range(200 * step))
        seen = rows.count()
    assert seen == 600
