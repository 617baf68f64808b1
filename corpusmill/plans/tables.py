"""The given tables in the shapes the jobs expect."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.scratch import new_path

# Last folder number of each corpus; later folders are books.
ROLE_ENDS = {"web": 8, "code": 13, "math": 17, "arxiv": 18}
CHOICES = 4
SPREAD_ROWS = 1 << 12  # texts of one task, about: more texts make more tasks, not larger ones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(source: Column) -> Column:
    """Corpus that a source folder belongs to."""
    number = F.substring(source, 4, 9).cast("int")
    chosen = F.when(F.lit(False), F.lit(""))
    for name, last in ROLE_ENDS.items():
        chosen = chosen.when(number <= last, F.lit(name))
    return chosen.otherwise(F.lit("books"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, ord, doc_id, text)`` in stream order ``ord = doc_id``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(role(F.col("source")).alias("source"), F.col("doc_id").alias("ord"), "doc_id", "text")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over all cores: the given table may lie in one file of one split.

    A task has about ``SPREAD_ROWS`` of them at most, so the batches that a Python worker
    gets, and what it makes of them, don't grow with the table.
    """
    docs = documents(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-docs.count() // SPREAD_ROWS))
    return docs.repartition(tasks, "ord")


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows ``(run_id, ord, ts, loss)``, one run per user."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), "ts", F.col("value").alias("loss")
    )


def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items ``(item_id, ctx, endings, label)`` from the benchmark texts.

    The context is an item's first half, the right ending its second half, the wrong
    ones the second halves of the next three items; the right one stands at
    ``item_id % 4``.
    """
    items = table(spark, sf_dir, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    halves = items.select(
        "item_id",
        F.substring("text", F.lit(1), half).alias("ctx"),
        F.substring("text", half + 1, F.length("text")).alias("ending"),
    )
    count = items.count()
    wanted = halves.select(
        "item_id", "ctx", F.explode(F.sequence(F.lit(0), F.lit(CHOICES - 1))).alias("shift")
    ).withColumn("from_id", (F.col("item_id") + F.col("shift")) % count)
    endings = halves.select(F.col("item_id").alias("from_id"), "ending")
    place = (F.col("item_id") + F.col("shift")) % CHOICES
    return (
        wanted.join(endings, "from_id")
        .groupBy("item_id", "ctx")
        .agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "ending"))).alias("placed"))
        .select(
            "item_id",
            "ctx",
            F.transform("placed", lambda p: p["ending"]).alias("endings"),
            (F.col("item_id") % CHOICES).cast("string").alias("label"),
        )
    )


def arrivals(docs: DataFrame, label: str, parts: int = 3) -> Iterator[str]:
    """Grow a folder by ``docs`` in ``ord`` order, one part per step; yields its path.

    Each part is dealt over all cores, as many files, wherever its rows lie in the given
    table: rows of near orders may share a file, and the stream reads a file in few tasks.
    The parts follow each other, as deliveries do.
    """
    spark = docs.sparkSession
    path, files = new_path(spark, label), spark.sparkContext.defaultParallelism
    low, high = docs.agg(F.min("ord"), F.max("ord")).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):
        start = (low or 0) + i * width
        piece = docs.where((F.col("ord") >= start) & (F.col("ord") < start + width))
        piece.repartition(files, "ord").write.mode("append").parquet(path)
        yield path
