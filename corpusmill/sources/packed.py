"""Packed blocks on disk with a zone map of their files, and evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED_SCHEMA = "block_idx bigint, tokens array<int>, split string, epoch int"


def write_packed(blocks: DataFrame, path: str, split: str) -> None:
    """Write blocks under ``split=/epoch=``, in block order inside each file.

    Packing leaves ranges of blocks together, so no further shuffle is needed and readers
    can skip files by the statistics of ``block_idx``. Writing an epoch again
    replaces that epoch only, in the zone map too.
    """
    ordered = blocks.select("block_idx", "tokens", F.lit(split).alias("split"), "epoch")
    (
        ordered.sortWithinPartitions("epoch", "block_idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("split", "epoch")
        .parquet(path)
    )
    _write_zones(blocks.sparkSession, path, split)


ZONES = "_zones"  # a folder that readers of the blocks pass over
ZONE_SCHEMA = "file string, low bigint, high bigint, blocks bigint, split string, epoch int"


def _write_zones(spark: SparkSession, path: str, split: str) -> None:
    """One row per file of a split: its range of blocks. Only the column of numbers is read."""
    blocks = spark.read.schema(PACKED_SCHEMA).parquet(path).where(F.col("split") == split)
    zones = blocks.groupBy("split", "epoch", F.col("_metadata.file_path").alias("file")).agg(
        F.min("block_idx").alias("low"), F.max("block_idx").alias("high"), F.count(F.lit(1)).alias("blocks")
    )
    names = ["file", "low", "high", "blocks", "split", "epoch"]
    writer = zones.select(*names).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("split", "epoch").parquet(f"{path}/{ZONES}")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """``(file, low, high, blocks, split, epoch)``: where blocks lie, a row per file."""
    return spark.read.schema(ZONE_SCHEMA).parquet(f"{path}/{ZONES}")


def read_range(
    spark: SparkSession, path: str, split: str, epoch: int, low: int, high: int, rank: int = 0, world_size: int = 1
) -> DataFrame:
    """Blocks ``low`` to ``high`` (exclusive) of one epoch, or those of them that are a rank's turn.

    The zone map says which files can hold them; no other is listed or opened. What
    reaches the driver are the names of these files.
    """
    zones = read_zones(spark, path).where((F.col("split") == split) & (F.col("epoch") == epoch))
    own = [r.file for r in zones.where((F.col("high") >= low) & (F.col("low") < high)).select("file").collect()]
    if not own:
        return spark.createDataFrame([], PACKED_SCHEMA)
    found = spark.read.schema("block_idx bigint, tokens array<int>").parquet(*own)
    wanted = found.where((F.col("block_idx") >= low) & (F.col("block_idx") < high) & (F.col("block_idx") % world_size == rank))
    return wanted.select("block_idx", "tokens", F.lit(split).alias("split"), F.lit(epoch).alias("epoch"))


def read_packed(
    spark: SparkSession, path: str, split: str | None = None, start_epoch: int = 0
) -> DataFrame:
    """Blocks of one split from ``start_epoch`` on; folders outside are not opened."""
    blocks = spark.read.schema(PACKED_SCHEMA).parquet(path)
    if split:
        blocks = blocks.where(F.col("split") == split)
    return blocks.where(F.col("epoch") >= start_epoch)


def batch_preview(batches: DataFrame, tokens: int = 50) -> DataFrame:
    """Shape and first tokens of row 0 of each epoch's first batch."""
    first = batches.where(F.col("batch_id") == 0)
    return first.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("tokens")).alias("columns"),
        F.max(F.when(F.col("row_in_batch") == 0, F.slice("tokens", 1, tokens))).alias("head"),
    )


def first_items(items: DataFrame, num_samples: int, order: str = "ord") -> DataFrame:
    """The first evaluation items by position."""
    return items.orderBy(order).limit(num_samples)
