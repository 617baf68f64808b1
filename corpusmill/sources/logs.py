"""Training and validation logs as files with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: places behind the point of the losses in a validation log.
VALIDATION_DIGITS = 4
LOG_SCHEMA = "run_id bigint, step bigint, loss double"


def append_log(log: DataFrame, path: str, digits: int | None = None) -> None:
    """Append ``(run_id, step, loss)`` lines to a CSV folder; every file has a header.

    Losses are written in full, or with ``digits`` places behind the point.
    """
    loss = F.col("loss") if digits is None else F.round("loss", digits).alias("loss")
    log.select("run_id", "step", loss).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV log without guessing types."""
    return spark.read.schema(LOG_SCHEMA).option("header", True).csv(path)
