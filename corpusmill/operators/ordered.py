"""Order-dependent operators that never put a whole group into one task.

Rows are cut by ranges of ``(group, order)`` into the parts of one written table, so
parts are of like size whatever the values of the order are: dense, sparse or negative.
Rows are numbered inside their part and the totals of the earlier parts of the group,
one row per part, are added. The order is unique inside a group; groups are not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import materialize

CHUNK_BITS = 20


def _keys(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _running(df: DataFrame, order, by, name: str, per_part: Column, inside: Column) -> DataFrame:
    """Add ``inside`` (a window value within a part) plus ``per_part`` of earlier parts."""
    by, order = list(by), _keys(order)
    ranged = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    parts = materialize(ranged, "ordered")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        parts.groupBy(*by, "_part")
        .agg(per_part.alias("_n"))
        .select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    window = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        parts.withColumn("_inside", inside.over(window))
        .join(bases, [*by, "_part"])
        .withColumn(name, F.col("_inside") + F.col("_base"))
        .drop("_part", "_inside", "_base")
    )


def global_index(
    df: DataFrame, order: str | Sequence[str] = "ord", by: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Add the 0-based dense position of each row in its group's ``order``.

    ``df`` is read twice (to find the ranges and to cut them), so give it a narrow table.
    """
    return _running(df, order, by, name, F.count(F.lit(1)), F.row_number()).withColumn(
        name, (F.col(name) - 1).cast("bigint")
    )


def running_total(
    df: DataFrame, value: str, order: str | Sequence[str] = "ord", by: Sequence[str] = (), name: str = "total"
) -> DataFrame:
    """Add the sum of ``value`` over the group's rows up to and with this one."""
    total = F.sum(value)
    return _running(df, order, by, name, total, total)


def previous_row(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    index: str = "idx",
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add ``prev_<column>``: the value one row earlier by dense ``index``."""
    by = list(by)
    size = 1 << bits
    chunked = df.withColumn("_chunk", F.shiftright(index, bits))
    tails = chunked.where(F.col(index) % size == size - 1).select(
        *by,
        (F.col("_chunk") + 1).alias("_chunk"),
        *[F.col(c).alias(f"_tail_{c}") for c in columns],
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(index)
    lagged = chunked.select("*", *[F.lag(c).over(inside).alias(f"prev_{c}") for c in columns])
    joined = lagged.join(tails, [*by, "_chunk"], "left")
    first = F.col(index) % size == 0
    for c in columns:
        joined = joined.withColumn(
            f"prev_{c}", F.when(first, F.col(f"_tail_{c}")).otherwise(F.col(f"prev_{c}"))
        )
    return joined.drop("_chunk", *[f"_tail_{c}" for c in columns])


def running_min_before(
    df: DataFrame,
    column: str,
    by: Sequence[str],
    index: str = "idx",
    name: str = "min_before",
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add the minimum of ``column`` over all earlier rows (null on the first)."""
    by = list(by)
    chunked = df.withColumn("_chunk", F.shiftright(index, bits))
    before = lambda keys, order: (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    mins = chunked.groupBy(*by, "_chunk").agg(F.min(column).alias("_m"))
    mins = mins.select(
        *by, "_chunk", F.min("_m").over(before(by, "_chunk")).alias("_earlier")
    )
    local = chunked.withColumn("_inside", F.min(column).over(before([*by, "_chunk"], index)))
    return (
        local.join(mins, [*by, "_chunk"])
        .withColumn(name, F.least("_inside", "_earlier"))
        .drop("_chunk", "_inside", "_earlier")
    )


def take_first(df: DataFrame, n: int, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, without a one-task sort."""
    return global_index(df, order, by, "_idx").where(F.col("_idx") < n).drop("_idx")
