"""Decisions about documents taken back to their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "_row_key"
SLICE = 256  # rows of an Arrow batch that tasks turn into Python objects at once
COLUMNS = ("doc_id", "source", "lang", "text")
FILTER_BITS = 1 << 23  # 1 MB, a power of 2; a fuller filter lets more through, never less


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts without copying, so that only one part's texts are unpacked."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def row_key(columns: tuple[str, ...] = COLUMNS) -> Column:
    """16 bytes that only equal rows share (nulls told from any value)."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """A filter of ``bits`` bits, fixed whatever its content, over a column of hashes.

    The low bits of a hash say which bit it sets. Bits are put together by grouped bit
    sums; what reaches the driver is the filter.
    """
    (name,) = hashes.columns
    bit = F.col(name).bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.shiftright(bit, 6).cast("int").alias("word"), (bit % 64).cast("int").alias("bit"))
    words = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def among(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether unsigned hashes may be of a filter's, given its words: always true for those."""
    bit = hashes & np.uint64(64 * len(words) - 1)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def may_hold(shared: Broadcast, hashes: Column) -> Column:
    """Whether hashes may be of the filter's: always true for those."""

    @F.arrow_udf("boolean")
    def seen(values: pa.Array) -> pa.Array:
        return pa.array(among(shared.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return seen(hashes)


def take_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``copies (KEY, copies)`` says, in ``docs``' columns.

    A key's copies are those of all rows that share it; the first of them is repeated.
    """
    counted = copies.groupBy(KEY).agg(F.sum("copies").cast("int").alias("_row_copies")).where("_row_copies > 0")
    joined = docs.withColumn(KEY, row_key()).join(counted, KEY)
    first = F.row_number().over(Window.partitionBy(KEY).orderBy(F.lit(0)))
    once = joined.withColumn("_row_nth", first).where("_row_nth = 1")
    each = F.explode(F.sequence(F.lit(1), F.col("_row_copies"))).alias("_row_copy")
    return once.select(*docs.columns, each).drop("_row_copy")
