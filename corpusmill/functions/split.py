"""Train/validation membership by content hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.config import VAL_PERCENT


def hash_bucket(text: Column) -> Column:
    """``md5(text) mod 100``, folded over four 32-bit chunks of the digest.

    2**32 leaves 96 when divided by 100, so each step multiplies by 96. The digest is the
    element of a list, so that it is computed once although the fold reads it four times.
    """

    def fold(digest: Column) -> Column:
        bucket = F.lit(0).cast("bigint")
        for j in range(4):
            chunk = F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("bigint")
            bucket = F.pmod(bucket * 96 + chunk, F.lit(100))
        return bucket

    return F.transform(F.array(F.md5(text)), fold)[0]


def split_name(text: Column) -> Column:
    """``'val'`` for the lowest buckets, else ``'train'``; missing text counts as empty."""
    bucket = hash_bucket(F.coalesce(text, F.lit("")))
    return F.when(bucket < VAL_PERCENT, F.lit("val")).otherwise(F.lit("train"))


def in_split(text: Column, split: str) -> Column:
    """True for the rows of ``split``."""
    if split not in ("train", "val"):
        raise ValueError(f"unknown split {split!r}")
    return split_name(text) == split
