"""Shards of near equal size from indivisible groups, by best-fit-decreasing packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ordered import global_index
from corpusmill.scratch import materialize

SHARDS = 40
OVERHEAD = 16  # bytes of a document besides its text
LARGE = 256  # a group is large from a shard's mean size over this
BUNDLES = 128  # bundles of small groups per shard


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item: largest first, each into the tightest bin that still has room.

    Open bins are kept in order of the room left, so the tightest one is found by
    bisection. An item larger than the capacity gets a bin of its own.
    """
    rooms: list[tuple[int, int]] = []
    bins, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, bins[i] = rooms.pop(at)
        else:
            room, bins[i] = capacity, opened
            opened += 1
        insort(rooms, (room - sizes[i], bins[i]))
    return bins


def equal_bins(sizes: Sequence[int], count: int) -> list[int]:
    """Bins 0 to ``count - 1`` at the least capacity at which best fit needs no more.

    Items above the mean of what is left get a bin each first: no capacity could
    balance them.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, rest, used = [0] * len(sizes), sum(sizes), 0
    while order and count - used > 1 and sizes[order[0]] * (count - used) >= rest:
        rest -= sizes[order[0]]
        bins[order.pop(0)] = used
        used += 1
    if not order:
        return bins
    left, items = count - used, [sizes[i] for i in order]
    low, high = max(items[0], -(-rest // left)), rest
    while low < high:
        middle = (low + high) // 2
        if max(best_fit_decreasing(items, middle)) < left:
            high = middle
        else:
            low = middle + 1
    for i, b in zip(order, best_fit_decreasing(items, high), strict=True):
        bins[i] = used + b
    return bins


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row.

    Documents of equal text are one group (null texts another) and share a shard. Large
    groups, at most ``shards * LARGE`` of them, are items of their own; small ones are
    bundled by a hash of their text into ``shards * BUNDLES`` items. So what is packed
    has a fixed bound at any input size and is packed on the driver; documents move as
    narrow rows. A small group is at most ``1 / LARGE`` of a shard and so is the
    imbalance it can cause. Slots are numbered through ranges of the shard's rows.
    """
    spark = docs.sparkSession
    prints = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
            F.coalesce(F.md5("text"), F.lit("null")).alias("_key"),
        ),
        "shard_sizes",
    )
    bundle = F.pmod(F.xxhash64("_key"), F.lit(shards * BUNDLES)).cast("int")
    groups = materialize(prints.groupBy("_key").agg(F.sum("size").alias("bytes")), "shard_groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * (shards * LARGE) >= total
    # Both lists are bounded by constants: shares of the total, and a number of hashes.
    alone = groups.where(large).orderBy("_key").collect()
    bundled = groups.where(~large).groupBy(bundle.alias("_bundle")).agg(F.sum("bytes").alias("bytes"))
    bundles = bundled.orderBy("_bundle").collect()
    bins = equal_bins([r.bytes for r in alone] + [r.bytes for r in bundles], shards)
    of_key = spark.createDataFrame(
        [(r["_key"], b) for r, b in zip(alone, bins)], "_key string, _own int"
    )
    of_bundle = spark.createDataFrame(
        [(r["_bundle"], b) for r, b in zip(bundles, bins[len(alone) :])], "_bundle int, _shared int"
    )
    placed = (
        prints.withColumn("_bundle", bundle)
        .join(F.broadcast(of_key), "_key", "left")
        .join(F.broadcast(of_bundle), "_bundle", "left")
        .withColumn("shard", F.coalesce("_own", "_shared"))
        .drop("_bundle", "_own", "_shared")
    )
    slotted = global_index(placed, ["_key", "doc_id", "_row"], ["shard"], "slot")
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
