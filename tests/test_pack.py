"""Packing against a map of places, and its consequences on their own."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.config import EOS_ID, PAD_ID
from corpusmill.operators.pack import (
    batch_blocks,
    block_layout,
    layout,
    pack,
    shard_blocks,
    token_budget,
)
from corpusmill.functions.permute import permuted
from corpusmill.sources.packed import batch_preview, read_packed, read_range, read_zones, write_packed


def by_places(documents, size, lossless=True):
    """Blocks of one epoch, from the place that each token has in the epoch's long row.

    ``brim`` says that the row so far ends with a document that just filled its block.
    """
    places, at, brim = {}, 0, False
    for tokens in documents:
        fill = at % size
        if fill:
            places[at] = EOS_ID
            at += 1
        overflows = brim or fill + bool(fill) + len(tokens) > size
        if overflows and not (lossless or fill or brim):
            tokens = tokens[size:]
        places |= dict(zip(range(at, at + len(tokens)), tokens))
        at += len(tokens)
        brim = at % size == 0 and not overflows and (fill > 0 or len(tokens) > 0)
    return [[places.get(b + i, PAD_ID) for i in range(size)] for b in range(0, at, size)]


def documents(spark, lists, epoch=0):
    rows = [(epoch, 3 * i, [int(t) for t in tokens]) for i, tokens in enumerate(lists)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "epoch int, pos bigint, tokens array<int>")


def as_lists(blocks):
    return [list(r.tokens) for r in blocks.orderBy("block_idx").collect()]


@pytest.mark.parametrize(
    "lengths,lossless,want",
    [
        ([4, 2], True, [[10, 11, 12, 13], [20, 21, 2, 2]]),
        ([3, 2], True, [[10, 11, 12, 2], [20, 21, 2, 2]]),
        ([6], True, [[10, 11, 12, 13], [14, 15, 2, 2]]),
        ([6], False, [[14, 15, 2, 2]]),
    ],
)
def test_known_blocks(spark, lengths, lossless, want):
    lists = [[10 * (d + 1) + t for t in range(n)] for d, n in enumerate(lengths)]
    assert as_lists(pack(documents(spark, lists), 4, lossless)) == want


@pytest.mark.parametrize("lossless", [True, False])
@pytest.mark.parametrize("size", [2, 5, 16])
def test_random_documents_over_many_chunks(spark, lossless, size):
    rng = random.Random(size)
    lists = [[rng.randrange(3, 99) for _ in range(rng.randrange(0, 3 * size))] for _ in range(90)]
    got = pack(documents(spark, lists), size, lossless, chunk_bits=4, group_bits=3)
    assert as_lists(got) == by_places(lists, size, lossless)


def test_lossless_keeps_all_tokens(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(3, 99) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    blocks = as_lists(pack(documents(spark, lists), 8))
    kept = [t for b in blocks for t in b if t != EOS_ID]
    assert kept == [t for tokens in lists for t in tokens]


def test_epochs_are_packed_apart(spark):
    one, two = [[5] * 3, [6] * 3], [[7] * 9]
    both = documents(spark, one, 0).unionByName(documents(spark, two, 4))
    got = pack(both, 4)
    assert as_lists(got.where("epoch = 0")) == by_places(one, 4, True)
    assert as_lists(got.where("epoch = 4")) == by_places(two, 4, True)


def test_many_levels_of_chunks(spark):
    rng = random.Random(7)
    lists = [[5] * rng.randrange(0, 9) for _ in range(70)]
    for lossless in (True, False):  # 3 * 70 positions in chunks of 2, tables of 2: 7 levels
        got = pack(documents(spark, lists), 4, lossless, chunk_bits=1, group_bits=1)
        assert as_lists(got) == by_places(lists, 4, lossless)


def test_long_documents_at_an_empty_buffer(spark):
    """Without losses all tokens stay; else the first block of such documents goes."""
    lists = [[1] * 9, [2] * 3, [3] * 4, [4] * 9, [5] * 8, [6] * 8]
    kept = [t for b in as_lists(pack(documents(spark, lists), 4, False)) for t in b]
    assert [kept.count(t) for t in (1, 3, 4, 5, 6)] == [5, 4, 9, 4, 4]
    whole = [t for b in as_lists(pack(documents(spark, lists), 4)) for t in b]
    assert [whole.count(t) for t in (1, 3, 4, 5, 6)] == [9, 4, 9, 8, 8]


def test_block_layout_counts(spark):
    lists = [[5] * n for n in (3, 6, 1, 4, 9)]
    lengths = documents(spark, lists).select("epoch", "pos", F.size("tokens").alias("n"))
    rows = block_layout(layout(lengths, 4), 4).orderBy("block_idx").collect()
    for row, block in zip(rows, by_places(lists, 4, True), strict=True):
        assert row.n_tokens == block.count(5)
        assert row.n_eos + row.n_pad == block.count(EOS_ID)


def test_batches_and_preview(spark):
    blocks = pack(documents(spark, [[5] * 4] * 5), 4)
    batches = batch_blocks(blocks, 3, 4)
    rows = {(r.batch_id, r.row_in_batch): list(r.tokens) for r in batches.collect()}
    assert len(rows) == 6 and rows[1, 2] == [PAD_ID] * 4 and rows[1, 1] == [5] * 4
    preview = batch_preview(batches, 2).first()
    assert (preview.rows, preview.columns, list(preview.head)) == (3, 4, [5, 5])
    full = batch_blocks(pack(documents(spark, [[5] * 4] * 6), 4), 3, 4)
    assert full.count() == 6  # no batch of padding alone


def test_shards_are_equal_and_wrap_around(spark):
    blocks = pack(documents(spark, [[5 + i] * 4 for i in range(5)]), 4)
    shards = shard_blocks(blocks, 3).collect()
    got = {(r.rank, r.slot): r.block_idx for r in shards}
    assert got == {(p % 3, p // 3): p % 5 for p in range(6)}
    few = shard_blocks(blocks.where("block_idx < 2"), 7).collect()
    assert {(r.rank, r.slot): r.block_idx for r in few} == {(p, 0): p % 2 for p in range(7)}


def test_sink_and_resume(spark, tmp_path):
    path = str(tmp_path / "packed")
    both = documents(spark, [[5] * 9], 0).unionByName(documents(spark, [[7] * 9], 1))
    write_packed(pack(both, 4), path, "train")
    assert read_packed(spark, path, "val").count() == 0
    resumed = read_packed(spark, path, "train", start_epoch=1).orderBy("block_idx").collect()
    assert [list(r.tokens) for r in resumed] == by_places([[7] * 9], 4, True)


def test_blocks_lie_in_ranges(spark, tmp_path):
    """Files of an epoch don't overlap in block_idx, so readers can skip them."""
    path = str(tmp_path / "packed")
    blocks = pack(documents(spark, [[5] * 40] * 300), 4, ranges=6)
    write_packed(blocks, path, "train")
    files = read_packed(spark, path).groupBy(F.col("_metadata.file_path").alias("f"))
    ends = sorted((r.low, r.high) for r in files.agg(F.min("block_idx").alias("low"), F.max("block_idx").alias("high")).collect())
    assert len(ends) > 3 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_ranges_open_their_files_only(spark, tmp_path):
    """Also after an epoch was written again, and for ranges that nothing lies in."""
    path = str(tmp_path / "packed")
    lists = [[5 + i % 7] * 40 for i in range(300)]
    write_packed(pack(documents(spark, lists), 4, ranges=6), path, "train")
    write_packed(pack(documents(spark, lists[:50], 1), 4, ranges=3), path, "train")
    write_packed(pack(documents(spark, lists[:100]), 4, ranges=4), path, "train")  # epoch 0 anew
    zones = read_zones(spark, path).collect()
    assert {z.epoch for z in zones} == {0, 1} and sum(z.blocks for z in zones) == read_packed(spark, path).count()
    want = {r.block_idx: r.tokens for r in read_packed(spark, path).where("epoch = 0").collect()}
    part = read_range(spark, path, "train", 0, 100, 160)
    holding = [z.file for z in zones if z.epoch == 0 and z.high >= 100 and z.low < 160]
    assert len(part.inputFiles()) == len(holding) < len([z for z in zones if z.epoch == 0])
    assert {r.block_idx: r.tokens for r in part.collect()} == {i: want[i] for i in range(100, 160)}
    turns = read_range(spark, path, "train", 0, 100, 160, rank=2, world_size=7).collect()
    assert sorted(r.block_idx for r in turns) == [i for i in range(100, 160) if i % 7 == 2]
    assert read_range(spark, path, "train", 0, 10**6, 10**7).count() == 0
    assert read_range(spark, path, "val", 0, 0, 10).count() == 0


def test_budget(spark):
    blocks = pack(documents(spark, [[5] * 4] * 8), 4)
    row = token_budget(blocks, 64, step_blocks=4, passes=64, every=4).first()
    assert (row.blocks, row.tokens) == (8, 8 * 64)
    assert row.tokens_per_log == 4 * 4 * 64
    assert row.micro_steps == 64 and row.optimizer_steps == 2.0


def test_permutation_is_one(spark):
    """Every number has one place, for odd and even n, and other keys give other orders."""
    orders = {}
    for n in (1, 2, 3, 5, 16, 97, 256, 1001, 4096):
        for key in (0, 1):
            rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(key)).alias("p"))
            orders[n, key] = [r.p for r in rows.orderBy("id").collect()]
            assert sorted(orders[n, key]) == list(range(n))
    assert orders[1001, 0] != orders[1001, 1]
    moved = sum(abs(p - i) for i, p in enumerate(orders[4096, 0])) / 4096
    assert 4096 / 4 < moved < 4096 / 2.4  # a third of n, when places are random


def test_shuffled_shards(spark):
    blocks = pack(documents(spark, [[5 + i] * 4 for i in range(11)]), 4)
    rows = shard_blocks(blocks, 4, seed=3).collect()
    assert {(r.rank, r.slot) for r in rows} == {(p % 4, p // 4) for p in range(12)} and len(rows) == 12
    assert sorted({r.block_idx for r in rows}) == list(range(11))
    first = next(r.block_idx for r in rows if (r.rank, r.slot) == (0, 0))
    assert next(r.block_idx for r in rows if (r.rank, r.slot) == (3, 2)) == first
    plan = shard_blocks(blocks, 4, seed=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan.partition("Join")[0]
