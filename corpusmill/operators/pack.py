"""Packing token sequences into fixed-length blocks.

A buffer of ``s`` tokens (0..B) runs through the documents in order. For a document of
``n`` tokens, an end-of-sequence id is put after a non-empty buffer (so ``c = s + 1``)
and ``rem = B - c`` places are left:

* ``n <= rem``: the tokens are appended;
* otherwise the buffer is filled up and emitted, whole blocks follow, the rest stays.
  A full buffer has no room for the end-of-sequence id, which is cut off.

With ``lossless=False``, a document longer than B that meets an empty buffer loses its
first B tokens.

Where a document starts depends on all documents before it, but only through ``s``. A
run of documents is a function on the B + 1 values of ``s``, and such functions compose:
chunks of documents are turned into tables in parallel, the tables are composed over
groups of chunks, level upon level, and start states flow back down. Only lengths take part; the tokens
are cut and regrouped by JVM expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import (
    BLOCK_SIZE,
    EOS_ID,
    LOG_EVERY,
    PAD_ID,
    PASSES_PER_STEP,
    SEQUENCES_PER_PASS,
    STEPS,
)
from corpusmill.functions.permute import permuted
from corpusmill.scratch import materialize

CHUNK_BITS = 14  # documents per chunk: 2**14
GROUP_BITS = 12  # tables composed by one task: 2**12
RUN_BITS = 6  # consecutive blocks kept in one partition: 2**6


def run_table(lengths: np.ndarray, block_size: int, lossless: bool) -> tuple[np.ndarray, np.ndarray]:
    """End state and emitted blocks of a run of documents, for every start state."""
    if lossless:
        # A full buffer acts like an empty one of the next block, so one running
        # position says all: a document moves it by its length, plus one unless aligned.
        place = np.arange(block_size + 1, dtype=np.int64)
        for n in lengths.tolist():
            place += place % block_size != 0
            place += n
        return place % block_size, place // block_size
    state = np.arange(block_size + 1, dtype=np.int64)
    blocks = np.zeros(block_size + 1, dtype=np.int64)
    for n in lengths.tolist():
        begin = state + (state > 0)
        room = block_size - begin
        spill = n > room
        left = n - np.maximum(room, 0)
        blocks += np.where(spill, left // block_size + (state > 0), 0)
        state = np.where(spill, left % block_size, begin + n)
    return state, blocks


def start_states(
    lengths: np.ndarray, block_size: int, lossless: bool, state: int, block: int
) -> tuple[np.ndarray, np.ndarray]:
    """Buffer size and block number in front of each document, from a known start."""
    count = len(lengths)
    if lossless:
        places, place = np.empty(count, np.int64), block * block_size + state
        for i, n in enumerate(lengths.tolist()):
            places[i] = place
            place += n + (place % block_size != 0)
        return (places % block_size).astype(np.int32), places // block_size
    states, blocks = np.empty(count, np.int32), np.empty(count, np.int64)
    for i, n in enumerate(lengths.tolist()):
        states[i], blocks[i] = state, block
        begin = state + 1 if state else 0
        room = block_size - begin
        if n <= room:
            state = begin + n
        else:
            left = n - max(room, 0)
            block += left // block_size + (1 if state else 0)
            state = left % block_size
    return states, blocks


def layout(
    lengths: DataFrame,
    block_size: int = BLOCK_SIZE,
    lossless: bool = True,
    chunk_bits: int = CHUNK_BITS,
    group_bits: int = GROUP_BITS,
) -> DataFrame:
    """Where each document starts: ``(epoch, pos, n, state, block)``.

    ``lengths (epoch, pos, n)`` is read several times, so give it a written table. Any
    number of documents takes the same path; more of them make more levels of tables.
    """
    chunked = lengths.select("epoch", "pos", "n", F.shiftright("pos", chunk_bits).alias("id"))
    top = (lengths.agg(F.max("pos")).first()[0] or 0) >> chunk_bits

    def to_table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("pos")
        state, blocks = run_table(ordered["n"].to_numpy(), block_size, lossless)
        return pd.DataFrame([(*key, state.tobytes(), blocks.tobytes())], columns=_TABLE_COLUMNS)

    if top == 0:  # a first chunk begins with an empty buffer, and no other asks for its table
        started = chunked.withColumns({"s0": F.lit(0), "b0": F.lit(0).cast("bigint")})
    else:
        tables = chunked.groupBy("epoch", "id").applyInPandas(to_table, _TABLE)
        starts = _starts(materialize(tables, "runs"), top, block_size, group_bits)
        started = chunked.join(starts, ["epoch", "id"])

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("pos")
        states, blocks = start_states(
            ordered["n"].to_numpy(), block_size, lossless,
            int(ordered["s0"].iloc[0]), int(ordered["b0"].iloc[0]),
        )
        return pd.DataFrame({
            "epoch": ordered["epoch"].to_numpy(), "pos": ordered["pos"].to_numpy(),
            "n": ordered["n"].to_numpy(), "state": states, "block": blocks,
        })

    return started.groupBy("epoch", "id").applyInPandas(
        place, "epoch int, pos bigint, n int, state int, block bigint"
    )


_TABLE_COLUMNS = ["epoch", "id", "state", "blocks"]
_TABLE = "epoch int, id bigint, state binary, blocks binary"


def _starts(tables: DataFrame, top: int, block_size: int, group_bits: int) -> DataFrame:
    """``(epoch, id, s0, b0)``: buffer and block number in front of each table's documents.

    Up to ``2**group_bits`` consecutive tables compose into one of the next level, until
    one per epoch is left, which begins with an empty buffer.
    """
    if top == 0:
        return tables.select("epoch", "id", F.lit(0).alias("s0"), F.lit(0).cast("bigint").alias("b0"))
    grouped = tables.withColumn("parent", F.shiftright("id", group_bits))

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = np.arange(block_size + 1, dtype=np.int64)
        blocks = np.zeros(block_size + 1, dtype=np.int64)
        for row in rows.sort_values("id").itertuples():
            blocks = blocks + np.frombuffer(row.blocks, np.int64)[state]
            state = np.frombuffer(row.state, np.int64)[state]
        return pd.DataFrame([(*key, state.tobytes(), blocks.tobytes())], columns=_TABLE_COLUMNS)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("id")
        state, block, found = int(ordered["s0"].iloc[0]), int(ordered["b0"].iloc[0]), []
        for row in ordered.itertuples():
            found.append((row.epoch, row.id, state, block))
            block += int(np.frombuffer(row.blocks, np.int64)[state])
            state = int(np.frombuffer(row.state, np.int64)[state])
        return pd.DataFrame(found, columns=["epoch", "id", "s0", "b0"])

    composed = grouped.groupBy("epoch", "parent").applyInPandas(compose, _TABLE)
    above = _starts(materialize(composed, "runs"), top >> group_bits, block_size, group_bits)
    started = grouped.join(above.withColumnRenamed("id", "parent"), ["epoch", "parent"])
    return started.groupBy("epoch", "parent").applyInPandas(walk, "epoch int, id bigint, s0 int, b0 bigint")


def _segments(block_size: int, lossless: bool) -> Column:
    """``array<struct<block, start, first, size>>`` of one placed document.

    A segment puts ``size`` tokens, beginning with the ``first`` (from 1), at ``start``
    in ``block``; ``first = 0`` stands for the end-of-sequence id.
    """
    state, block, n = F.col("state"), F.col("block"), F.col("n")
    begin = F.when(state > 0, state + 1).otherwise(F.lit(0))
    room = F.lit(block_size) - begin
    spill = n > room
    used = F.greatest(room, F.lit(0))
    emits = (begin > 0) | F.lit(lossless)
    next_block = F.when(emits, block + 1).otherwise(block)

    def segment(number: Column, start: Column, first: Column, size: Column) -> Column:
        return F.struct(
            number.cast("bigint").alias("block"),
            start.cast("int").alias("start"),
            first.cast("int").alias("first"),
            size.cast("int").alias("size"),
        )

    none = F.array().cast("array<struct<block: bigint, start: int, first: int, size: int>>")

    def when(condition: Column, found: Column) -> Column:
        return F.when(condition, found).otherwise(none)

    one = F.lit(1)
    eos = when(
        (state > 0) & (state < block_size), F.array(segment(block, state, F.lit(0), one))
    )
    head = when(
        (spill & (room > 0) & emits) | (~spill & (n > 0)),
        F.array(segment(block, begin, one, F.least(n, room))),
    )
    runs = when(
        spill & (n > used),
        F.transform(
            F.sequence(F.lit(0), F.floor((n - used - 1) / block_size).cast("int")),
            lambda j: segment(
                next_block + j,
                F.lit(0),
                used + j * block_size + 1,
                F.least(n - used - j * block_size, F.lit(block_size)),
            ),
        ),
    )
    return F.concat(eos, head, runs)


def pack(
    documents: DataFrame,
    block_size: int = BLOCK_SIZE,
    lossless: bool = True,
    eos_id: int = EOS_ID,
    pad_id: int = PAD_ID,
    chunk_bits: int = CHUNK_BITS,
    group_bits: int = GROUP_BITS,
    ranges: int | None = None,
) -> DataFrame:
    """Pack ``documents (epoch, pos, tokens)`` into ``(epoch, block_idx, tokens)``.

    Each block has exactly ``block_size`` tokens; the last of an epoch is padded. The
    table is read twice; give it a written one or something cheap. ``ranges`` of blocks
    lie in partitions of their own; without a number Spark chooses it by size.
    """
    lengths = materialize(
        documents.select("epoch", "pos", F.size("tokens").alias("n")), "lengths"
    )
    placed = layout(lengths, block_size, lossless, chunk_bits, group_bits)
    joined = placed.join(documents, ["epoch", "pos"])
    return assemble(joined, block_size, lossless, eos_id, pad_id, ranges)


def assemble(
    placed: DataFrame,
    block_size: int = BLOCK_SIZE,
    lossless: bool = True,
    eos_id: int = EOS_ID,
    pad_id: int = PAD_ID,
    ranges: int | None = None,
) -> DataFrame:
    """Blocks from documents ``(epoch, tokens, n, state, block)`` with known starts.

    A block gathers at most ``block_size`` tokens, whatever the documents look like.
    """
    def cut(s: Column) -> Column:
        tokens = F.when(s["first"] == 0, F.array(F.lit(eos_id))).otherwise(
            F.slice("tokens", s["first"], s["size"])
        )
        return F.struct(s["block"].alias("block"), s["start"].alias("start"), tokens.alias("part"))

    parts = placed.select(
        "epoch", F.inline(F.transform(_segments(block_size, lossless), cut))
    )
    # Grouping within runs needs no shuffle after this one, and leaves ranges of blocks
    # together for the writer, so that files of one epoch don't overlap. Collecting
    # map-side first would not make the lists any smaller.
    number = [] if ranges is None else [ranges]
    runs = parts.withColumn("run", F.shiftright("block", RUN_BITS)).repartitionByRange(*number, "epoch", "run")
    blocks = runs.groupBy("epoch", "run", "block").agg(
        F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts")
    )
    flat = F.flatten(F.transform("parts", lambda p: p["part"]))
    return blocks.select("epoch", F.col("block").alias("block_idx"), flat.alias("tokens")).select(
        "epoch",
        "block_idx",
        F.concat(
            "tokens", F.array_repeat(F.lit(pad_id), F.lit(block_size) - F.size("tokens"))
        ).alias("tokens"),
    )


def block_layout(placed: DataFrame, block_size: int = BLOCK_SIZE, lossless: bool = True) -> DataFrame:
    """Per block: how many tokens and end-of-sequence ids it holds before padding."""
    parts = placed.select("epoch", F.inline(_segments(block_size, lossless)))
    is_eos = F.col("first") == 0
    return parts.groupBy("epoch", F.col("block").alias("block_idx")).agg(
        F.sum(F.when(is_eos, 0).otherwise(F.col("size"))).alias("n_tokens"),
        F.count_if(is_eos).alias("n_eos"),
        (F.lit(block_size) - F.sum("size")).alias("n_pad"),
    )


def batch_blocks(
    blocks: DataFrame, batch_size: int, block_size: int = BLOCK_SIZE, pad_id: int = PAD_ID
) -> DataFrame:
    """``(epoch, batch_id, row_in_batch, tokens)``; the last batch is filled with padding."""
    ends = blocks.groupBy("epoch").agg((F.max("block_idx") + 1).alias("n"))
    first_free = F.col("n")
    end = F.ceil(F.col("n") / batch_size) * batch_size
    fillers = ends.where(first_free < end).select(
        "epoch",
        F.explode(F.sequence(first_free, end - 1)).alias("block_idx"),
        F.array_repeat(F.lit(pad_id), block_size).alias("tokens"),
    )
    return blocks.select("epoch", "block_idx", "tokens").unionByName(fillers).select(
        "epoch",
        F.floor(F.col("block_idx") / batch_size).alias("batch_id"),
        (F.col("block_idx") % batch_size).cast("int").alias("row_in_batch"),
        "tokens",
    )


def shard_blocks(blocks: DataFrame, world_size: int, seed: int | None = None) -> DataFrame:
    """Assign each block to a rank in turn, ``(epoch, rank, slot, block_idx, tokens)``.

    Every rank gets the same number of blocks: places left over are filled by starting
    again from the first blocks. With a ``seed``, blocks take their turns in an order of
    their own in every epoch, by a keyed permutation: no sort, and no other shuffle.
    """
    ends = blocks.groupBy("epoch").agg((F.max("block_idx") + 1).alias("n"))
    numbered = blocks.join(F.broadcast(ends), "epoch")  # one row per epoch
    place = F.col("block_idx")
    if seed is not None:
        place = permuted(place, F.col("n"), F.lit(seed), F.col("epoch"))
    # A first block comes again at each of the places it fills at the end.
    missing = F.ceil(F.col("n") / world_size) * world_size - F.col("n")
    again = F.floor((missing - 1 - F.col("place")) / F.col("n")) + 1
    times = F.sequence(F.lit(0).cast("bigint"), F.greatest(again, F.lit(0)))
    placed = numbered.withColumn("place", place).withColumn("time", F.explode(times))
    turn = F.col("place") + F.col("time") * F.col("n")
    return placed.select(
        "epoch",
        (turn % world_size).cast("int").alias("rank"),
        F.floor(turn / world_size).alias("slot"),
        "block_idx",
        "tokens",
    )


def token_budget(
    blocks: DataFrame,
    block_size: int = BLOCK_SIZE,
    step_blocks: int = SEQUENCES_PER_PASS * PASSES_PER_STEP,
    passes: int = STEPS * PASSES_PER_STEP,
    every: int = LOG_EVERY,
    world_size: int = 1,
) -> DataFrame:
    """Per epoch: blocks and tokens on hand against what the schedule consumes.

    An optimizer step takes ``step_blocks`` blocks on each of ``world_size`` processes.
    """
    return blocks.groupBy("epoch").agg(F.count(F.lit(1)).alias("blocks")).select(
        "epoch",
        "blocks",
        (F.col("blocks") * block_size).alias("tokens"),
        F.lit(every * step_blocks * block_size * world_size).cast("bigint").alias("tokens_per_log"),
        F.lit(passes).cast("bigint").alias("micro_steps"),
        (F.col("blocks") / (step_blocks * world_size)).alias("optimizer_steps"),
    )
