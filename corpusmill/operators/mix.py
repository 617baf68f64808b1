"""Weighted interleaving of ordered sources, by epoch.

At each step ``i`` a source is drawn; it emits its next record. The draw is a hash of
``(seed, i)``, so it is a table that any task can compute: the k-th draw of a source
meets the source's k-th record in an equi-join. Mixing ends with the last record of
the source that runs out first. Only keys are mixed here, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.config import SPLIT_SEEDS, MixConfig
from corpusmill.operators.ordered import global_index
from corpusmill.scratch import materialize

DRAW_RANGE = 1 << 32
DRAW_CHUNK = 1 << 14  # draws made and counted together
_OUTER = ""  # name of the outer mixture


def thresholds(weights: Mapping) -> list[tuple]:
    """Exclusive upper end of each source's share of the 32-bit draw range."""
    total, so_far, ends = sum(weights.values()), 0.0, []
    for name, weight in weights.items():
        so_far += weight
        ends.append((name, round(so_far / total * DRAW_RANGE)))
    return ends


def draw_value(seed: Column, step: Column) -> Column:
    """Uniform 32-bit integer for one step of one seed."""
    text = F.concat_ws(":", seed.cast("string"), step.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def drawn_source(value: Column, weights: Mapping) -> Column:
    """Source whose share holds ``value``."""
    ends = thresholds(weights)
    choice = F.when(value < ends[0][1], F.lit(ends[0][0]))
    for name, end in ends[1:]:
        choice = choice.when(value < end, F.lit(name))
    return choice


def draws_needed(sizes: Mapping[str, int], weights: Mapping[str, float]) -> tuple[int, int]:
    """Draws that almost surely, and that certainly, exhaust some source.

    With at least as many draws as records, some source must have run out. The first
    figure is the expected number for the scarcest source plus twelve deviations.
    """
    sure = sum(max(sizes.get(name, 0), 1) for name in weights)
    total = sum(weights.values())
    likely = sure
    for name, weight in weights.items():
        if weight > 0:
            n = max(sizes.get(name, 0), 1)
            share = weight / total
            likely = min(likely, math.ceil((n + 12 * math.sqrt(n) + 64) / share))
    return likely, sure


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number each source's draws inside its chunk from 1; a chunk's rows come in step order."""
    current, so_far = None, np.zeros(0, np.int64)
    for batch in batches:
        chunks, sources = (batch.column(c).to_numpy() for c in ("cell", "source"))
        within = np.empty(len(chunks), np.int64)
        cuts = np.flatnonzero(chunks[1:] != chunks[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)], strict=True):
            if low == high:
                continue
            if chunks[low] != current:
                current, so_far = chunks[low], np.zeros(0, np.int64)
            part = sources[low:high]
            width = int(part.max()) + 1
            so_far = np.concatenate([so_far, np.zeros(max(width - len(so_far), 0), np.int64)])
            for code in range(width):
                own = part == code
                within[low:high][own] = so_far[code] + 1 + np.arange(own.sum())
                so_far[code] += own.sum()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], [*batch.schema.names, "within"])


def _draws(
    spark: SparkSession,
    mixes: Mapping[str, tuple[Mapping[str, float], int]],
    base_seed: int,
    epochs: list[int],
) -> DataFrame:
    """``(mix, epoch, step, source, k)`` with ``k`` counting each source's draws from 1.

    ``mixes`` gives the weights of each mixture and its number of steps per epoch. Draws
    are made chunk by chunk in step order, so counting them needs no sort and no shuffle:
    a draw's number is its number in the chunk plus the totals of earlier chunks, one row
    per chunk and source.
    """
    table, cells = None, 0
    listed = F.array(*[F.lit(e) for e in epochs])
    codes = {(m, i): s for m, (weights, _) in mixes.items() for i, s in enumerate(weights)}
    for name, (weights, steps) in mixes.items():
        chunks = -(-steps // DRAW_CHUNK)
        ids = spark.range(chunks * len(epochs))
        epoch = F.element_at(listed, F.floor(F.col("id") / chunks).cast("int") + 1)
        first = F.col("id") % chunks * DRAW_CHUNK
        placed = ids.select(
            F.lit(name).alias("mix"),
            epoch.alias("epoch"),
            (F.col("id") + cells).alias("cell"),
            F.explode(F.sequence(first, F.least(first + (DRAW_CHUNK - 1), F.lit(steps - 1)))).alias("step"),
        )
        value = draw_value(F.lit(base_seed) + F.col("epoch"), F.col("step"))
        by_code = dict(enumerate(weights.values()))
        drawn = placed.withColumn("value", value).select(
            "mix", "epoch", "cell", "step", drawn_source(F.col("value"), by_code).alias("source")
        )
        table = drawn if table is None else table.unionByName(drawn)
        cells += chunks * len(epochs)
    schema = "mix string, epoch int, cell bigint, step bigint, source int, within bigint"
    numbered = materialize(table.mapInArrow(_count_on, schema), "draws")
    before = Window.partitionBy("mix", "epoch", "source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("mix", "epoch", "cell", "source").agg(F.max("within").alias("n"))
    bases = totals.select("mix", "epoch", "cell", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = materialize(bases, "draw_bases")
    name = F.lit(None).cast("string")
    for (mix, code), source in codes.items():
        name = F.when((F.col("mix") == mix) & (F.col("source") == code), source).otherwise(name)
    return numbered.join(bases, ["mix", "epoch", "cell", "source"]).select(
        "mix", "epoch", "step", name.alias("source"), (F.col("base") + F.col("within")).alias("k")
    )


def _last_steps(
    draws: DataFrame, sizes: Mapping[tuple[str, int, str], int]
) -> dict[tuple[str, int], int]:
    """Per mixture and epoch, the step at which the first source gives its last record.

    An empty source ends the mixture at its first draw.
    """
    ends = draws.sparkSession.createDataFrame(
        [(m, e, s, max(n, 1)) for (m, e, s), n in sizes.items()],
        "mix string, epoch int, source string, k bigint",
    )  # one row per mixture, epoch and source
    last = draws.join(F.broadcast(ends), ["mix", "epoch", "source", "k"])
    rows = last.groupBy("mix", "epoch").agg(F.min("step").alias("last")).collect()
    return {(r.mix, r.epoch): r.last for r in rows}


def source_keys(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """``(source, ord)`` of the named sources, written once.

    Whatever decided which records are in ``docs`` (such as a hash of the text) is
    evaluated in this one pass.
    """
    wanted = docs.where(F.col("source").isin(*names))
    return materialize(wanted.select("source", "ord"), "mix_keys")


def source_sizes(keys: DataFrame) -> dict[str, int]:
    """Records per named source (one row per source is collected)."""
    rows = keys.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.source: r.n for r in rows}


def weighted_interleave(
    docs: DataFrame,
    weights: Mapping[str, float],
    base_seed: int = SPLIT_SEEDS["train"],
    epochs: Iterable[int] = (0,),
) -> DataFrame:
    """Mix ``docs (source, ord, ...)`` into ``(epoch, pos, source, ord)``."""
    return nested_interleave(docs, MixConfig(dict(weights), {}), base_seed, epochs)


def nested_interleave(
    docs: DataFrame,
    config: MixConfig | None = None,
    base_seed: int = SPLIT_SEEDS["train"],
    epochs: Iterable[int] = (0,),
) -> DataFrame:
    """Mix sources some of which are mixtures: ``(epoch, pos, source, ord)``.

    An inner mixture uses the epoch's seed as well, ends on its own first exhausted
    source, and then counts as one source of the outer mixture.
    """
    config = config or MixConfig()
    epochs = list(epochs)
    spark = docs.sparkSession
    mixes = {_OUTER: config.weights, **config.nested}
    mixes = {m: {s: w for s, w in ws.items() if w > 0} for m, ws in mixes.items()}
    leaves = {s for ws in mixes.values() for s in ws} - set(config.nested)
    keys = source_keys(docs, leaves)
    sizes = source_sizes(keys)
    # An inner mixture has at most the records of its sources.
    bound = {m: sum(sizes.get(s, 0) for s in ws) for m, ws in config.nested.items()}

    for likely in (True, False):  # the second number of draws is always enough
        needed = {m: draws_needed(sizes | bound, ws)[0 if likely else 1] for m, ws in mixes.items()}
        draws = _draws(spark, {m: (ws, needed[m]) for m, ws in mixes.items()}, base_seed, epochs)
        last = _mix_ends(draws, mixes, sizes, epochs)
        if len(last) == len(mixes) * len(epochs):
            break
    ends = spark.createDataFrame(
        [(m, e, n) for (m, e), n in last.items()], "mix string, epoch int, last bigint"
    )  # one row per mixture and epoch
    steps = draws.join(F.broadcast(ends), ["mix", "epoch"]).where(F.col("step") <= F.col("last"))
    outer = steps.where(F.col("mix") == _OUTER).select("epoch", "step", "source", "k")
    drawn = outer
    if config.nested:
        drawn = outer.where(~F.col("source").isin(*config.nested))
        inner = steps.where(F.col("mix") != _OUTER).select(
            "epoch", F.col("mix"), (F.col("step") + 1).alias("mix_k"), "source", "k"
        )
        picked = outer.select(
            "epoch", "step", F.col("source").alias("mix"), F.col("k").alias("mix_k")
        ).join(inner, ["epoch", "mix", "mix_k"])
        drawn = drawn.unionByName(picked.select("epoch", "step", "source", "k"))
    ranked = global_index(keys, "ord", ["source"], "k").withColumn("k", F.col("k") + 1)
    return drawn.join(ranked, ["source", "k"]).select(
        "epoch", F.col("step").alias("pos"), "source", "ord"
    )


def _mix_ends(
    draws: DataFrame,
    mixes: Mapping[str, Mapping[str, float]],
    sizes: Mapping[str, int],
    epochs: list[int],
) -> dict[tuple[str, int], int]:
    """Last step per mixture and epoch: inner mixtures first, they size the outer one."""
    inner = {m: ws for m, ws in mixes.items() if m != _OUTER}
    wanted = {(m, e, s): sizes.get(s, 0) for m, ws in inner.items() for e in epochs for s in ws}
    last = _last_steps(draws, wanted) if wanted else {}
    outer = {}
    for epoch in epochs:
        for source in mixes[_OUTER]:
            if source not in inner:
                outer[_OUTER, epoch, source] = sizes.get(source, 0)
            elif (source, epoch) in last:
                # With an empty source, the last draw found nothing.
                empty = any(sizes.get(s, 0) == 0 for s in inner[source])
                outer[_OUTER, epoch, source] = last[source, epoch] + (0 if empty else 1)
    return last | _last_steps(draws, outer)
