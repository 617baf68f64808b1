"""Reports over training logs ``(run_id, step, loss, ...)``.

One run may be most of the table, so windows never span a whole run: rows get a dense
index first, and windows work on chunks of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import LOG_EVERY, SAVE_EVERY, VALIDATE_EVERY, RateCurve
from corpusmill.operators.ordered import CHUNK_BITS, global_index, previous_row, running_min_before, running_total


def with_steps(events: DataFrame) -> DataFrame:
    """Number events ``(run_id, ord, ...)`` of each run from 1, as ``step``."""
    indexed = global_index(events, "ord", ["run_id"], "step")
    return indexed.withColumn("step", F.col("step") + 1)


def every_n(
    log: DataFrame, every: int = LOG_EVERY, validate: int = VALIDATE_EVERY, save: int = SAVE_EVERY
) -> DataFrame:
    """Every ``every``-th step, with flags for validation and checkpoint steps."""
    falls_on = lambda n: F.pmod(F.col("step"), F.lit(n)) == 0
    return log.where(falls_on(every)).select(
        "*", falls_on(validate).alias("validates"), falls_on(save).alias("saves")
    )


def chunk_length(decay: float) -> int:
    """Rows after which a weight has decayed below 1e-60."""
    return max(2, math.ceil(-60 * math.log(10) / math.log(decay)))


def loss_ema(log: DataFrame, smoothing: float = 0.9, rows: int | None = None) -> DataFrame:
    """Add ``smoothed``: weighted mean of all losses so far, weights ``smoothing**age``.

    A missing loss has no weight but ages the others; the last value is carried on over
    any gap. Inside a chunk of rows the sums are windows over ``loss / smoothing**place``.
    A chunk starts from the sums of the last chunks with a loss before it: as many as
    still matter in double precision, scaled to the latest of them, so that a long gap
    takes nothing from their ratio.
    """
    rows = rows or chunk_length(smoothing)
    reach = math.ceil(chunk_length(smoothing) / rows)
    indexed = global_index(log.select("run_id", "step", "loss"), "step", ["run_id"], "i")
    place = F.col("i") % rows
    weight = F.pow(F.lit(smoothing), -place)
    chunked = indexed.select(
        "*",
        F.floor(F.col("i") / rows).alias("chunk"),
        place.alias("place"),
        F.coalesce(F.col("loss") * weight, F.lit(0.0)).alias("wx"),
        F.when(F.col("loss").isNull(), 0.0).otherwise(weight).alias("w"),
    )
    so_far = (
        Window.partitionBy("run_id", "chunk")
        .orderBy("i")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = chunked.select(
        "run_id",
        "step",
        "loss",
        "chunk",
        "place",
        F.sum("wx").over(so_far).alias("num"),
        F.sum("w").over(so_far).alias("den"),
    )
    joined = local.join(_chunk_starts(chunked, smoothing, rows, reach), ["run_id", "chunk"], "left")
    old = F.pow(F.lit(smoothing), F.col("away") * rows)
    num = F.col("num") + F.coalesce(F.col("start_num") * old, F.lit(0.0))
    den = F.col("den") + F.coalesce(F.col("start_den") * old, F.lit(0.0))
    smoothed = F.when(F.col("den") > 0, num / den).otherwise(F.col("start_num") / F.col("start_den"))
    return joined.select("run_id", "step", "loss", smoothed.alias("smoothed"))


def _chunk_starts(chunked: DataFrame, smoothing: float, rows: int, reach: int) -> DataFrame:
    """``(run_id, chunk, start_num, start_den, away)``: the sums a chunk starts from.

    They are scaled to the first row of the latest earlier chunk with a loss, which lies
    ``away`` chunks back. The ``reach`` latest ones are found by their number in the run.
    """
    ends = chunked.groupBy("run_id", "chunk").agg(
        F.sum("wx").alias("ex"), F.sum("w").alias("ew"), F.max((F.col("w") > 0).cast("long")).alias("full")
    )
    ends = running_total(ends, "full", "chunk", ["run_id"], "nth")
    given = ends.where("full = 1").select(
        "run_id",
        F.struct(F.col("chunk").alias("at"), "ex", "ew").alias("sums"),
        F.explode(F.sequence(F.col("nth"), F.col("nth") + (reach - 1))).alias("before"),
    )
    wanted = ends.select("run_id", "chunk", (F.col("nth") - F.col("full")).alias("before"))
    latest = F.array_max("found")["at"]
    faded = lambda name: F.aggregate(
        "found",
        F.lit(0.0),
        lambda total, s: total + s[name] * F.pow(F.lit(smoothing), (latest - s["at"]) * rows),
    )
    return (
        wanted.join(given, ["run_id", "before"])
        .groupBy("run_id", "chunk")
        .agg(F.collect_list("sums").alias("found"))
        .select(
            "run_id",
            "chunk",
            faded("ex").alias("start_num"),
            faded("ew").alias("start_den"),
            (F.col("chunk") - latest).alias("away"),
        )
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, the same for timestamps with and without time zone."""
    gap = end - start
    parts = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    total = F.lit(0.0)
    for unit, size in parts:
        total = total + F.extract(F.lit(unit), gap).cast("double") * size
    return total


def throughput(
    log: DataFrame, step_tokens: int, every: int = LOG_EVERY, bits: int = CHUNK_BITS
) -> DataFrame:
    """Tokens per second between consecutive log lines of a run."""
    per_log = every * step_tokens
    lines = every_n(log, every).select("run_id", "step", "ts")
    timed = previous_row(global_index(lines, "step", ["run_id"], "i"), ["ts"], ["run_id"], "i", bits)
    seconds = seconds_between(F.col("prev_ts"), F.col("ts"))
    return timed.select(
        "run_id",
        "step",
        seconds.alias("seconds"),
        F.when(seconds > 0, per_log / seconds).alias("tokens_per_sec"),
    )


def best_so_far(log: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Flag losses strictly below every earlier one of the run."""
    indexed = global_index(log.select("run_id", "step", "loss"), "step", ["run_id"], "i")
    before = running_min_before(indexed, "loss", ["run_id"], "i", "best_before", bits)
    is_best = F.col("loss") < F.coalesce(F.col("best_before"), F.lit(float("inf")))
    return before.select(
        "run_id",
        "step",
        "loss",
        "best_before",
        F.coalesce(is_best, F.lit(False)).alias("is_best"),
    )


def learning_rate(step: Column, curve: RateCurve = RateCurve()) -> Column:
    """Linear warm-up, then a half cosine down to the minimum."""
    progress = (step - curve.warmup) / F.lit(float(curve.last - curve.warmup))
    cosine = curve.floor + 0.5 * (1 + F.cos(F.lit(math.pi) * progress)) * (curve.peak - curve.floor)
    return (
        F.when(step < curve.warmup, curve.peak * (step + 1) / curve.warmup)
        .when(step > curve.last, F.lit(curve.floor))
        .otherwise(cosine)
    )
