"""Scoring token sequences, one loss per shifted target.

A scorer is any function from a column of token ids to a column with one loss for each
target, so every evaluation takes a table of scores by id (``table_scorer``) or a model
of the caller's. Losses are added up per sequence where the sequence stands; rows per
token are made only by ``token_nll``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import BOS_ID, PAD_ID, UNK_ID
from corpusmill.functions.tokens import Tokenizer, attention_mask, pad_to, targets

Scorer = Callable[[Column], Column]
SCORE_ROWS = 1 << 24  # of a score table that is shipped to every task


def table_scorer(scores: DataFrame) -> Scorer:
    """Scorer from a table ``(id, nll)``; an id without a row has the unknown id's loss.

    The table has a row per id of a vocabulary. It is counted before it is shipped.
    Without a row for the unknown id, an id without a row is an error.
    """
    if scores.count() > SCORE_ROWS:
        raise ValueError(f"more than {SCORE_ROWS} scores; use a scorer of your own")
    rows = scores.select(F.col("id").cast("long"), F.col("nll").cast("double")).toArrow()
    ids, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(ids)
    shared = scores.sparkSession.sparkContext.broadcast((ids[order], values[order]))
    unknown_id = UNK_ID

    @F.arrow_udf("array<double>")
    def look_up(found: pa.Array) -> pa.Array:
        known, losses = shared.value
        offsets = found.offsets.to_numpy()
        flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            missing = known[at] != flat
        else:
            at, missing = np.zeros(len(flat), np.int64), np.ones(len(flat), bool)
        unknown = np.flatnonzero(known == unknown_id)
        if missing.any() and not len(unknown):
            raise ValueError(f"no score for id {flat[missing][0]} nor for the unknown id")
        nll = np.where(missing, losses[unknown[0]] if len(unknown) else 0.0, losses[at] if len(known) else 0.0)
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(nll))

    return lambda tokens: look_up(F.coalesce(targets(tokens), F.array().cast("array<int>")))


def token_nll(sequences: DataFrame, scorer: Scorer, by: Sequence[str]) -> DataFrame:
    """``(by..., pos, token, nll)``: the loss of every shifted target of ``tokens``."""
    tokens = F.col("tokens")
    both = F.arrays_zip(targets(tokens).alias("token"), scorer(tokens).alias("nll"))
    scored = sequences.select(*by, F.posexplode(both).alias("pos", "t"))
    return scored.select(*by, "pos", "t.token", "t.nll")


def sequence_losses(sequences: DataFrame, scorer: Scorer, by: Sequence[str], pad: int = PAD_ID) -> DataFrame:
    """``(by..., total, n, total_real, n_real)``: sums and numbers of losses per sequence.

    The last two leave out targets equal to ``pad``.
    """
    tokens = F.col("tokens")
    scored = sequences.select(
        *by, F.arrays_zip(targets(tokens).alias("token"), scorer(tokens).alias("nll")).alias("scored")
    )
    add = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, t: a + t["nll"])
    real = F.filter("scored", lambda t: t["token"] != pad)
    return scored.select(
        *by,
        add(F.col("scored")).alias("total"),
        F.size("scored").alias("n"),
        add(real).alias("total_real"),
        F.size(real).alias("n_real"),
    )


def mean_nll(losses: DataFrame, by: Sequence[str], ignore_pad: bool = False) -> DataFrame:
    """Mean loss per ``by`` over ``sequence_losses``; null where no target counts."""
    total, n = ("total_real", "n_real") if ignore_pad else ("total", "n")
    summed = losses.groupBy(*by).agg(F.sum(total).alias("_total"), F.sum(n).alias("_n"))
    return summed.select(*by, F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")).alias("mean_nll"))


def val_loss(
    batches: DataFrame, scorer: Scorer, num_batches: int | None = None, ignore_pad: bool = False
) -> DataFrame:
    """Mean of the batch means over epoch 0, or over its first ``num_batches`` batches."""
    chosen = first_batches(batches, num_batches)
    per_batch = mean_nll(sequence_losses(chosen, scorer, ["batch_id"]), ["batch_id"], ignore_pad)
    counted = per_batch.where(F.col("mean_nll").isNotNull())
    return counted.agg(F.avg("mean_nll").alias("val_loss"), F.count(F.lit(1)).alias("batches"))


def first_batches(batches: DataFrame, num_batches: int | None, epoch: int = 0) -> DataFrame:
    """The batches an evaluation scores: of its first epoch all, or the first ones."""
    own = batches.where(F.col("epoch") == epoch)
    return own if num_batches is None else own.where(F.col("batch_id") < num_batches)


def retokenize_padded(
    batches: DataFrame, first: Tokenizer, second: Tokenizer, max_length: int
) -> DataFrame:
    """Decode each row, encode it with another tokenizer, cut, and pad to its batch.

    Gives ``(epoch, batch_id, row_in_batch, ids, mask)``. The longest row of a batch is
    found over the few rows of that batch.
    """
    ids = second.encode(first.decode(F.col("tokens")))
    coded = batches.select(
        "epoch", "batch_id", "row_in_batch", F.slice(ids, 1, max_length).alias("ids")
    )
    # Collecting the rows of one batch is bounded by the batch size.
    rows = coded.groupBy("epoch", "batch_id").agg(
        F.max(F.size("ids")).alias("longest"),
        F.collect_list(F.struct("row_in_batch", "ids")).alias("rows"),
    )
    flat = rows.select("epoch", "batch_id", "longest", F.inline("rows"))
    return flat.select(
        "epoch",
        "batch_id",
        "row_in_batch",
        pad_to(F.col("ids"), F.col("longest")).alias("ids"),
        attention_mask(F.col("ids"), F.col("longest")).alias("mask"),
    )


def choice_texts(items: DataFrame) -> DataFrame:
    """``(item_id, label, choice, text)``: context and ending joined by one space."""
    exploded = items.select("item_id", "ctx", "label", F.posexplode("endings").alias("choice", "ending"))
    return exploded.select(
        "item_id",
        F.col("label").cast("int").alias("label"),
        "choice",
        F.concat_ws(" ", "ctx", "ending").alias("text"),
    )


def choice_scores(items: DataFrame, tokenizer: Tokenizer, scorer: Scorer) -> DataFrame:
    """``(item_id, label, choice, score)``: minus the mean loss of the whole text.

    The tokenizer's default for single texts puts the beginning-of-sequence id in front,
    so every token of the text is a target. A choice without any target has no row.
    """
    key = ["item_id", "label", "choice"]
    start = F.array(F.lit(BOS_ID))
    coded = choice_texts(items).select(*key, F.concat(start, tokenizer.encode(F.col("text"))).alias("tokens"))
    losses = sequence_losses(coded, scorer, key).where("n > 0")
    return losses.select(*key, (-F.col("total") / F.col("n")).alias("score"))


def choice_predict(scored: DataFrame) -> DataFrame:
    """``(item_id, label, pred)``: best score, ties to the lowest choice."""
    best = F.min_by("choice", F.struct(-F.col("score"), F.col("choice")))
    return scored.groupBy("item_id", "label").agg(best.alias("pred"))


def choice_accuracy(predicted: DataFrame) -> DataFrame:
    """Share of items whose prediction is the label."""
    return predicted.agg(
        F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("items"),
    )


def compare_val_loss(
    batches: DataFrame,
    first: Tokenizer,
    first_scorer: Scorer,
    second: Tokenizer,
    second_scorer: Scorer,
    block_size: int,
    num_batches: int | None = None,
) -> DataFrame:
    """Loss of the same validation text under two tokenizers and scorers.

    The first counts padding targets, the second ignores them.
    """
    chosen = first_batches(batches, num_batches)
    other = retokenize_padded(chosen, first, second, block_size).withColumnRenamed("ids", "tokens")
    own = val_loss(chosen, first_scorer).withColumn("scorer", F.lit("own"))
    baseline = val_loss(other, second_scorer, ignore_pad=True).withColumn("scorer", F.lit("baseline"))
    return own.unionByName(baseline).select("scorer", "val_loss", "batches")
