"""A scorer that sees context: interpolated Kneser-Ney n-grams, counted and looked up by joins.

The highest order counts how often an n-gram occurs; every lower order counts how many
different tokens stand in front of it. So the table of one order is the next higher one
grouped by its tail. A model is one table with a row per n-gram of any order: its log
probability behind its own context, and the weight it passes on as a context. A target is
scored by the longest n-gram that ends there and has a row, times the weights of the longer
contexts that have one.

Neither the model nor the sequences reach the driver or are broadcast: windows of
sequences are made distinct, meet the model in a shuffled join, and go back to their
places by another.

Inside, an n-gram is a number per position rather than an array: such keys are hashed and
sorted by generated code, arrays are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import BOS_ID, EOS_ID
from corpusmill.scratch import materialize

ORDER = 3
DISCOUNT = 0.75  # taken off every count, below 1

MODEL_SCHEMA = "gram array<int>, log_p double, log_back double"
NO_ID = 1 << 40  # in the place of a null id, since null keys join with nothing
ABSENT = 1 << 41  # in the places in front of an n-gram of a lower order


def _names(order: int) -> list[str]:
    """Columns of the positions of an n-gram: the last is ``g1``, the one before ``g2``."""
    return [f"g{i}" for i in range(order, 0, -1)]


def _number(token: Column) -> Column:
    return F.coalesce(token.cast("bigint"), F.lit(NO_ID))


def _id(number: Column) -> Column:
    return F.when(number < NO_ID, number).cast("int")


def _counted(sequences: DataFrame, order: int) -> DataFrame:
    """``ngram_counts`` with a column per position."""
    tokens = F.coalesce("tokens", F.array().cast("array<int>"))
    padded = F.concat(F.array_repeat(F.lit(BOS_ID), order - 1), tokens, F.array(F.lit(EOS_ID)))
    held = sequences.select(padded.alias("padded"))
    size = F.size("padded") - (order - 1)
    runs = F.arrays_zip(*[F.slice("padded", F.lit(i + 1), size).alias(n) for i, n in enumerate(_names(order))])
    grams = held.select(F.inline(runs).alias(*_names(order))).select(*[_number(F.col(n)).alias(n) for n in _names(order)])
    return grams.groupBy(*_names(order)).agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(sequences: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, n)`` of all n-grams of ``sequences (tokens)``, counted before the shuffle.

    Beginning ids in front and one end id behind make every token, and the end, the last
    of exactly one n-gram. Null tokens count as none.
    """
    return _counted(sequences, order).select(F.array(*[_id(F.col(n)) for n in _names(order)]).alias("gram"), "n")


class NgramModel:
    """Probabilities of n-grams of ids, as one table in the scratch folder.

    ``ids`` is the number of ids of the vocabulary, special ones included: what the
    unigrams leave over is shared by all of them alike, so that no id is impossible.
    """

    def __init__(self, sequences: DataFrame, ids: int, order: int = ORDER, discount: float = DISCOUNT):
        if order < 1 or not 0 < discount < 1:
            raise ValueError("an order of 1 at least and a discount between 0 and 1")
        self.order = order
        counts = [materialize(_counted(sequences, order), "ngrams")]
        for size in range(order - 1, 0, -1):
            shorter = counts[-1].groupBy(*_names(size)).agg(F.count(F.lit(1)).alias("n"))
            counts.append(materialize(shorter, "ngrams"))
        counts.reverse()  # from unigrams up
        total, types = counts[0].agg(F.sum("n"), F.count(F.lit(1))).first()
        # Nothing counted: all ids are alike.
        rest = discount * types / total / ids if total else 1.0 / ids
        self.unseen = rest
        lower = counts[0].select("g1", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.lit(float(total or 1)) + rest).alias("p"))
        lower = materialize(lower, "ngram_p")
        probabilities, weights = [lower], []
        for size, grams in enumerate(counts[1:], 2):
            names, tail = _names(size), _names(size - 1)
            heads = names[:-1]
            contexts = grams.groupBy(*heads).agg(
                F.sum("n").alias("total"), (discount * F.count(F.lit(1)) / F.sum("n")).alias("back")
            )
            contexts = materialize(contexts, "ngram_contexts")
            weights.append(contexts.select(*[F.col(h).alias(n) for h, n in zip(heads, tail, strict=True)], "back"))
            known = grams.join(contexts, heads).join(lower.withColumnRenamed("p", "below"), tail)
            p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below")
            lower = materialize(known.select(*names, p.alias("p")), "ngram_p")
            probabilities.append(lower)
        rows = None
        for size, part in enumerate(probabilities, 1):
            names = _names(size)
            if size < order:  # contexts of beginning ids are no n-grams themselves
                part = part.join(weights[size - 1], names, "full")
            else:
                part = part.withColumn("back", F.lit(None).cast("double"))
            absent = [F.lit(ABSENT).alias(n) for n in _names(order)[: order - size]]
            part = part.select(*absent, *names, F.log("p").alias("log_p"), F.log("back").alias("log_back"))
            rows = part if rows is None else rows.unionByName(part)
        self.numbered = materialize(rows, "ngram_model")
        gram = F.filter(F.array(*_names(order)), lambda t: t < ABSENT)
        self.table = self.numbered.select(F.transform(gram, _id).alias("gram"), "log_p", "log_back")

    def score(self, windows: DataFrame) -> DataFrame:
        """``(window, nll)`` of distinct ``windows (window)``: a target behind its context.

        A window has ``order`` ids at most; fewer where a sequence begins.
        """
        size = F.size("window")
        ends = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(
            k.alias("k"), F.lit(False).alias("is_context"), F.slice("window", size - k + 1, k).alias("gram")
        ))
        contexts = F.transform(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), lambda k: F.struct(
            k.alias("k"), F.lit(True).alias("is_context"),
            F.when(k <= size, F.slice("window", F.greatest(size - k + 1, F.lit(1)), k - 1)).alias("gram"),
        ))
        asked = windows.select("window", F.inline(F.concat(ends, contexts))).where("gram is not null")
        for i, name in enumerate(reversed(_names(self.order)), 1):
            number = F.when(F.size("gram") >= i, _number(F.try_element_at("gram", F.lit(-i)))).otherwise(F.lit(ABSENT))
            asked = asked.withColumn(name, number)
        found = asked.join(self.numbered, _names(self.order), "left")
        # At most two rows per order of a window.
        known = found.groupBy("window").agg(
            F.max(F.when(~F.col("is_context") & F.col("log_p").isNotNull(), F.struct("k", "log_p"))).alias("best"),
            F.collect_list(F.when(F.col("is_context"), F.struct("k", "log_back"))).alias("backs"),
        )
        longest = F.coalesce("best.k", F.lit(0))
        passed = F.filter("backs", lambda b: (b["k"] > longest) & b["log_back"].isNotNull())
        backed = F.aggregate(passed, F.lit(0.0), lambda a, b: a + b["log_back"])
        from_unseen = F.lit(self.unseen)
        return known.select("window", (-(F.coalesce("best.log_p", F.log(from_unseen)) + backed)).alias("nll"))

    def token_nll(self, sequences: DataFrame, by: Sequence[str]) -> DataFrame:
        """``(by..., pos, token, nll)``: the loss of every shifted target of ``tokens``.

        Equal windows are scored once, whatever their number.
        """
        size = F.size("tokens")
        before = F.lit(self.order - 1)
        window = lambda at: F.slice(
            "tokens", F.greatest(at + 2 - before, F.lit(1)), F.least(at + 1, before) + 1
        )
        places = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
        targets = sequences.select(
            *by, F.inline(F.transform(places, lambda at: F.struct(at.alias("pos"), window(at).alias("window"))))
        )
        targets = materialize(targets, "ngram_targets")
        scored = self.score(targets.select("window").distinct())
        joined = targets.join(scored, "window")
        return joined.select(*by, "pos", F.element_at("window", -1).alias("token"), "nll")


def context_val_loss(batches: DataFrame, model: NgramModel, epoch: int = 0) -> DataFrame:
    """Mean of the batch means over one epoch of ``batches (epoch, batch_id, tokens)``."""
    chosen = batches.where(F.col("epoch") == epoch)
    means = model.token_nll(chosen, ["batch_id"]).groupBy("batch_id").agg(F.avg("nll").alias("mean"))
    return means.agg(F.avg("mean").alias("val_loss"), F.count(F.lit(1)).alias("batches"))
