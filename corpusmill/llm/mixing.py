"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.rows import KEY, row_key, take_copies
from corpusmill.operators.ordered import global_index, running_total
from corpusmill.scratch import materialize

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # words of the mix over words of the corpus
MOST = 2  # copies of a document at most, and so of a source
SEED = 42
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    short = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(short, SPACES, "")).cast("long"), F.lit(0).cast("long"))


def _draw(seed: int, source: Column) -> Column:
    """One offset in [0, 1) per source number."""
    text = F.concat_ws(":", F.lit(str(seed)), source.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Add ``src``, ``target`` and ``offset`` to the one-row-per-source ``(source, source_size)``.

    Sources by code point, null last, have the weights in turn. A target is
    ``least(MOST * source_size, weight * level)`` with one level for all, at which the
    targets add up to ``share`` of all words: what is left when excess goes back to the
    others by weight until none is above. The level is found among the points where a
    source is full, by running sums in order of fullness; one row reaches the driver.
    """
    ranked = global_index(
        sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], name="src"
    )
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("src") % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST)
    ranked = materialize(ranked.withColumn("full_at", F.col("cap") / F.col("weight")), "sources")
    all_words, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (all_words or 0)
    caps = running_total(ranked, "cap", ["full_at", "src"], name="caps")
    both = running_total(caps, "weight", ["full_at", "src"], name="taken")
    spent = F.col("caps") + F.col("full_at") * (F.lit(all_weight) - F.col("taken"))
    last = both.where(spent <= total).agg(F.max_by(F.struct("caps", "taken"), F.struct("full_at", "src")))
    full = last.first()[0]
    caps_full, weight_full = (full.caps, full.taken) if full else (0, 0)
    rest = (all_weight or 0) - weight_full
    level = (total - caps_full) / rest if rest else float("inf")
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select(
        "source", "source_size", "src", target.alias("target"), _draw(SEED, F.col("src")).alias("offset")
    )


def mix_copies(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, keep: Sequence[str] = ()
) -> DataFrame:
    """``(_row, doc_id, size, source_size, target, copies)``, one row per input row.

    Every document of a source is expected ``target / source_size`` times. Along the
    source's documents in order of size these expectations add up; with one offset per
    source, a document is emitted once per whole number that the sum crosses on it. So
    documents of like size are taken at an even rate, and the words taken come near the
    target. Null text has size 0; null is a source of its own, the last; repeated rows
    count each. Sizes are read from the texts once, all else moves narrow rows.
    """
    sized = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5("text").alias("_text"),
        *keep,
    )
    sized = materialize(sized, "mix_sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(materialize(sizes, "mix_sources"), weights, share), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    known = sized.join(targets, same).drop("source")
    placed = global_index(known, ["size", "doc_id", "_text", "_row"], ["src"], "k")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("k") + 1) * rate + F.col("offset")) - F.floor(F.col("k") * rate + F.col("offset"))
    return placed.select(
        "_row",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.least(crossed, F.lit(MOST)).cast("long").alias("copies"),
        *keep,
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken of it."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix_copies(docs).select("doc_id", "size", "source_size", "target", taken, "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; needs their ``lang`` too."""
    keyed = docs.withColumn(KEY, row_key())
    return take_copies(docs, mix_copies(keyed, keep=[KEY]).select(KEY, "copies"))
