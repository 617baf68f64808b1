"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import BLOCK_SIZE, SPLIT_SEEDS, MixConfig
from corpusmill.functions.split import in_split
from corpusmill.functions.text import length_ok
from corpusmill.functions.tokens import Tokenizer, VocabTokenizer, words
from corpusmill.operators.evaluate import Scorer, table_scorer
from corpusmill.operators.mix import nested_interleave
from corpusmill.operators.ordered import global_index
from corpusmill.operators.pack import assemble, layout, pack
from corpusmill.operators.vocab import build_vocab, count_tokens, encode_table, unigram_scores
from corpusmill.scratch import materialize


class Lexicon:
    """A tokenizer built from a corpus, with the unigram scores of that corpus."""

    def __init__(self, docs: DataFrame, split: Callable[[Column], Column] = words):
        self.counts = count_tokens(docs, split)
        self.vocab = materialize(build_vocab(self.counts), "vocab")
        self.tokenizer = VocabTokenizer(self.vocab, split)

    def scores(self) -> DataFrame:
        """``(id, nll)`` per id."""
        return unigram_scores(self.counts, self.vocab)

    def scorer(self) -> Scorer:
        """The scores as a function of a token column."""
        return table_scorer(self.scores())


def tokenize(docs: DataFrame, tokenizer: Tokenizer, *keys: str) -> DataFrame:
    """``(keys..., tokens)`` of ``docs (keys..., text)``, by joins if the vocabulary is too large."""
    if not getattr(tokenizer, "fits", True):
        return encode_table(docs, tokenizer.vocab, *keys, split=tokenizer.split)
    return docs.select(*keys, tokenizer.encode(F.col("text")).alias("tokens"))


def training_texts(docs: DataFrame) -> DataFrame:
    """Texts of fitting length in the training split."""
    return docs.where(in_split(F.col("text"), "train") & length_ok(F.col("text")))


def mixed_keys(
    docs: DataFrame, split: str, epochs: Iterable[int], config: MixConfig | None = None
) -> DataFrame:
    """``(epoch, pos, source, ord)`` of one split of ``docs (source, ord, text)``."""
    chosen = docs.where(in_split(F.col("text"), split))
    return nested_interleave(chosen, config, SPLIT_SEEDS[split], epochs)


def text_corpus(
    docs: DataFrame,
    split: str = "train",
    epochs: Iterable[int] = (0,),
    config: MixConfig | None = None,
) -> DataFrame:
    """Mixed texts, not tokenised: ``(epoch, pos, source, ord, text)``.

    The length filter comes after mixing, so a dropped text uses up its draw.
    """
    keys = mixed_keys(docs, split, epochs, config)
    fitting = docs.select("source", "ord", "text").where(length_ok(F.col("text")))
    placed = keys.join(fitting, ["source", "ord"])
    return placed.select("epoch", "pos", "source", "ord", "text")


def packed_corpus(
    docs: DataFrame,
    tokenizer: Tokenizer,
    split: str = "train",
    epochs: Iterable[int] = (0,),
    block_size: int = BLOCK_SIZE,
    lossless: bool = True,
    config: MixConfig | None = None,
) -> DataFrame:
    """Mix, filter, tokenise and pack: ``(epoch, block_idx, tokens)``.

    One scan of the texts gives each record of the split its tokens, whatever the number
    of epochs; texts of other lengths keep their place in the mixture and no tokens.
    Mixing and the packing scan move keys and lengths only. Tokens are shuffled to their
    mixed place, and once more into their blocks.
    """
    fits = length_ok(F.col("text"))
    chosen = docs.where(in_split(F.col("text"), split)).select(
        "source", "ord", fits.alias("fits"), F.when(fits, F.col("text")).alias("text")
    )
    coded = tokenize(chosen, tokenizer, "source", "ord", "fits").withColumn("n", F.size("tokens"))
    coded = materialize(coded, "tokens")
    keys = nested_interleave(coded, config, SPLIT_SEEDS[split], epochs)
    coded = coded.where("fits")
    placed_lengths = materialize(
        keys.join(coded.select("source", "ord", "n"), ["source", "ord"]), "mixed"
    )
    placed = layout(placed_lengths.select("epoch", "pos", "n"), block_size, lossless)
    located = placed_lengths.drop("n").join(placed, ["epoch", "pos"])
    joined = located.join(coded.select("source", "ord", "tokens"), ["source", "ord"])
    return assemble(joined, block_size, lossless)


def pack_in_order(
    docs: DataFrame,
    tokenizer: Tokenizer,
    block_size: int = BLOCK_SIZE,
    lossless: bool = True,
) -> DataFrame:
    """Tokenise ``docs (ord, text)`` and pack them in ``ord`` order as one epoch."""
    coded = tokenize(docs.where(length_ok(F.col("text"))), tokenizer, "ord")
    coded = coded.select(F.lit(0).alias("epoch"), F.col("ord").alias("pos"), "tokens")
    return pack(materialize(coded, "tokens"), block_size, lossless)


def first_texts(corpus: DataFrame, n: int) -> DataFrame:
    """The first ``n`` texts of a corpus that runs through its epochs one after another."""
    keys = materialize(corpus.select("epoch", "pos", "source", "ord"), "corpus_keys")
    sizes = {r.epoch: r.n for r in keys.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, before = F.lit(None).cast("bigint"), 0
    for epoch in sorted(sizes):
        base = F.when(F.col("epoch") == epoch, F.lit(before).cast("bigint")).otherwise(base)
        before += sizes[epoch]
    indexed = global_index(keys, "pos", ["epoch"], "in_epoch")
    return indexed.withColumn("idx", base + F.col("in_epoch")).where(F.col("idx") < n).drop("in_epoch")
