"""Building a vocabulary and unigram scores from a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import (
    BOS_ID,
    EOS_ID,
    FIRST_WORD_ID,
    UNK_ID,
    VOCAB_SIZE,
)
from corpusmill.functions.tokens import words
from corpusmill.scratch import materialize

_STEPS = 16  # count classes per doubling
PAGE_TOKENS = 1 << 15  # distinct tokens of one page, about
PAGE_ROWS = 1 << 12  # texts of one page at most


def count_tokens(docs: DataFrame, split: Callable[[Column], Column] = words) -> DataFrame:
    """Occurrences ``(token, n)`` in ``docs (text)``, counted before the shuffle.

    The table is written once, since vocabulary and scores both read it.
    """
    tokens = docs.select(F.explode(split(F.col("text"))).alias("token"))
    return materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")


def build_vocab(counts: DataFrame, size: int = VOCAB_SIZE) -> DataFrame:
    """The most frequent tokens as ``(token, id, n)``, ties in token order.

    Counts fall into logarithmic classes (at most a thousand). Only classes that can
    reach the top are kept before the final sort, so that sort sees little more than
    ``size`` rows instead of every rare string of the corpus.
    """
    wanted = size - FIRST_WORD_ID
    fit = counts.withColumn("_class", F.floor(F.log2("n") * _STEPS))
    higher = Window.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        fit.groupBy("_class")
        .agg(F.count(F.lit(1)).alias("_m"))
        .select("_class", F.coalesce(F.sum("_m").over(higher), F.lit(0)).alias("_above"))
        .where(F.col("_above") < wanted)
        .select("_class")
    )
    top = (
        fit.join(F.broadcast(reach), "_class")  # one row per count class
        .orderBy(F.desc("n"), "token")
        .limit(wanted)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select(
        "token", (rank - 1 + FIRST_WORD_ID).cast("int").alias("id"), "n"
    )


def unigram_scores(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add-one smoothed negative log-likelihood per id: ``(id, nll)``.

    Every id of the vocabulary and the three special ones get a row; tokens outside
    the vocabulary are counted under the unknown id.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    known, size = vocab.agg(F.sum("n"), F.count(F.lit(1))).first()
    spark = counts.sparkSession
    special = spark.createDataFrame(
        [(UNK_ID, total - (known or 0)), (BOS_ID, 0), (EOS_ID, 0)], "id int, n bigint"
    )
    mass = total + size + FIRST_WORD_ID
    return vocab.select("id", "n").unionByName(special).select(
        "id", (-F.log((F.col("n") + 1) / F.lit(mass))).alias("nll")
    )


def encode_table(docs: DataFrame, vocab: DataFrame, *keys: str, split: Callable[[Column], Column] = words) -> DataFrame:
    """``(keys..., tokens)`` of ``docs (keys..., text)`` under a vocabulary of any size.

    Texts are gathered into pages, each with a dictionary of its distinct tokens, of
    bounded size. Only dictionaries meet the vocabulary, in a shuffled join; a page's ids
    then go back to its texts, which hold numbers in the dictionary meanwhile. Tokens
    without an id become the unknown id; null text has no tokens.
    """
    tokens = docs.select(*keys, split(F.coalesce("text", F.lit(""))).alias("tokens"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes if c != "tokens")
    numbered = tokens.withColumn("page", F.monotonically_increasing_id()).mapInArrow(
        _paged, f"{kinds + ', ' if kinds else ''}page bigint, codes array<int>, dictionary array<string>"
    )
    pages = materialize(numbered, "token_pages")
    entries = pages.where("dictionary is not null").select("page", F.posexplode("dictionary").alias("code", "token"))
    known = entries.join(vocab.select("token", "id"), "token", "left")
    ids = known.groupBy("page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("code", F.coalesce("id", F.lit(UNK_ID)).alias("id")))), lambda e: e["id"]
        ).alias("ids")
    )
    rows = pages.where("codes is not null").select(*keys, "page", "codes")
    return rows.join(ids, "page", "left").select(
        *keys, F.arrow_udf(_looked_up, "array<int>")(F.col("codes"), F.col("ids")).alias("tokens")
    )


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with codes, and behind a page's rows one with its dictionary; a page is never empty.

    A page is named by the number of its first row, which no other page has.
    """
    page, rows, numbers = None, 0, {}

    def last(schema: pa.Schema) -> pa.RecordBatch:
        nulls = [pa.nulls(1, schema.field(c).type) for c in schema.names if c not in ("tokens", "page")]
        words = pa.array([list(numbers)], pa.list_(pa.string()))
        columns = [*nulls, pa.array([page], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), words]
        names = [c for c in schema.names if c not in ("tokens", "page")] + ["page", "codes", "dictionary"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = None
    for batch in batches:
        schema = batch.schema
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            if page is not None and (len(numbers) >= PAGE_TOKENS or rows >= PAGE_ROWS):
                yield last(schema)
                page, rows, numbers = None, 0, {}
            if page is None:
                page = part.column("page")[0].as_py()
            rows += part.num_rows
            lists = part.column("tokens")
            coded = pc.dictionary_encode(lists.flatten().cast(pa.string()))
            own = [numbers.setdefault(t, len(numbers)) for t in coded.dictionary.to_pylist()]
            codes = np.array(own, np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
            offsets = lists.offsets.to_numpy()
            found = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(codes, pa.int32()))
            names = [c for c in schema.names if c not in ("tokens", "page")]
            columns = [part.column(c) for c in names]
            columns += [pa.array(np.full(part.num_rows, page)), found, pa.nulls(part.num_rows, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "page", "codes", "dictionary"])
    if page is not None:
        yield last(schema)


def _looked_up(codes: pa.Array, ids: pa.Array) -> pa.Array:
    """Per row the ids at its codes."""
    offsets, base = codes.offsets.to_numpy(), ids.offsets.to_numpy()
    flat, known = codes.flatten().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    at = flat + np.repeat(base[:-1] - base[0], sizes)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(known[at], pa.int32()))
