"""Tokens, ids and the functions between them.

A vocabulary is a table ``(token, id, n)`` of the size its maker chose, whatever the size
of the corpus. Its bytes are counted before it is shipped to every task. Splitting text into tokens stays in the JVM; the
lookup runs on Arrow batches, the rest piece by piece of a batch, of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import PAD_ID, UNK_ID
from corpusmill.functions.pieces import pieces

# Fixed values of the two built-in token rules.
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\x0b\p{L}\p{N}_]"
SPACE_PATTERN = r"[^\s\x0b]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, and single other symbols."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def space_words(text: Column) -> Column:
    """Lower-cased words between white space (the second, comparison rule)."""
    return F.regexp_extract_all(F.lower(text), F.lit(SPACE_PATTERN), F.lit(0))


class Tokenizer(Protocol):
    """Anything that turns a text column into ids and back."""

    def encode(self, text: Column) -> Column:
        """Ids (``array<int>``) of a text column."""

    def decode(self, ids: Column) -> Column:
        """Text of an id column, special ids left out."""


VOCAB_BYTES = 256 << 20  # of tokens that are shipped to every task


class VocabTokenizer:
    """Tokenizer over a vocabulary table and a token rule.

    As a function of a column it takes any number of tokens of any length, as long as
    together they have ``VOCAB_BYTES``. A larger vocabulary does not reach the tasks
    (``fits`` is false): whole tables are then encoded by joins, see ``encode_table``.
    """

    def __init__(self, vocab: DataFrame, split: Callable[[Column], Column] = words):
        self.vocab, self.split = vocab, split
        size = vocab.agg(F.sum(F.octet_length("token"))).first()[0] or 0
        self.fits = size <= VOCAB_BYTES
        if not self.fits:
            return
        rows = vocab.select("token", "id").toArrow().sort_by("id")
        self.tokens = rows["token"].to_pylist()
        self.ids = rows["id"].to_pylist()
        shared = vocab.sparkSession.sparkContext.broadcast((self.tokens, self.ids))

        # Tables are made once per task. Nothing of a batch's size is made beside the batch.
        @F.arrow_udf("array<int>")
        def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, ids = shared.value
            values, coded_as = pa.array(known, pa.string()), pa.array(ids, pa.int32())
            for found in pieces(batches):
                at = pc.index_in(found.flatten().cast(pa.string()), value_set=values)
                yield pa.ListArray.from_arrays(_offsets(found), pc.fill_null(pc.take(coded_as, at), UNK_ID))

        @F.arrow_udf("string")
        def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, ids = shared.value
            by_id = np.full(max(ids, default=0) + 2, None, dtype=object)
            by_id[np.asarray(ids, dtype=np.int64)] = known
            spelling = pa.array(by_id, pa.string())
            for found in pieces(batches):
                flat = pc.min_element_wise(found.flatten().cast(pa.int64()), len(by_id) - 1)
                spelled = pc.take(spelling, flat)
                keep = pc.is_valid(spelled)
                kept_before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
                offsets = kept_before[_offsets(found).to_numpy()].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), spelled.filter(keep))
                yield pc.binary_join(lists, " ")

        self._lookup, self._spell = lookup, spell

    def _must_fit(self) -> None:
        if not self.fits:
            raise ValueError(f"a vocabulary of more than {VOCAB_BYTES} bytes reaches no task; encode whole tables")

    def encode(self, text: Column) -> Column:
        """Ids of the text's tokens; unknown ones become ``UNK_ID``."""
        self._must_fit()
        return self._lookup(self.split(F.coalesce(text, F.lit(""))))

    def decode(self, ids: Column) -> Column:
        """Tokens joined with spaces; special and unknown ids are skipped, null ids have the empty text.

        Of ids that ``encode`` has just made, the same Python worker makes the text.
        """
        self._must_fit()
        return self._spell(ids)


def _offsets(lists: pa.ListArray) -> pa.Array:
    """List offsets counted from the first element that ``flatten`` returns."""
    offsets = lists.offsets.to_numpy()
    return pa.array((offsets - offsets[0]).astype(np.int32))


def crop_last(tokens: Column, size: int) -> Column:
    """The last ``size`` tokens."""
    start = F.greatest(F.lit(1), F.size(tokens) - size + 1)
    return F.slice(tokens, start, size)


def inputs(tokens: Column) -> Column:
    """All tokens but the last."""
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def targets(tokens: Column) -> Column:
    """All tokens but the first."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def counted_targets(tokens: Column, pad_id: int = PAD_ID) -> Column:
    """Targets that take part in the loss: padding is left out."""
    return F.filter(targets(tokens), lambda t: t != pad_id)


def pad_to(ids: Column, length: Column, pad_id: int = PAD_ID) -> Column:
    """Ids followed by padding up to ``length``."""
    missing = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def attention_mask(ids: Column, length: Column) -> Column:
    """1 for each id, 0 for the padding behind it."""
    missing = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))
