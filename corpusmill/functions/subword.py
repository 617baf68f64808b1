"""Sub-word tokens of a public byte-level vocabulary, without loss.

A vocabulary is a list of byte strings by rank; it is read from a file of the caller's and
never made here. A text is cut into words by a pattern in the JVM. Each word's bytes are
merged pair by pair, the pair whose joint string has the least rank first; every byte is
a token of its own, so any text has ids, and its ids give back exactly the text.

Words repeat, so an Arrow batch merges its distinct words only, and a worker remembers
words within a fixed bound. Ids are put to their places piece by piece of a batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.pieces import pieces

# Fixed value: how public byte-level vocabularies of this kind cut a text into words.
WORD_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
RANK_BYTES = 1 << 26  # of a vocabulary file at most: it goes to every task
REMEMBERED = 1 << 17  # words of a worker
LISTED = 1 << 14  # words whose ids are lists at once


class Ranks:
    """Byte strings by rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.by_token = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.by_token for b in range(256)):
            raise ValueError("a vocabulary without all 256 bytes")
        self.words: dict[str, list[int]] = {}

    def __reduce__(self):
        return Ranks, (self.tokens,)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Ranks:
        """A file of lines ``<base64 of the bytes> <rank>``, wherever Spark reads it."""
        rows = spark.read.text(path).where("value != ''")
        size = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
        if size > RANK_BYTES:
            raise ValueError(f"{path} is larger than {RANK_BYTES} bytes")
        found = {}
        for row in rows.collect():  # bounded above
            token, rank = row.value.split()
            found[int(rank)] = base64.b64decode(token)
        if sorted(found) != list(range(len(found))):
            raise ValueError(f"{path} does not rank its tokens from 0 on")
        return cls([found[i] for i in range(len(found))])

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of least rank is joined, the first of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        never = len(self.tokens)
        while len(parts) > 1:
            ranks = [self.by_token.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.by_token[p] for p in parts]

    def ids(self, word: str) -> list[int]:
        """``merged``, remembered."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            found = self.words[word] = self.merged(word.encode())
        return found

    def spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all; lists of few words exist at a time."""
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in range(0, len(words), LISTED):
            rows = [self.ids(w) for w in words.slice(at, LISTED).to_pylist()]
            sizes.append(np.array([len(r) for r in rows], np.int64))
            flat.append(np.array([i for r in rows for i in r], np.int32))
        return np.concatenate(sizes), np.concatenate(flat)


class SubwordTokenizer:
    """Tokenizer (see ``functions.tokens``) over ranked byte strings.

    Null text has no ids. Ids that the vocabulary has not, such as an end-of-sequence id
    behind its last rank, are left out when decoding; bytes that are no UTF-8, as they
    come from ids cut off within a character, become U+FFFD.
    """

    def __init__(self, spark: SparkSession, ranks: Ranks, pattern: str = WORD_PATTERN):
        self.size, self.pattern = len(ranks.tokens), pattern
        shared = spark.sparkContext.broadcast(ranks)

        @F.arrow_udf("array<int>")
        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = shared.value
            for lists in batches:
                coded = pc.dictionary_encode(lists.flatten())
                sizes, flat = known.spelled(coded.dictionary)
                before = np.cumsum(sizes) - sizes
                for part in pieces([pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), coded.indices)]):
                    at = part.flatten().to_numpy(zero_copy_only=False)
                    # Each place takes its word's run of ids.
                    taken = sizes[at]
                    ends = np.cumsum(taken)
                    starts = before[at]
                    ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - taken), taken)]
                    offsets = part.offsets.to_numpy()
                    runs = np.concatenate([[0], ends])[offsets - offsets[0]].astype(np.int32)
                    yield pa.ListArray.from_arrays(pa.array(runs), pa.array(ids))

        @F.arrow_udf("string")
        def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = pa.array([*shared.value.tokens, b""], pa.binary())
            for lists in pieces(batches):
                flat = lists.flatten().cast(pa.int64())
                inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens) - 1))
                spelled = pc.take(tokens, pc.if_else(inside, flat, len(tokens) - 1))
                offsets = lists.offsets.to_numpy()
                parts = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), spelled)
                joined = pc.binary_join(parts, b"")
                yield pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())

        self._look_up, self._spell = look_up, spell

    def encode(self, text: Column) -> Column:
        """Ids of a text column."""
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))
        return self._look_up(words)

    def decode(self, ids: Column) -> Column:
        """Text of an id column."""
        return self._spell(F.coalesce(ids, F.array().cast("array<int>")))
