"""Spelling variants: frequent words one edit apart, by products of letter-count blocks.

A word's letter counts are a vector. One inserted or deleted letter changes one count by
one, one replaced letter two: the squared distance is one or two. The squared distances
of a whole block of words come from one matrix product, their Gram matrix; only pairs at
most two apart, of the same or neighbouring length, are compared letter by letter.

Blocks are cut so that near words meet. Letters fall into classes; a word's profile is
its length and its number of letters of every class. Take one letter off the longer word
of a pair, or off both of equal length, and the profiles agree. So a word is a member of
the block of its own profile, as a short one, and of those of its profile less one letter
of a class, as a long one; in a block every short word meets every long one, and the long
ones each other. A block of too many members is cut again by all letters in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.rows import slices
from corpusmill.llm.shingles import mix
from corpusmill.scratch import Scope, materialize

#: Fixed by the contract: what a run is, which are changed, and which words and forms count.
RUN = "[A-Za-zÀ-ÿ]+"
DIVISOR = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_FACTOR = 5

CLASSES = 12  # of letters, for the profile of a word
BLOCK_WORDS = 1 << 12  # members from which a block is cut again by all letters
GRAM_ROWS = 1 << 10  # words turned into vectors at once
TILE = 256  # rows of either side of one product, of one large block or several small ones
LETTERS = 26 + 64  # components of a vector: a to z, and U+00C0 to U+00FF
COUNTED = 1 << 18  # distinct words that a task adds up before it passes them on

_LOWER = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` of texts, added up over the documents of a task as far as memory goes."""
    find = re.compile(RUN).findall
    counts: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for part in (p for batch in batches for p in slices(batch)):
        for doc_id, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            # A document's equal runs have one checksum.
            for run, n in Counter(find(text or "")).items():
                if len(run) < LEAST_LENGTH:
                    continue
                word = run if run.islower() else run.translate(_LOWER)
                h = zlib.crc32(word.encode(), start)
                if h % DIVISOR == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                counts[word] = counts.get(word, 0) + n
            if len(counts) >= COUNTED:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times.

    Runs of letters of the whole texts (null: none), A to Z in lower case. Where 199
    divides the checksum of ``<doc_id>:<run>`` the run loses one letter; a null doc_id is
    the empty string there. All rows count, repeated ones too.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    counted = rows.mapInArrow(_counted, "word string, n bigint").where(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts, a row for each word, and the words' code points, zeros behind their end."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    codes = np.zeros((len(words), int(sizes.max(initial=0)) + 1), np.uint8)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    column = np.where(flat < 0xC0, flat - ord("a"), 26 + flat - 0xC0)
    counts = np.bincount(row * LETTERS + column, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
    return counts, codes


# A profile's hash is a sum over its letters, so that taking one off is a subtraction.
_OF_LETTER = mix(np.arange(1, LETTERS + 1, dtype=np.uint64))
_CLASS = (_OF_LETTER % np.uint64(CLASSES)).astype(np.int64)
_OF_CLASS = mix(np.arange(1001, 1001 + CLASSES, dtype=np.uint64))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, GRAM_ROWS)):
        counts, _ = _letters(batch.column("word").to_pylist())
        unsigned = counts.astype(np.uint64)
        fine, block = unsigned @ _OF_LETTER, unsigned @ _OF_CLASS[_CLASS]
        at, letter = np.nonzero(counts)  # a row for each letter that could go
        own = np.arange(len(counts))
        rows = np.concatenate([own, at])
        out = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([block, block[at] - _OF_CLASS[_CLASS[letter]]]).view(np.int64)),
                pa.array(np.concatenate([fine, fine[at] - _OF_LETTER[letter]]).view(np.int64)),
                out.column("word"),
                out.column("n"),
                pa.array(np.arange(len(rows)) < len(own)),
            ],
            ["block", "fine", "word", "n", "short"],
        )


def memberships(words: DataFrame) -> DataFrame:
    """``(block, fine, word, n, short)``: the blocks of every word of ``words (word, n)``.

    ``block`` stands for the profile, ``fine`` for all letters, both less one letter unless
    ``short``. A long word has a row for each letter it could lose.
    """
    return words.select("word", "n").mapInArrow(
        _members, "block bigint, fine bigint, word string, n bigint, short boolean"
    )


def _one_edit(codes: np.ndarray, a: np.ndarray, b: np.ndarray, inserted: bool) -> np.ndarray:
    """Whether words ``a`` are words ``b`` but for one character, replaced or more in ``a``."""
    if not inserted:
        return (codes[a] != codes[b]).sum(axis=1) == 1
    more, less = codes[a], codes[b]
    same = np.cumprod(more[:, :-1] == less[:, :-1], axis=1).sum(axis=1)  # length of the joint beginning
    behind = more[:, 1:] == less[:, :-1]
    return (behind | (np.arange(behind.shape[1]) < same[:, None])).all(axis=1)


def near_in_tile(counts: np.ndarray, codes: np.ndarray, left: slice, right: slice, block: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of two runs of rows: longer word first, equal ones once."""
    x, y = counts[left], counts[right]
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    near = (distance > 0) & (distance <= 2) & (block[left][:, None] == block[right][None, :])
    i, j = np.nonzero(np.triu(near) if left == right else near)
    i, j, distance = i + left.start, j + right.start, distance[i, j]
    i, j = np.where(short[i], j, i), np.where(short[i], i, j)
    out = []
    for inserted in (False, True):
        # Of one length, and both less a letter here; or the second as it is, and shorter.
        fits = ~short[i] & (short[j] == inserted) & (distance == (1 if inserted else 2))
        a, b = i[fits], j[fits]
        right_ones = _one_edit(codes, a, b, inserted)
        out.append((a[right_ones], b[right_ones]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows that come block by block."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        short = rows.column("short").to_numpy()
        keys = np.stack([rows.column(c).to_numpy() for c in ("block", "fine")], axis=1)
        block = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        counts, codes = _letters(words)
        counts = counts.astype(np.float32)
        for at in range(0, len(words), TILE):
            left = slice(at, min(at + TILE, len(words)))
            for other in range(at, len(words), TILE):
                right = slice(other, min(other + TILE, len(words)))
                if block[right.start] > block[left.stop - 1]:
                    break
                a, b = near_in_tile(counts, codes, left, right, block, short)
                one, two = np.concatenate([a, b]), np.concatenate([b, a])
                take = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([take(one), take(two), pa.array(n[two])], ["word", "near", "near_n"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "fine")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        begun = waiting and (waiting[-1].column("block")[-1].as_py(), waiting[-1].column("fine")[-1].as_py())
        if begun and begun != tuple(keys[0].tolist()):
            cuts = np.concatenate([[0], cuts])
        if not len(cuts):
            waiting.append(batch)
            continue
        # All but the last block are whole.
        yield from pairs(pa.Table.from_batches([*waiting, batch.slice(0, int(cuts[-1]))]))
        waiting = [batch.slice(int(cuts[-1]))]
    if waiting:
        yield from pairs(pa.Table.from_batches(waiting))


def near_words(scope: Scope, words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every near pair of ``words (word, n)``, both ways, once."""
    members = scope.keep(memberships(words), "members")
    coarse = members.select("block", F.lit(0).cast("long").alias("fine"), "word", "n", "short").distinct()
    sizes = coarse.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    large = scope.keep(sizes.where(F.col("members") > BLOCK_WORDS).select("block"), "large")
    whole = coarse.join(large, "block", "left_anti")
    again = members.join(large, "block", "left_semi")
    dealt = whole.unionByName(again).repartition("block", "fine").sortWithinPartitions("block", "fine")
    found = dealt.mapInArrow(_near, "word string, near string, near_n bigint")
    near = scope.keep(found.distinct(), "near")
    scope.drop(members, large)
    return near


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``docs (doc_id, text)``.

    ``form`` is the near word of largest count, the smallest in code-point order among
    equals, if that count is at least five times the word's own; ``root`` is where
    following forms ends, the word itself without one. Tables without texts give no rows.
    """
    with Scope(docs.sparkSession) as scope:
        words = scope.keep(word_counts(docs), "words")
        near = near_words(scope, words)
        counted = near.groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
        )
        known = words.join(counted, "word", "left")
        enough = -F.col("best.minus") >= FORM_FACTOR * F.col("n")
        formed = known.select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        )
        formed = scope.keep(formed, "formed")
        # Counts grow fivefold along forms, so chains are short; pointers double each round.
        roots = scope.keep(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        while True:
            ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
            jumped = roots.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
            jumped = scope.keep(jumped, "roots")
            done = jumped.where("moved").isEmpty()
            roots = jumped.select("word", "root")
            if done:
                break
        out = formed.join(roots, "word", "left")
        return materialize(
            out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"
        )
