"""Character shingles, MinHash signatures and their bands.

Signatures come from Arrow batches: Spark partitions the documents, numpy hashes all
shingles of a text at once. The arithmetic is plain unsigned 32-bit (wrap-around), so
the same numbers can be computed in SQL.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.config import DEDUP_THRESHOLD, NUM_PERM, SHINGLE_CHARS

EMPTY_HASH = (1 << 32) - 1  # signature value of a text without shingles
SHINGLE_BASE = 0x01000193
MIX_1 = 0x85EBCA6B
MIX_2 = 0xC2B2AE35
_GROUP = 100_000  # characters hashed together, small enough to stay in cache


def permutations(count: int = NUM_PERM) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash family, from a fixed recurrence."""
    state, values = 0x9E3779B9, []
    for _ in range(2 * count):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        values.append(state >> 32)
    a = np.array(values[:count], dtype=np.uint32) | np.uint32(1)
    return a, np.array(values[count:], dtype=np.uint32)


def shingle_hashes(text: str, n: int = SHINGLE_CHARS) -> np.ndarray:
    """32-bit hash of each run of ``n`` code points, at every offset."""
    # "surrogatepass" keeps lone surrogates, which a JVM string may hold.
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    count = len(points) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint32)
    h = np.zeros(count, dtype=np.uint32)
    for j in range(n):
        h *= np.uint32(SHINGLE_BASE)
        h += points[j : j + count]
    h ^= h >> np.uint32(16)
    h *= np.uint32(MIX_1)
    h ^= h >> np.uint32(13)
    h *= np.uint32(MIX_2)
    h ^= h >> np.uint32(16)
    return h


def signatures(
    texts: list[str | None], num_perm: int = NUM_PERM, n: int = SHINGLE_CHARS
) -> np.ndarray:
    """One signature row per text: the minimum of each permuted shingle hash.

    A missing text counts as empty.
    """
    texts = [t or "" for t in texts]
    out = np.full((len(texts), num_perm), EMPTY_HASH, dtype=np.uint32)
    rows, size = [], 0
    for row, text in enumerate(texts):
        if len(text) >= n:
            rows.append(row)
            size += len(text)
        if rows and (size >= _GROUP or row == len(texts) - 1):
            out[rows] = _group_minima([texts[r] for r in rows], num_perm, n)
            rows, size = [], 0
    return out


def _group_minima(texts: list[str], num_perm: int, n: int) -> np.ndarray:
    """Per-text minima of every permutation, over the texts laid end to end.

    Shingles that reach into the next text lie between the segments and are skipped.
    """
    a, b = permutations(num_perm)
    hashes = shingle_hashes("".join(texts), n)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    bounds = np.column_stack([starts, ends - n + 1]).ravel()[:-1]
    minima = np.empty((len(texts), num_perm), dtype=np.uint32)
    permuted = np.empty_like(hashes)
    for i in range(num_perm):
        np.multiply(hashes, a[i], out=permuted)
        permuted += b[i]
        minima[:, i] = np.minimum.reduceat(permuted, bounds)[::2]
    return minima


def minhash(text: Column, num_perm: int = NUM_PERM, n: int = SHINGLE_CHARS) -> Column:
    """MinHash signature of ``text`` as ``array<bigint>``."""

    @F.arrow_udf("array<bigint>")
    def batch_signatures(texts: pa.Array) -> pa.Array:
        flat = signatures(texts.to_pylist(), num_perm, n).astype(np.int64).ravel()
        offsets = np.arange(0, len(flat) + 1, num_perm, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return batch_signatures(text)


def distinct_shingles(text: str, n: int = SHINGLE_CHARS) -> int:
    """Number of different runs of ``n`` code points, compared in full."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < n:
        return 0
    runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, n))
    return len(np.unique(runs.view(f"V{4 * n}").ravel()))


def shingle_counts(text: Column, n: int = SHINGLE_CHARS) -> Column:
    """Struct: number of shingles, of distinct ones, and their least hash."""

    @F.arrow_udf("struct<n_shingles: bigint, n_distinct: bigint, min_hash: bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        totals, distinct, least = [], [], []
        for t in texts.to_pylist():
            h = shingle_hashes(t or "", n)
            totals.append(len(h))
            distinct.append(distinct_shingles(t or "", n))
            least.append(int(h.min()) if len(h) else None)
        columns = [pa.array(c, pa.int64()) for c in (totals, distinct, least)]
        return pa.StructArray.from_arrays(columns, ["n_shingles", "n_distinct", "min_hash"])

    return counts(text)


@lru_cache(maxsize=32)
def band_shape(
    threshold: float = DEDUP_THRESHOLD, num_perm: int = NUM_PERM
) -> tuple[int, int]:
    """Bands and rows that minimise the summed area of wrong decisions.

    A pair of similarity ``s`` meets in some band with probability
    ``1 - (1 - s**rows)**bands``; the area below the threshold counts as false
    positives and the missing area above it as false negatives, at equal weight.
    """
    low = np.linspace(0.0, threshold, 2001)
    high = np.linspace(threshold, 1.0, 2001)
    best, shape = np.inf, (1, num_perm)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_positive = np.trapezoid(1 - (1 - low**rows) ** bands, low)
            false_negative = np.trapezoid((1 - high**rows) ** bands, high)
            if false_positive + false_negative < best:
                best, shape = false_positive + false_negative, (bands, rows)
    return shape


def band_keys(
    sig: Column, threshold: float = DEDUP_THRESHOLD, num_perm: int = NUM_PERM
) -> Column:
    """One 16-byte key per band of the signature."""
    bands, rows = band_shape(threshold, num_perm)
    return F.array(
        *[
            F.unhex(F.md5(F.array_join(F.slice(sig, 1 + i * rows, rows), ",")))
            for i in range(bands)
        ]
    )
