"""Hashed word shingles of whole texts, in numpy over many texts at once.

A word's hash adds up scrambled values of its 8-byte lanes, each with its place in the
word; a shingle's hash scrambles those of its words. Sets of these 64-bit hashes stand for
the sets of shingles. Scrambling is not linear in the bytes, so no family of words
collides by its pattern; as for any function that behaves like a random one, two
different shingles of a pair of texts are taken for one with a chance of about
``words**2 / 2**64``. It is no defence against words searched out to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
PIECE = 1 << 18  # bytes hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: places get different values
_SPACES = (0x20, *range(0x09, 0x0E))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LANE = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(_LANE + 1)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACES)] = True
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Cuts at white space, ``PIECE`` bytes long unless one word is longer."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                while end < len(data) and not _IS_SPACE[data[end]]:
                    end += 1
        yield at, data[at:end]
        at = end


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array; ASCII letters count as lower case."""
    starts, hashes = [], []
    for at, piece in _pieces(data):
        space = _IS_SPACE[piece]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        padded = np.concatenate([_LOWER[piece], np.zeros(_LANE, np.uint8)])
        # The eight bytes from any place on, without copying.
        from_place = np.ndarray((len(piece) + 1,), "<u8", padded, strides=(1,))
        size = last - first
        lanes = -(-size // _LANE)
        begins = np.cumsum(lanes) - lanes
        nth = np.arange(int(lanes.sum())) - np.repeat(begins, lanes)
        places = np.repeat(first, lanes) + nth * _LANE
        rest = np.minimum(np.repeat(last, lanes) - places, _LANE)
        values = mix((from_place[places] & _MASKS[rest]) + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
        sums = np.add.reduceat(values, begins)
        starts.append(first + at)
        hashes.append(mix(sums + size.astype(np.uint64) * _STEP))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def combine(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` words; fewer words make one run, none make none."""
    if len(words) < WORDS:
        if not len(words):
            return np.empty(0, np.uint64)
        total = (words * _FACTORS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix(np.array([total], dtype=np.uint64))
    count = len(words) - WORDS + 1
    total = np.zeros(count, dtype=np.uint64)
    for j in range(WORDS):
        total += words[j : j + count] * _FACTORS[j]
    return mix(total)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size < WORDS`` words, as ``combine`` gives them alone."""
    count = len(words) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for j in range(size):
        total += words[j : j + count] * _FACTORS[j]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], budget: int = PIECE) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``WORDS``-word shingles.

    A text of fewer words has one shingle, the whole sequence; one without words, or
    null, has none. Texts are hashed together up to ``budget`` bytes.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > budget:
            yield from _group_sets(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from _group_sets(group)


def _group_sets(group: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(group), dtype=np.uint8)
    starts, words = word_hashes(data)
    lengths = np.array([len(g) + 1 for g in group])
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    runs = combine(words)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.unique(runs[a : b - WORDS + 1] if b - a >= WORDS else combine(words[a:b]))
