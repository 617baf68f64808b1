"""Arrow lists in pieces, so that what a Python worker makes of a batch has a bounded size.

A batch has as many rows as the session says, however long they are. A worker that turns
it into other arrays at once needs several times its size for them, and keeps the memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_ITEMS = 1 << 17  # of the lists in one piece; a longer list is a piece of its own


def pieces(batches: Iterable[pa.ListArray]) -> Iterator[pa.ListArray]:
    """The rows of ``batches``, in order, in runs of at most ``PIECE_ITEMS`` items together."""
    for lists in batches:
        offsets, at = lists.offsets.to_numpy(), 0
        while at < len(lists):
            end = max(int(np.searchsorted(offsets, offsets[at] + PIECE_ITEMS, "right")) - 1, at + 1)
            yield lists.slice(at, end - at)
            at = end
        del lists, offsets
        pa.default_memory_pool().release_unused()
