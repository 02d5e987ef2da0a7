"""Dictionary-coded blocks: what a run of documents shares is listed once, and documents hold positions in that list.

A pass over the documents cuts them into blocks of bounded text. A block lists its distinct entries (words, windows);
each document of it keeps the positions of its entries, compressed. Entries are then worked on once for all blocks,
and results go back to a block by position, so that no occurrence is ever shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import zstandard
from pyspark import TaskContext

_PACK = {level: zstandard.ZstdCompressor(level=level) for level in (3, 9)}
_UNPACK = zstandard.ZstdDecompressor()


def numbering() -> defaultdict:
    """A dictionary that numbers its keys as they are first looked up."""
    return defaultdict(count().__next__)


def block_number(index: int) -> int:
    """The number of the ``index``-th block of the running task, unique in its stage."""
    return TaskContext.get().partitionId() << 32 | index


def squeezed(data: bytes, level: int = 3) -> bytes:
    return _PACK[level].compress(data)


def stretched(data: bytes) -> bytes:
    return _UNPACK.decompress(data)


def packed(numbers, level: int = 3) -> bytes:
    """Non-negative integers below 2**32, byte plane by byte plane, compressed."""
    planes = np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return squeezed(np.ascontiguousarray(planes).tobytes(), level)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(stretched(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
