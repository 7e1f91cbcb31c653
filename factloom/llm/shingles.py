"""Word shingles of whole texts as 64-bit numbers, without a Python loop over
words.

Words are runs of bytes that are not ASCII white space, A-Z in lower case.  A
word's number is a polynomial hash of its bytes (each byte first replaced by a
random 64-bit number), taken for all words at once as differences of a running
sum; a shingle's number mixes the numbers of its words.  Two different shingles
share a number with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
SLICE = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_numbers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts that end at ``ends`` in ``data``, and how
    many words there are up to each end."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends[ends <= len(data)]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(data))
    numbers = _mix((running[stop] - running[start]) * back[start] + (stop - start).astype(np.uint64))
    return numbers, np.searchsorted(start, ends, side="left")


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text; a text of fewer words has its
    whole sequence as one, a text without words none."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        base = offsets[first]
        numbers, upto = word_numbers(data[base:offsets[last]], (offsets[first + 1:last + 1] - base).astype(np.int64))
        rolled = numbers[:max(0, len(numbers) - width + 1)].copy()
        for i in range(1, width):
            rolled = _mix(rolled * np.uint64(3) + numbers[i:i + len(rolled)])
        begin = 0
        for end in upto.tolist():
            if end - begin >= width:
                yield np.unique(rolled[begin:end - width + 1])
            elif end > begin:
                whole = np.array([end - begin], np.uint64)
                for i in range(begin, end):
                    whole = _mix(whole * np.uint64(5) + numbers[i:i + 1])
                yield whole
            else:
                yield np.empty(0, np.uint64)
            begin = end
        first = last
