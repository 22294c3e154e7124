"""Word and shingle hashes of Arrow batches, vectorised over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets) of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        low, high = offsets[first], offsets[end]
        yield first, end, data[low:high], offsets[first : end + 1] - low
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words start (n + 1 numbers)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    heads = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    values = _TABLE[data[at]] * powers[place]
    hashes = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(at[heads], offsets)


def shingle_sets(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words. A text of fewer words, but
    not none, has its whole sequence as its only shingle."""
    factors = (2 * np.arange(size, dtype=np.uint64) + np.uint64(1)) * _BASE
    n = len(words) - size + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for i, factor in enumerate(factors):
        whole += words[i : i + n] * factor if n > 0 else 0
    whole = mix(whole)
    out = []
    for low, high in zip(starts[:-1], starts[1:]):
        if high - low >= size:
            out.append(np.unique(whole[low : high - size + 1]))
        elif high > low:
            part = words[low:high] * factors[: high - low]
            out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(high - low)))
        else:
            out.append(whole[:0])
    return out
