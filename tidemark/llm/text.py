"""Words and word shingles of whole Arrow batches as NumPy arrays of 64-bit hashes.

Texts are worked on as UTF-8 bytes, some hundred KB at a time, without a Python
loop over words. Separators are the ASCII white space characters; A-Z is
lower-cased. Hashes are fixed functions of the bytes, equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes of text worked on at once; a longer single text is a chunk of its own
CHUNK_BYTES = 512 << 10


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.ChunkedArray | pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets of the rows in them), each of about ``chunk_bytes``; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        yield slice(lo, hi), data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; the spans follow each other up to the end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, length)
    power = np.full(int(length.max()), _STEP)
    power[0] = 1
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(_BYTE[data] * power[place], starts)
    return mix(h + length.astype(np.uint64) * _PLACE[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each text's first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = word[at]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    letters = (_LOWER[data] if lower else data)[word]
    return span_hashes(letters, np.cumsum(word)[starts] - 1), first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and the index of each text's first one.

    A text with fewer than ``width`` words has its whole sequence as its only
    shingle; one without words has none.
    """
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    lone = np.array([
        (hashes[first[d]: first[d + 1]] * _PLACE[1: 1 + count[d]]).sum(dtype=np.uint64) + np.uint64(count[d]) for d in short
    ], dtype=np.uint64)
    long = np.flatnonzero(count >= width)
    n = count[long] - width + 1
    begin = np.repeat(first[:-1][long], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(begin), np.uint64)
    for j in range(width):
        h += hashes[begin + j] * _PLACE[1 + j]
    h += np.uint64(width)
    doc = np.concatenate([np.repeat(long, n), short])
    h = mix(np.concatenate([h, lone]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(first)))


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Arrow lists of signed 64-bit values from flat values and first indexes."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
