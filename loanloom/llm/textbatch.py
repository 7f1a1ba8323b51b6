"""Vectorised views of Arrow string columns: whole texts as one byte buffer, word boundaries and 64-bit
word hashes as numpy arrays. Texts are cut into blocks of about BLOCK bytes at document boundaries,
so that memory does not grow with the batch; one longer document is a block of its own."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For words without punctuation: all but ASCII letters, digits and bytes of longer code points.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (one more than there are texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8).copy()
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    whole = whole[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of blocks of whole texts."""
    whole, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        last = min(last, n)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about size bytes at most, for what makes Python objects of each; a
    longer row is a batch of its own. Column 1 holds what is long."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Gives back to the system what a worker holds between tasks: workers are used again, and an executor's
    memory would hold the largest needs of all stages at once."""
    del _powers[:]
    _powers.extend((np.ones(1, np.uint64), np.ones(1, np.uint64)))
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, with what it held given back once its partition or group is done."""

    def whole(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            release()

    return whole


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without gap bytes, none across texts), and for each text the
    number of the first word (one more than there are texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~gap[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[(inner > 0) & (inner <= n)] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2^64, from which span_hashes reads any span."""
    powers, _ = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, inverse = _tables(len(sums) - 1)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text the number of its first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = words(data, offsets, gap)
    return span_hashes(prefix(data), starts, ends), first


def joined(hashes: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """For each place, one hash of the hashes at the given steps from it, in their order; places whose
    last step would fall outside are left out."""
    n = len(hashes) - steps[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x1F83D9ABFB41BD6B, np.uint64)
    for step in steps:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + hashes[step : step + n]
    return mixed(out)
