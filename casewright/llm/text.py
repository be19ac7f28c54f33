"""Words of the whole texts of an Arrow batch, as numpy arrays over the batch's bytes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def released(run: Callable) -> Callable:
    """``run`` over a task's batches; a worker then gives back the memory that it has freed.

    Workers live on from one task to the next, and a later task may be of another kind.
    """

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    """Give back the memory that this worker has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def powers(n: int, factor: int = _FACTOR) -> np.ndarray:
    """factor ** 0 .. factor ** (n - 1) modulo 2 ** 64."""
    steps = np.full(max(n, 1), factor, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = powers(max(n, 4096))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offset of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and last row, bytes, offsets.

    A text longer than the limit is a run of its own; no text is cut.
    """
    data, offsets = raw(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run never leaves its text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges], last[edges - 1] = True, True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of the text that each start lies in."""
    return np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of anything but ASCII white space."""
    return runs(~SPACE[data], offsets)


def prefix_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial sums over the bytes of the given spans, packed without gaps.

    Returns the sums (one more than bytes) and each span's first place in them, so the hash
    of a span's first k bytes is ``sums[at + k] - sums[at]``.
    """
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    within = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    values = data[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)
    sums = np.zeros(at[-1] + 1, np.uint64)
    np.cumsum(values * _table(int(lengths.max(initial=0)) + 1)[within], out=sums[1:])
    return sums, at


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    sums, at = prefix_hash(data, starts, ends)
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ (ends - starts).astype(np.uint64))


def window_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive values: one rolling polynomial modulo 2 ** 64."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    inverse = pow(_FACTOR, -1, 1 << 64)
    rolled = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=rolled[1:])
    return mix((rolled[n:] - rolled[:-n]) * powers(len(values) - n + 1, inverse))
