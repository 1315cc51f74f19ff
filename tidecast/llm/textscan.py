"""Vectorised scanning of text columns: words, and names of words and of runs of them, of Arrow batches in numpy.

Names are 64-bit hashes.  A word is hashed eight bytes at a time and mixed after each; runs of a fixed length are named by
doubling, two names of a length giving one of twice the length, mixed again.  No name is a sum of terms of its items, so that
no pattern of a few items can make such a sum vanish.  Everything here is a pure function of the text: tasks that are run
again give the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 256
BYTE_BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: Python workers are used again by later stages."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two names in a row."""
    return mix(left * _LEFT + right * _RIGHT)


def run_names(items: np.ndarray, length: int, have: int = 1) -> np.ndarray:
    """Names of all runs of length items, by their starts; items are names of runs of have (length >= have)."""
    got = items
    while 2 * have <= length:
        got, have = join(got[:-have], got[have:]), 2 * have
    rest = length - have
    return join(got[:-rest], got[rest:]) if rest else got


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end) as one integer, for each byte and the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            got = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
        _powers[base] = got
    return got


class Texts:
    """Some whole texts side by side: one byte array, with the byte range of each text."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def __len__(self) -> int:
        return len(self.ids)

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (one more entry than texts)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        gap = separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = edge[:-1].copy()
        before[1:] |= gap[:-1]
        after = edge[1:].copy()
        after[:-1] |= gap[1:]
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        data = FOLD[self.data] if fold else self.data
        eight, size = eights(data), ends - starts
        out = mix((eight[starts] & MASK[np.minimum(size, 8)]) * _LEFT + size.astype(np.uint64))
        more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            out[more] = join(out[more], mix(eight[starts[more] + done] & MASK[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def byte_sums(self) -> np.ndarray:
        up, _ = powers(BYTE_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hashes of the runs [start, end) from prefix sums."""
    _, down = powers(base, len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, counts)


def byte_names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of length bytes, by their starts."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    eight = eights(data)[: len(data) - min(length, 8) + 1]
    return mix(eight & MASK[length]) if length < 8 else run_names(mix(np.array(eight)), length, 8)


def slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes [begin, end) of each, as a binary array."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ranges(begin, size)].tobytes())])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(batch: pa.RecordBatch, limit: int = CHUNK, id_column: int = 0, text_column: int = 1) -> Iterator[tuple[slice, Texts]]:
    """The texts of a batch in runs of about limit bytes (a longer text is a run of its own)."""
    ids = batch.column(id_column).to_numpy(zero_copy_only=False)
    data, offsets = column_bytes(batch.column(text_column))
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield slice(at, to), Texts(ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
