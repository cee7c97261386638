"""NumPy primitives over the UTF-8 buffers of Arrow string columns.

All functions work on one flat byte array holding many documents plus the
offsets between them, so a batch costs a handful of vector passes whatever the
number of documents.  Nulls count as empty texts here; callers that care keep
the validity mask themselves.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vector pass works on (a longer document goes alone).
CHUNK_BYTES = 1 << 20

_MIX1, _MIX2, _ODD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 12), _ODD, dtype=U64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=U64)
    return _POWERS[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def trim() -> None:
    """Give free memory back to the system: a Python worker lives on after its task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    at = utf8(batch.column(column))[1]
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
    trim()


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; runs stop at document ends."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _lane(every: np.ndarray, at: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, or ``size`` if these are fewer, mixed."""
    drop = np.clip(8 - size, 0, 7).astype(U64) << U64(3)
    return mix(mix(((every[at] << drop) >> drop) ^ salt) + salt)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run, none of which is empty; other seeds give independent ones.

    Every eight bytes go through ``mix``, with their place, before they are added up: sums of plain multiples would be
    equal for runs that are easy to construct.
    """
    if not len(starts):
        return np.empty(0, U64)
    salts = lambda place: mix((place.astype(U64) + U64(1)) * _ODD + U64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1))
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    every = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    first = salts(np.arange(4))
    total = _lane(every, starts, size, first[0])
    for k in range(1, 4):
        more = np.flatnonzero(size > 8 * k)
        if not len(more):
            break
        total[more] += _lane(every, starts[more] + 8 * k, size[more] - 8 * k, first[k])
    if len(more := np.flatnonzero(size > 32)):
        count = (size[more] + 7 >> 3) - 4
        begin = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(begin, count) + 4
        total[more] += np.add.reduceat(_lane(every, np.repeat(starts[more], count) + 8 * place, np.repeat(size[more], count) - 8 * place, salts(place)), begin)
    return mix(total + mix(size.astype(U64) + first[0]))


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with A-Z lowered, the first word of each document (n + 1 values), byte starts and ends.

    ``in_word`` is a table of 256 booleans on the lowered bytes.
    """
    low = ASCII_LOWER[raw]
    starts, ends = runs(in_word[low], at)
    return run_hashes(low, starts, ends), np.searchsorted(starts, at), starts, ends


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of k words inside a document."""
    n = len(hashes)
    if n < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    total = np.zeros(n - k + 1, U64)
    for i, p in enumerate(powers(k + 1)[1:]):
        total += hashes[i : n - k + 1 + i] * p
    owner_end = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    keep = np.flatnonzero(np.arange(n - k + 1) + k <= owner_end)
    return mix(total[keep]), keep


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the offsets of items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
