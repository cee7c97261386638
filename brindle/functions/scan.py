"""Byte scanners over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that white space and punctuation but for the apostrophe have in ASCII.
CUTS = np.zeros(256, bool)
CUTS[list(b"\t\n\v\f\r !\"#%&()*,-./:;?@[\\]_{}")] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def parts(column: pa.Array, cuts: np.ndarray = CUTS) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the runs of other bytes of all texts, in order, the text that each is in)."""
    raw, at = buffers(column)
    inside = ~cuts[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # runs end where texts do
    start = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))) if len(raw) else inside
    first = np.flatnonzero(start)
    place = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.append(place[first], place[-1]).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return runs.dictionary_encode(), np.searchsorted(at, first, side="right") - 1
