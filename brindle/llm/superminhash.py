"""SuperMinHash signatures of many sets at once.

Each element runs through a pseudo-random permutation of the m components; its
j-th step offers the value j + fraction to the component at place j.  A
component keeps its least offer.  Offers of step j exceed all of earlier steps,
so a set is done once every component has an offer: after one step for large
sets, after at most m for the smallest.
"""

from __future__ import annotations

import numpy as np

from .textops import U64, mix

EMPTY = np.iinfo(np.uint64).max
#: Elements whose permutations are held at a time.
ELEMENTS = 1 << 16


def _step(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place from j to m - 1, value) of each element's step j."""
    x = mix(elements + U64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
    return (((x >> U64(32)) * U64(m - j)) >> U64(32)).astype(np.int64) + j, (x & U64(0xFFFFFFFF)) | U64(j << 32)


def signatures(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(sets, m) values; set i has the distinct elements first[i]:first[i + 1].  Empty sets keep EMPTY."""
    sets = len(first) - 1
    out = np.full(sets * m, EMPTY, np.uint64)
    place, value = _step(elements, 0, m)
    owner = np.repeat(np.arange(sets), np.diff(first))
    np.minimum.at(out, owner * m + place, value)
    out = out.reshape(sets, m)
    todo = np.flatnonzero((out == EMPTY).any(axis=1) & (np.diff(first) > 0))
    sizes = np.diff(first)[todo]
    begin = 0
    while begin < len(todo):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), ELEMENTS, side="right")))
        rows = todo[begin:end]
        take = np.concatenate([np.arange(first[i], first[i + 1]) for i in rows])
        out[rows] = _finish(elements[take], np.repeat(np.arange(len(rows)), sizes[begin:end]), place[take], out[rows], m)
        begin = end
    return out


def _finish(elements: np.ndarray, owner: np.ndarray, place: np.ndarray, out: np.ndarray, m: int) -> np.ndarray:
    """Steps from the second on, for the sets that still have components without an offer."""
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(elements), 1))
    row = np.arange(len(elements))
    order[row, place] = 0  # the swap of the first step; place 0 itself isn't read again
    flat = out.reshape(-1).copy()
    for j in range(1, m):
        open_sets = (flat.reshape(out.shape) == EMPTY).any(axis=1)
        if not open_sets.any():
            break
        live = open_sets[owner]
        if live.sum() < 0.7 * len(live):
            elements, owner, order = elements[live], owner[live], order[live]
            row = np.arange(len(elements))
        place, value = _step(elements, j, m)
        component = order[row, place].astype(np.int64)
        order[row, place] = order[:, j]
        np.minimum.at(flat, owner * m + component, value)
    return flat.reshape(out.shape)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of runs of ``rows`` components; a band's number is part of its key."""
    parts = values[:, : bands * rows].reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(values), bands)) + U64(1)
    for i in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key
