"""Levenshtein distances within limits, of one pair of texts or of many at once.

The columns of the table are the bits of integers (Myers 1999, Hyyrö 2003).  Of one pair these are Python's long
integers; of many pairs, words of 64 rows in NumPy arrays, so that a step costs a few vector passes for all words of
all pairs.
Both give up on a pair once no cell of a column can lead to a small enough distance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .textops import U64

#: Characters between two looks at whether an edit distance can still be small enough.
STRETCH = 48
#: Fewer pairs than so many together are compared one by one.
FEW = 12
#: Pairs that are worked on together have about so many words of 64 characters, and so many masks (words by different characters).
WORDS_AT_ONCE, MASKS_AT_ONCE = 1 << 13, 1 << 22


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a[:1] != b[:1]:
        return 0
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """The Levenshtein distance if it is at most limit: one column of the table at a time, as the bits of two integers.

    A few columns are looked at as a whole, so that most pairs of unlike texts end early.
    """
    n = _common(a, b)
    a, b = a[n:][::-1], b[n:][::-1]
    n = _common(a, b)
    a, b = sorted((a[n:], b[n:]), key=len)
    if len(b) - len(a) > limit:
        return None
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, cost, left = every, 0, len(a), len(b)
    step = max(STRETCH, -(-len(b) // 16))
    for begin in range(0, len(b), step):
        for c in b[begin : begin + step]:
            same = places.get(c, 0)
            down = same | less
            across = ((same & more) + more ^ more) | same
            up, low = less | (every & ~(across | more)), more & across
            left -= 1
            if up & last:
                cost += 1
            elif low & last:
                cost -= 1
            if cost - left > limit:
                return None
            up, low = up << 1 | 1, low << 1
            more, less = (low | ~(down | up)) & every, up & down & every
        if left and _least_cost(more, less, len(a), len(b) - left, left) > limit:
            return None
    return cost if cost <= limit else None


def _least_cost(more: int, less: int, rows: int, column: int, left: int) -> int:
    """The least distance that any cell of a column of the table can still lead to."""
    bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-rows // 8), "little"), np.uint8), count=rows, bitorder="little") for x in (more, less)]
    cells = np.concatenate(([column], column + np.cumsum(bits[0].astype(np.int64) - bits[1])))
    return int((cells + np.abs(rows - np.arange(rows + 1) - left)).min())


def _flat(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many of the n characters from at and bt on (backwards for step -1) are equal without a break; looked at in ever longer stretches."""
    out, open_, stretch = np.zeros(len(n), np.int64), np.flatnonzero(n > 0), 16
    while len(open_):
        from_, m = out[open_], np.minimum(n[open_] - out[open_], stretch)
        total = np.cumsum(m)
        place = np.arange(int(total[-1])) - np.repeat(total - m - from_, m)
        wrong = np.flatnonzero(a[np.repeat(at[open_], m) + step * place] != b[np.repeat(bt[open_], m) + step * place])
        first = np.append(wrong, int(total[-1]))[np.searchsorted(wrong, total - m)]
        equal = np.minimum(first - (total - m), m)
        out[open_] += equal
        open_, stretch = open_[(equal == m) & (out[open_] < n[open_])], 4 * stretch
    return out


def within(xs: Sequence[str], ys: Sequence[str], limits: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair is at most its limit."""
    if not len(xs):
        return np.zeros(0, bool)
    a, at = _flat([min(x, y, key=len) for x, y in zip(xs, ys)])
    b, bt = _flat([y if len(x) <= len(y) else x for x, y in zip(xs, ys)])
    limits, n, m = np.asarray(limits, np.int64), np.diff(at), np.diff(bt)
    head = _same(a, at[:-1], b, bt[:-1], n, 1)
    tail = _same(a, at[1:] - 1, b, bt[1:] - 1, n - head, -1)
    n, m = n - head - tail, m - head - tail
    out = (m - n <= limits) & (m <= limits)  # of two texts with nothing in common the distance is at most the longer length
    open_ = np.flatnonzero((m - n <= limits) & ~out & (n > 0))
    open_ = open_[np.argsort(m[open_], kind="stable")]
    before = np.concatenate(([0], np.cumsum((n[open_] + 63) // 64)))
    begin = 0
    while begin < len(open_):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + WORDS_AT_ONCE, side="right")) - 1)
        p = open_[begin:end]
        if len(p) < FEW:
            out[p] = [edit_distance_within(xs[i], ys[i], int(limits[i])) is not None for i in p.tolist()]
        else:
            out[p] = _within(a, at[p] + head[p], n[p], b, bt[p] + head[p], m[p], limits[p])
        begin = end
    return out


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at[i], at[i] + 1, ... of n[i] each."""
    return np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)


def _within(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """``within`` for texts a of n and b of m characters (0 < n <= m) from at and bt on.

    The words of all pairs, whatever their number, lie in one array.  In each step every word is one column behind the
    word above it, so its character and the carries are what that word had in the step before.
    """
    a, b = a[_ranges(at, n)], b[_ranges(bt, m)]
    seen = np.zeros(int(max(a.max(), b.max())) + 1, bool)
    seen[a] = True
    letters = np.cumsum(seen)  # from 1 on; what a doesn't have is 0
    kinds, width = int(letters[-1]) + 1, (n + 63) // 64
    if len(n) > 1 and kinds * int(width.sum()) > MASKS_AT_ONCE:
        half, cut_a, cut_b = len(n) // 2, np.cumsum(n) - n, np.cumsum(m) - m
        return np.concatenate([_within(a, cut_a[s], n[s], b, cut_b[s], m[s], limits[s]) for s in (slice(half), slice(half, None))])
    base = kinds * (np.cumsum(width) - width)  # of the masks of a pair, kind by kind
    masks = np.zeros(kinds * int(width.sum()), U64)
    row = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    np.bitwise_or.at(masks, np.repeat(base, n) + letters[a] * np.repeat(width, n) + (row >> 6), U64(1) << (row & 63).astype(U64))
    kind = np.where(seen[b], letters[b], 0)
    codes = np.insert(np.repeat(base, m) + kind * np.repeat(width, m), np.cumsum(m), base)  # behind each text one more place, which matches nothing
    code_at = np.cumsum(m + 1) - (m + 1)
    out, live = np.zeros(len(n), bool), np.arange(len(n))
    cells = int(width.sum())
    word = np.arange(cells) - np.repeat(np.cumsum(width) - width, width)
    place = np.repeat(base, width) + word  # of the mask of each word's character, no character at first
    more, less = np.full(cells, U64(0xFFFFFFFFFFFFFFFF)), np.zeros(cells, U64)
    plus, minus, end_more, end_less = (np.zeros(cells, U64) for _ in range(4))
    t = 0
    while len(live):
        first, last = np.cumsum(width) - width, np.repeat(m, width) - 1 + word  # the step in which a word has its last column
        final = np.flatnonzero((last >= t) & (last < t + STRETCH))
        final = final[np.argsort(last[final], kind="stable")]
        cuts = np.searchsorted(last[final], np.arange(t, t + STRETCH + 1))
        same, down, across, up, low, came_plus, came_minus = (np.empty(len(word), U64) for _ in range(7))
        came = np.empty(len(word), np.int64)
        for k in range(STRETCH):
            np.add(place[:-1], 1, out=came[1:])
            came[first] = codes[code_at + np.minimum(t + k, m)]
            place, came = came, place
            came_plus[1:], came_minus[1:] = plus[:-1], minus[:-1]
            came_plus[first], came_minus[first] = 1, 0
            np.take(masks, place, out=same, mode="clip")
            np.bitwise_or(same, less, out=down)
            np.bitwise_or(same, came_minus, out=same)
            np.bitwise_and(same, more, out=across)
            np.add(across, more, out=across)
            np.bitwise_xor(across, more, out=across)
            np.bitwise_or(across, same, out=across)
            np.bitwise_or(across, more, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, less, out=up)
            np.bitwise_and(more, across, out=low)
            np.right_shift(up, U64(63), out=plus)
            np.right_shift(low, U64(63), out=minus)
            np.left_shift(up, U64(1), out=up)
            np.bitwise_or(up, came_plus, out=up)
            np.left_shift(low, U64(1), out=low)
            np.bitwise_or(low, came_minus, out=low)
            np.bitwise_or(down, up, out=more)
            np.invert(more, out=more)
            np.bitwise_or(more, low, out=more)
            np.bitwise_and(up, down, out=less)
            if cuts[k] < cuts[k + 1]:
                done = final[cuts[k] : cuts[k + 1]]
                end_more[done], end_less[done] = more[done], less[done]
        t += STRETCH
        ended = m + width - 1 <= t
        if ended.any():
            rows = np.clip(np.repeat(n, width) - 64 * word, 0, 64)
            valid = U64(0xFFFFFFFFFFFFFFFF) >> (64 - rows).astype(U64)
            steps = np.bitwise_count(end_more & valid).astype(np.int64) - np.bitwise_count(end_less & valid)
            distance = m + np.add.reduceat(steps, first)
            out[live[ended]] = distance[ended] <= limits[live[ended]]
        keep = ~ended & ((t >= m) | (_least(more, less, plus, minus, word, first, width, n, m, t) <= limits[live]))
        if not keep.all():
            cell = np.repeat(keep, width)
            word, place, more, less, plus, minus, end_more, end_less = (x[cell] for x in (word, place, more, less, plus, minus, end_more, end_less))
            live, width, n, m, code_at = (x[keep] for x in (live, width, n, m, code_at))
    return out


def _least(more: np.ndarray, less: np.ndarray, plus: np.ndarray, minus: np.ndarray, word: np.ndarray, first: np.ndarray, width: np.ndarray, n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """A bound of the distance of each pair: the least that any cell can lead to in which a path leaves what is done after t steps.

    Every eighth row is looked at.  From row to row what a cell leads to changes by 2 at most, so no row between is lower by over 8.
    """
    rises = np.bitwise_count(more.view(np.uint8)).astype(np.int16) - np.bitwise_count(less.view(np.uint8))
    rises = np.cumsum(rises.reshape(-1, 8), axis=1, dtype=np.int32)
    change = rises[:, 7] - plus.astype(np.int32) + minus.astype(np.int32)  # from the top of a word to that of the next one, a column before
    tops = np.cumsum(change) - change
    tops += np.repeat(t - tops[first], width)
    column, row = np.maximum(t - word, 0), 64 * word
    wide, long = np.repeat(n, width), np.repeat(m, width)
    lead = (wide - row) - (long - column)
    best = tops + np.abs(lead)
    for k in range(8):
        cell = tops + rises[:, k] + np.abs(lead - 8 * (k + 1))
        best = np.where(row + 8 * k < wide, np.minimum(best, cell), best)
    return np.minimum.reduceat(best, first) - 8


def similar_texts(xs: Sequence[str], ys: Sequence[str], similarity: int) -> np.ndarray:
    """Which pairs have an edit similarity of at least ``similarity`` percent."""
    return within(xs, ys, np.array([(100 - similarity) * max(len(x), len(y)) // 100 for x, y in zip(xs, ys)], np.int64))
