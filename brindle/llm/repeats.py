"""Repeated passages by common-prefix intervals of enhanced suffix arrays.

Any two equal strings of ``length`` bytes contain the same anchor at the same
place: the least hash among their K-grams.  So the corpus is cut by anchors.

1. Texts are written once, as chunks of about 2 MB.  Each chunk names its
   distinct anchors; those that only one document of the corpus has are done.
2. For the others, each run of window starts that share an anchor gives a
   context: its bytes from the first window to the end of the last.  Equal
   contexts of a chunk are sent once, with all their places, to the bucket of
   the anchor.  An anchor with more than ``hot`` places sends its windows one by
   one instead, each to the bucket of its own hash, so that no bucket gathers
   all surroundings of a very common passage.
3. A bucket takes its contexts by ranges of anchors, about ``SLICE_BYTES`` at a
   time, builds an enhanced suffix array (suffixes, common prefix lengths, left
   neighbours) of the windows that occur more than once, scans it with a stack
   into the tree of common-prefix intervals, and drops intervals whose
   occurrences all have the same byte to the left: they are inside longer ones.
   What is left are maximal repeats with all their occurrences.
4. Places go back to their chunks.

A repeat longer than a context comes out in overlapping pieces, each with its
own occurrences; together they cover it.

Nulls: a null text is empty; a row with a null id is neither compared nor cut.
Rows that repeat an id are parts of one document: they don't remove each other.
Texts of any length are read whole.  Extra columns are ignored, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64, mix, owners, pieces, run_hashes, runs, trim, utf8
from .workspace import Workspace

LENGTH = 50
K = 16
#: Places of an anchor, beyond which its windows are sent one by one.
HOT_PLACES = 20_000
#: Bytes of contexts for one suffix array.
SLICE_BYTES = 1 << 20
#: Bytes of text in a chunk, and for each bucket.
CHUNK_TEXT, BUCKET_BYTES = 2 << 20, 16 << 20
MIN_BUCKETS = 4

_HIGH = U64(0xFFFFFFFF00000000)


#: Chunks and contexts are most of what this operator shuffles; a stronger level is worth its time.
_CODEC = pa.Codec("zstd", compression_level=5)


def _packed(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(_CODEC.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True))


# ---- anchors and contexts ---------------------------------------------------------------------------


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes, by doubling."""
    total, have, parts, n = raw.astype(U64) + U64(1), 1, [], size
    while n:
        if n & 1:
            parts.append((have, total))
        n >>= 1
        if n:
            factor = U64(pow(0x9E3779B97F4A7C15, have, 1 << 64))
            total = total[: len(total) - have] * factor + total[have:] if len(total) > have else total[:0]
            have *= 2
    out, at = None, 0
    for have, part in parts:
        piece = part[at : at + len(raw) - size + 1]
        out = piece.copy() if out is None else out * U64(pow(0x9E3779B97F4A7C15, have, 1 << 64)) + piece
        at += have
    return mix(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    have = 1
    now = values
    while 2 * have <= size:
        now = np.minimum(now[: len(now) - have], now[have:])
        have *= 2
    n = len(values) - size + 1
    return np.minimum(now[:n], now[size - have : size - have + n])


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window start, last window start, anchor hash) of each run of windows with one anchor."""
    n = len(raw) - length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, np.empty(0, U64)
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(start):
        return none, none, none, np.empty(0, U64)
    hashes = rolling(raw, k)
    least = sliding_min((hashes & _HIGH) | np.arange(len(hashes), dtype=U64), length - k + 1)
    place = (least[start] & ~_HIGH).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    # hashes of minima are small ones; mixed again they are even
    return np.searchsorted(at, first, side="right") - 1, first, last, mix(hashes[place[cut]] ^ U64(0xA0761D6478BD642F))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted hashes have sorted buckets."""
    return (((hashes >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


CHUNK_SCHEMA = "chunk long, doc_ids array<bigint>, sizes array<bigint>, body binary"


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (p for b in batches for p in pieces(b, limit=CHUNK_TEXT)):
            raw, at = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(at)], pa.list_(pa.int64())), pa.array([_packed(raw)], pa.binary())], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])
            number += 1

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def _opened(doc_ids: pa.Scalar, sizes: pa.Scalar, body: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(np.array(sizes.as_py(), np.int64))))
    return np.array(doc_ids.as_py(), np.int64), at, _unpacked(body.as_py())[0]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, first of each in the order, order)."""
    order = np.argsort(hashes, kind="stable")
    found = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.empty(0, np.int64)
    return found[first], first, order


PART_SCHEMA = "bucket int, chunk long, part binary"


def _named(chunks: DataFrame, length: int, buckets: int) -> DataFrame:
    """The distinct anchors of each chunk by bucket; with each, twice the number of its places there and whether two documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, at, raw = _opened(*(batch.column(k)[i] for k in (1, 2, 3)))
                doc, _, _, hashes = anchors(raw, at, length)
                known, first, order = _distinct(hashes)
                last = np.append(first[1:], len(order)) - 1
                several = doc[order[first]] != doc[order[last]] if len(known) else np.empty(0, bool)
                many = ((last - first + 1) * 2 + several).astype(np.uint32)
                cuts = np.searchsorted(_bucket(known, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                parts = [_packed(known[a:b].byteswap().view(np.uint8).reshape(-1, 8)[:, :6], many[a:b]) for a, b in zip(cuts[some], cuts[some + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(some), pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "chunk", "part"])

    return chunks.mapInArrow(run, PART_SCHEMA)


def _flagged(hot: int, within: bool):
    """For each part, which anchors are in several documents (1) or have very many places (2); ``within`` one document counts too."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("part").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.concatenate([p[0] for p in parts])
        many = np.concatenate([p[1] for p in parts])
        _, first, order = _distinct(wide.view(">u8").ravel().astype(U64))
        count = np.diff(np.append(first, len(order)))
        several = (count > 1) | (np.maximum.reduceat(many[order] & 1, first) > 0)
        places = np.add.reduceat((many[order] >> 1).astype(np.int64), first)
        several |= within & (places > 1)
        flag = np.where(several & (places > hot), 2, several).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(flag, count)
        cuts = np.cumsum([0, *sizes])
        trim()
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "part": pa.array([_packed(out[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return run


def _contexts(length: int, buckets: int):
    """Contexts of a chunk's shared anchors by bucket, with all their places."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "part": pa.array([], pa.binary())})
        if not right.num_rows or not left.num_rows:
            return empty
        ids, at, raw = _opened(*(left.column(k)[0] for k in ("doc_ids", "sizes", "body")))
        doc, first, last, hashes = anchors(raw, at, length)
        by = sorted(zip(right.column("bucket").to_pylist(), right.column("part").to_pylist()))
        known, begin, order = _distinct(hashes)
        flag = np.empty(len(order), np.uint8)
        flag[order] = np.repeat(np.concatenate([_unpacked(p)[0] for _, p in by]), np.diff(np.append(begin, len(order))))
        keep = np.flatnonzero(flag == 1)
        doc_of, start, end, key = doc[keep], first[keep], last[keep] + length, hashes[keep]
        if len(very := np.flatnonzero(flag == 2)):
            n = last[very] - first[very] + 1
            one = np.repeat(first[very] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            doc_of, start, end = np.concatenate((doc_of, np.repeat(doc[very], n))), np.concatenate((start, one)), np.concatenate((end, one + length))
            key = np.concatenate((key, rolling(raw, length)[one]))
        if not len(start):
            return empty
        same, begin, order = _distinct(mix(run_hashes(raw, start, end) ^ key))
        head = order[begin]  # an occurrence of each distinct context
        count = np.diff(np.append(begin, len(order)))
        group = np.argsort(_bucket(key[head], buckets), kind="stable")
        cuts = np.searchsorted(_bucket(key[head], buckets)[group], np.arange(buckets + 1))
        out, parts = np.flatnonzero(np.diff(cuts)), []
        for b in out.tolist():
            mine = group[cuts[b] : cuts[b + 1]]
            size = end[head[mine]] - start[head[mine]]
            body = raw[np.repeat(start[head[mine]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            n = count[mine]
            places = order[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            parts.append(_packed((key[head[mine]] & U64(0xFFFF)).astype(np.uint16), size.astype(np.uint32), body, n.astype(np.uint32), ids[doc_of[places]], doc_of[places].astype(np.uint32), (start[places] - at[doc_of[places]]).astype(np.int64)))
        trim()
        return pa.table({"bucket": pa.array(out, pa.int32()), "chunk": pa.array([left.column("chunk")[0].as_py()] * len(out), pa.int64()), "part": pa.array(parts, pa.binary())})

    return run


# ---- suffix arrays and intervals ----------------------------------------------------------------------


class SuffixArray:
    """The enhanced suffix array of those suffixes of many short strings that share ``length`` bytes or more and can begin a maximal repeat."""

    def __init__(self, body: np.ndarray, size: np.ndarray, length: int):
        at = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
        string = owners(at)
        room = at[string + 1] - np.arange(len(body))
        start = np.flatnonzero(room >= length)
        if len(start):
            _, first, order = _distinct(rolling(body, length)[start])
            left = self._left(body, start, at, string)[order]
            count = np.diff(np.append(first, len(order)))
            low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
            # windows with one byte to their left everywhere are inside longer repeats
            start = np.sort(start[order[np.repeat((count > 1) & ((low != high) | (low == -1)), count)]])
        wide = -(-int(size.max(initial=length)) // 8) * 8
        padded = np.concatenate((body, np.zeros(wide, np.uint8)))
        text = sliding_window_view(padded, wide)[start]
        text *= np.arange(wide)[None, :] < room[start][:, None]
        words = text.view(">u8").astype(U64)
        order = np.lexsort(words.T[::-1])
        text, start = text[order], start[order]
        self.start, self.string = start, string[start]
        self.offset, self.room = start - at[self.string], room[start]
        self.left = self._left(body, start, at, string)
        #: Common prefix with the suffix before; 0 for the first.
        self.common = np.zeros(len(start), np.int64)
        if len(start) > 1:
            other = text[1:] != text[:-1]
            same = np.where(other.any(axis=1), other.argmax(axis=1), wide)
            self.common[1:] = np.minimum(same, np.minimum(self.room[1:], self.room[:-1]))

    @staticmethod
    def _left(body: np.ndarray, start: np.ndarray, at: np.ndarray, string: np.ndarray) -> np.ndarray:
        """The byte to the left of each suffix, or -1 where its string begins."""
        return np.where(start > at[string[start]], body[start - 1].astype(np.int64), -1) if len(start) else start


def intervals(common: list[int], left: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of at least ``length``, inner before outer, by one scan with a stack.

    Only those with more than one byte to the left, or with a string that
    begins there: others are parts of longer repeats.
    """
    stack: list[list] = []  # [common prefix, first suffix, the byte to the left or None if there are several]

    def joined(a, b):
        return a if a == b and a != -1 else None

    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        first, held = i - 1, left[i - 1] if left[i - 1] != -1 else None
        while stack and stack[-1][0] > now:
            depth, first, byte = stack.pop()
            held = joined(byte, held)
            if held is None:
                yield depth, first, i - 1
        if now >= length:
            if stack and stack[-1][0] == now:
                stack[-1][2] = joined(stack[-1][2], held)
            else:
                stack.append([now, first, held])


def _interval_groups(suffixes: SuffixArray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(common prefix, positions in the suffix array) of each interval of the tree."""
    begin = np.flatnonzero(suffixes.common < length)
    if not len(begin):
        return
    low, high = np.minimum.reduceat(suffixes.left, begin), np.maximum.reduceat(suffixes.left, begin)
    end = np.append(begin[1:], len(suffixes.common))
    several = np.flatnonzero((end - begin > 1) & ((low != high) | (low == -1)))
    for a, b in zip(begin[several].tolist(), end[several].tolist()):
        common = suffixes.common[a:b].tolist()
        common[0] = 0
        for depth, first, last in intervals(common, suffixes.left[a:b].tolist(), length):
            yield depth, np.arange(a + first, a + last + 1)


def _gathered(first: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Indices of the items of the groups first[i]:first[i + 1], for the groups in take."""
    n = first[take + 1] - first[take]
    return np.repeat(first[take] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Bucket:
    """Contexts with all their places, for a range of anchors."""

    def __init__(self, size, body, count, row, ids, doc, place, length: int):
        self.size, self.count, self.row, self.ids, self.doc, self.place, self.length = size, count, row, ids, doc, place, length
        self.first = np.concatenate(([0], np.cumsum(count.astype(np.int64))))
        self.least = np.minimum.reduceat(ids, self.first[:-1])
        self.suffixes = SuffixArray(body, size, length)

    @staticmethod
    def slices(table: pa.Table, length: int, limit: int) -> Iterator[Bucket]:
        """The contexts of a table in slices that keep equal anchors together; rows of the table are chunks."""
        parts = [_unpacked(x) for x in table.column("part").to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(p[4]) for p in parts])
        anchor, size, body, count, ids, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(7))
        del parts
        order = np.argsort(anchor, kind="stable")
        bytes_at, places_at = (np.concatenate(([0], np.cumsum(x.astype(np.int64)))) for x in (size, count))
        total, anchor = np.cumsum(size[order].astype(np.int64)), anchor[order]
        begin = 0
        while begin < len(order):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, side="right"))
            end = int(np.searchsorted(anchor, anchor[max(begin, min(end, len(order)) - 1)], side="right"))
            take = order[begin:end]
            which = _gathered(places_at, take)
            yield Bucket(size[take], body[_gathered(bytes_at, take)], count[take], row[which], ids[which], doc[which], place[which], length)
            begin = end

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, start, end) inside its context, of what a document with a smaller id has too."""
        owner = owners(self.first)
        whole = np.flatnonzero(self.ids > self.least[owner])  # an equal context of the same chunk
        out = [(whole, np.zeros(len(whole), np.int64), self.size[owner[whole]].astype(np.int64))]
        s, least = self.suffixes, self.least[self.suffixes.string]
        done = np.zeros(len(least), bool)
        at, to = [], []
        for depth, members in _interval_groups(s, self.length):
            if len(members) == 2:
                i, j = int(members[0]), int(members[1])
                if least[i] != least[j] and not done[k := i if least[i] > least[j] else j]:
                    done[k] = True
                    at.append(k), to.append(depth)
                continue
            later = members[(least[members] > least[members].min()) & ~done[members]]
            done[later] = True
            at.extend(later.tolist()), to.extend([depth] * len(later))
        string = s.string[at]
        n = self.count[string].astype(np.int64)
        places = np.repeat(self.first[string] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        starts = np.repeat(s.offset[at], n)
        ends = starts + np.repeat(np.array(to, np.int64), n)
        own = self.ids[places] == self.least[owner[places]]
        out.append((places[own], starts[own], ends[own]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _ranges(length: int, slice_bytes: int):
    """Places to remove, by chunk: (document in the chunk, start, end)."""

    def run(table: pa.Table) -> pa.Table:
        chunks, found = table.column("chunk").to_pylist(), []
        for bucket in Bucket.slices(table, length, slice_bytes):
            which, start, end = bucket.removed()
            found.append((bucket.row[which], bucket.doc[which], start + bucket.place[which], end + bucket.place[which]))
        row, doc, start, end = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, doc, row))
        trim()
        cuts = np.searchsorted(row[order], np.arange(len(chunks) + 1))
        some = np.flatnonzero(np.diff(cuts))
        parts = [_packed(*(x[order[cuts[r] : cuts[r + 1]]] for x in (doc, start, end))) for r in some.tolist()]
        return pa.table({"chunk": pa.array([chunks[r] for r in some.tolist()], pa.int64()), "part": pa.array(parts, pa.binary())})

    return run


GROUP_SCHEMA = "group_id long, length long, doc_id long, start long"


def _groups(length: int, slice_bytes: int):
    """Maximal repeats of a bucket: rows of one group_id are all occurrences of one string, in bytes from the start of the text."""

    def run(table: pa.Table) -> pa.Table:
        columns, n = [], int(table.column("bucket")[0].as_py()) << 36
        for bucket in Bucket.slices(table, length, slice_bytes):
            s = bucket.suffixes
            depths, members = [], []
            for depth, some in _interval_groups(s, length):
                depths.append(depth), members.append(some)
            sizes = np.array([len(m) for m in members], np.int64)
            member = np.concatenate(members) if members else np.empty(0, np.int64)
            shared = np.zeros(len(bucket.count), bool)
            shared[s.string[s.offset == 0]] = True
            alone = np.flatnonzero((bucket.count > 1) & ~shared)  # equal contexts of one chunk alone
            string = np.concatenate((s.string[member], alone)).astype(np.int64)
            offset = np.concatenate((s.offset[member], np.zeros(len(alone), np.int64))).astype(np.int64)
            depth = np.concatenate((np.repeat(np.array(depths, np.int64), sizes), bucket.size[alone].astype(np.int64)))
            group = np.concatenate((np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(len(alone)))) + n + 1
            n += len(sizes) + len(alone)
            count = bucket.count[string].astype(np.int64)
            which = _gathered(bucket.first, string)
            columns.append((np.repeat(group, count), np.repeat(depth, count), bucket.ids[which], bucket.place[which] + np.repeat(offset, count)))
        trim()
        names = ("group_id", "length", "doc_id", "start")
        return pa.table({name: pa.array(np.concatenate([c[i] for c in columns]) if columns else [], pa.int64()) for i, name in enumerate(names)})

    return run


# ---- operators -------------------------------------------------------------------------------------------


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shared_contexts(space: Workspace, docs: DataFrame, length: int, hot: int, buckets: int | None, within: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(chunks, contexts by bucket, tasks): both are dealt to so many tasks, which grow with their size."""
    named, spark = docs.where("doc_id is not null"), docs.sparkSession
    if buckets is None:
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    chunks = space.write(_chunks(named), "chunks", "none").repartition(tasks, "chunk")
    parts = _named(chunks, length, buckets).repartitionById(buckets, F.col("bucket"))  # a task for each bucket
    flags = space.write(parts.groupBy("bucket").applyInArrow(_flagged(hot, within), PART_SCHEMA), "flags", "none").repartition(tasks, "chunk")
    contexts = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_contexts(length, buckets), PART_SCHEMA)
    return chunks, contexts.repartitionById(buckets, F.col("bucket")), tasks


def repeat_groups(docs: DataFrame, length: int = LENGTH, hot: int = HOT_PLACES, buckets: int | None = None) -> DataFrame:
    """group_id, length, doc_id, start (bytes): repeats of at least ``length`` bytes with all their occurrences, within one document too.

    Repeats are maximal inside their contexts of at most 84 bytes (``length`` for anchors with over ``hot`` places): a longer repeat
    is reported in overlapping pieces that cover it, not as one group, and an interval inside a longer repeat may be reported along
    with it where a context begins.
    """
    _, contexts, _ = _shared_contexts(Workspace(docs.sparkSession, "repeats"), _plain(docs), length, hot, buckets, within=True)
    return contexts.groupBy("bucket").applyInArrow(_groups(length, SLICE_BYTES), GROUP_SCHEMA)


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, raw = _opened(*(left.column(k)[0] for k in ("doc_ids", "sizes", "body")))
        edge = np.zeros(len(raw) + 1, np.int32)
        for part in right.column("part").to_pylist():
            doc, start, end = _unpacked(part)
            np.add.at(edge, at[doc] + start, 1)
            np.add.at(edge, at[doc] + end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = np.searchsorted(at[1:], runs(gone, at)[0], side="right")
        total = np.concatenate(([0], np.cumsum(gone)))
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        n = len(ids)
        table = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(np.diff(total[at]), pa.int64()), "n_spans": pa.array(np.bincount(spans, minlength=n)[:n], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_text:
            table["kept"] = pa.array(kept, pa.binary())
        return pa.table(table)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT_PLACES, buckets: int | None = None, with_text: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: what is left after removing each byte of a string of ``length`` bytes that a document with a smaller id has too.

    ``with_text`` adds the bytes that are kept, as binary: a cut may fall inside a character.
    """
    space, docs = Workspace(docs.sparkSession, "repeats"), _plain(docs)
    chunks, contexts, tasks = _shared_contexts(space, docs, length, hot, buckets)
    ranges = space.write(contexts.groupBy("bucket").applyInArrow(_ranges(length, slice_bytes), "chunk long, part binary"), "ranges", "none").repartition(tasks, "chunk")
    space.drop("flags")
    out = chunks.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(_kept(with_text), RESULT_SCHEMA + ", kept binary" * with_text)
    zero, body = F.lit(0).cast("long"), F.coalesce("text", F.lit("")).cast("binary")
    unnamed = docs.where("doc_id is null").select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), *([body.alias("kept")] * with_text))
    return out.unionByName(unnamed)
