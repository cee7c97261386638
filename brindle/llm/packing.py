"""Packing along a space-filling curve.

A document's ids are hashed into a signed, log-scaled and normalised count
vector of ``BUCKETS`` dimensions, projected by a fixed Gaussian matrix to
``AXES`` coordinates and quantised; its place is the Hilbert key of those.
Documents are range-sorted by (key, doc_id), so each partition is a stretch of
the curve and equal or similar documents lie side by side, and each stretch is
cut into sequences of ``size`` ids.  Long documents travel in rows of ``ROW_IDS``
ids, so that stretches of equally many rows have about equally many ids, and a
document may go on in the next stretch.  What is left at the end of a stretch is cut
into powers of two, which need no padding either.

Nulls: a null text counts as empty and packs its end id alone; null ids sort
first among equal keys.  Repeated rows are packed as often as they occur, ties
of the key by id.  Texts of any length are packed whole.  Extra columns are
ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .textops import U64, mix, pieces
from .workspace import Workspace, partitions

SIZE = 2048
ROW_IDS = 4096
#: Stored bytes of ids for one stretch of the curve; the number of stretches grows with the table.
STRETCH_BYTES = 32 << 20
BUCKETS, AXES, AXIS_BITS = 1024, 4, 15


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of (n, axes) integers below 2**bits; axes * bits is at most 63.

    Skilling's transposition: undo the excess work of each bit plane, then Gray-decode.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Projection:
    """Fixed tables: the signed bucket of each id and the matrix."""

    def __init__(self, vocabulary: int, seed: int = 7):
        code = mix(np.arange(vocabulary, dtype=U64) + U64(1))
        self.slot = (code % U64(2 * BUCKETS)).astype(np.int64)
        self.matrix = np.random.default_rng(seed).standard_normal((BUCKETS, AXES))

    def keys(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        slot, sums = self.slot[ids], np.zeros((len(first) - 1, BUCKETS))
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            counts = np.log1p(np.bincount(slot[a:b], minlength=2 * BUCKETS))
            v = counts[:BUCKETS] - counts[BUCKETS:]
            sums[i] = v / max(1e-9, np.sqrt(v @ v))
        place = 1 / (1 + np.exp(-1.7 * (sums @ self.matrix)))
        return hilbert_keys((place * (1 << AXIS_BITS)).astype(np.int64).clip(0, (1 << AXIS_BITS) - 1), AXIS_BITS)


def _placed(docs: DataFrame, name: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(name)
        where = Projection(encode.vocabulary)
        for batch in (p for b in batches for p in pieces(b, limit=tokens.TEXT_BYTES)):
            ids, first = encode.encode(batch.column(1))
            keys = where.keys(ids, first)
            rows: list[list] = [[], [], [], [], []]
            for doc, key, a, b in zip(batch.column(0).to_pylist(), keys.tolist(), first[:-1].tolist(), first[1:].tolist()):
                whole = ids[a:b].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                for start in range(0, b - a + 1, ROW_IDS):
                    for into, value in zip(rows, (doc, key, start, b - a + 1, whole[4 * start : 4 * (start + ROW_IDS)])):
                        into.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.binary())], names=["doc_id", "place", "start", "doc_tokens", "ids"])

    return docs.mapInArrow(run, "doc_id long, place long, start long, doc_tokens long, ids binary")


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch], size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cut a stretch of documents into sequences; the open sequence is held back to the end."""
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids
    sequence, held, open_pieces = TaskContext.get().partitionId() << 40, 0, []
    rows: list[tuple] = []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            arrays.append(pa.array(columns[7], pa.binary()))
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def add(piece: tuple, offset: int) -> None:
        doc, start, ids, total = piece
        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, *([bytes(ids)] * with_ids)))

    for batch in batches:
        for doc, begin, total, ids in zip(*(c.to_pylist() for c in batch.columns)):
            view, have, at = memoryview(ids), len(ids) // 4, 0
            while at < have:
                n = min(size - held, have - at)
                last = open_pieces[-1] if open_pieces else None
                if last and last[0] == doc and last[1] + len(last[2]) // 4 == begin + at and begin + at > 0:  # the same document goes on
                    open_pieces[-1] = (doc, last[1], bytes(last[2]) + bytes(view[4 * at : 4 * (at + n)]), total)
                else:
                    open_pieces.append((doc, begin + at, view[4 * at : 4 * (at + n)], total))
                at, held = at + n, held + n
                if held == size:
                    offset = 0
                    for piece in open_pieces:
                        add(piece, offset)
                        offset += len(piece[2]) // 4
                    open_pieces, held, sequence = [], 0, sequence + 1
        if len(rows) >= 4096:
            yield emit()
    while held:  # powers of two, largest first
        room, offset = 1 << (held.bit_length() - 1), 0
        held -= room
        while offset < room:
            doc, start, ids, total = open_pieces.pop(0)
            n = min(room - offset, len(ids) // 4)
            add((doc, start, ids[: 4 * n], total), offset)
            offset += n
            if 4 * n < len(ids):
                open_pieces.insert(0, (doc, start + n, ids[4 * n :], total))
        sequence += 1
    yield emit()


def pack(docs: DataFrame, size: int = SIZE, end_id: int = 1, tokenizer: str = tokens.TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as little-endian 32-bit integers."""
    space = Workspace(docs.sparkSession, "packing")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = space.write(_placed(plain, tokenizer, end_id), "placed")
    n = partitions(docs.sparkSession, space.size("placed"), STRETCH_BYTES)
    stretch = placed.repartitionByRange(n, "place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start", "doc_tokens").select("doc_id", "start", "doc_tokens", "ids")
    return stretch.mapInArrow(lambda batches: _packed(batches, size, with_ids), PIECE_SCHEMA + ", ids binary" * with_ids)
