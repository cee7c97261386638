"""Token-id output: canonical length-limited Huffman coding in independent blocks.

``write_ids`` range-sorts documents by id, tokenises them, counts all ids,
derives code lengths of at most ``max_bits`` by package-merge, and writes

* ``codebook``: (id, bits), one row per id that occurs; canonical codes follow
  from it by ascending (bits, id);
* ``blocks``: one row per block of whole documents with ``part``, ``block``,
  ``start`` (ids before it in the whole output), ``doc_ids``, ``counts`` (ids of
  each document), ``checkpoints`` (bits taken by each run of 128 ids, as
  little-endian 16-bit integers) and ``payload`` (codes, most significant bit first).

Any block can be decoded alone.  ``read_ids`` looks codes up in one table and
advances all runs of a block at once, each from its checkpoint.

Nulls: a null text counts as empty, so its document holds the end id only; null
ids sort first.  Repeated ids keep one place each, by the hash of their text.
Texts of any length are encoded whole.  Extra columns are ignored, whatever
their names.  An empty table gives an empty codebook and no block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .textops import pieces
from .workspace import Workspace

MAX_BITS = 18
RUN = 128
BLOCK_IDS = 1 << 18


def code_lengths(weights: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for positive weights, by package-merge."""
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit in {max_bits} bits")
    order = np.argsort(weights, kind="stable")
    coins = weights[order].astype(np.int64)
    levels, row = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate((coins, row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)))
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        row = both[place]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(levels):
        coins_in = int(is_coin[:take].sum())
        lengths[order[:coins_in]] += 1
        take = 2 * (take - coins_in)
    return lengths


def canonical_codes(symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The code of each symbol: consecutive numbers by (bits, symbol)."""
    order = np.lexsort((symbols, bits))
    out, code, before = np.zeros(len(symbols), np.uint64), 0, 0
    for k in order.tolist():
        code <<= int(bits[k]) - before
        out[k], before = code, int(bits[k])
        code += 1
    return out


class Codebook:
    """Codes by symbol and the decoding table."""

    def __init__(self, symbols: np.ndarray, bits: np.ndarray):
        self.wide = int(bits.max()) if len(bits) else 1
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.codes, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.codes[symbols], self.bits[symbols] = canonical_codes(symbols, bits), bits
        self.table = np.zeros(1 << self.wide, np.uint32)
        for s, b in zip(symbols.tolist(), bits.tolist()):
            low = int(self.codes[s]) << (self.wide - b)
            self.table[low : low + (1 << (self.wide - b))] = s << 5 | b

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of one block."""
        if not len(ids):
            return b"", b""
        size = self.bits[ids]
        end = np.cumsum(size)
        begin = end - size
        word, code = begin >> np.uint64(6), self.codes[ids]
        over = (begin & np.uint64(63)) + size  # bits used up to the end of the code, from its first word
        spill = over > 64
        high = np.where(spill, code >> np.where(spill, over - 64, 0).astype(np.uint64), code << (64 - np.where(spill, 64, over)).astype(np.uint64))
        out = np.zeros(int(end[-1] >> np.uint64(6)) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] = np.add.reduceat(high, first)
        at = np.flatnonzero(spill)
        out[word[at] + np.uint64(1)] += code[at] << (128 - over[at]).astype(np.uint64)
        marks = np.diff(np.concatenate((begin[::RUN], end[-1:]))).astype("<u2")
        return out.byteswap().tobytes()[: (int(end[-1]) + 7) // 8], marks.tobytes()

    def unpack(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids of one block, one table look-up per id and all runs in step."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        four = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        marks = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        at, out = np.cumsum(marks) - marks, np.empty((min(RUN, n), len(marks)), np.uint32)
        shift = np.uint32(32 - self.wide)
        for i in range(len(out)):
            found = self.table[(four[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
            out[i] = found >> np.uint32(5)
            at += found & np.uint32(31)
            np.minimum(at, 8 * len(payload), out=at)  # the last run may be shorter than the others
        return out.T.ravel()[:n]


IDS_SCHEMA = "part long, block long, offset long, doc_ids array<bigint>, counts array<bigint>, ids binary"


def _tokenised(docs: DataFrame, name: str, end_id: int) -> DataFrame:
    """Blocks of whole documents in the order of docs' partitions, with ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens.encoder(name).encode, TaskContext.get().partitionId()
        block = offset = held = 0
        doc_ids, counts, parts = [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([offset], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())], names=[x.split()[0] for x in IDS_SCHEMA.split(", ")])

        for batch in (p for b in batches for p in pieces(b, limit=tokens.TEXT_BYTES)):
            ids, first = encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                doc_ids.append(doc), counts.append(b - a + 1)
                parts.append(ids[a:b].astype("<u4").tobytes() + end_id.to_bytes(4, "little"))
                held += b - a + 1
                if held >= BLOCK_IDS:
                    yield flush()
                    block, offset, held = block + 1, offset + held, 0
                    doc_ids, counts, parts = [], [], []
        if doc_ids:
            yield flush()

    return docs.mapInArrow(run, IDS_SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            found = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["id", "n"])


BLOCK_SCHEMA = "part long, block long, start long, doc_ids array<bigint>, counts array<bigint>, checkpoints binary, payload binary"


def write_ids(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str = tokens.TOKENIZER, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all texts, each followed by end_id, under path in ascending doc_id order."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "ids")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ids = space.write(_tokenised(ordered, tokenizer, end_id), "ids")
    # As many rows as the vocabulary has ids, and as there are partitions.
    counts = ids.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    totals = sorted(ids.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n")).collect())
    symbols = np.array([r[0] for r in counts], np.int64)
    bits = code_lengths(np.array([r[1] for r in counts], np.int64), max(max_bits, int(len(counts)).bit_length()))
    before, known = {}, 0
    for part, n in totals:
        before[part], known = known, known + n
    sent = spark.sparkContext.broadcast((symbols, bits, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, bits, before = sent.value
        book = Codebook(symbols, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                payload, marks = book.pack(np.frombuffer(batch.column(5)[i].as_buffer(), "<u4"))
                start = before[batch.column(0)[i].as_py()] + batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([start], pa.int64()), batch.column(3).slice(i, 1), batch.column(4).slice(i, 1), pa.array([marks], pa.binary()), pa.array([payload], pa.binary())], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    ids.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(list(zip(symbols.tolist(), bits.tolist())), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    space.drop("ids")


DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _blocks(spark: SparkSession, path: str):
    book = spark.read.schema("id long, bits long").parquet(f"{path}/codebook").collect()  # one row per id of the vocabulary
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64)))
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("start", "doc_ids", "counts", "checkpoints", "payload"), sent


def _decoded(batch: pa.RecordBatch, book: Codebook):
    for i in range(batch.num_rows):
        start, docs, counts = (batch.column(k)[i].as_py() for k in range(3))
        ids = book.unpack(batch.column(4)[i].as_py(), batch.column(3)[i].as_py(), sum(counts))
        at = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        yield start, docs, counts, at.tolist(), ids.astype("<u4")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array) of every document in the files under path."""
    blocks, sent = _blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*sent.value)
        for batch in batches:
            for start, docs, counts, at, ids in _decoded(batch, book):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([start + a for a in at[:-1]], pa.int64()), lists], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of every document in the files under path."""
    blocks, sent = _blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*sent.value)
        for batch in batches:
            for start, docs, counts, at, ids in _decoded(batch, book):
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([start + a for a in at[:-1]], pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return blocks.mapInArrow(run, DIGEST_SCHEMA)
