"""Bit sets in containers and Bloom filters in packed words."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

#: Positions of a container, and the 64-bit words they make.
BUCKET, BUCKET_WORDS = 1 << 15, (1 << 15) // bits.WORD
CONTAINER = "bucket bigint, n int, places array<smallint>, runs array<struct<first:smallint,last:smallint>>, bits binary"


def _container(bucket: int, member: np.ndarray) -> tuple:
    """The smallest of three kinds for a flag a position: places (2 bytes each), runs (4 bytes each) or a bitmap (4 KB)."""
    places = np.flatnonzero(member)
    breaks = np.flatnonzero(np.diff(places) > 1)
    first, last = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)]
    best = min((2 * len(places), 0), (4 * len(first), 1), (BUCKET // 8, 2))[1]
    runs = [{"first": int(a), "last": int(b)} for a, b in zip(first, last)] if best == 1 else None
    return bucket, len(places), places.astype(np.int16) if best == 0 else None, runs, np.packbits(member, bitorder="little").tobytes() if best == 2 else None


def _member(places: list | None, runs: list | None, bitmap: bytes | None) -> np.ndarray:
    if bitmap is not None:
        return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    out = np.zeros(BUCKET, bool)
    for run in runs or ():
        out[run["first"] : run["last"] + 1] = True
    if places is not None:
        out[np.array(places, np.int64)] = True
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    run = pa.list_(pa.struct([("first", pa.int16()), ("last", pa.int16())]))
    kinds = {"bucket": pa.int64(), "n": pa.int32(), "places": pa.list_(pa.int16()), "runs": run, "bits": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def _containers(words: DataFrame) -> DataFrame:
    """Containers of rows (word, bits), of which each word has one: at most 512 words meet in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.zeros(BUCKET_WORDS, "<i8")
                table[[w["word"] for w in held]] = [w["bits"] for w in held]
                rows.append(_container(bucket, np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)))
            if rows:
                yield _batch(rows)

    word = F.struct((F.col("word") % BUCKET_WORDS).alias("word"), "bits")
    grouped = words.groupBy(F.expr(f"word div {BUCKET_WORDS}").alias("bucket")).agg(F.collect_list(word).alias("words"))
    return grouped.mapInArrow(run, CONTAINER)


def _words(df: DataFrame, position: str, inside: Column) -> DataFrame:
    """(word, bits) of the positions of a column, merged by OR within tasks and then over them."""
    return df.where(inside).groupBy(bits.word_index(position).alias("word")).agg(F.bit_or(bits.word_mask(position)).alias("bits"))


class BitSet:
    """Positions 0 to the capacity of whole 64-bit words, as rows of containers of 32,768 positions.

    A container has its number of positions and one of places, runs or a bitmap, whichever is smallest; containers
    without a position are not there.
    """

    def __init__(self, rows: DataFrame, size: int | None = None):
        self.rows, self.size = rows, size

    @classmethod
    def of(cls, df: DataFrame, position: str, size: int | None = None) -> BitSet:
        """The set of all positions of a column; negative ones and those beyond the capacity are left out."""
        inside = F.col(position) >= 0
        if size is not None:
            inside &= F.col(position) < bits.capacity(size)
        return cls(_containers(_words(df, position, inside)), size)

    def cleared(self, df: DataFrame, position: str) -> BitSet:
        """The set without the positions of a column: container by container, those that lose any are chosen anew."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if r["gone_n"] is None:
                        rows.append((r["bucket"], r["n"], r["places"], r["runs"], r["bits"]))
                        continue
                    left = _member(r["places"], r["runs"], r["bits"]) & ~_member(r["gone_places"], r["gone_runs"], r["gone_bits"])
                    if left.any():
                        rows.append(_container(r["bucket"], left))
                if rows:
                    yield _batch(rows)

        gone = _containers(_words(df, position, F.col(position) >= 0))
        gone = gone.select(F.col("bucket").alias("gone_bucket"), *[F.col(c).alias(f"gone_{c}") for c in ("n", "places", "runs", "bits")])
        both = self.rows.join(gone, F.col("bucket") == F.col("gone_bucket"), "left").drop("gone_bucket")
        return BitSet(both.mapInArrow(run, CONTAINER), self.size)

    def test(self, df: DataFrame, position: str, name: str = "there") -> DataFrame:
        """df with whether its position is in the set; NULL outside the capacity."""
        rows = self.rows.select(*[F.col(c).alias(f"__{c}") for c in ("bucket", "places", "runs", "bits")])
        p = F.col(position).cast("long")
        bucket, place = F.expr(f"CAST(`{position}` AS BIGINT) div {BUCKET}"), (p % BUCKET).cast("int")
        byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3) + 1, 1)), 16, 10).cast("int")
        bit = F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)))
        there = F.when(F.col("__bits").isNotNull(), byte.bitwiseAND(bit) != 0)
        there = there.when(F.col("__runs").isNotNull(), F.exists("__runs", lambda r: place.between(r["first"], r["last"])))
        there = there.when(F.col("__places").isNotNull(), F.array_contains("__places", place.cast("smallint"))).otherwise(False)
        found = df.withColumn("__at", F.when(p >= 0, bucket)).join(rows, F.col("__at") == F.col("__bucket"), "left")
        inside = p >= 0 if self.size is None else p.between(0, bits.capacity(self.size) - 1)
        return found.withColumn(name, F.when(inside, there)).drop("__at", "__bucket", "__places", "__runs", "__bits")

    def count(self) -> DataFrame:
        return self.rows.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).cast("long").alias("n"))

    def sizes(self) -> DataFrame:
        """(kind, containers, positions, bytes) of the containers of each kind."""
        kind = F.when(F.col("bits").isNotNull(), "bitmap").when(F.col("runs").isNotNull(), "runs").otherwise("places")
        size = F.when(F.col("bits").isNotNull(), F.octet_length("bits")).when(F.col("runs").isNotNull(), 4 * F.size("runs")).otherwise(2 * F.size("places"))
        return self.rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("containers"), F.sum(F.col("n").cast("long")).alias("positions"), F.sum(size.cast("long")).alias("bytes"))


#: Filters of up to so many bits are a scalar of the plan, and up to so many they are sent to all tasks packed (32 MB).
SCALAR_BITS, PACKED_BITS = 1 << 16, 1 << 28


class BloomFilter:
    """m bits and any number of hash functions from a text column to a non-negative long."""

    def __init__(self, m: int, hashes: list[Callable[[Column | str], Column]]):
        if m <= 0:
            raise ValueError("a Bloom filter has at least one bit")
        if not hashes:
            raise ValueError("a Bloom filter has at least one hash function")
        self.m, self.hashes = m, hashes

    def positions(self, element: Column | str) -> Column:
        return F.array(*[h(element) % self.m for h in self.hashes])

    def of(self, df: DataFrame, element: str) -> DataFrame:
        """The filter in 64-bit words (word, bits) that are not 0: each task's words are merged by OR, at most m / 64 leave it."""
        bit = df.select(F.explode(self.positions(element)).alias("bit")).where("bit is not null")
        return bit.groupBy(bits.word_index("bit").alias("word")).agg(F.bit_or(bits.word_mask("bit")).alias("bits"))

    def packed(self, words: DataFrame) -> np.ndarray:
        """All m bits as words, on the driver."""
        out = np.zeros((self.m - 1) // bits.WORD + 1, np.int64)
        rows = words.toArrow()
        out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return out

    def contains(self, df: DataFrame, element: str, words: DataFrame, name: str = "maybe") -> DataFrame:
        """df with whether all bits of its element are set: no member is ever missed; NULL for a null element.

        Small filters are one array from a scalar subquery, larger ones a packed broadcast; beyond 32 MB distinct elements
        are joined with the words they need.
        """
        if self.m <= SCALAR_BITS:
            by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))  # at most m / 64 of them
            table = words.agg(by_word.alias("by_word")).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit((self.m - 1) // bits.WORD).cast("long")), lambda w: F.coalesce(F.try_element_at(F.col("by_word"), w), F.lit(0).cast("long"))).alias("words"))
            held = table.scalar()
            probes = [h(element) % self.m for h in self.hashes]
            return df.withColumn(name, functools.reduce(operator.and_, [bits.test_bit(F.get(held, bits.word_index(p).cast("int")), p) for p in probes]))
        if self.m <= PACKED_BITS:
            sent = df.sparkSession.sparkContext.broadcast(self.packed(words))

            @F.pandas_udf("boolean")
            def all_set(*probes: pd.Series) -> pd.Series:
                known = probes[0].notna().to_numpy()
                at = [p.fillna(0).to_numpy(np.int64) for p in probes]
                found = functools.reduce(np.logical_and, [sent.value[a >> 6] >> (a & 63) & 1 == 1 for a in at])
                return pd.Series(found, dtype="boolean").where(known, pd.NA)

            return df.withColumn(name, all_set(*[h(element) % self.m for h in self.hashes]))
        elements = df.select(F.col(element).alias("__e")).distinct()
        probed = elements.select("__e", F.explode(self.positions("__e")).alias("bit")).withColumn("word", bits.word_index("bit")).join(words, "word", "left")
        known = probed.groupBy("__e").agg(F.bool_and(F.when(F.col("bit").isNotNull(), F.coalesce(bits.test_bit("bits", "bit"), F.lit(False)))).alias(name))
        return df.join(known, F.col(element).eqNullSafe(F.col("__e")), "left").drop("__e")


#: Bits of a block, as many as a cache line has, bits that an element sets in it, and bits for each element.
BLOCK, PROBES, BITS_EACH = 512, 7, 12
CHUNK = 1 << 13


class BlockedFilter:
    """A Bloom filter of which an element touches one block of 512 bits: before a join it drops most rows without a partner.

    Each task packs its keys into words of its own, tasks are merged by OR in chunks of 64 KB, and the whole, of at most
    PACKED_BITS, goes to all tasks.  More keys than fit well make it let more through, and change nothing else.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _probes(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each key's block, its bits in the block as rows of numbers below 512)."""
        h = hashes.view(np.uint64)
        block = (h >> np.uint64(33)) * np.uint64(blocks) >> np.uint64(31)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
        return block.astype(np.int64) * 8, ((h ^ (h >> np.uint64(32)))[:, None] >> shifts & np.uint64(511)).astype(np.int64)

    @classmethod
    def of(cls, df: DataFrame, key: str, expected: int | None = None) -> BlockedFilter:
        """The filter of a column's keys; ``expected`` of them, or as many as there are rows."""
        n = df.count() if expected is None else expected
        blocks = max(1, min(PACKED_BITS, n * BITS_EACH) // BLOCK)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(-(-blocks * 8 // CHUNK) * CHUNK, np.uint64)
            for batch in batches:
                at, bit = cls._probes(batch.column(0).to_numpy(), blocks)
                np.bitwise_or.at(words, at[:, None] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            chunks = words.reshape(-1, CHUNK)
            for i in np.flatnonzero(chunks.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([chunks[i].tobytes()], pa.binary())], names=["chunk", "words"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, np.zeros(CHUNK, np.uint64)
            out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "words"])
            for batch in batches:
                for chunk, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if chunk != now:
                        if now is not None:
                            yield out()
                        now, held = chunk, np.zeros(CHUNK, np.uint64)
                    held |= np.frombuffer(words.as_buffer(), np.uint64)
            if now is not None:
                yield out()

        packed = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).mapInArrow(pack, "chunk int, words binary")
        merged = packed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, words binary")
        words = np.zeros(-(-blocks * 8 // CHUNK) * CHUNK, np.uint64)
        for chunk, part in merged.collect():  # at most PACKED_BITS together
            words[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(part, np.uint64)
        return cls(words[: blocks * 8])

    def maybe(self, key: Column | str, session: DataFrame) -> Column:
        """Whether a key may be among the filter's; false for a null."""
        sent, blocks = session.sparkSession.sparkContext.broadcast(self.words), len(self.words) // 8

        @F.pandas_udf("boolean")
        def all_set(hashes: pd.Series) -> pd.Series:
            at, bit = BlockedFilter._probes(hashes.to_numpy(np.int64), blocks)
            return pd.Series((sent.value[at[:, None] + (bit >> 6)] >> (bit & 63).astype(np.uint64) & np.uint64(1)).all(axis=1))

        column = F.col(key) if isinstance(key, str) else key
        return column.isNotNull() & all_set(F.xxhash64(column))


def filtered_join(large: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An inner or left semi join whose large side loses most rows without a partner before it is shuffled."""
    if how not in ("inner", "left_semi"):
        raise ValueError("rows without a partner are part of other joins")
    held = BlockedFilter.of(small, on)
    return large.where(held.maybe(on, large)).join(small, on, how)
