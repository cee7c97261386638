"""How far the sources of a language differ in their words: sketch-prefiltered counting and sparse pair joins.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered.  A language keeps the V terms that are in at least
``least`` of its documents.  With N the kept occurrences of a group, a term that occurs ``count`` times has the share
``p = 1 + floor(SCALE * (count + 1) / (N + V))`` there, and group a is ``sum over kept terms of floor((p - q)**2 / q)``
away from group b, with p of a and q of b.  All of it is whole numbers.

1. Tasks count their texts in pieces and gather up to ``HELD`` rows (lang, source, term, occurrences, documents) for a table.
2. Each task adds the documents of its rows up in a count-min sketch of ``DEPTH`` rows.  Counters stop at ``least``, which
   is all that is asked of them, so merging them by chunks is exact and never too low.  A bit a counter, whether
   it has reached ``least``, goes to all tasks (``DEPTH * MAX_WIDTH`` bits, 6 MB, at most).
3. Rows of terms that the bits rule out are dropped before anything is shuffled; the survivors are counted exactly, by
   (lang, source, term) with map-side sums, and terms that are too rare after all go then.  A sketch that a very large
   vocabulary fills up drops less, and changes nothing else.
4. Pairs of sources: a term that neither of two sources has adds the same value for every such term.  So a pair
   starts with V times that value, and only terms that a source has correct it: ones of one source against the other's
   value for absent terms, ones of both by a join on the term.  Terms are dealt to buckets and sources to blocks, by
   hash, so a task sees at most two blocks of about ``BLOCK`` sources and one bucket of their terms.
5. The ``top`` terms of each group are cut within tasks before the groups meet.

Defined cases: null text, lang and source are ''.  Each row is a document, whatever its id, so repeated rows count
repeatedly.  A group without terms has its pairs; with V = 0 they are 0.  Ties in rank go by the item's UTF-8 bytes.
Texts and terms of any length are read whole.  Further columns are ignored, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import ASCII_LOWER, U64, mix, owners, pieces, runs, trim, utf8
from .workspace import Workspace

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes of text that are counted at once.
PIECE = 8 << 20
#: Counts that a task gathers before it passes them on.
HELD = 1 << 21
DEPTH, MIN_WIDTH, MAX_WIDTH = 3, 1 << 16, 1 << 24
CHUNK = 1 << 16
#: Sources of a block and entries of a bucket, on average.
BLOCK, BUCKET = 128, 1 << 14
#: Pairs of entries that one vector pass works on.
PAIRS = 1 << 20

_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the terms of all texts in order, the text of each term)."""
    raw, at = utf8(column)
    inside = _IN_TERM[raw]
    starts, ends = runs(inside, at)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    letters = ASCII_LOWER[raw[inside]]
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return flat.dictionary_encode(), owners(np.searchsorted(starts, at))


def _added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of the values of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


class _Counts:
    """Counts of some pieces, by group and term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        terms, doc = terms_of(batch.column(2))
        names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        group = np.array([self.groups.setdefault(name, len(self.groups)) for name in names], np.int64)
        size = max(1, len(terms.dictionary))
        both, n = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
        keys, n, docs = _added(group[both // size] * size + both % size, n, np.ones(len(both), np.int64))
        self.held.append((terms.dictionary, keys // size, (keys % size).astype(np.int32), n, docs))
        self.rows += len(keys)

    def flush(self) -> pa.RecordBatch:
        """The counts so far, which start anew."""
        words = pa.concat_arrays([h[0] for h in self.held]).dictionary_encode()
        size = max(1, len(words.dictionary))
        place = np.cumsum([0] + [len(h[0]) for h in self.held])
        codes = words.indices.to_numpy()
        keys = np.concatenate([h[1] * size + codes[at + h[2]] for h, at in zip(self.held, place)])
        keys, n, docs = _added(keys, *[np.concatenate([h[i] for h in self.held]) for i in (3, 4)])
        names = list(self.groups)
        lang, source = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        of = pa.array(keys // size)
        self.groups, self.held, self.rows = {}, [], 0
        return pa.RecordBatch.from_arrays([lang.take(of), source.take(of), words.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


FOUND = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial counts by (lang, source, term): a row for each of them and ``HELD`` rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in (p for b in batches for p in pieces(b, limit=PIECE)):
            counts.add(batch)
            if counts.rows >= HELD:
                yield counts.flush()
        if counts.rows:
            yield counts.flush()

    return docs.select("lang", "source", "text").mapInArrow(run, FOUND)


def _places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(hashes + U64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & U64(width - 1)).astype(np.int64)


def sketch(counted: DataFrame, least: int = LEAST_DOCS, width: int = MAX_WIDTH) -> np.ndarray:
    """The bits, DEPTH rows of ``width``, whether the documents counted in (hash, docs) may reach ``least`` (255 at most)."""
    chunk = min(CHUNK, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, docs = batch.column(0).to_numpy().view(U64), np.minimum(batch.column(1).to_numpy(), least)
            for row in range(DEPTH):
                cells = _places(hashes, row, width)
                order = np.argsort(cells)
                cells, first = np.unique(cells[order], return_index=True)
                table[row, cells] = np.minimum(table[row, cells] + np.add.reduceat(docs[order], first), least)
        flat = table.reshape(-1, chunk)
        some = np.flatnonzero(flat.any(axis=1))
        for part in (some[at : at + 64] for at in range(0, len(some), 64)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([flat[i].tobytes() for i in part], pa.binary())], names=["chunk", "counters"])
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(0, np.int64)
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["chunk", "bits"])
        for batch in batches:
            for k, counters in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now:
                    if now >= 0:
                        yield bits()
                    now, total = k, np.zeros(chunk, np.int64)
                total = np.minimum(total + np.frombuffer(counters.as_buffer(), np.uint8), least)
        if now >= 0:
            yield bits()

    many = min(DEPTH * width // chunk, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = counted.mapInArrow(add, "chunk int, counters binary").repartition(many, "chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros((DEPTH * width // chunk, chunk // 8), np.uint8)
    for k, bits in merged.collect():
        out[k] = np.frombuffer(bits, np.uint8)
    return out.reshape(DEPTH, -1)


def possible(counted: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows of counted, whose last column is the hash, that the bits do not rule out; without the hash."""
    sent, width = counted.sparkSession.sparkContext.broadcast(bits), bits.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy().view(U64)
            keep = np.ones(batch.num_rows, bool)
            for row, known in enumerate(sent.value):
                at = _places(hashes, row, width)
                keep &= known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    return counted.mapInArrow(run, counted.drop("hash").schema)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total); as decimals where the product overflows a LONG, and 1 if total is 0."""
    small, large = (count + 1) * SCALE, (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    div = lambda a, b: F.call_function("div", a, b)
    return F.when(total == 0, F.lit(0).cast("long")).when(count < 9 * SCALE, div(small, total)).otherwise(div(large, total.cast("decimal(20,0)"))) + 1


def _off(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PARTS = "lang string, source string, item string, value decimal(38,0)"


def _pair_sums(key: tuple, group: pa.Table) -> pa.Table:
    """What one bucket of terms adds to the pairs (a source of the first block, one of the second)."""
    side, p, v = (group.column(name).to_numpy() for name in ("side", "p", "v"))
    of, term = group.column("source").combine_chunks(), group.column("term").combine_chunks()
    is_base = pc.is_null(term).to_numpy(zero_copy_only=False)
    code = term.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def one(bit: int) -> tuple:
        rows = np.flatnonzero(is_base & (side & bit > 0))
        names = of.take(pa.array(rows))
        mine = np.flatnonzero(~is_base & (side & bit > 0))
        mine = mine[np.argsort(code[mine], kind="stable")]
        return names, p[rows], pc.index_in(of.take(pa.array(mine)), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64), p[mine], code[mine]

    names_a, base_a, at_a, p_a, code_a = one(1)
    names_b, base_b, at_b, p_b, code_b = one(2)
    wide = len(names_b)
    plain = _off(base_a[:, None], base_b[None, :])
    total = plain * (int(v[is_base][0]) if key[1].as_py() == 0 else 0)
    step = max(1, PAIRS // max(1, wide, len(names_a)))
    for at in range(0, len(p_a), step):  # terms of a against what b has for absent ones
        part = slice(at, at + step)
        np.add.at(total, at_a[part], _off(p_a[part, None], base_b[None, :]) - plain[at_a[part]])
    for at in range(0, len(p_b), step):
        part = slice(at, at + step)
        np.add.at(total.T, at_b[part], _off(base_a[None, :], p_b[part, None]) - plain.T[at_b[part]])
    first, last = np.searchsorted(code_b, code_a), np.searchsorted(code_b, code_a, side="right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(code_a):  # terms of both
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        many = (last - first)[at:to]
        i = np.repeat(np.arange(at, to), many)
        j = np.arange(len(i)) - np.repeat(ends[at:to] - many - before, many) + first[i]
        x, y = at_a[i], at_b[j]
        np.add.at(total.reshape(-1), x * wide + y, _off(p_a[i], p_b[j]) - _off(p_a[i], base_b[y]) - _off(base_a[x], p_b[j]) + plain[x, y])
        at = to
    x, y = np.divmod(np.arange(total.size), max(1, wide))
    names_a, names_b = names_a.take(pa.array(x)), names_b.take(pa.array(y))
    out = pa.table({"lang": pa.repeat(key[0], len(x)), "source": names_a, "item": names_b, "value": pa.array(total.reshape(-1)).cast(pa.decimal128(38, 0))})
    return out.filter(pc.not_equal(names_a, names_b))


def _blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its own is in; side: 1 first, 2 second, 3 both."""
    both = "inline(filter(flatten(transform(sequence(0, blocks - 1), j -> array(named_struct('a', block, 'b', j, 'side', if(j = block, 3, 1)), named_struct('a', j, 'b', block, 'side', if(j = block, 0, 2))))), s -> s.side > 0))"
    return rows.selectExpr("lang", "bucket", "source", "term", "p", "v", both)


def source_pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources; entries are terms of a group with their p."""
    terms = entries.withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    base = groups.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("base")).withColumn("bucket", F.explode(F.expr("sequence(0, buckets - 1)")))
    rows = _blocks(base).unionByName(_blocks(terms))
    return rows.groupBy("lang", "bucket", "a", "b").applyInArrow(_pair_sums, _PARTS).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and the terms that tell a source from its language."""
    spark = docs.sparkSession
    space = Workspace(spark, "divergence")
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    docs = docs.select(*map(empty, ("lang", "source", "text")))
    found = space.write(count_terms(docs), "found", batch_rows=1 << 14)
    width = min(MAX_WIDTH, max(MIN_WIDTH, 1 << (2 * found.count()).bit_length()))
    hashed = found.withColumn("hash", F.xxhash64("lang", "term"))
    bits = sketch(hashed.select("hash", "docs"), least, width)
    exact = possible(hashed, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    exact = space.write(exact, "exact")
    space.drop("found")
    kept = space.write(exact.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    posted = space.write(exact.drop("docs").join(kept, ["lang", "term"]), "posted")
    space.drop("exact")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("of_group"), F.count("*").alias("entries"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("of_group", "entries", "v", "of_lang")])
    groups = space.write(groups.withColumn("base", _share(F.lit(0).cast("long"), F.col("of_group") + F.col("v"))), "groups")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum("entries") / BUCKET)).cast("int").alias("buckets"))
    groups = space.write(groups.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "sized")

    entries = posted.join(groups.drop("entries"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("of_group") + F.col("v")))
    terms = entries.withColumn("q", _share(F.col("total"), F.col("of_lang") + F.col("v"))).where("p > q").selectExpr("lang", "source", "'term' part", "term item", "(p - q) * (p - q) div q value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    pairs = space.write(source_pairs(groups, entries), "pairs").selectExpr("lang", "source", "'pair' part", "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)
