"""Benchmark decontamination by winnowing.

Words are runs of digits, letters (A-Z lowered) and non-ASCII characters.  A
window is 10 consecutive words of a benchmark item; an item of fewer words,
but not none, is one window.  Both sides hash all runs of K words and keep the
least hash of every W consecutive runs (ties: all).  As W + K - 1 = 10, two
texts that share 10 words share a kept fingerprint inside them, so joining
fingerprints and extending each hit to both sides finds every shared window.
Items of fewer than 10 words lie below that guarantee; their whole-item hash is
looked up among all document runs of the same length.  Hashes only find: what
is reported has been compared word by word.

A benchmark of at most ``broadcast_bytes`` of text is sent to all tasks, and
documents are read once without a shuffle.  A larger one is joined: documents
emit only fingerprints, each with the words around it, and a fixed-size filter
of the benchmark's fingerprints is applied first.  Contexts that are equal are
compared once, however many documents and items have them.

Nulls: a null text has no words; an item with null id or without words is left
out.  Rows with null ids, repeated rows and repeated items are kept as they
are; texts of any length are read whole.  Extra columns are ignored, whatever
their names.  An empty benchmark leaves all documents clean, an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ASCII_LOWER, U64, grams, mix, owners, pieces, powers, utf8, words
from .workspace import Workspace

SPAN = 10
K = 5
W = SPAN - K + 1
BROADCAST_BYTES = 16 << 20
FILTER_BITS = 1 << 26

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def winnow(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, index of its first word), winnowed inside each document."""
    found, place = grams(hashes, first, K)
    n = len(found)
    if n < W:
        return found[:0], place[:0]
    least = found[: n - W + 1].copy()
    for i in range(1, W):
        np.minimum(least, found[i : n - W + 1 + i], out=least)
    whole = place[W - 1 :] - place[: n - W + 1] == W - 1  # false where the window crosses documents
    keep = np.zeros(n, bool)
    for i in range(W):
        keep[i : n - W + 1 + i] |= whole & (found[i : n - W + 1 + i] == least)
    return found[keep], place[keep]


class Words:
    """The words of many texts: hashes, and the bytes behind them."""

    def __init__(self, texts: pa.Array):
        raw, at = utf8(texts)
        self.hashes, self.first, self.starts, self.ends = words(raw, at, IN_WORD)
        self.low = ASCII_LOWER[raw].tobytes()

    def list(self, a: int, b: int) -> list[bytes]:
        return [self.low[i:j] for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def _equal_runs(x: list[bytes], y: list[bytes], least: int) -> list[tuple[int, int]]:
    """The runs of at least ``least`` places at which two lists of one size agree."""
    if x == y:
        return [(0, len(x))] if len(x) >= least else []
    other = [-1, *(i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x)]
    return [(a + 1, b) for a, b in zip(other, other[1:]) if b - a - 1 >= least]


class Benchmark:
    """Items with their words, fingerprints and short-item hashes."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids, self.words = ids, Words(pa.array(texts, pa.string()))
        hashes, self.first = self.words.hashes, self.words.first
        sizes = np.diff(self.first)
        found, place = winnow(hashes, self.first)
        order = np.argsort(found, kind="stable")
        self.prints, self.places = found[order], place[order]
        self.item_of = owners(self.first)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SPAN):
            if len(items := np.flatnonzero(sizes == n)):
                whole = np.zeros(len(items), U64)
                for i, p in enumerate(powers(n + 1)[1:]):
                    whole += hashes[self.first[items] + i] * p
                order = np.argsort(mix(whole), kind="stable")
                self.short[n] = mix(whole)[order], items[order]

    def hits(self, texts: Words) -> list[tuple[int, int, int, int]]:
        """(document, first word, end word, item) of shared runs; words count from the start of the batch."""
        out, hashes, first = [], texts.hashes, texts.first
        if len(self.prints):
            found, place = winnow(hashes, first)
            lo = np.searchsorted(self.prints, found)
            near = np.minimum(lo, len(self.prints) - 1)
            owner = owners(first)
            done: dict[tuple[int, int], int] = {}
            for k in np.flatnonzero(self.prints[near] == found).tolist():
                pos, doc = int(place[k]), int(owner[place[k]])
                for e in range(int(lo[k]), int(np.searchsorted(self.prints, found[k], side="right"))):
                    at = int(self.places[e])
                    if done.get((doc, at - pos), -1) >= pos:
                        continue  # inside a run that was extended before
                    item = int(self.item_of[at])
                    a, b = _extend(hashes, pos, int(first[doc]), int(first[doc + 1]), self.words.hashes, at, int(self.first[item]), int(self.first[item + 1]))
                    done[doc, at - pos] = b - 1
                    if b - a >= SPAN:
                        out += [(doc, a + i, a + j, item) for i, j in _equal_runs(texts.list(a, b), self.words.list(a + at - pos, b + at - pos), SPAN)]
        for n, (known, items) in self.short.items():
            found, place = grams(hashes, first, n)
            lo = np.searchsorted(known, found)
            owner = owners(first)
            for k in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == found).tolist():
                a = int(place[k])
                mine = texts.list(a, a + n)
                for e in range(int(lo[k]), int(np.searchsorted(known, found[k], side="right"))):
                    begin = int(self.first[items[e]])
                    if mine == self.words.list(begin, begin + n):
                        out.append((int(owner[a]), a, a + n, int(items[e])))
        return out


def _extend(a: np.ndarray, i: int, a_low: int, a_end: int, b: np.ndarray, j: int, b_low: int, b_end: int) -> tuple[int, int]:
    """The longest run of equal values around a[i] and b[j]."""
    n = min(a_end - i, b_end - j)
    other = np.flatnonzero(a[i : i + n] != b[j : j + n])
    end = i + (int(other[0]) if len(other) else n)
    n = min(i - a_low, j - b_low)
    other = np.flatnonzero(a[i - n : i] != b[j - n : j])
    return i - n + (int(other[-1]) + 1 if len(other) else 0), end


def _covered(ranges: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(ranges):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")


def _item_bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: its words, the words inside shared windows, the items they come from."""
    items = _items(benchmark, item_col, item_text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _by_broadcast(docs, items) if _item_bytes(items) <= broadcast_bytes else _by_join(docs, items)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs whose text shares no window with the benchmark; all their columns stay.

    With a benchmark of up to ``broadcast_bytes`` rows are left out as they are
    read; with a larger one hits are joined by id and text.
    """
    items = _items(benchmark, "item_id", "text")
    if _item_bytes(items) <= broadcast_bytes:
        sent, place = _sent(items), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(*sent.value)
            for batch in (p for b in batches for p in pieces(b)):
                clean = np.ones(batch.num_rows, bool)
                clean[[hit[0] for hit in known.hits(Words(batch.column(place)))]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = _by_join(plain, items, hit_keys=True).select(F.col("row_key").alias("__hit_key"))
    named = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", _named("__id", "text"))
    return named.join(known, F.col("__key") == F.col("__hit_key"), "left_anti").select(*docs.columns)


def _sent(items: DataFrame):
    rows = items.collect()  # at most broadcast_bytes
    return items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    sent = _sent(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Benchmark(*sent.value)
        for batch in (p for b in batches for p in pieces(b)):
            texts = Words(batch.column(1))
            by: dict[int, tuple[list, set]] = {}
            for doc, a, b, item in known.hits(texts):
                ranges, seen = by.setdefault(doc, ([], set()))
                ranges.append((a, b))
                seen.add(known.ids[item])
            n = batch.num_rows
            hit, n_items, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), [_digest(())] * n
            for doc, (ranges, seen) in by.items():
                hit[doc], n_items[doc], digest[doc] = _covered(ranges), len(seen), _digest(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(texts.first), pa.int64()), pa.array(hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(hit > 0)], names=[x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return docs.mapInArrow(run, RESULT_SCHEMA)


PRINT_SCHEMA = "row_key string, print long, pos long, around binary, before int, size int"


def _prints(frame: DataFrame, key: str, bits) -> DataFrame:
    """Fingerprints with up to SPAN - K words, as text, to either side, and short whole texts and runs under their own hashes.

    ``bits`` is None for items, or a broadcast filter and the short lengths for documents.
    """
    names = [x.split()[0] for x in PRINT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = bits.value if bits is not None else (None, range(1, SPAN))
        for batch in (p for b in batches for p in pieces(b)):
            texts = Words(batch.column(1))
            hashes, first = texts.hashes, texts.first
            owner, sizes = owners(first), np.diff(first)
            found, place = winnow(hashes, first)
            sets = [(found, place, np.full(len(found), SPAN))]
            for n in lengths:
                h, p = grams(hashes, first, n)
                if bits is None:
                    whole = sizes[owner[p]] == n if len(p) else np.zeros(0, bool)
                    h, p = h[whole], p[whole]
                sets.append((mix(h + U64(n)), p, np.full(len(h), n)))
            found, place, kind = (np.concatenate(x) for x in zip(*sets))
            if table is not None:
                slot = found & U64(FILTER_BITS - 1)
                keep = (table[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 > 0
                found, place, kind = found[keep], place[keep], kind[keep]
            doc = owner[place] if len(place) else place
            low = np.where(kind == SPAN, np.maximum(first[doc], place - (SPAN - K)), place)
            end = np.where(kind == SPAN, np.minimum(first[doc + 1] if len(doc) else doc, place + SPAN), place + kind)
            around = [b" ".join(texts.list(a, b)) for a, b in zip(low.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(found.view(np.int64)), pa.array(place - first[doc], pa.int64()), pa.array(around, pa.binary()), pa.array(place - low, pa.int32()), pa.array(kind, pa.int32())], names=names)

    return frame.select(key, "text").mapInArrow(run, PRINT_SCHEMA)


RUN_SCHEMA = "context string, item_context string, a long, b long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn pairs of contexts into runs of shared words, counted from the fingerprint's place."""
    for batch in batches:
        c = batch.to_pydict()
        out: list[list] = [[], [], [], []]
        for one, other, x, bx, y, by, kind in zip(c["context"], c["item_context"], c["around"], c["before"], c["item_around"], c["item_before"], c["size"]):
            p, q = x.split(b" "), y.split(b" ")
            low, n = -min(bx, by), min(len(p) - bx, len(q) - by)
            for i, j in _equal_runs(p[bx + low : bx + n], q[by + low : by + n], kind):
                for into, value in zip(out, (one, other, low + i, low + j)):
                    into.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])


def _named(key: str, text: str):
    """A name of a row: its id and a 128-bit digest of its text."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull().cast("string"), F.left(F.sha2(F.col(text).cast("binary"), 256), F.lit(32)))


def _by_join(docs: DataFrame, items: DataFrame, hit_keys: bool = False) -> DataFrame:
    """For benchmarks of any size: rows are named by id and a digest of the text, so equal rows share one answer.

    A fingerprint and the words around it are a context, named by its digest.  Different contexts alone are joined by
    fingerprint and compared; places of documents, and ids of items, come to what was found afterwards.  So a passage
    that very many documents and items have is compared once.  ``hit_keys`` gives only the names of hit rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "decontamination")
    context = F.left(F.sha2(F.concat_ws(":", "print", "size", "before", F.hex("around")), 256), F.lit(32))
    keyed = docs.withColumn("row_key", _named("doc_id", "text"))
    named = items.withColumn("row_key", _named("item_id", "text")).dropDuplicates(["row_key"])
    known = space.write(_prints(named, "row_key", None).withColumn("context", context).join(named.select("row_key", "item_id"), "row_key"), "items")
    fixed = known.selectExpr(f"print & {FILTER_BITS - 1} slot").groupBy(F.expr("int(slot div 8)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, int(slot % 8)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in fixed.toLocalIterator():  # at most FILTER_BITS / 8 bytes, whatever the benchmark's size
        table[part[0]] = part[1]
    lengths = [r[0] for r in known.where(F.col("size") < SPAN).select("size").distinct().collect()]
    sent = spark.sparkContext.broadcast((table, sorted(lengths)))
    places = space.write(_prints(keyed, "row_key", sent).withColumn("context", context), "places")
    one = places.select("context", "print", "size", "around", "before").distinct()
    other = known.select(F.col("context").alias("item_context"), "print", "size", F.col("around").alias("item_around"), F.col("before").alias("item_before")).distinct()
    runs = space.write(one.join(other, ["print", "size"]).mapInArrow(_shared, RUN_SCHEMA), "runs")
    if hit_keys:
        return places.join(runs.select("context").distinct(), "context", "left_semi").select("row_key").distinct()
    held = known.select(F.col("context").alias("item_context"), "item_id").distinct()
    found = runs.join(held, "item_context").groupBy("context").agg(F.collect_set(F.struct("a", "b")).alias("ranges"), F.collect_set("item_id").alias("ids"))
    hit = places.select("row_key", "pos", "context").join(found, "context")
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("pos")).alias("a"), (r["b"] + F.col("pos")).alias("b")))
    ordered = hit.select("row_key", moved.alias("ranges"), "ids").groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ranges")))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    covered = F.aggregate("ranges", start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))["n"]
    hits = ordered.select("row_key", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            raw, at = utf8(batch.column(1))
            _, first, _, _ = words(raw, at, IN_WORD)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first), pa.int64())], names=["doc_id", "row_key", "n_words"])

    base = keyed.select("doc_id", "text", "row_key").mapInArrow(counts, "doc_id long, row_key string, n_words long")
    zero = F.lit(0).cast("long")
    return base.join(hits, "row_key", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest(()))).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
