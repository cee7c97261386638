"""Near-duplicate documents by SuperMinHash.

A document's set holds its distinct runs of ``shingle`` words (A-Z lowered,
words are runs without white space); a shorter text is one element, a text
without words has an empty set and is linked with nothing.  Two documents are
linked when ``100 * |A n B| >= threshold * |A u B|`` on the full sets.

1. Equal sets become one class, named by its least doc_id, before anything
   else, so exact copies cost one row each.
2. A SuperMinHash signature per class is cut into ``bands`` bands of ``rows``
   components; classes that share a band are candidates.  With 32 bands of 5 a
   pair at similarity 0.8 is missed with probability 3e-6.
3. Candidates of a band are compared with its hub first (``hubs``).  Classes
   that are still apart after ``HUB_ROUNDS`` rounds, such as texts that have a
   long passage in common and little else, are compared by prefixes: with
   elements ordered from rare to common, sets of similarity t share one of the
   first ``n - ceil(t n) + 1`` elements of either, at places that leave room for
   the overlap.  This loses no link and leaves out pairs that share only what
   very many have.
4. Components come from repeated star contraction (``components``).

Nulls: a null text has no words; a row with a null id keeps its counts, is
linked with nothing and is kept, with a null component.  Rows that repeat an
id are judged each by its own text.  Texts of any length are read whole.  Extra columns are ignored,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hubs
from .superminhash import band_keys, signatures
from .textops import ASCII_LOWER, U64, grams, mix, owners, pieces, powers, run_hashes, runs, trim, utf8
from .workspace import Workspace

SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS = 32, 5
HUB_ROUNDS = 2
#: Up to so many ids (eight bytes each) are sent to all tasks; beyond, texts are joined with them.
BROADCAST_IDS = 1 << 20

_IN_WORD = np.ones(256, bool)
_IN_WORD[32] = _IN_WORD[9:14] = False


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct elements, offsets) of the set of each text."""
    raw, at = utf8(texts)
    low = ASCII_LOWER[raw]
    starts, ends = runs(_IN_WORD[low], at)
    hashes, first = run_hashes(low, starts, ends), np.searchsorted(starts, at)
    found, place = grams(hashes, first, shingle)
    owner = owners(first)
    cut = np.searchsorted(owner[place] if len(place) else place, np.arange(len(first)))
    sets = []
    for i in range(len(first) - 1):
        if cut[i + 1] > cut[i]:
            sets.append(np.unique(found[cut[i] : cut[i + 1]]))
        else:  # fewer words than a shingle has
            words = hashes[first[i] : first[i + 1]]
            sets.append(mix((words * powers(len(words) + 1)[1:]).sum(dtype=U64, keepdims=True) + U64(len(words))) if len(words) else words)
    return (np.concatenate(sets) if sets else np.empty(0, U64)), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[first[1:]] - total[first[:-1]]


SIGNED_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, keys array<bigint>"


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            elements, first = shingle_sets(batch.column(1), shingle)
            keys = band_keys(signatures(elements, first, bands * rows), bands, rows).view(np.int64)
            one, two = _sums(mix(elements + U64(1)), first), _sums(mix(elements ^ U64(0x5851F42D4C957F2D)), first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=[x.split()[0] for x in SIGNED_SCHEMA.split(", ")])

    return docs.mapInArrow(run, SIGNED_SCHEMA)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            elements, first = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([elements[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["rep", "set"])

    return docs.mapInArrow(run, "rep long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), U64) for k in (2, 3))
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= threshold * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))
        trim()

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


SLOTS, BLOCK = 1 << 18, 1 << 12


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many elements fall into each of SLOTS hash slots: a table of fixed size that orders elements from rare to common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), U64) & U64(SLOTS - 1)).astype(np.int64), 1)
        blocks = np.flatnonzero(total.reshape(-1, BLOCK).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([total.reshape(-1, BLOCK)[i].tobytes() for i in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block] = total.get(block, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    schema = "block long, counts binary"
    for block, counts in sets.select("set").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[block] = np.frombuffer(counts, np.int64)
    return out.ravel()


def _prefix_pairs(members: DataFrame, sets: DataFrame, threshold: int, space: Workspace) -> DataFrame:
    """Pairs (a, b) of items of different components that share a prefix element and may be similar enough."""
    items = members.select("item", "component").distinct()
    own = space.write(sets.join(items, F.col("rep") == F.col("item")).select("item", "component", "set"), "rest")
    sent = members.sparkSession.sparkContext.broadcast(_slot_counts(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), U64)
                n, take = len(x), len(x) - (threshold * len(x) + 99) // 100 + 1
                x = x[np.lexsort((x, counts[(x & U64(SLOTS - 1)).astype(np.int64)]))][:take]
                for into, value in zip(out, (x.view(np.int64), np.full(take, batch.column(0)[i].as_py()), np.full(take, batch.column(1)[i].as_py()), np.full(take, n), np.arange(take))):
                    into.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["key", "item", "component", "n", "place"])

    rows = hubs.crowded(space, space.write(own.mapInArrow(run, "key long, item long, component long, n long, place long"), "prefixes", batch_rows=256), "crowded-prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    room = 100 * most >= threshold * (F.col("x.n") + F.col("y.n") - most)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.item") < F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & room).select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, hub_rounds: int = HUB_ROUNDS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links) and kept."""
    space = Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = space.write(_signed(docs, shingle, bands, rows), "signed")
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    classes = space.write(classes, "classes")
    similar_size = lambda x, y: 100 * F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])
    met = hubs.crowded(space, classes.select(F.explode("keys").alias("key"), F.col("rep").alias("item"), F.col("n_shingles").alias("n")), "met").select("key", "item", F.struct("n").alias("info"))
    few = space.write(met.select(F.col("item").alias("doc_id")).distinct(), "candidates")
    few = F.broadcast(few) if few.count() <= broadcast_ids else few
    sets = space.write(_sets(docs.join(few, "doc_id", "left_semi"), shingle), "sets")
    confirm = lambda pairs, name: space.write(_confirmed(pairs, sets, threshold), name, batch_rows=128)
    stars = hubs.components(space, met, similar_size, confirm, hub_rounds, lambda members: _prefix_pairs(members, sets, threshold, space))
    found = classes.join(stars, classes["rep"] == stars["u"], "left").select("h1", "h2", "n_shingles", F.coalesce("v", "rep").alias("found"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS, **how) -> DataFrame:
    """The rows of docs but those of documents linked, over any number of links, with one of a smaller id; rows with a null id stay.

    Up to ``broadcast_ids`` ids to leave out are sent to where the texts are read.
    """
    gone = near_duplicates(docs, broadcast_ids=broadcast_ids, **how).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Workspace(docs.sparkSession, "gone").write(gone, "ids")
    gone = F.broadcast(gone) if gone.count() <= broadcast_ids else gone
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
