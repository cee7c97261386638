"""Components of candidates that share buckets, without comparing all pairs.

``met`` has a row for each item and each bucket that it shares with another
item.  In every bucket the item that meets most others is the hub; members are
compared with it, confirmed links merge components, and a bucket whose members
are in one component is done.  The others go on without that hub, whose links
there are all known, and with HUBS hubs drawn by hash in each further round.  After ``rounds`` rounds, and as many more as still link at
least one in GOING of the pairs they compare, every pair still between two
components of a bucket is compared, unless ``remaining`` can tell exactly that
it isn't linked.  So each link between candidates is found or lies within a
component, and a large group of copies costs a number of pairs in proportion
to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .workspace import Workspace, partitions


#: Hub rounds go on while one in so many compared pairs is linked, up to a number of rounds: large groups whose members are linked through others.
GOING, MOST_ROUNDS = 10, 12
#: Hubs that a bucket has in each round but the first: fewer rounds, each with more to do, for groups in which no member is like most others.
HUBS = 3

#: Buckets (a power of two) by the first bits of keys, and rows that a task packs at once.
BUCKETS, PACKED_AT_ONCE = 1 << 11, 1 << 20
#: Of a key with over HOT_LEAST rows and over one in HOT_PART of those that are packed at once, two rows go to its bucket.
HOT_LEAST, HOT_PART = 16, 1 << 10


def _together(key: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, items, place of each row in its key's, rows of its key), in order and without repeated rows."""
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1]))
    key, item = key[fresh], item[fresh]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    return key, item, np.arange(len(key)) - np.repeat(begin, size), np.repeat(size, size)


def packed(key: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, keys, items) with the bytes of many keys and items each, for ``shared``.

    A key with very many rows, all of which are shared then, goes to bucket -1 but for two rows that tell others of it:
    so no bucket, which is one task's work, has much more of a key than any other bucket has rows.
    """
    if not len(key):
        key, item = np.empty(0, np.uint64), np.empty(0, np.int64)
        place = size = np.empty(0, np.int64)
    else:
        key, item, place, size = _together(key.view(np.uint64), item)
    hot = (size > max(HOT_LEAST, len(key) // HOT_PART)) & (place >= 2)
    rows = []
    for some, known in ((~hot, False), (hot, True)):
        mine, of = key[some], item[some]
        bucket = (mine >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)
        names = np.unique(bucket)
        cuts = np.append(np.searchsorted(bucket, names), len(bucket)).tolist()
        rows += [(-1 if known else name, mine[a:b].tobytes(), of[a:b].tobytes()) for name, a, b in zip(names.tolist(), cuts, cuts[1:])]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["bucket", "keys", "items"])


def shared(space: Workspace, packs: DataFrame, name: str, size: int) -> DataFrame:
    """The rows (key, item) that ``packed`` put into packs whose key has another item too, each once, written as a table.  size: bytes of packs."""

    def rows(keys: list[bytes], items: list[bytes], known: bool) -> pa.RecordBatch:
        key, item, _, crowd = _together(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(items), np.int64))
        some = (crowd > 1) | known
        return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(item[some])], names=["key", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, items = None, [], []  # of the bucket whose end isn't seen yet; rows are in order of buckets
        for batch in batches:
            for bucket, key, item in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now or bucket < 0:
                    if keys:
                        yield rows(keys, items, now < 0)
                    now, keys, items = bucket, [], []
                keys.append(key), items.append(item)
        if keys:
            yield rows(keys, items, now < 0)

    cold = packs.where("bucket >= 0").repartition(partitions(space.spark, size), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, item long")
    hot = packs.where("bucket < 0")
    if hot.limit(1).count():
        cold = cold.union(hot.mapInArrow(run, "key long, item long")).distinct()
    return space.write(cold, name)


def crowded(space: Workspace, members: DataFrame, name: str) -> DataFrame:
    """The rows of members (key, item and further numbers) whose key another item has too, written as a table; repeated rows once.

    Rows are dealt by ranges of (key, item), so that not even a key with very
    many rows is one task's work, sorted, and read in order.  The first and the
    last row of a range stay, as what lies beyond isn't seen: some rows without
    company remain, none with company goes.
    """
    columns = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, of which the next one isn't known yet, and whether it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([batch])])
            key, item = (table.column(c).to_numpy() for c in ("key", "item"))
            same = key[1:] == key[:-1]
            fresh = np.append(True, ~(same & (item[1:] == item[:-1])))
            rows = np.flatnonzero(fresh)
            same = key[rows[1:]] == key[rows[:-1]]
            stays = np.append(held is None or held[1], same) | np.append(same, False)
            held = table.slice(int(rows[-1]), 1), bool(stays[-1])
            yield from table.take(pa.array(rows[:-1][stays[:-1]])).to_batches()
        if held is not None:
            yield from held[0].to_batches()

    ordered = members.repartitionByRange("key", "item").sortWithinPartitions("key", "item")
    return space.write(ordered.mapInArrow(run, members.schema), name, batch_rows=1 << 14).select(*columns)


def different(space: Workspace, met: DataFrame, name: str) -> DataFrame:
    """The rows of met of keys with several items, and how many (crowd), one key of those that have the same items, written as a table.

    Lines or documents that are much alike share many keys, and nothing is found under one of these that isn't under
    another.  Sets of items are told apart by their sizes and two sums of 64-bit hashes each.
    """
    sums = [F.bit_xor(F.xxhash64("item", F.lit(seed))) for seed in (1, 2)]
    sets = met.groupBy("key").agg(F.count("*").alias("crowd"), sums[0].alias("one"), sums[1].alias("two")).where("crowd > 1")
    return space.write(met.join(sets.groupBy("crowd", "one", "two").agg(F.min("key").alias("key")).select("key", "crowd"), "key"), name)


def components(space: Workspace, met: DataFrame, similar: Callable[[Column, Column], Column], confirm: Callable[[DataFrame, str], DataFrame], rounds: int, remaining: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v): the least item v of the component of each other item u.

    met: key, item (long), info (a struct) and maybe crowd, the rows of the key.  ``similar`` is a cheap condition
    on two infos; ``confirm`` writes the linked ones of a table of pairs (a, b)
    under a name and returns them; ``remaining`` gives the pairs to compare at
    the end from (key, item, info, component), all pairs of a key by default.
    """
    spark = met.sparkSession
    counted = met if "crowd" in met.columns else met.join(met.groupBy("key").agg(F.count("*").alias("crowd")), "key")
    degree = counted.groupBy("item").agg(F.sum("crowd").alias("degree"))
    active = space.write(met.select("key", "item", "info").join(degree, "item").withColumn("component", F.col("item")), "active-0")
    stars, tested, k, going = spark.createDataFrame([], "u long, v long"), None, 0, False
    while active.limit(1).count():
        order = F.col("degree") if k == 0 else F.xxhash64("item", F.lit(k))  # later any member: who meets most may be like none
        candidate, draw = F.struct(order.alias("order"), F.col("item").alias("item"), "component", "info"), F.pmod(F.xxhash64("item", F.lit(-k)), F.lit(HUBS))
        tops = [F.max(candidate)] if k == 0 else [F.max(F.when(draw == i, candidate)) for i in range(HUBS)]
        hubs = active.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.array_compact(F.array(*tops)).alias("hubs")).where("low <> high").select("key", "size", "hubs")
        members = active.join(hubs, "key")
        hub_round = k < rounds or going
        if hub_round:
            facing = members.select("item", "component", "info", F.explode("hubs").alias("hub"))
            pairs = facing.where((F.col("component") != F.col("hub.component")) & similar(F.col("info"), F.col("hub.info"))).select(F.least("item", "hub.item").alias("a"), F.greatest("item", "hub.item").alias("b"))
        elif remaining is not None:
            pairs = remaining(members.select("key", "item", "info", "component"))
        else:
            x, y = members.alias("x"), members.alias("y")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.item") < F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & similar(F.col("x.info"), F.col("y.info"))).select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
        pairs = pairs.where("a <> b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = space.write(pairs, f"pairs-{k}")
        links = confirm(pairs, f"links-{k}")
        n_pairs, n_links = pairs.count(), links.count()
        going = k + 1 < MOST_ROUNDS and n_links > 0 and GOING * n_links >= n_pairs
        if n_links:
            stars = connected(space, stars.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links), f"stars-{k}")
        if not hub_round:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        rest = members.where(~F.exists("hubs", lambda h: h["item"] == F.col("item")) & (F.col("size") > 2)).select("key", "item", "info", "degree").join(stars, F.col("item") == F.col("u"), "left")
        k += 1
        active = space.write(rest.select("key", "item", "info", "degree", F.coalesce("v", "item").alias("component")), f"active-{k}")
    return stars
