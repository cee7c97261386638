"""Connected components of an edge table, by alternating large and small stars.

Each round links every larger neighbour of a node, and then every smaller one,
to the least node that the node sees.  Minima are combined before the shuffle
and put back by a join, so no node's neighbours are ever gathered in one place;
rounds are cut by writing the edges to the shared folder.  At the fixed point
each node hangs on the least node of its component.

Edges between whole numbers are first contracted within tasks, each of which has
up to EDGES_AT_ONCE of them: what it sees of a component is a star then.  A table
of so few edges is done with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Edges that a task contracts.
EDGES_AT_ONCE = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with the edges u, v, of all nodes but those least ones."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v, top = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[u], top[v]), np.maximum(top[u], top[v])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            break
        u, v = u[apart], v[apart]
        np.minimum.at(top, high[apart], low[apart])
        while (top != top[top]).any():
            top = top[top]
    some = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[some], nodes[top[some]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        found = contracted(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * EDGES_AT_ONCE:
            held = [stars()]
            if held[0].num_rows > EDGES_AT_ONCE:  # hardly anything to contract
                yield held.pop()
    if held:
        yield stars()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def connected(space: Workspace, edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v) with v the least node of u's component, for all nodes u but that one.  Nodes are of any one ordered type."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if dict(now.dtypes)["u"] == "bigint":
        tasks = -(-edges.count() // EDGES_AT_ONCE) or 1
        now = now.coalesce(tasks).mapInArrow(_contract, "u long, v long")
        if tasks == 1:
            return space.write(now, name)
    now, before, k = space.write(now.distinct(), f"{name}-0"), None, 0
    mark = _mark(now)
    while mark != before and mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least.select("u", F.col("m").alias("v")).union(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        k, before = k + 1, mark
        now = space.write(small, f"{name}-{k}")
        mark = _mark(now)
    return now
