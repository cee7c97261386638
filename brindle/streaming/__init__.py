"""Keyed state over streams: counters, stock and bills that change event by event.

A batch query has no later micro-batch to keep state for: its counters and stock are a sum, a count and a sorted segmented
scan, whose work grows with the rows and not with calls to a state store for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import Segments, Stock
from .processors import BillKeeper, SaleKeeper, StockKeeper, VoteKeeper

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_state_store(spark: SparkSession) -> None:
    """Value and map state live in RocksDB stores; the session is set to them where it has Spark's default."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKSDB)
    spark.streams  # noqa: B018  a batch query finds the coordinator of its stores once the session's streams are there


def _keyed(rows: DataFrame, key: str, order: list[str]) -> GroupedData:
    """Rows by key.  A batch query gets each key's rows in order; a stream sorts those of a micro-batch in the processor."""
    if not rows.isStreaming and order:
        rows = rows.repartition(key).sortWithinPartitions(key, *order)
    return rows.groupBy(key)


def _run(rows: DataFrame, key: str, order: list[str], processor, schema: str, initial: DataFrame | None, ttl_ms: int | None) -> DataFrame:
    need_state_store(rows.sparkSession)
    processor.presorted = not rows.isStreaming
    mode = "processingTime" if ttl_ms else "none"
    return _keyed(rows, key, order).transformWithStateInPandas(processor, schema, "Update", mode, initialState=initial.groupBy(key) if initial is not None else None)


def _begun(rows: DataFrame, key: str, initial: int | DataFrame | None, value: str, name: str) -> DataFrame:
    """rows, of a batch query, with what their keys begin with: a number for all, or the sums of ``value`` in a table, 0 without any."""
    if initial is None or isinstance(initial, int):
        return rows.withColumn(name, F.lit(initial or 0).cast("long"))
    sums = initial.groupBy(F.col(key).alias("__begun")).agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))
    return rows.join(sums, rows[key].eqNullSafe(sums["__begun"]), "left").drop("__begun").withColumn(name, F.coalesce(name, F.lit(0)))


def vote_stream(events: DataFrame, candidate: str, increment: str) -> DataFrame:
    """The counter of each candidate, for output mode update or complete: a sum, which needs no state of its own."""
    return events.groupBy(candidate).agg(F.sum(increment).alias("votes"))


def vote_states(events: DataFrame, candidate: str, increment: str, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(candidate, votes) of each counter that a micro-batch changes, output mode update.

    Counters start at 0, or as ``initial`` (candidate, votes) says; one that has not changed for ``ttl_ms`` starts anew.
    """
    rows = events.select(F.col(candidate).cast("string").alias("candidate"), F.col(increment).cast("long").alias("n"))
    begun = None if initial is None else initial.select(F.col("candidate").cast("string").alias("candidate"), F.col("votes").cast("long").alias("votes"))
    if not events.isStreaming:
        sums = rows.groupBy("candidate").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return _begun(sums, "candidate", begun, "votes", "votes").select("candidate", (F.col("votes") + F.col("n")).alias("votes"))
    return _run(rows, "candidate", [], VoteKeeper(ttl_ms), VoteKeeper.SCHEMA, begun, ttl_ms)


def stock_stream(sales: DataFrame, title: str, initial: int | DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stock of each title after every micro-batch of sales of one: (title, in_stock, sold, rejected), output mode update.

    ``initial`` is a number for all titles, or a table (title, in_stock) in which other titles have none.
    """
    rows = sales.select(F.col(title).cast("string").alias("title"))
    begun = None if isinstance(initial, int) else initial.select(F.col("title").cast("string").alias("title"), F.col("in_stock").cast("long").alias("in_stock"))
    if not sales.isStreaming:
        asked = _begun(rows.groupBy("title").agg(F.count("*").alias("asked")), "title", initial if begun is None else begun, "in_stock", "in_stock")
        sold = F.greatest(F.lit(0), F.least("in_stock", "asked")).cast("long")
        return asked.select("title", (F.col("in_stock") - sold).alias("in_stock"), sold.alias("sold"), (F.col("asked") - sold).alias("rejected"))
    return _run(rows, "title", [], StockKeeper(initial if isinstance(initial, int) else 0, ttl_ms), StockKeeper.SCHEMA, begun, ttl_ms)


def sale_stream(sales: DataFrame, title: str, order: str, initial: int | DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(title, at, in_stock, error) for every sale, by ``order`` within a micro-batch; ``initial`` as in ``stock_stream``."""
    rows = sales.select(F.col(title).cast("string").alias("title"), F.col(order).cast("long").alias("at"))
    begun = None if isinstance(initial, int) else initial.select(F.col("title").cast("string").alias("title"), F.col("in_stock").cast("long").alias("in_stock"))
    if not sales.isStreaming:
        stocked = _begun(rows, "title", initial if begun is None else begun, "in_stock", "stock").withColumn("change", F.lit(-1).cast("long"))
        return Segments(stocked, ["title"], ["at"]).scan(Stock("stock", "change")).select("title", "at", "in_stock", "error")
    return _run(rows, "title", ["at"], SaleKeeper(initial if isinstance(initial, int) else 0, ttl_ms), SaleKeeper.SCHEMA, begun, ttl_ms)


def bill_stream(ops: DataFrame, key: str, order: str, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The bill of each key after every micro-batch of rows (op, item, unit), by ``order`` within the batch.

    Rows (key as text, item, quantity, accepted) of all items on the bill, output mode update; a bill without items
    is one row with a null item.  Only quantities by item and the number of accepted ops are kept, not the ops.
    ``initial`` has lines (key, item, quantity) of bills that go on; lines that have not changed for ``ttl_ms`` are dropped.
    """
    rows = ops.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), "op", "item", "unit")
    begun = None if initial is None else initial.select(F.col("key").cast("string").alias("key"), "item", F.col("quantity").cast("long").alias("quantity"))
    return _run(rows, "key", ["at"], BillKeeper(ttl_ms), BillKeeper.SCHEMA, begun, ttl_ms)
