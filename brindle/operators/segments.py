"""Sorted segmented scans: running states of keys over rows in order, however many rows a key has.

Rows are dealt to range partitions by key and order, sorted there and checkpointed, so a key with very many rows spans
several tasks.  One narrow pass sums up what each partition does to the state of its last key; the driver carries these
states from partition to partition (one small row each); a second narrow pass replays the rows from what was carried.
Rows stream through both passes in Arrow batches, nothing is gathered by key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder

PART = "__part"


class Fold:
    """What a scan does with the rows of a key; ``columns`` are its inputs, ``results`` the fields it adds.

    ``start`` gives the state before the first row of a key, ``extend`` sums up more rows in a function of the state,
    ``apply`` works it out (None: it can't tell), and ``replay`` goes through rows: of several keys, if ``begins`` has
    the places where keys begin.  ``state`` is that of the first row's key; it is not used where a key begins at 0.  ``n``
    is the number of rows.
    """

    columns: list[str] = []
    results: list[tuple[str, pa.DataType, str]] = []

    def start(self, values: list[pa.Array], at: int) -> Any:
        return 0

    def extend(self, known: Any, values: list[pa.Array], n: int) -> Any:
        raise NotImplementedError

    def apply(self, known: Any, state: Any) -> Any:
        raise NotImplementedError

    def replay(self, state: Any, values: list[pa.Array], begins: np.ndarray, n: int) -> tuple[list[pa.Array], Any]:
        raise NotImplementedError


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Which rows, but for the first, differ from the one before; nulls are equal, as are NaNs."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        a, b = column[:-1], column[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            differ = pc.and_(differ, pc.invert(pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))))
        differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


class _Keys:
    """Where keys begin in the batches of one partition."""

    def __init__(self, many: int):
        self.many, self.last, self.first = many, None, None

    def begins(self, batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column(i) for i in range(self.many)]
        if self.last is None:
            self.first = repr([k[0].as_py() for k in keys])
            changes = np.concatenate(([True], _changes(keys)))
        else:
            changes = _changes([pa.concat_arrays([a, b]) for a, b in zip(self.last, keys)])
        self.last = [k[-1:] for k in keys]
        return np.flatnonzero(changes)

    def end(self) -> str:
        return repr([k[0].as_py() for k in self.last])


def first_rows(begins: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the place where its key begins; 0 for those of a key that began before."""
    at = np.zeros(n, np.int64)
    at[begins] = begins
    return np.maximum.accumulate(at)


class Segments:
    """Rows sorted by keys and order in partitions that stay as they are."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        checkpoint_folder(df.sparkSession)
        self.keys, self.names = keys, df.columns
        self.rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).checkpoint()

    def _states(self, fold: Fold) -> dict[int, Any]:
        """The state of the first key of each partition that began in an earlier one."""
        many = len(self.keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, known, whole, start, part = _Keys(many), None, True, None, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                part, begins = batch.column(many)[0].as_py(), keys.begins(batch)
                values, at = batch.columns[many + 1 :], 0
                if start is None:
                    start = fold.start(values, 0)
                    begins = begins[1:]
                if len(begins):
                    at = int(begins[-1])
                    whole, known, start = False, None, fold.start(values, at)
                known = fold.extend(known, [v[at:] for v in values], batch.num_rows - at)
            if keys.last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (keys.first, pa.string()), (keys.end(), pa.string()), (whole, pa.bool_()), (pickle.dumps((start, known)), pa.binary()))], names=["part", "first", "last", "whole", "known"])

        rows = self._inputs(fold).mapInArrow(run, "part int, first string, last string, whole boolean, known binary").collect()
        carried, now, key = {}, None, None
        for part, first, last, whole, known in sorted(rows):
            start, known = pickle.loads(known)
            if first == key:
                carried[part] = now
            before = now if whole and first == key else start
            now, key = fold.apply(known, before), last
            if now is None:
                now = self._walk(fold, part, before)
        return carried

    def _walk(self, fold: Fold, part: int, before: Any) -> Any:
        """The last state of a partition whose sum does not tell it: its rows are replayed, in one task."""
        many = len(self.keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, state, fresh = _Keys(many), before, True
            for batch in batches:
                if not batch.num_rows:
                    continue
                begins, values = keys.begins(batch), batch.columns[many + 1 :]
                if fresh:
                    begins, fresh = begins[1:], False
                at = int(begins[-1]) if len(begins) else 0
                state = fold.replay(state, [v[at:] for v in values], np.zeros(min(1, len(begins)), np.int64), batch.num_rows - at)[1]
            if not fresh:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

        return pickle.loads(self._inputs(fold).where(F.col(PART) == part).mapInArrow(run, "state binary").first()[0])

    def _inputs(self, fold: Fold) -> DataFrame:
        return self.rows.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(self.keys)], F.spark_partition_id().alias(PART), *[F.col(c).alias(f"__in{i}") for i, c in enumerate(fold.columns)])

    def scan(self, fold: Fold) -> DataFrame:
        """All rows with the fold's results."""
        carried, keys, names = self._states(fold), self.keys, self.names
        place = [names.index(c) for c in (*keys, *fold.columns)]
        many = len(keys)
        sent = self.rows.sparkSession.sparkContext.broadcast(carried)
        kept = [i for i, n in enumerate(names) if n not in {r[0] for r in fold.results}]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, state, fresh = _Keys(many), None, True
            for batch in batches:
                if not batch.num_rows:
                    continue
                inputs = [batch.column(i) for i in place]
                begins = seen.begins(pa.RecordBatch.from_arrays(inputs[:many], names=[str(i) for i in range(many)]))
                if fresh:
                    fresh, state = False, sent.value.get(batch.column(len(names))[0].as_py())
                    if state is not None:
                        begins = begins[1:]
                made, state = fold.replay(state, inputs[many:], begins, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names=[*[names[i] for i in kept], *[r[0] for r in fold.results]])

        fields = {f.name: f for f in self.rows.schema.fields}
        schema = ", ".join([f"`{names[i]}` {fields[names[i]].dataType.simpleString()}" for i in kept] + [f"`{n}` {t}" for n, _, t in fold.results])
        return self.rows.withColumn(PART, F.spark_partition_id()).mapInArrow(run, schema)


class Position(Fold):
    """The row number within the key, from 0."""

    def __init__(self, name: str):
        self.results = [(name, pa.int64(), "bigint")]

    def extend(self, known: int | None, values: list[pa.Array], n: int) -> int:
        return (known or 0) + n

    def apply(self, known: int, state: int) -> int:
        return state + known

    def replay(self, state: int | None, values: list[pa.Array], begins: np.ndarray, n: int) -> tuple[list[pa.Array], int]:
        at = np.arange(n) - first_rows(begins, n)
        if state is not None:
            at[: int(begins[0]) if len(begins) else n] += state
        return [pa.array(at)], int(at[-1]) + 1


class RunningTotal(Fold):
    """The sum of a column of whole numbers up to each row; nulls count as 0."""

    def __init__(self, column: str, name: str):
        self.columns, self.results = [column], [(name, pa.int64(), "bigint")]

    @staticmethod
    def _whole(values: list[pa.Array], known: int | None) -> np.ndarray:
        v = pc.fill_null(values[0].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        if float(np.abs(v.astype(np.float64)).sum()) + abs(known or 0) >= 2.0**62:
            raise OverflowError("running total beyond 64 bits")
        return v

    def extend(self, known: int | None, values: list[pa.Array], n: int) -> int:
        return (known or 0) + int(self._whole(values, known).sum())

    def apply(self, known: int, state: int) -> int:
        return state + known

    def replay(self, state: int | None, values: list[pa.Array], begins: np.ndarray, n: int) -> tuple[list[pa.Array], int]:
        total = np.concatenate(([0], np.cumsum(self._whole(values, state))))
        out = total[1:] - total[first_rows(begins, n)]
        if state is not None:
            out[: int(begins[0]) if len(begins) else n] += state
        return [pa.array(out)], int(out[-1])


class Stock(Fold):
    """Copies left after each sale of one (-1) or delivery (1 or more), and the error of a sale without any.

    What rows do to the stock is ``max(stock + c, m)``, and such functions follow each other as one more of them.  A
    negative stock has nothing to sell; its debt stays as it is, and deliveries are for sale at once.
    """

    def __init__(self, stock: str, change: str, left: str = "in_stock", error: str = "error"):
        self.columns, self.results = [stock, change], [(left, pa.int64(), "bigint"), (error, pa.string(), "string")]

    def start(self, values: list[pa.Array], at: int) -> int:
        return max(0, values[0][at].as_py() or 0)

    @staticmethod
    def _changes(values: list[pa.Array]) -> np.ndarray:
        return np.maximum(pc.fill_null(values[1].cast(pa.int64()), 0).to_numpy(zero_copy_only=False), -1)

    def extend(self, known: tuple[int, int] | None, values: list[pa.Array], n: int) -> tuple[int, int]:
        total = np.cumsum(self._changes(values))
        c, m = known or (0, 0)
        return c + int(total[-1]), max(m + int(total[-1]), int(total[-1] - total.min()))

    def apply(self, known: tuple[int, int], state: int) -> int:
        return max(state + known[0], known[1])

    def replay(self, state: int | None, values: list[pa.Array], begins: np.ndarray, n: int) -> tuple[list[pa.Array], int]:
        change, first = self._changes(values), first_rows(begins, n)
        stock = pc.fill_null(values[0].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        initial = np.maximum(stock, 0)[first]
        if state is not None:
            initial[: int(begins[0]) if len(begins) else n] = state
        total = np.concatenate(([0], np.cumsum(change)))
        since = total[1:] - total[first]
        step = int(np.abs(since).max(initial=0)) * 2 + 1  # keys further down lie below all earlier ones, so minima start anew
        key = np.cumsum(np.isin(np.arange(n), begins))
        least = np.minimum.accumulate(since - step * key) + step * key
        after = since + np.maximum(initial, -least)
        before = np.where(np.arange(n) == first, initial, np.concatenate((initial[:1], after[:-1])))
        refused = (change < 0) & (before < 1)
        return [pa.array(after + np.minimum(stock, 0)), pa.array(np.where(refused, "out_of_stock", None), pa.string())], int(after[-1])
