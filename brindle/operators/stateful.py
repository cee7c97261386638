"""State machines: folds over ordered arrays, closed forms, scans over rows in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import UNITS, new_bill, units
from ..functions.columns import col, long, num
from ..functions.decisions import integer_division
from .segments import Fold, RunningTotal, Segments, Stock, first_rows

OPS = "array<struct<op:string,item:string,unit:string>>"


def apply_bill_op(bill: Column, op: Column) -> Column:
    """Struct of the bill after one op (add or remove) and whether it was accepted.

    Adding takes a known unit.  Removing takes an item on the bill, a known unit
    and a quantity that is there; an item that comes to 0 leaves the bill.
    """
    amount, there = F.try_element_at(units(), op["unit"]), F.try_element_at(bill, op["item"])
    after = F.when(op["op"] == "add", F.coalesce(there, long(0)) + amount).when(there >= amount, there - amount)
    accepted = F.coalesce(after.isNotNull(), F.lit(False))
    rest = F.map_filter(bill, lambda k, _: k != op["item"])
    changed = F.when(after == 0, rest).otherwise(F.map_concat(rest, F.create_map(op["item"], after)))
    return F.struct(F.when(accepted, changed).otherwise(bill).alias("bill"), accepted.alias("accepted"))


def fold_bill(ops: Column | str) -> Column:
    """Struct of the bill after an ordered array of ops on an empty one, and the number of accepted ops."""

    def step(state: Column, op: Column) -> Column:
        done = apply_bill_op(state["bill"], op)
        return F.struct(done["bill"].alias("bill"), (state["accepted"] + done["accepted"].cast("long")).alias("accepted"))

    return F.aggregate(col(ops), F.struct(new_bill().alias("bill"), long(0).alias("accepted")), step)


#: Pieces of a bill function that are kept; what lies between the lower and the upper ones is worked out when it is needed.
PIECES = 4096


class BillLine(Fold):
    """The quantity of one item after each op, whether the op was accepted, and the op's number from 1.

    A line that is 0 is off the bill and has a null quantity.  What ops do to a quantity q is q plus a whole number that
    depends on where q lies: adding moves all of them, removing ``a`` splits pieces where what is left comes to ``a``.
    """

    def __init__(self, op: str, unit: str):
        self.columns = [op, unit]
        self.results = [("quantity", pa.int64(), "bigint"), ("accepted", pa.bool_(), "boolean"), ("step", pa.int64(), "bigint")]

    def start(self, values: list[pa.Array], at: int) -> tuple[int, int]:
        return 0, 0

    @staticmethod
    def _amounts(values: list[pa.Array]) -> np.ndarray:
        """What each op adds (above 0) or removes (below 0); 0 for unknown units."""
        table = np.array([*UNITS.values(), 0])
        amount = table[pc.fill_null(pc.index_in(values[1], value_set=pa.array(list(UNITS))), len(UNITS)).to_numpy(zero_copy_only=False)]
        return np.where(pc.fill_null(pc.equal(values[0], "add"), False).to_numpy(zero_copy_only=False), amount, -amount)

    def extend(self, known: tuple | None, values: list[pa.Array], n: int) -> tuple:
        begins, shift, sure, count = known or (np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool), 0)
        added = 0
        for amount in self._amounts(values).tolist():
            if amount >= 0:
                added += amount
                continue
            need = -amount - added - shift  # a quantity of at least this much is enough, in each piece
            ends = np.append(begins[1:], np.iinfo(np.int64).max)
            split = sure & (need > begins) & (need < ends)
            shift = np.where(sure & (need <= begins), shift + amount, shift)
            if split.any():
                at = np.flatnonzero(split)
                begins, sure = np.insert(begins, at + 1, need[at]), np.insert(sure, at + 1, True)
                shift = np.insert(shift, at + 1, shift[at] + amount)
                same = np.append(False, (shift[1:] == shift[:-1]) & sure[1:] & sure[:-1])
                if same.any():
                    begins, shift, sure = begins[~same], shift[~same], sure[~same]
                if len(begins) > PIECES:
                    low, high = PIECES // 2, len(begins) - PIECES // 4
                    keep = np.r_[: low + 1, high : len(begins)]
                    begins, shift, sure = begins[keep], shift[keep], sure[keep]
                    sure[low] = False
        return begins, shift + added, sure, count + n

    def apply(self, known: tuple, state: tuple[int, int]) -> tuple[int, int] | None:
        begins, shift, sure, count = known
        at = int(np.searchsorted(begins, state[0], side="right")) - 1
        return (state[0] + int(shift[at]), state[1] + count) if sure[at] else None

    def replay(self, state: tuple[int, int] | None, values: list[pa.Array], begins: np.ndarray, n: int) -> tuple[list[pa.Array], tuple[int, int]]:
        quantity, before = state or (0, 0)
        out, accepted, fresh = np.zeros(n, np.int64), np.zeros(n, bool), set(begins.tolist())
        for i, amount in enumerate(self._amounts(values).tolist()):
            if i in fresh:
                quantity = 0
            if amount and quantity + amount >= 0:
                quantity += amount
                accepted[i] = True
            out[i] = quantity
        step = np.arange(1, n + 1) - first_rows(begins, n)
        step[: int(begins[0]) if len(begins) else n] += before
        return [pa.array(out, mask=out == 0), pa.array(accepted), pa.array(step)], (quantity, int(step[-1]))


def bill_events(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every op of rows (key, op, item, unit) with the quantity of its item after it and whether it was accepted."""
    return Segments(df, [key, "item"], order).scan(BillLine("op", "unit"))


def bill_lines(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, item, quantity, accepted) after all ops, in order; the quantity of an item that is off the bill is null."""
    events = bill_events(df.select(key, *[c for c in order if c != key], *[c for c in ("op", "item", "unit") if c not in order]), key, order)
    return events.groupBy(key, "item").agg(F.max_by("quantity", "step").alias("quantity"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def bills(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The bill of each key from rows (op, item, unit), taken in order, and its accepted ops; null items are not on the map."""
    line = F.when(F.col("quantity").isNotNull() & F.col("item").isNotNull(), F.struct("item", "quantity"))
    lines = F.map_concat(new_bill(), F.map_from_entries(F.collect_list(line)).cast("map<string,bigint>"))
    return bill_lines(df, key, order).groupBy(key).agg(lines.alias("bill"), F.sum("accepted").alias("accepted"))


# ---- votes ------------------------------------------------------------------------------------------------------


def vote_counter(initial: int | Column) -> Column:
    return long(num(initial))


def vote_count(counter: Column | str) -> Column:
    """0 for no counter."""
    return F.coalesce(col(counter), long(0))


def increment_votes(counter: Column | str, by: int | Column) -> Column:
    return col(counter) + num(by)


def running_votes(df: DataFrame, candidate: str, order: list[str], increment: str) -> DataFrame:
    """The counter of each candidate after each row; rows without an increment count as 0."""
    return Segments(df, [candidate], order).scan(RunningTotal(increment, "votes"))


def election_result(name: Column | str, votes: Column | str) -> Column:
    return F.struct(col(name).alias("name"), long(col(votes)).alias("votes"))


def decrement_votes(results: Column | str, candidate: str | Column) -> Column:
    """The map with one vote less for a candidate; one that isn't there gets -1."""
    key, m = (F.lit(candidate) if isinstance(candidate, str) else candidate), col(results)
    less = F.coalesce(F.try_element_at(m, key), long(0)) - 1
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, less))


# ---- cars ----------------------------------------------------------------------------------------------------------


def new_car(speed: Column | str, drain: Column | str) -> Column:
    return F.struct(long(col(speed)).alias("speed"), long(col(drain)).alias("drain"), long(100).alias("battery"), long(0).alias("distance"))


def new_track(distance: Column | str) -> Column:
    return F.struct(long(col(distance)).alias("distance"))


def drive(car: Column | str, times: int | Column = 1, spare: bool = True) -> Column:
    """The car after driving so often, as far as the battery goes.

    With ``spare`` a drive needs more battery than it drains, otherwise as much.
    A car without drain always drives.
    """
    car, n = col(car), long(num(times))
    most = integer_division(car["battery"] - (1 if spare else 0), car["drain"])
    drives = F.when(car["drain"] > 0, F.greatest(long(0), F.least(n, most))).otherwise(n)
    return F.struct(car["speed"].alias("speed"), car["drain"].alias("drain"), (car["battery"] - drives * car["drain"]).alias("battery"), (car["distance"] + drives * car["speed"]).alias("distance"))


def sell_one(in_stock: Column | str) -> Column:
    """Struct of the stock after a sale and its error, if there is none left."""
    stock = col(in_stock)
    return F.struct(F.when(stock >= 1, stock - 1).otherwise(stock).alias("in_stock"), F.when(stock < 1, "out_of_stock").alias("error"))


def sale_events(df: DataFrame, key: str, order: list[str], stock: str, change: str) -> DataFrame:
    """Every sale of one (change -1) and delivery (change 1 or more), with the stock after it and the error of a sale without any."""
    return Segments(df, [key], order).scan(Stock(stock, change))
