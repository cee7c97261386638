"""State processors: what is kept for a key between micro-batches, and what a micro-batch does to it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.arrays import UNITS


class _Keeper(StatefulProcessor):
    """State with or without a time to live in milliseconds."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms, self.presorted = ttl_ms, False

    def _value(self, handle: StatefulProcessorHandle, name: str, schema: str) -> Any:
        return handle.getValueState(name, schema, self.ttl_ms) if self.ttl_ms else handle.getValueState(name, schema)

    def close(self) -> None:
        pass


class VoteKeeper(_Keeper):
    """A counter, which each row adds to."""

    SCHEMA = "candidate string, votes long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = self._value(handle, "votes", "votes long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.votes.update((int(initialState["votes"].fillna(0).sum()),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        votes = (self.votes.get()[0] if self.votes.exists() else 0) + sum(int(part["n"].fillna(0).sum()) for part in rows)
        self.votes.update((votes,))
        yield pd.DataFrame({"candidate": [key[0]], "votes": [votes]})


class StockKeeper(_Keeper):
    """Copies in stock, sold and asked for in vain; each row is a sale of one."""

    SCHEMA = "title string, in_stock long, sold long, rejected long"

    def __init__(self, initial: int = 0, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = self._value(handle, "stock", "in_stock long, sold long, rejected long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.state.update((int(initialState["in_stock"].fillna(0).sum()), 0, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stock, sold, rejected = self.state.get() if self.state.exists() else (self.initial, 0, 0)
        asked = sum(len(part) for part in rows)
        now = max(0, min(stock, asked))
        self.state.update((stock - now, sold + now, rejected + asked - now))
        yield pd.DataFrame({"title": [key[0]], "in_stock": [stock - now], "sold": [sold + now], "rejected": [rejected + asked - now]})


class SaleKeeper(_Keeper):
    """Copies in stock; a row for each sale of one."""

    SCHEMA = "title string, at long, in_stock long, error string"

    def __init__(self, initial: int = 0, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = self._value(handle, "stock", "in_stock long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.stock.update((int(initialState["in_stock"].fillna(0).sum()),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stock = self.stock.get()[0] if self.stock.exists() else self.initial
        for part in _in_order(rows, self.presorted):
            left, errors = [], []
            for _ in range(len(part)):
                errors.append(None if stock >= 1 else "out_of_stock")
                stock -= stock >= 1
                left.append(stock)
            yield pd.DataFrame({"title": key[0], "at": part["at"].to_numpy(), "in_stock": left, "error": pd.Series(errors, dtype=object)})
        self.stock.update((stock,))


class BillKeeper(_Keeper):
    """Quantities by item, and the number of ops that were accepted."""

    SCHEMA = "key string, item string, quantity long, accepted long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ("lines", "named boolean, item string", "quantity long")
        self.lines = handle.getMapState(*kinds, self.ttl_ms) if self.ttl_ms else handle.getMapState(*kinds)
        self.accepted = self._value(handle, "accepted", "n long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        for item, quantity in zip(initialState["item"], initialState["quantity"]):
            self.lines.updateValue(_line(item), (int(quantity),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bill = {tuple(k): v[0] for k, v in self.lines.iterator()}
        accepted, touched = self.accepted.get()[0] if self.accepted.exists() else 0, set()
        for part in _in_order(rows, self.presorted):
            for op, item, unit in zip(part["op"], part["item"], part["unit"]):
                line, amount = _line(item), UNITS.get(unit)
                there = bill.get(line, 0)
                if amount is None or op != "add" and there < amount:
                    continue
                bill[line] = there + (amount if op == "add" else -amount)
                accepted += 1
                touched.add(line)
        for line in touched:
            if bill[line]:
                self.lines.updateValue(line, (bill[line],))
            else:
                del bill[line]
                if self.lines.containsKey(line):
                    self.lines.removeKey(line)
        self.accepted.update((accepted,))
        items = sorted(bill) or [None]
        names = [line[1] if line and line[0] else None for line in items]
        yield pd.DataFrame({"key": [key[0]] * len(items), "item": names, "quantity": pd.array([bill.get(line) for line in items], "Int64"), "accepted": [accepted] * len(items)})


def _line(item: Any) -> tuple[bool, str]:
    return (False, "") if item is None or item != item else (True, item)


def _in_order(rows: Iterator[pd.DataFrame], presorted: bool) -> Iterator[pd.DataFrame]:
    """The rows of a key by ``at``: a batch query's come so, a micro-batch, which is bounded, is sorted here."""
    if presorted:
        yield from rows
    elif parts := list(rows):
        yield pd.concat(parts).sort_values("at", kind="stable")
