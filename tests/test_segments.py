"""Scans over rows in order against plain loops, with keys that span many partitions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.functions.arrays import UNITS
from brindle.operators import relational, stateful
from brindle.operators.segments import Position, RunningTotal, Segments, Stock


@pytest.fixture
def many(spark):
    """Many small partitions, so that a key spans them."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


KEYS = {"one key": lambda i, r: "a", "a hot key": lambda i, r: "a" if i % 3 else f"k{r.randint(0, 9)}", "small keys": lambda i, r: f"k{r.randint(0, 90)}", "null keys": lambda i, r: r.choice([None, "", "b"])}


@pytest.mark.parametrize("keys", KEYS)
def test_positions_and_totals(many, keys):
    rnd = random.Random(keys)
    rows = [(KEYS[keys](i, rnd), rnd.randint(0, 10**6), i, rnd.choice([None, 1, 2, -3])) for i in range(700)]
    frame = many.createDataFrame(rows, "k string, at long, i long, n long").repartition(3)
    seen, want, total = {}, {}, {}
    for k, _, i, n in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, r[1], r[2])):
        want[i] = (seen.get(k, 0), total.get(k, 0) + (n or 0))
        seen[k], total[k] = want[i][0] + 1, want[i][1]
    parts = Segments(frame, ["k"], ["at", "i"])
    assert parts.rows.rdd.getNumPartitions() > 5
    assert {r.i: r.p for r in parts.scan(Position("p")).collect()} == {i: w[0] for i, w in want.items()}
    assert {r.i: r.v for r in parts.scan(RunningTotal("n", "v")).collect()} == {i: w[1] for i, w in want.items()}
    weeks = {(r.k, r.week): int(r.total) for r in relational.tumbling_totals(frame.fillna(0, ["n"]), "k", ["at", "i"], "n").collect()}
    assert len(weeks) == sum(n // 7 for n in seen.values())


@pytest.mark.parametrize("keys", ["one key", "a hot key", "small keys"])
def test_sales(many, keys):
    rnd = random.Random(keys)
    stocks = {}
    rows = []
    for i in range(600):
        k = KEYS[keys](i, rnd)
        stocks.setdefault(k, rnd.choice([0, 1, 5, 40, -2, None]))
        rows.append((k, i, stocks[k], rnd.choice([-1, -1, -1, 2, None])))
    left, want = {}, {}
    for k, i, stock, change in rows:
        now = left.get(k, max(0, stock or 0))
        error = "out_of_stock" if change == -1 and now < 1 else None
        left[k] = now if error else now + (change or 0)
        want[i] = (left[k] + min(0, stock or 0), error)
    got = stateful.sale_events(many.createDataFrame(rows, "k string, i long, stock long, change long").repartition(4), "k", ["i"], "stock", "change")
    assert {r.i: (r.in_stock, r.error) for r in got.collect()} == want


def plain_bill(ops):
    bill, out = {}, []
    for key, op, item, unit in ops:
        amount, there = UNITS.get(unit), bill.get((key, item), 0)
        ok = amount is not None and (op == "add" or there >= amount)
        bill[key, item] = there + (0 if not ok else amount if op == "add" else -amount)
        out.append((bill[key, item] or None, ok))
    return out


@pytest.mark.parametrize("pieces", [4096, 6])
@pytest.mark.parametrize("adds", [0.3, 0.5, 0.7])
@pytest.mark.parametrize("keys", ["one key", "a hot key", "small keys"])
def test_bills(many, monkeypatch, keys, adds, pieces):
    """With few pieces partitions have to be walked through, one after the other."""
    monkeypatch.setattr(stateful, "PIECES", pieces)
    rnd = random.Random(f"{keys}{adds}")
    ops = [(KEYS[keys](i, rnd), "add" if rnd.random() < adds else "remove", rnd.choice(["peas", "peas", "peas", "corn", None]), rnd.choice([*UNITS, "crate", None])) for i in range(900)]
    frame = many.createDataFrame([(i, *op) for i, op in enumerate(ops)], "i long, k string, op string, item string, unit string").repartition(5)
    want = plain_bill(ops)
    assert {r.i: (r.quantity, r.accepted) for r in stateful.bill_events(frame, "k", ["i"]).collect()} == dict(enumerate(want))
    last = {(op[0], op[2]): q for op, (q, _) in zip(ops, want)}
    assert {(r.k, r.item): r.quantity for r in stateful.bill_lines(frame, "k", ["i"]).collect()} == last
    bills = {r.k: (r.bill, r.accepted) for r in stateful.bills(frame, "k", ["i"]).collect()}
    assert bills == {k: ({i: q for (of, i), q in last.items() if of == k and q and i}, sum(ok for op, (_, ok) in zip(ops, want) if op[0] == k)) for k in {op[0] for op in ops}}


def test_bill_function_equals_walking():
    rnd = random.Random(4)
    fold = stateful.BillLine("op", "unit")
    for _ in range(40):
        ops = [(rnd.choice(["add", "remove"]), rnd.choice([*UNITS, "crate"])) for _ in range(rnd.randint(1, 60))]
        values = [pa.array([o for o, _ in ops]), pa.array([u for _, u in ops])]
        cut = rnd.randint(0, len(ops) - 1)
        known = fold.extend(None, [v[: cut + 1] for v in values], cut + 1)
        known = fold.extend(known, [v[cut + 1 :] for v in values], len(ops) - cut - 1)
        for q in [0, 1, 3, 6, 9, 12, 119, 120, 121, 144, 1727, 1728, 5000, 10**6, *[rnd.randint(0, 4000) for _ in range(20)]]:
            assert fold.apply(known, (q, 0)) == fold.replay((q, 0), values, np.zeros(0, np.int64), len(ops))[1]


def test_empty_rows(many):
    none = many.createDataFrame([], "k string, at long, n long, stock long, change long")
    assert Segments(none, ["k"], ["at"]).scan(Position("p")).count() == 0
    assert stateful.sale_events(none, "k", ["at"], "stock", "change").columns == ["k", "at", "n", "stock", "change", "in_stock", "error"]
    assert Segments(none, ["k"], ["at"]).scan(Stock("stock", "change")).count() == 0


def test_names_that_are_replaced_and_odd_keys(many):
    frame = many.createDataFrame([(float("nan"), 1, "x"), (float("nan"), 2, "y"), (None, 3, "z"), (None, 4, "w"), (0.5, 5, "v")], "position double, at long, step string")
    got = Segments(frame, ["position"], ["at"]).scan(Position("step")).collect()
    assert {r.at: r.step for r in got} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0} and got[0].__fields__ == ["position", "at", "step"]


def test_totals_beyond_longs_are_errors(many):
    frame = many.createDataFrame([(1, i, 2**61) for i in range(3)], "k long, at long, n long")
    with pytest.raises(Exception, match="beyond 64 bits"):
        stateful.running_votes(frame, "k", ["at"], "n").collect()
