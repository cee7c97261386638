"""Streams that stop, start again from their checkpoint and end up with what a batch query says."""

import random
import time

import pytest

from brindle.functions.arrays import UNITS
from brindle.operators import stateful
from brindle.streaming import bill_stream, sale_stream, stock_stream, vote_states, vote_stream


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[("a", 1), ("a", 2), ("b", 1)], [("a", 1), ("b", 4)]]
    for rows in batches:
        spark.createDataFrame(rows, "title string, n bigint").coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema("title string, n bigint").option("maxFilesPerTrigger", 1).parquet(source)
    votes = vote_stream(events, "title", "n").writeStream.format("memory").queryName("votes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    stock = stock_stream(events, "title", 2).writeStream.format("memory").queryName("stock").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    for q in (votes, stock):
        q.processAllAvailable()
        q.stop()
    assert {r.title: r.votes for r in spark.table("votes").collect()} == {"a": 4, "b": 5}
    last = {t: spark.table("stock").where(f"title = '{t}'").orderBy("rejected", "sold").collect()[-1] for t in "ab"}
    assert tuple(last["a"])[1:] == (0, 2, 1) and tuple(last["b"])[1:] == (0, 2, 0)


SCHEMA = "at long, k string, op string, item string, unit string, n long"


def operations(seed, n=240):
    rnd = random.Random(seed)
    return [(i, rnd.choice("aab"), rnd.choice(["add", "remove"]), rnd.choice(["peas", "corn", None]), rnd.choice([*UNITS, "crate"]), rnd.randint(0, 5)) for i in range(n)]


def restarted(spark, tmp_path, rows, build):
    """What a stream puts out that reads four files, stopped and started again after two of them."""
    source, out = str(tmp_path / "in"), []
    step = len(rows) // 4
    for half in (0, 1):
        for i in (0, 1):
            at = (2 * half + i) * step
            spark.createDataFrame(random.Random(at).sample(rows[at : at + step], step), SCHEMA).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.01)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = build(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: out.append((n, df.collect()))).start()
        query.processAllAvailable()
        query.stop()
    assert [n for n, _ in out] == [0, 1, 2, 3]
    return [r for _, batch in out for r in batch], [batch for _, batch in out]


def test_bills_go_on_after_a_restart(spark, tmp_path):
    rows = operations(1)
    begun = spark.createDataFrame([("a", "peas", 30), ("z", "corn", 3)], "key string, item string, quantity long")
    _, batches = restarted(spark, tmp_path, rows, lambda s: bill_stream(s, "k", "at", begun))
    first = [(-1, "a", "add", "peas", unit, 0) for unit in ("dozen", "dozen", "half_of_a_dozen")]
    frame = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(first + rows)], SCHEMA)
    want = {(r.k, r.item, r.quantity) for r in stateful.bill_lines(frame, "k", ["at"]).collect() if r.quantity}
    accepted = {r.k: r.accepted - 3 * (r.k == "a") for r in stateful.bills(frame, "k", ["at"]).collect()}
    last = {}
    for batch in batches:
        for key in {r.key for r in batch}:
            last[key] = [r for r in batch if r.key == key]
    assert {(r.key, r.item, r.quantity) for rows in last.values() for r in rows if r.quantity} == want
    assert {r.key: r.accepted for rows in last.values() for r in rows} == accepted


def test_votes_and_stock_go_on_after_a_restart(spark, tmp_path):
    rows = operations(2)
    begun = spark.createDataFrame([("a", 100)], "candidate string, votes long")
    got, _ = restarted(spark, tmp_path, rows, lambda s: vote_states(s, "k", "n", begun))
    total = {k: sum(r[5] for r in rows if r[1] == k) + 100 * (k == "a") for k in "ab"}
    assert {r.candidate: r.votes for r in sorted(got, key=lambda r: r.votes)} == total


def test_a_row_per_sale_after_a_restart(spark, tmp_path):
    rows = operations(3)
    stock = {"a": 25, "b": 500}
    begun = spark.createDataFrame(list(stock.items()), "title string, in_stock long")
    got, _ = restarted(spark, tmp_path, rows, lambda s: sale_stream(s, "k", "at", begun))
    frame = spark.createDataFrame([(r[0], r[1], stock[r[1]], -1) for r in rows], "at long, k string, stock long, change long")
    want = {(r.at, r.k, r.in_stock, r.error) for r in stateful.sale_events(frame, "k", ["at"], "stock", "change").collect()}
    assert {(r.at, r.title, r.in_stock, r.error) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("ttl", [None, 1])
def test_state_that_expires(spark, tmp_path, ttl):
    source = str(tmp_path / "in")
    last = {}
    for half in (0, 1):
        spark.createDataFrame([("a", 2)], "k string, n long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n long").parquet(source)
        query = vote_states(stream, "k", "n", ttl_ms=ttl).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: last.update({r.candidate: r.votes for r in df.collect()})).start()
        until = time.time() + 25  # with state that expires batches go on without rows
        while time.time() < until and not any(p.numInputRows for p in query.recentProgress):
            time.sleep(0.1)
        query.stop()
        time.sleep(0.05)
    assert last == {"a": 2 if ttl else 4}


def test_batch_states_take_rows_in_order(spark):
    rows = operations(4, 3000)
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), SCHEMA).repartition(7)
    got = {(r.key, r.item): r.quantity for r in bill_stream(frame, "k", "at").collect() if r.quantity}
    assert got == {(r.k, r.item): r.quantity for r in stateful.bill_lines(frame, "k", ["at"]).collect() if r.quantity}


def test_batches_without_a_state_store(spark):
    """Sales, stock and votes of a batch query: null and unknown titles, negative, repeated and null stock, a title over several tasks."""
    sales = [("a", i) for i in range(400)] + [("b", 1), ("b", 2), ("c", 1), (None, 1), (None, 2), ("d", 5), ("e", None), ("e", 3)]
    begun = [("a", 150), ("a", 7), ("b", -2), (None, 1), ("d", None), ("e", 1), ("unsold", 9)]
    rows = spark.createDataFrame(random.Random(6).sample(sales, len(sales)), "k string, at long").repartition(5)
    start = spark.createDataFrame(begun, "title string, in_stock long")
    for initial in (start, 3):
        stock, want = {}, set()
        for title, at in sorted(sales, key=lambda s: (s[0] or "", -1 if s[1] is None else s[1])):
            left = stock.setdefault(title, initial if initial == 3 else sum(n or 0 for t, n in begun if t == title))
            want.add((title, at, left - (left >= 1), None if left >= 1 else "out_of_stock"))
            stock[title] = left - (left >= 1)
        sold = sale_stream(rows, "k", "at", initial)
        assert {tuple(r) for r in sold.collect()} == want and sold.count() == len(sales)
        totals = stock_stream(rows, "k", initial)
        got = {r.title: (r.in_stock, r.sold, r.rejected) for r in totals.collect()}
        errors = {t: sum(w[0] == t and w[3] is not None for w in want) for t in stock}
        asked = {t: sum(s[0] == t for s in sales) for t in stock}
        assert got == {t: (stock[t], asked[t] - errors[t], errors[t]) for t in stock}
        assert totals.schema.simpleString() == "struct<title:string,in_stock:bigint,sold:bigint,rejected:bigint>"
        votes = vote_states(rows, "k", "at", start.withColumnsRenamed({"title": "candidate", "in_stock": "votes"}) if initial is start else None)
        assert {r.candidate: r.votes for r in votes.collect()} == {t: sum(s[1] or 0 for s in sales if s[0] == t) + sum(n or 0 for u, n in begun if u == t and initial is start) for t in stock}
        for frame in (sold, totals, votes):
            assert "TransformWithState" not in frame._jdf.queryExecution().toString()
