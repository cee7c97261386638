"""Plans, clashing column names, and values that whole batches must agree on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays, bits, numeric, text
from brindle.operators import relational, sets, stateful
from brindle.streaming import bill_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 5), (2, 30), (3, None)], "k int, v int").write.parquet(path)
    df = spark.read.parquet(path)
    kept, gone = relational.keep(df, F.col("v") > 25), relational.discard(df, F.col("v") > 25)
    assert "GreaterThan(v,25)" in plan(kept) and "LessThanOrEqual(v,25)" in plan(gone)
    assert [r.k for r in kept.collect()] == [2] and sorted(r.k for r in gone.collect()) == [1, 3]


def test_no_column_is_lost_or_left(spark):
    df = spark.createDataFrame([(1, 70, "a", "b", 3)], "id int, position int, word string, bits string, asked int")
    found = sets.BitSet.of(df, "position").test(df, "position")
    assert found.columns == [*df.columns, "there"] and tuple(found.first()) == (1, 70, "a", "b", 3, True)
    assert tuple(relational.fix_alternate(df, "id", ["word"], "asked").first()) == (1, 70, "a", "b", 4)
    sold = relational.sell(df.withColumn("n", F.lit(2).cast("long")), df.select("id"), "id", "n").first()
    assert (sold.asked, sold.n, sold.sold) == (3, 1, 1)
    totals = relational.tumbling_totals(spark.createDataFrame([(1, i, i) for i in range(7)], "v int, position int, week int"), "v", ["position"], "week")
    assert [(r.v, r.week, int(r.total)) for r in totals.collect()] == [(1, 1, 21)]


@pytest.mark.parametrize("m", [1, 64, 1000, 1 << 17])
def test_bloom_without_cross_join(spark, m):
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "bit string")
    bloom = sets.BloomFilter(m, [bits.fnv1, bits.fnv1a])
    got = bloom.contains(df, "bit", bloom.of(df.where("bit < 'w3'"), "bit"))
    assert got.columns == ["bit", "maybe"] and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    maybe = {r.bit: r.maybe for r in got.collect()}
    assert all(maybe[w] for w in words if w < "w3") and (m < 1000 or not all(maybe[w] for w in words))


def test_one_decimal_is_of_the_exact_value(spark):
    rnd = random.Random(1)
    values = [0.05, 0.15, 0.25, 0.35, 1e15 + 0.5, -0.04, -2.5, 1e22, 0.0] + [round(rnd.uniform(-1e4, 1e4), 2) + 0.0 for _ in range(500)] + [rnd.uniform(-1e6, 1e6) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(text.one_decimal("x").alias("s")).collect()
    assert [r.s for r in got] == [f"{v:.1f}" for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(text.one_decimal("x").alias("s"))
    assert [r.s for r in odd.collect()] == ["NaN", "+Inf", "-Inf", None]


def test_prime_factors_of_batches(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(1, 10**6, 300)] + [int(x) for x in rng.integers(1, 2**62, 40)] + [1, 2, 2999 * 2999, 3001 * 3001, 9_006_001, 0, -4]
    got = [r.f for r in spark.createDataFrame([(v,) for v in values], "n bigint").select(numeric.prime_factors("n").alias("f")).collect()]
    for v, f in zip(values, got):
        assert (f is None) == (v < 1)
        if f is not None:
            assert int(np.prod([1, *map(int, f)], dtype=object)) == v and list(f) == sorted(f) and all(p > 1 and numeric._is_prime(p) if p > 40 else p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37) for p in f)


def test_words_counted_raw_equal_words_split(spark):
    texts = ["It's 'quoted' a-b  A b! $5.00 'tis''  ÉÉ é", "", None, "!!!", " x ", "a’b don't DON'T"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "k int, __part string").withColumnRenamed("__part", "t")
    got = {(r.k, r.word): r.n for r in relational.word_counts(df, "t", ["k"]).collect()}
    want = {}
    for r in df.select("k", F.explode(text.word_split("t")).alias("w")).collect():
        want[r.k, r.w] = want.get((r.k, r.w), 0) + 1
    assert got == want and got


def test_bill_stream_equals_the_fold(spark, tmp_path):
    rnd, source, rows = random.Random(3), str(tmp_path / "in"), []
    for i in range(4):
        batch = [(rnd.choice("ab"), 100 * i + j, rnd.choice(["add", "add", "remove"]), rnd.choice(["peas", "corn"]), rnd.choice([*arrays.UNITS, "crate"])) for j in range(12)]
        rows += batch
        spark.createDataFrame(batch, "k string, n bigint, op string, item string, unit string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, n bigint, op string, item string, unit string").option("maxFilesPerTrigger", 1).parquet(source)
    query = bill_stream(stream, "k", "n").writeStream.format("memory").queryName("bills").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("bills").collect():
        last.setdefault((r.key, r.accepted), {})[r.item] = r.quantity
    folded = stateful.bills(spark.createDataFrame(rows, "k string, n bigint, op string, item string, unit string"), "k", ["n"]).collect()
    for r in folded:
        assert {k: v for k, v in last[r.k, r.accepted].items() if k is not None} == r.bill
