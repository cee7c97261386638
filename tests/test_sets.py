"""Containers and filters against Python sets, and false positives against the formula."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import bits
from brindle.operators import sets


def chosen(seed):
    """Sparse, dense and consecutive positions, and ones far apart."""
    rnd = random.Random(seed)
    out = {rnd.randrange(32768) for _ in range(100)} | {32768 + x for x in range(32768) if rnd.random() < 0.4} | set(range(70000, 95000)) | {2**40 + 5, 2**62}
    return out | {98304 + rnd.randrange(32768) for _ in range(2047)} | {131072, 163839, 163840}


@pytest.mark.parametrize("size", [None, 90_000])
def test_containers(spark, size):
    held = chosen(1)
    frame = spark.createDataFrame([(p,) for p in [*held, *list(held)[:50], -1, -64]] + [(None,)], "p bigint").repartition(6)
    got = sets.BitSet.of(frame, "p", size)
    most = math.inf if size is None else bits.capacity(size)
    inside = {p for p in held if p < most}
    assert got.count().first()[0] == len(inside)
    rnd = random.Random(2)
    probes = {rnd.randrange(200_000) for _ in range(3000)} | {2**40 + 5, 2**40 + 6, 2**62, -3, -32768, 32767, 32768, 65535, 65536}
    asked = spark.createDataFrame([(p, "x") for p in probes] + [(None, "x")], "p bigint, bits string")
    want = {p: (p in inside) if 0 <= p < most else None for p in probes} | {None: None}
    found = got.test(asked, "p")
    assert found.columns == ["p", "bits", "there"] and {r.p: r.there for r in found.collect()} == want
    gone = {p for p in held if p % 3 == 0} | {1, 2, 3, 2**62}
    left = got.cleared(spark.createDataFrame([(p,) for p in gone] + [(-9,), (None,)], "p bigint"), "p")
    assert left.count().first()[0] == len(inside - gone)
    assert {r.p for r in left.test(asked, "p").where("there").collect()} == (inside - gone) & probes
    assert got.cleared(frame, "p").rows.count() == 0 and sets.BitSet.of(frame.limit(0), "p").count().first()[0] == 0


def test_kinds_by_density(spark):
    got = {r.kind: r for r in sets.BitSet.of(spark.createDataFrame([(p,) for p in chosen(1)], "p bigint"), "p").sizes().collect()}
    assert set(got) == {"places", "runs", "bitmap"} and got["bitmap"].bytes == 4096 * got["bitmap"].containers
    assert got["runs"].bytes == 4 and got["runs"].positions == 25000 and got["places"].bytes == 2 * got["places"].positions
    rows = sets.BitSet.of(spark.createDataFrame([(p,) for p in chosen(1)], "p bigint"), "p").rows.where("bits is not null")
    assert all(r[0] == r[1] for r in rows.select(F.bitmap_count("bits"), "n").collect())


@pytest.mark.parametrize(("m", "n"), [(1 << 16, 9000), (1 << 17, 9000), (200_003, 30_000)])
def test_false_positives_are_as_the_formula_says(spark, m, n):
    bloom = sets.BloomFilter(m, [bits.fnv1a, lambda c: F.abs(F.xxhash64(c) % (1 << 40)), lambda c: F.abs(F.xxhash64(c, F.lit(1)) % (1 << 40))])
    frame = spark.range(4 * n).select(F.concat(F.lit("key "), "id").alias("s"), "id")
    got = bloom.contains(frame, "s", bloom.of(frame.where(f"id < {n}"), "s"))
    counted = got.groupBy((F.col("id") < n).alias("member")).agg(F.avg(F.col("maybe").cast("int")).alias("share")).collect()
    shares = {r.member: r.share for r in counted}
    want = (1 - math.exp(-3 * n / m)) ** 3
    assert shares[True] == 1 and abs(shares[False] - want) < 4 * math.sqrt(want / (3 * n)) + 0.05 * want


def test_all_three_ways_agree(spark, monkeypatch):
    words = spark.createDataFrame([(f"w{i}",) for i in range(400)] + [(None,)], "s string")
    bloom = sets.BloomFilter(5000, [bits.fnv1, bits.fnv1a])
    some = bloom.of(words.where("s < 'w2'"), "s")
    ways = []
    for scalar, packed in ((1 << 16, 1 << 28), (1, 1 << 28), (1, 1)):
        monkeypatch.setattr(sets, "SCALAR_BITS", scalar)
        monkeypatch.setattr(sets, "PACKED_BITS", packed)
        ways.append({r.s: r.maybe for r in bloom.contains(words, "s", some).collect()})
    assert ways[0] == ways[1] == ways[2] and ways[0][None] is None and sum(map(bool, ways[0].values())) < 300


def test_filter_before_a_join(spark):
    small = spark.range(0, 90_000, 9).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    large = spark.range(90_000).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") * 2).alias("v"))
    held = sets.BlockedFilter.of(small, "k")
    assert len(held.words) * 64 <= 12 * 10_000 and len(held.words) % 8 == 0
    maybe = large.where(held.maybe("k", large))
    members = large.join(small, "k", "left_semi").count()
    assert members < maybe.count() < members + 0.02 * 90_000
    got = sets.filtered_join(large, small, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, large.join(small, "k").collect())) and got.columns == ["k", "v", "id"]
    assert sets.filtered_join(large, small, "k", "left_semi").count() == members
    assert sets.filtered_join(large, small.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        sets.filtered_join(large, small, "k", "left")
