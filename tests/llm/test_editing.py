"""Edit distances of many pairs at once against those of one pair, and keys with the same lines."""

import random

import numpy as np
import pytest

from brindle.llm import components, editing, hubs, lines
from brindle.llm.workspace import Workspace


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "日本語文字列", "a😀é"])
def test_many_pairs_at_once(letters):
    rnd = random.Random(len(letters))
    text = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    xs, ys = [], []
    for _ in range(800):
        x = text(rnd.choice([0, 1, 5, 63, 64, 65, 128, 129, 190]))
        y = list(x)
        for _ in range(rnd.randint(0, len(x) // 3)):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.randint(0, 2)] = text(rnd.randint(0, 2))
        xs.append(x), ys.append("".join(y) if rnd.random() < 0.8 else text(len(x)))
    limits = np.array([rnd.choice([0, 20, 40]) * max(len(x), len(y)) // 100 for x, y in zip(xs, ys)])
    want = [editing.edit_distance_within(x, y, int(n)) is not None for x, y, n in zip(xs, ys, limits)]
    assert editing.within(xs, ys, limits).tolist() == want and 0 < sum(want) < len(want)


def test_keys_with_the_same_lines_are_one(spark):
    rows = [(key, item) for key in range(40) for item in (1, 2)] + [(100, 2), (100, 3), (200, 4)]
    met = hubs.different(Workspace(spark, "keys"), spark.createDataFrame(rows, "key long, item long"), "met")
    assert sorted((r.key, r.item) for r in met.collect()) == [(0, 1), (0, 2), (100, 2), (100, 3)]


def test_texts_of_many_widths_at_once_and_masks_in_parts(monkeypatch):
    rnd = random.Random(5)
    xs = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([3, 70, 300, 900, 2000]))) for _ in range(120)]
    ys = ["".join(c if rnd.random() > share else rnd.choice(["", "z", "xy"]) for c in x) for x in xs for share in [rnd.choice([0.05, 0.2, 0.25, 0.4])]]
    limits = np.array([20 * max(len(x), len(y)) // 100 for x, y in zip(xs, ys)])
    want = [editing.edit_distance_within(x, y, int(n)) is not None for x, y, n in zip(xs, ys, limits)]
    assert editing.within(xs, ys, limits).tolist() == want and 20 < sum(want) < 100
    monkeypatch.setattr(editing, "MASKS_AT_ONCE", 500)
    assert editing.within(xs, ys, limits).tolist() == want


@pytest.mark.parametrize("at_once", [1 << 20, 64])
def test_shared_keys_of_packs(spark, at_once):
    rnd = random.Random(4)
    rows = [(7, i) for i in range(3000)] + [(rnd.getrandbits(63) - (1 << 62), i) for i in range(500)] + [(rnd.randint(-40, 900), rnd.randint(0, 50)) for _ in range(900)]
    rows += rnd.sample(rows, 40)
    rnd.shuffle(rows)
    of = {}
    for key, item in rows:
        of.setdefault(key, set()).add(item)
    packs = [hubs.packed(*(np.array(x, np.int64) for x in zip(*rows[i : i + at_once]))).to_pylist() for i in range(0, len(rows), at_once)]
    frame = spark.createDataFrame([(r["bucket"], r["keys"], r["items"]) for p in packs for r in p], "bucket int, keys binary, items binary")
    got = sorted((r.key, r.item) for r in hubs.shared(Workspace(spark, "packs"), frame, "shared", 1).collect())
    assert got == sorted((k, i) for k, v in of.items() if len(v) > 1 for i in v)
    assert max(len(r["keys"]) // 8 for p in packs for r in p if r["bucket"] >= 0) < 100 + at_once


def test_lines_of_one_number_get_other_ones(spark):
    def weak(data, cuts, salt):  # all lines have the same number at first
        found = lines._digests(data, cuts, salt)
        return found if salt else np.stack([np.zeros(len(found), np.int64), found[:, 1]], axis=1)

    docs = lines._with_body(spark.createDataFrame([(1, "a b\nc d"), (2, "c d"), (3, "e")], "doc_id long, text string"))
    for digests in (weak, lines._digests):
        rows, _, distinct = lines._numbered(docs, Workspace(spark, "numbers"), None, digests)
        assert rows.select("item").distinct().count() == rows.select("form").distinct().count() == distinct.count() == 3


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_components_contracted_in_tasks(spark, monkeypatch, at_once):
    rnd = random.Random(8)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000 - i, 5000) for i in range(1, 90)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    got = components.connected(Workspace(spark, "edges"), spark.createDataFrame(edges, "a long, b long").repartition(7), "stars").collect()
    assert sorted((r.u, r.v) for r in got) == sorted((x, top(x)) for x in root if top(x) != x)
