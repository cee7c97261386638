"""Equality is of texts, not of hashes that are easy to make equal, and hot keys stay whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontam, hubs, lines, neardup, workspace
from brindle.llm.textops import run_hashes
from brindle.llm.workspace import Workspace

DOCS = "doc_id long, text string"


def thue_morse(n=2048):
    """A word and its complement: any polynomial in an odd number, modulo 2**64, is equal for both."""
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


T, U = thue_morse()


@pytest.mark.parametrize("seed", [0, 1])
def test_run_hashes(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "ab", "abcdefgh", "abcdefghi", "x" * 31, "x" * 32, "x" * 33, "x" * 40, "x" * 1000, T, U] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 70))) for _ in range(500)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    got = run_hashes(raw, start, start + size, seed)
    alone = [int(run_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), seed)[0]) for w in words]
    assert got.tolist() == alone and len(set(alone)) == len(set(words))
    assert not set(alone) & set(run_hashes(raw, start, start + size, seed + 1).tolist())


def test_near_duplicates(spark):
    got = neardup.near_duplicates(spark.createDataFrame([(1, T), (2, U), (3, T + " x"), (4, U + " x")], DOCS), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_contamination(spark, limit):
    docs = spark.createDataFrame([(1, T), (2, U), (3, "p q " + U), (4, "a b c d e f g h i " + T)], DOCS)
    bench = spark.createDataFrame([(7, T), (8, "a b c d e f g h i " + T)], "item_id long, text string")
    got = sorted(decontam.contamination(docs, bench, broadcast_bytes=limit).collect())
    assert [(r.doc_id, r.n_hit, r.n_items) for r in got] == [(1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 10, 2)]
    kept = decontam.drop_contaminated(docs.withColumn("item_id", F.lit("z")), bench, broadcast_bytes=limit)
    assert kept.columns == ["doc_id", "text", "item_id"] and sorted(r.doc_id for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("flips", [None, 3])
def test_lines(spark, flips):
    got = lines.line_digest(spark.createDataFrame([(1, T), (2, U), (3, T)], DOCS), flips=flips).collect()
    linked = flips is None and lines.similar_lines(T, U, lines.SIMILARITY)  # 246 of 2048 characters apart, which is similar
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, int(linked)), (3, 1)]


def test_crowded_rows(spark):
    rnd = random.Random(4)
    rows = [(7, i) for i in range(3000)] + [(rnd.randint(10, 900), rnd.randint(0, 50)) for _ in range(900)]
    rows += rnd.sample(rows, 40)
    of = {}
    for key, item in rows:
        of.setdefault(key, set()).add(item)
    want = {(k, i) for k, v in of.items() if len(v) > 1 for i in v}
    got = [tuple(r) for r in hubs.crowded(Workspace(spark, "t"), spark.createDataFrame(rows, "key long, item long").repartition(5), "crowd").collect()]
    assert want <= set(got) and len(set(got) - want) <= 2 * 4


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_line_lookup_by_broadcast_and_join(spark, limit):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    base = [word() for _ in range(30)]
    rows = [(i, " ".join(base[:k] + [word()] + base[k + 1 :]) + "\n" + " ".join(word() for _ in range(20))) for i, k in enumerate(range(12))]
    got = lines.drop_repeated_lines(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", item int"), flips=None, broadcast_bytes=limit)
    assert {r.doc_id: len(r.text.split("\n")) for r in got.collect()} == {i: 1 if i else 2 for i in range(12)}


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_near_duplicate_lookup_by_broadcast_and_join(spark, limit):
    rows = [(i, " ".join(f"w{j}" if j != i else "x" for j in range(60))) for i in range(9)] + [(20, "other text"), (None, None)]
    got = neardup.drop_near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", rep int"), broadcast_ids=limit, shingle=1)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, 0, 20]


def test_edit_distance_of_long_texts():
    rnd = random.Random(11)

    def levenshtein(a, b):
        row = np.arange(len(b) + 1)
        other = np.array([ord(c) for c in b])
        for i, c in enumerate(a, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (other != ord(c)))
            row = np.minimum.accumulate(np.concatenate(([i], best)) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
        return int(row[-1])

    for _ in range(150):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(60, 500)))
        b = list(a) if rnd.random() < 0.8 else [rnd.choice("abcde ") for _ in range(rnd.randint(60, 500))]
        for _ in range(rnd.randint(0, 60)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 4)] = rnd.choice(["", "x", "yz", "abc"])
        if rnd.random() < 0.3:
            b = b[len(b) // 3 :] + b[: len(b) // 3]
        b, d = "".join(b), None
        d = levenshtein(a, b)
        for limit in (d - 1, d, d + 5, 20 * max(len(a), len(b)) // 100):
            assert lines.edit_distance_within(a, b, limit) == (d if d <= limit else None)


def test_a_passage_in_half_of_all_documents_and_items(spark):
    """Its contexts are compared once, and every document and item still gets its own answer."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    items = [(f"i{k}", passage if k % 2 else f"{passage} {word()}" if k % 4 else " ".join(word() for _ in range(20))) for k in range(40)]
    docs = [(k, f"{word()} {word()} {passage} {word()}" if k % 2 else " ".join(word() for _ in range(30))) for k in range(200)] + [(1, items[2][1]), (None, passage), (7, None)]
    frame = spark.createDataFrame([(*d, "z", 1) for d in rnd.sample(docs, len(docs))], "doc_id long, text string, item_id string, a long").repartition(5)
    bench = spark.createDataFrame([(*i, 0) for i in items + items[:3]], "item_id string, text string, b long")
    small, large = (sorted(map(tuple, decontam.contamination(frame, bench, broadcast_bytes=limit).collect()), key=repr) for limit in (1 << 20, -1))
    assert small == large and sum(r[5] for r in small) >= 102
    left = [sorted((repr(r.doc_id), r.text, r.a) for r in decontam.drop_contaminated(frame, bench, broadcast_bytes=limit).collect() if r.text) for limit in (1 << 20, -1)]
    assert left[0] == left[1] and len(left[0]) == 100


def test_pairs_of_contexts_stay_few(spark, tmp_path):
    """A thousand copies of one passage on either side make as many joined rows as one copy does."""
    passage = " ".join(f"w{i}" for i in range(30))
    sizes = []
    for n in (1, 1000):
        docs = spark.createDataFrame([(i, passage) for i in range(n)], "doc_id long, text string")
        bench = spark.createDataFrame([(f"i{i}", passage) for i in range(n)], "item_id string, text string")
        got = decontam.contamination(docs, bench, broadcast_bytes=-1)
        assert {(r.n_hit, r.n_items) for r in got.collect()} == {(30, n)}
        made = [m for s, m in workspace._MADE if "decontamination" in m][-1]
        sizes.append(spark.read.parquet(f"{made}/runs").count())
    assert sizes[0] == sizes[1]
