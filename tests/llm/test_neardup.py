import random
import re

import numpy as np
import pytest

from brindle.llm import neardup, superminhash
from brindle.llm.components import connected
from brindle.llm.textops import U64, mix
from brindle.llm.workspace import Workspace

DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, shingle, threshold):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def corpus(seed, families=12, copies=12):
    rnd, rows = random.Random(seed), []
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randint(0, 40))
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([1, 2, 3, 8, 30, 120, 400]))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 10))):
                w[rnd.randrange(len(w))] = word()
            rows.append(rnd.choice([" ", "\n", "\t "]).join(w) if rnd.random() < 0.9 else " ".join(w).upper())
    rows += ["", None, " \n", "one", "ONE", "one two", rows[0], rows[0]]
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed,shingle", [(1, 2), (2, 2), (3, 5), (4, 1)])
def test_against_brute_force(spark, seed, shingle):
    rows = corpus(seed)
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", rep int").repartition(3), shingle=shingle).collect()
    assert sorted(map(tuple, got)) == brute(rows, shingle, 80)


@pytest.mark.parametrize("hub_rounds", [0, 1, 3])
def test_copies_that_link_only_through_one(spark, hub_rounds):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(40):  # near to the base, far from each other
        w = list(base)
        for k in rnd.sample(range(200), 10):
            w[k] = f"n{i}.{k}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2, hub_rounds=hub_rounds).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: (r[0] is None, r))
    assert [tuple(r) for r in got] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 1, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = neardup.drop_near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"] and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 3]


def test_superminhash_equals_one_element_at_a_time():
    rng, m = np.random.default_rng(3), 24
    sizes = [0, 1, 2, 5, 40, 300]
    elements = rng.integers(0, 2**63, sum(sizes)).astype(U64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    got = superminhash.signatures(elements, first, m)
    for i, (a, b) in enumerate(zip(first, first[1:])):
        want = [int(superminhash.EMPTY)] * m
        for e in elements[a:b]:
            order = list(range(m))
            for j in range(m):
                x = int(mix(np.array([e], U64) + U64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))[0])
                k = j + ((x >> 32) * (m - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], j << 32 | x & 0xFFFFFFFF)
        assert got[i].tolist() == want


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(U64)
    x, y = pool[:2000], pool[500:2500]  # 1500 of 2500
    sig = superminhash.signatures(np.concatenate((x, y)), np.array([0, 2000, 4000]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(30)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(80)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = connected(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert sorted(map(tuple, got)) == sorted((n, r) for n, r in root.items() if n != r)
