import hashlib
import random

import numpy as np
import pytest

from brindle.llm import repeats

DOCS = "doc_id long, text string"


def brute(rows, length):
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if least[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    filler = lambda k: "".join(rnd.choice("abcdefghij é") for _ in range(k))
    passages = [filler(rnd.randint(45, 260)) for _ in range(6)] + ["x" * 70, "ab" * 40, "\0" * 55]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a, b = sorted((rnd.randrange(len(p) + 1), rnd.randrange(len(p) + 1)))
            text += filler(rnd.randint(0, 90)) + rnd.choice([p, p, p[a:b]])
        rows.append((rnd.randint(0, 500) * 2, text))
    rows += [(1, None), (3, ""), (5, "short"), (7, passages[0]), (None, passages[0]), (9, passages[0]), (9, passages[0]), (11, passages[1] + "."), (13, "x" * 300)]
    rows += [(2000 + i, rows[i][1]) for i in range(8)]
    rnd.shuffle(rows)
    return rows


key = lambda r: (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("seed,hot,length", [(1, 4096, 50), (2, 1, 50), (3, 5, 50), (4, 4096, 24)])
def test_removed_bytes_equal_brute_force(spark, seed, hot, length):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "y") for r in rows], DOCS + ", chunk string").repartition(5)
    got = [tuple(r) for r in repeats.remove_repeats(frame, length=length, hot=hot, buckets=3, slice_bytes=2000 if seed > 2 else 1 << 20).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, length), key=key)


def test_chunks_of_one_document_each(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7, 20))]
    got = [tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(len(rows)), with_text=True).collect()]
    assert sorted(r[:5] for r in got) == sorted(brute(rows, 50))
    assert all(hashlib.sha256(bytes(r[5])).hexdigest() == r[4] for r in got)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert repeats.repeat_groups(spark.createDataFrame([(1, None)], DOCS)).count() == 0


def test_groups_hold_all_occurrences(spark):
    rnd = random.Random(3)
    filler = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    passage = filler(60)
    rows = [(i, filler(i * 7) + passage + filler(30)) for i in range(9)]
    got = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, DOCS).repartition(4)).collect():
        text = dict(rows)[r.doc_id]
        got.setdefault((r.group_id, r.length), []).append((r.doc_id, r.start, text[r.start : r.start + r.length]))
    assert got and all(len({x[2] for x in g}) == 1 and len(g) == len(set(g)) > 1 for g in got.values())
    covered = set()
    for (_, n), g in got.items():
        if len(g) < 9:  # a longer repeat of fewer documents
            continue
        assert {d for d, _, _ in g} == set(range(9))
        covered |= {(d, i) for d, s, _ in g for i in range(s, s + n)}
    assert covered == {(d, i) for d, t in rows for i in range(t.index(passage), t.index(passage) + 60)}


def test_intervals_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = bytes(rng.integers(97, 99, rng.integers(8, 40)).astype(np.uint8))
        n = 3
        found = {}
        for i in range(len(text)):
            for j in range(i + n, len(text) + 1):
                found.setdefault(text[i:j], []).append(i)
        want = set()
        for s, at in found.items():
            right = {text[i + len(s) : i + len(s) + 1] or i for i in at}
            left = {text[i - 1] if i else -1 for i in at}
            if len(at) > 1 and len(right) > 1 and (len(left) > 1 or -1 in left):
                want.add((len(s), tuple(sorted(at))))
        array = repeats.SuffixArray(np.frombuffer(text, np.uint8), np.array([len(text)], np.uint32), n)
        got = {(d, tuple(sorted(array.start[m].tolist()))) for d, m in repeats._interval_groups(array, n)}
        assert got == want, text


def test_sliding_minimum_and_hashes():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 99, 80).astype(np.uint64)
    for size in (1, 2, 3, 7, 35, 64, 80):
        assert repeats.sliding_min(values, size).tolist() == [values[i : i + size].min() for i in range(81 - size)]
    raw = rng.integers(0, 2, 300).astype(np.uint8)
    for size in (1, 3, 16, 24, 50):
        by = {}
        for i, h in enumerate(repeats.rolling(raw, size).tolist()):
            by.setdefault(h, set()).add(raw[i : i + size].tobytes())
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({raw[i : i + size].tobytes() for i in range(301 - size)})
