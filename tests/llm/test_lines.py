import hashlib
import random

import numpy as np
import pytest

from brindle.llm import lines
from brindle.llm.textops import ASCII_LOWER, U64, mix, run_hashes

DOCS = "doc_id long, text string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(800):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 24)))
        b = list(a) if rnd.random() < 0.7 else [rnd.choice("abc") for _ in range(rnd.randint(0, 24))]
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 2)] = rnd.choice(["", "a", "bc"])
        b, limit = "".join(b), rnd.randint(0, 12)
        d = levenshtein(a, b)
        assert lines.edit_distance_within(a, b, limit) == (d if d <= limit else None), (a, b, limit)


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    short = run_hashes(ASCII_LOWER[raw], np.array([0]), np.array([len(raw)])) >> U64(24)
    return int(mix(short)[0])


def simhash(form):
    words = [word_hash(w) for w in set(form.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))


def brute(rows, similarity=80):
    seen = sorted({(d, t or "") for d, t in rows if d is not None})
    first = {}
    for d, t in seen:
        for i, line in enumerate(t.split("\n")):
            if form := lines.normal_form(line):
                first.setdefault(form, []).append((d, i))
    forms = sorted(first)
    sims = {f: simhash(f) for f in forms}
    root = {f: f for f in forms}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            if (sims[a] ^ sims[b]).bit_count() <= 3 and levenshtein(a, b) <= (100 - similarity) * max(len(a), len(b)) // 100:
                root[find(a)] = find(b)
    best = {}
    for f in forms:
        best[find(f)] = min([best.get(find(f), first[f][0]), *first[f]])
    out = []
    for d, t in rows:
        kept, all_lines = [], (t or "").split("\n")
        for i, line in enumerate(all_lines):
            form = lines.normal_form(line)
            if d is None or not form or best[find(form)] == (d, i):
                kept.append(line)
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "Line", "of", "über", "42", "x"]) + rnd.choice(["", "a", "be", "cd"])
    pool = [" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(25)]

    def vary(line):
        words = line.split(" ")
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice([word(), words[0].upper(), ""])
        return rnd.choice(["", "- ", "> "]) + rnd.choice([" ", "  "]).join(words) + rnd.choice(["", ".", "!!"])

    rows = [(i, "\n".join(vary(rnd.choice(pool)) if rnd.random() < 0.7 else rnd.choice(["", "***", " ".join(word() for _ in range(12))]) for _ in range(rnd.randint(0, 8)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, pool[0] + "\n"), (None, pool[0]), (3, rows[3][1]), (n + 4, " ".join(word() for _ in range(900)))]
    rows += [(n + 5, rows[-1][1].replace("of", "off", 1))]
    rnd.shuffle(rows)
    return rows


key = lambda r: (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("seed,hub_rounds", [(1, 3), (2, 0), (3, 1)])
def test_against_brute_force(spark, seed, hub_rounds):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", body string").repartition(3)
    got = [tuple(r) for r in lines.line_digest(frame, hub_rounds=hub_rounds).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_documents_without_repeated_lines(spark):
    rows = corpus(4)
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in rows], DOCS + ", n_chars int, line string")
    got = lines.drop_repeated_lines(frame)
    assert got.schema == frame.schema
    digest = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect() if r.doc_id is not None)
    assert digest == sorted((d, h) for d, _, _, h in brute(rows) if d is not None)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)
    assert [r.text for r in got.where("doc_id = 40").collect()] == [None]


def test_empty(spark):
    assert lines.line_digest(spark.createDataFrame([], DOCS)).count() == 0
