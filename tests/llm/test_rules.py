import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import rules

DOCS = "doc_id long, text string, lang string, source string, quality int, bytes double, score double"
ODD = [None, "", " ", "\n\n", "a", "A", "a a a a", "x\nx\nx", "Ünï cödé 日本 ÄÖ", "!!! | | ### 12 3.", "one two three one two three one two three", "\tA b\x1c c\r\n", "é" * 50, "word " * 3000]


def plain(text):
    raw = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0d]+", raw), re.findall(rb"[^\n]+", raw)
    log, share = lambda n: math.log2(1 + n), lambda a, b: a / max(b, 1)
    count = lambda cls: len(re.findall(rb"[" + cls + rb"]", raw))
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marks = rb"!#$%&*+/<=>@\[\\\]^_`{|}~"
    return [
        log(len(raw)), log(len(words)), share(sum(map(len, words)), len(words)), log(max(map(len, words), default=0)), log(share(len(words), len(lines))),
        share(count(rb"A-Za-z\x80-\xff"), len(raw)), share(count(rb"A-Z"), count(rb"A-Za-z")), share(count(rb"0-9"), len(raw)), share(count(rb"\x20\x09-\x0d"), len(raw)),
        share(count(rb".,;:?'\"()-"), len(raw)), share(count(marks), len(raw)), share(count(rb"!"), len(words)), share(count(rb"|"), len(words)),
        share(sum(a == b for a, b in zip(words, words[1:])), len(words) - 1), share(len(set(words)), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(len(runs) - len(set(runs)), len(words) - 2),
        share(sum(len(w) <= 2 for w in words), len(words)), share(sum(bool(re.match(rb"[A-Z]", w)) for w in words), len(words)), share(sum(bool(re.search(rb"[.,;:?'\"()-]$", w)) for w in words), len(words)),
        share(sum(bool(re.search(rb"[" + marks + rb"]$", w)) for w in words), len(words)), share(sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words), len(words)),
    ]


def texts(n, seed=1):
    """Pairs of a text and whether it is good: prose, shouting, tables or repeated words."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = [rnd.choice(["the", "river", "was", "a", "cold", "Stone", "house,", "and.", "nine"]) for _ in range(rnd.randint(5, 60))]
        kind = rnd.randint(0, 5)
        out.append({0: ("!! ".join(words).upper(), 0), 1: (" | ".join(words), 0)}.get(kind, (" ".join(words), 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "en", "s", 7, 1.0, 0.3) for i, text in rows], DOCS).repartition(4)


def test_statistics(spark):
    rows = list(enumerate(ODD + [t for t, _ in texts(60)])) + [(None, "a null id"), (3, "again")]
    got = rules.statistics(frame(spark, rows)).collect()
    want = sorted((([-1, i][i is not None], *plain(t)) for i, t in rows), key=str)
    have = sorted((([-1, r.doc_id][r.doc_id is not None], *r[1:]) for r in got), key=str)
    assert len(want) == len(have)
    for w, h in zip(sorted(want), sorted(have)):
        assert h == pytest.approx(w, abs=1e-12)
    assert rules.numbers(pa.array([], pa.string())).shape == (0, len(rules.STATISTICS))


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(2)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1])))).astype(float)
    w = rules.lasso(r, y, 0.02, steps=5000)
    gap = y - 1 / (1 + np.exp(-(r @ w[:-1] + w[-1])))
    slope = r.T @ gap / len(y)
    assert abs(gap.mean()) < 1e-4
    assert all(abs(s - 0.02 * np.sign(v)) < 2e-4 if v else abs(s) <= 0.0201 for s, v in zip(slope, w[:-1]))
    assert 0 < np.count_nonzero(w[:-1]) < 12 and w[0] > 0 > w[1]


def test_rules_of_trees_hold_as_they_say():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(rules.STATISTICS))).round(2)
    y = ((x[:, 4] > 0.5) & (x[:, 9] <= 0.3)).astype(float)
    found = rules.tree_rules(x, y)
    assert 10 < len(found) == len({rules.holds(x, rule).tobytes() for rule in found})
    assert all(1 <= len(rule) <= rules.DEPTH and len(rule) > 0 for rule in found)
    model = rules.RuleModel.fit(x, y)
    fresh = rng.random((2000, len(rules.STATISTICS)))
    assert ((model.predict(fresh) >= 0.5) == ((fresh[:, 4] > 0.5) & (fresh[:, 9] <= 0.3))).mean() > 0.95
    assert 0 < len(model.rules) < len(found) / 2 and len(model.describe()) == len(model.rules)


def test_column_equals_prediction(spark):
    some = texts(300)
    x, y = rules.numbers(pa.array([t for t, _ in some])), np.array([g for _, g in some], float)
    model = rules.RuleModel.fit(x, y)
    got = {r[0]: r[1] for r in rules.statistics(frame(spark, [(i, t) for i, (t, _) in enumerate(some)])).select("doc_id", model.column()).collect()}
    assert [got[i] for i in range(len(some))] == pytest.approx(model.predict(x).tolist(), abs=1e-12)


def test_held_out_texts_and_odd_ones(spark):
    some = texts(900)
    rows = [(i, t) for i, (t, _) in enumerate(some)] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, some[0][0]), (0, some[0][0])]
    labels = [(i, good, 0, "x") for i, (_, good) in enumerate(some)] + [(None, 1, 0, ""), (3, None, 0, ""), (4, 9, 1, ""), (99999, 1, 0, "")]
    lies = [(i, 1 - good if zlib.crc32(str(i).encode()) % 3 == 1 else good, toxic, x) for (i, good, toxic, x) in labels[:900]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = rules.score_quality(frame(spark, rows), known).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == some[r.doc_id][1] for r in got if r.held_out and r.doc_id < 900]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    false = spark.createDataFrame(lies, "doc_id long, quality int, toxic int, text string")
    assert sorted(map(str, rules.score_quality(frame(spark, rows), false).collect())) == sorted(map(str, got))  # labels of held-out rows have no part in it


def test_bounded_sample(spark):
    some = texts(900)
    docs, known = frame(spark, [(i, t) for i, (t, _) in enumerate(some)]), spark.createDataFrame([(i, g) for i, (_, g) in enumerate(some)], "doc_id long, quality int")
    stats = rules.statistics(docs)
    model = rules.fit(stats, known, 200)
    got = {r[0]: r[1] for r in stats.select("doc_id", model.column()).collect()}
    assert np.mean([(got[i] >= 0.5) == g for i, (_, g) in enumerate(some)]) > 0.95


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, None), (None, 0), (77, 1)], 0.5), ([(0, 1), (2, 1), (3, 1), (4, 1)], None)])
def test_few_labels(spark, labels, score):
    docs = frame(spark, [(i, t) for i, (t, _) in enumerate(texts(6))])
    got = rules.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1
    assert got[0].score == score if score else got[0].score > 0.7
    assert rules.score_quality(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.predicted for r in rules.score_quality(docs, labels).where(F.col("held_out")).collect()}
    rows = duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall()
    right = [got[i] == q for i, q in rows if i in got]
    assert len(right) > 90 and sum(right) / len(right) > 0.95
