import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import divergence

ROWS = "doc_id long, text string, lang string, source string, n long, term string, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    spread, count = defaultdict(set), defaultdict(Counter)
    for i, (lang, source, words) in enumerate(docs):
        count[lang, source].update(words)
        for w in words:
            spread[lang, w].add(i)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang in {d[0] for d in docs}:
        kept = sorted(w for (of, w), ids in spread.items() if of == lang and len(ids) >= least)
        sources = sorted({s for of, s in count if of == lang})
        total = Counter()
        for s in sources:
            total.update({w: count[lang, s][w] for w in kept})
        n = {s: sum(count[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: share(count[lang, s][w], n[s], len(kept)) for w in kept} for s in sources}
        q = {w: share(total[w], sum(total.values()), len(kept)) for w in kept}
        for a in sources:
            pairs = [(-sum((p[a][w] - p[b][w]) ** 2 // p[b][w] for w in kept), b.encode(), b) for b in sources if b != a]
            terms = [(-((p[a][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if count[lang, a][w] and p[a][w] > q[w]]
            out += [(lang, a, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pairs))]
            out += [(lang, a, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def documents(seed=7):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "straße", "日本", "x", "naïve", "über", "Ünder", *[f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]]
    rows = []
    for i in range(150):
        source = "hot" if i % 3 == 0 else f"s{rnd.randint(0, 9)}"
        rows.append((i, " 12 ".join(rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de"]), source, 1, "x", 2))
    rows += [(None, None, None, None, None, None, None), (1, "", "en", "", 0, None, 0), (2, "the of " * 3000, None, "only", 0, None, 0), (3, "123 456", "en", "digits", 0, "a", 0)]
    rows += [(3, "the rare rare", "xx", "a", 1, "b", 1)] * 2 + [(4, "one", "yy", "b", 1, "c", 1), (5, "two", "yy", "a", 1, "c", 1)]
    rows += [(9, "tie zeit", "zz", "a", 1, "", 1), (9, "tie zeit", "zz", "b", 1, "", 1), (9, "Zeit tie", "zz", "c", 1, "", 1), (9, "", "zz", "d", 1, "", 1)]
    return rows


@pytest.mark.parametrize(("block", "bucket", "piece", "width"), [(128, 1 << 14, 8 << 20, 1 << 16), (3, 20, 300, 8), (2, 7, 1, 1 << 10)])
def test_against_brute_force(spark, monkeypatch, block, bucket, piece, width):
    for name, value in (("BLOCK", block), ("BUCKET", bucket), ("PIECE", piece), ("MIN_WIDTH", width), ("MAX_WIDTH", width), ("PAIRS", 50), ("HELD", piece)):
        monkeypatch.setattr(divergence, name, value)
    rows = documents()
    got = divergence.audit(spark.createDataFrame(rows, ROWS).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_top_terms_and_least(spark):
    rows = documents(3)
    got = divergence.audit(spark.createDataFrame(rows, ROWS), least=2, top=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 2, 4)


def test_empty_table(spark):
    got = divergence.audit(spark.createDataFrame([], ROWS))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_sketch_is_never_too_low(spark):
    rows = [(random.Random(i).getrandbits(63), 1 + i % 3) for i in range(4000)] + [(5, 1), (5, 1), (5, 1), (6, 1), (6, 1), (-7, 2**40)]
    counted = spark.createDataFrame(rows, "hash long, docs long").repartition(6)
    want = Counter()
    for h, n in rows:
        want[h] += n
    for width in (8, 1 << 12, 1 << 17):
        bits = divergence.sketch(counted, 3, width)
        assert bits.shape == (divergence.DEPTH, width // 8)
        left = {r[0] for r in divergence.possible(counted.select(F.col("hash").alias("key"), "hash"), bits).collect()}
        assert {h for h, n in want.items() if n >= 3} <= left
    assert len([h for h in left if want[h] < 3]) < 30 and 6 not in left  # a wide one rules nearly all others out


def test_shares_are_exact_beyond_longs(spark):
    rows = [(0, 1), (2, 3), (8_999_999_999, 9_000_000_000), (9_000_000_000, 9_000_000_001), (10**15, 3 * 10**15), (10**17, 10**17 + 7), (0, 0)]
    got = spark.createDataFrame(rows, "c long, n long").select("c", "n", divergence._share(F.col("c"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // n if n else 1 for c, n in rows]


def test_terms_stop_at_document_ends():
    import pyarrow as pa

    terms, doc = divergence.terms_of(pa.array(["Abc", "dÉf 1g", None, "", "ÄB_c"]))
    assert terms.to_pylist() == ["abc", "dÉf", "g", "Äb", "c"] and doc.tolist() == [0, 1, 1, 4, 4]
    assert np.array_equal(divergence._off(np.array([5, 3]), np.array([2, 4])), [4, 0])
