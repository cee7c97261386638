"""Scanners, tables of steps, running exponents and classes against plain versions."""

import math
import random
import re
import time
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from brindle.functions import arrays, numeric, scan, text
from brindle.operators import iterative, relational


def test_collatz_look_ups_equal_single_steps():
    rnd = random.Random(1)
    edge = 1 << numeric.COLLATZ_BITS
    numbers = [*range(1, 3000), edge - 1, edge, edge + 1, 2**62, 2**63 - 1, 837799, 77031, *[rnd.randint(1, 10**6) for _ in range(300)], *[rnd.randint(2**40, 2**63 - 1) for _ in range(200)]]

    def plain(n):
        k = 0
        while n != 1:
            n, k = n // 2 if n % 2 == 0 else 3 * n + 1, k + 1
        return k

    assert numeric.collatz_steps.func(pd.Series(numbers)).tolist() == [plain(n) for n in numbers]
    assert numeric.collatz_steps.func(pd.Series([0, -7, None, 27], dtype="Int64")).tolist()[3] == 111


def test_sliding_products(spark):
    rnd = random.Random(2)

    def plain(digits, span):
        best = 0
        for i in range(len(digits) - span + 1):
            product = 1
            for c in digits[i : i + span]:
                product *= int(c)
            best = max(best, product)
        return best

    for _ in range(300):
        digits = "".join(rnd.choice("0123456789" if rnd.random() < 0.2 else "123456789") for _ in range(rnd.randint(1, 60)))
        span = rnd.randint(1, len(digits))
        assert arrays._largest(digits, span) == plain(digits, span)
    long = "".join(rnd.choice("123456789") for _ in range(10**6))
    frame = spark.createDataFrame([(long,), ("9" * 39,), ("9" * 45,), ("12a", ), (None,), ("1\n" * 30,)], "s string")
    got = [r[0] for r in frame.select(arrays.largest_product("s", 39)).collect()]
    assert got[0] == arrays._largest(long, 39) and got[1:] == [9**39, 9**39, None, None, None]
    assert frame.select(arrays.largest_product("s", 40)).collect()[2][0] is None


PHRASES = ["car: carpet as java: javascript!!&@$%^&", "Joe can't tell between 'large' and large.", "ΟΔΟΣ ΑΣ.Β αβγς", "a—b c d　e…f", "İstanbul naïve x'y' ''z''", "tab\tnew\nline\x0b\x0c\r\x1cend\x85next", "1,2,3 x_y {z} [w] $5+3=8 ~^`|", "日本語。テスト、です", None, "", "'", "!!!"]


def plain_words(phrase):
    lowered = phrase.lower() if phrase else ""
    parts = regex.split(r"[\s\p{P}--[']]+", lowered, flags=regex.V1)
    cleaned = [re.sub("^'+|'+$", "", regex.sub(r"[^\p{L}\p{Nd}']", "", p)) for p in parts]
    return [w for w in cleaned if w]


def test_word_counts(spark, monkeypatch):
    rows = [(i % 3, p) for i, p in enumerate(PHRASES * 3)]
    frame = spark.createDataFrame(rows, "k int, s string").repartition(3)
    want = Counter(w for _, p in rows for w in plain_words(p) if "\x1c" not in (p or ""))
    for piece in (4 << 20, 1):
        monkeypatch.setattr(relational, "PIECE", piece)
        got = {r.word: r.n for r in relational.word_counts(frame.where("s is null or not contains(s, '\x1c')"), "s").collect()}
        assert got == dict(want)
    by = Counter((k, w) for k, p in rows for w in plain_words(p) if "\x1c" not in (p or ""))
    assert {(r.k, r.word): r.n for r in relational.word_counts(frame.where("s is null or not contains(s, '\x1c')"), "s", ["k"]).collect()} == dict(by)
    direct = frame.select(F.explode(text.word_split("s")).alias("word")).groupBy("word").count()
    assert {r.word: r["count"] for r in direct.collect()} == {r.word: r.n for r in relational.word_counts(frame, "s").collect()}


def test_parts_stop_at_text_ends():
    found, row = scan.parts(pa.array(["ab cd", "", None, "ef", "gh,", ",x"]).slice(0, 6))
    assert found.to_pylist() == ["ab", "cd", "ef", "gh", "x"] and row.tolist() == [0, 0, 3, 4, 5]
    found, row = scan.parts(pa.array(["zz", "ab cd", "é—f"]).slice(1, 2))
    assert found.to_pylist() == ["ab", "cd", "é—f"] and row.tolist() == [0, 0, 1]
    assert len(scan.parts(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("block", [256, 2])
def test_anagram_classes(spark, block):
    rnd = random.Random(3)
    words = ["".join(rnd.sample("abcdef", 6)) for _ in range(60)] + ["tea", "eat", "Eat", "ATE", "tea", "solo", "", None, "Banana", "banana"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    some = {w for w in words if w is not None}
    want = {(a, b) for a in some for b in some if sorted(a.lower()) == sorted(b.lower()) and a.lower() != b.lower()}
    pairs = [tuple(r) for r in relational.anagram_pairs(frame, block=block).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    classes = relational.anagram_classes(frame, block=block).collect()
    assert sum({r.letters: r.pairs for r in classes}.values()) == len(want)
    members = {}
    for r in classes:
        members.setdefault(r.letters, []).extend(r.words)
        assert r.members == len([w for w in some if "".join(sorted(w.lower())) == r.letters])
    assert {w for m in members.values() for w in m} == {a for a, _ in want} and (block > 2 or len(classes) > len(members))


def test_primes_of_a_column(spark):
    frame = spark.createDataFrame([(n,) for n in [2, 3, 4, 5, 91, 97, 97, 1, 0, -7, None, 1009]], "n bigint")
    assert sorted(r.n for r in iterative.primes_among(frame, "n").collect()) == [2, 3, 5, 97, 97, 1009]
    assert iterative.primes_among(frame.where("n < 0"), "n").count() == 0 and iterative.primes_among(frame.limit(0), "n").count() == 0


def test_guesses(spark):
    frame = spark.createDataFrame([(t, s) for t in (1, 2, 50, 99, 100, 0, 101, None) for s in range(4)], "target bigint, seed bigint")
    for r in frame.withColumn("g", iterative.guesses("target", "seed")).collect():
        if r.target is None or not 1 <= r.target <= 100:
            assert r.g is None
            continue
        low, high = 1, 100
        for guess in r.g:
            assert low <= guess <= high
            low, high = (guess + 1, high) if guess < r.target else (low, guess - 1)
        assert r.g[-1] == r.target and r.target not in r.g[:-1]


def test_books_of_a_table(spark):
    store = relational.add_books(relational.new_book_store(spark), [relational.new_book("a", "x", 1.0, 1), relational.new_book("b", "y", 2.0, 0)])
    rows = spark.createDataFrame([(f"t{i}", "z", float(i), i, 100 - i) for i in range(50)], "title string, author string, price double, in_stock int, place int").repartition(5)
    more = relational.add_books(store, rows, ["place"])
    assert [(r.title, r.ins_seq) for r in more.orderBy("ins_seq").collect()] == [("a", 0), ("b", 1), *[(f"t{49 - i}", 2 + i) for i in range(50)]]
    assert relational.add_books(more, rows.limit(0)).count() == 52


def test_largest_products_of_many_texts():
    """Batches of texts of the span and longer against plain products; 20,000 texts take no more than two seconds."""
    rnd = random.Random(26)
    for span in (1, 2, 3, 5, 8, 11, 18, 19):
        texts = ["".join(rnd.choice("0123456789" if rnd.random() < 0.3 else "789") for _ in range(span + rnd.choice([0, 0, 1, 2, 30]))) for _ in range(300)]
        texts[7] = texts[-1] = None
        want = [None if t is None else max(math.prod(map(int, t[i : i + span])) for i in range(len(t) - span + 1)) for t in texts]
        assert [None if v is pd.NA else v for v in arrays._largest_of_many(pd.Series(texts, index=range(5, 305)), span)] == want
    assert len(arrays._largest_of_many(pd.Series([None, None], dtype=object), 3)) == 2 and not len(arrays._largest_of_many(pd.Series([], dtype=object), 3))
    began = time.perf_counter()
    arrays._largest_of_many(pd.Series(["512345678905"] * 20000), 3)
    assert time.perf_counter() - began < 2
