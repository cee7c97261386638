"""op2_lines and the pipeline's stage against edit similarity alone, without SimHashes or keys."""

import random

import pytest

import corpus_pipeline
from brindle.llm import lines
from brindle.llm.queries import op2_lines

DOCS = "doc_id long, text string"
SIZES = (1, 2, 3, 4, 5, 7, 10, 13, 16, 20, 27, 40, 80)


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rnd.randint(2, 9)))


def similar(a, b):
    return lines.edit_distance_within(a, b, 20 * max(len(a), len(b)) // 100) is not None


def changed(rnd, line, most):
    """line with up to ``most`` words replaced, left out or put in, while the similarity stays 0.8; None if there is no such change."""
    now = line
    for _ in range(most):
        words = now.split(" ")
        k = rnd.randrange(len(words))
        words[k : k + rnd.randint(0, 1)] = rnd.choice([[word(rnd)], [word(rnd)], []])
        if not (new := " ".join(words)) or not similar(line, new):
            break
        now = new
    return now if now != line else None


def pairs(seed, most, each=30):
    """{words: pairs of similar lines}."""
    rnd, out = random.Random(seed), {}
    for n in SIZES:
        found = out.setdefault(n, [])
        for _ in range(each * 60):
            line = " ".join(word(rnd) for _ in range(n))
            if len(found) < each and (other := changed(rnd, line, most)):
                found.append((line, other))
        if n < 3:  # single letters, as a whole word is too much
            while len(found) < each:
                line = " ".join(word(rnd) for _ in range(n))
                k = rnd.randrange(len(line))
                other = line[:k] + rnd.choice("xyz") + line[k + 1 :]
                if other != line and similar(line, other):
                    found.append((line, other))
    return out


def removed(spark, tmp_path, found):
    rows = [(2 * i + k, x) for i, p in enumerate(p for v in found.values() for p in v) for k, x in enumerate(p)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id: r.n_removed for r in op2_lines(spark, str(tmp_path)).collect()}
    assert not any(gone[i] for i, _ in rows if i % 2 == 0)
    again = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in again.collect() if r.text == ""} == {i for i, n in gone.items() if n}
    out, at = {}, 0
    for n, v in found.items():
        out[n] = sum(gone[2 * (at + i) + 1] for i in range(len(v))) / len(v)
        at += len(v)
    return out


@pytest.mark.parametrize("most,least", [(1, 0.99), (99, 0.8)])
def test_recall_at_every_length(spark, tmp_path, most, least):
    found = pairs(most, most)
    assert all(len(v) >= 20 for v in found.values())
    got = removed(spark, tmp_path, found)
    print("recall by words:", got)
    assert min(got.values()) >= least and sum(got.values()) / len(got) >= (1 + least) / 2, got


def test_only_similar_lines(spark, tmp_path):
    rnd = random.Random(9)
    found = {n: [] for n in SIZES}
    for n in SIZES:
        while len(found[n]) < 20:
            words = [word(rnd) for _ in range(n)]
            other = list(words)
            for k in rnd.sample(range(n), -(-n * 2 // 5)):
                other[k] = word(rnd)
            if not similar(" ".join(words), " ".join(other)):
                found[n].append((" ".join(words), " ".join(other)))
    assert not any(removed(spark, tmp_path, found).values())


THAI = "".join(chr(0x0E01 + i) for i in range(46)) + "".join(chr(0x0E30 + i) for i in range(11))
SCRIPTS = {"hex": "0123456789abcdef", "base 64": "abcdefghijklmnopqrstuvwxyz0123456789", "chinese": "".join(chr(0x4E00 + 7 * i) for i in range(900)) + "。，", "thai": THAI, "japanese": "".join(chr(0x3042 + i) for i in range(80)) + "日本語東京都。"}


@pytest.mark.parametrize("script", SCRIPTS)
def test_recall_of_lines_without_spaces(spark, tmp_path, script):
    """Pairs by edit similarity alone: one to as many changed, left out or added characters as leave 0.8."""
    rnd, found = random.Random(script), {}
    letters = SCRIPTS[script]
    for size in (30, 64, 100, 300):
        for share in (0.01, 0.1, 0.19):
            pairs_ = found.setdefault((size, share), [])
            while len(pairs_) < 25:
                line = [rnd.choice(letters) for _ in range(size)]
                other = list(line)
                for _ in range(max(1, int(share * size))):
                    k = rnd.randrange(len(other))
                    other[k : k + rnd.randint(0, 1)] = rnd.choice([[rnd.choice(letters)], [rnd.choice(letters)], []])
                if other != line and similar("".join(line), "".join(other)):
                    pairs_.append(("".join(line), "".join(other)))
    got = removed(spark, tmp_path, found)
    print("recall by characters and share of changes:", script, got)
    assert all(v == 1 for (_, share), v in got.items() if share == 0.01) and sum(got.values()) / len(got) >= 0.95 and min(got.values()) >= 0.75, got


def test_one_changed_character_in_long_words(spark):
    line = "".join(chr(0x4E00 + 13 * i) for i in range(100))
    thai = (THAI * 3)[:120]
    digits = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    rows = []
    for i, x in enumerate((line, thai, digits)):
        rows += [(3 * i, x), (3 * i + 1, x[:40] + "x" + x[41:]), (3 * i + 2, x[::-1])]
    got = {r.doc_id: r.n_removed for r in lines.line_digest(spark.createDataFrame(rows, DOCS), flips=None).collect()}
    assert got == {i: int(i % 3 == 1) for i in range(9)}
