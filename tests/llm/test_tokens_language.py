import random
import zlib
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import huffman, language, packing, tokens

DOCS = "doc_id long, text string"
ODD = ["", None, "  a\n\nb ", "İstanbul ΣΑΣ x́ ́e <|endoftext|> it's\tdon't 's x<|startoftext|>y 12 345 \x1c\x85z 　日本\r\nabc é", "Å ﬁ ΟΔΟΣ. 'S 'LL", "word " * 5000]


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def texts(n, seed=3):
    rnd = random.Random(seed)
    return ODD + [" ".join(rnd.choice(["the", "tokenizer", "Zürich", "x9", "!?", "über-alles", "qqqzz"]) for _ in range(rnd.randint(0, 300))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_whole_texts(plain_ids):
    encoder, all_texts = tokens.Encoder(tokens.TOKENIZER), texts(50)
    for _ in range(2):  # cold and cached
        ids, first = encoder.encode(pa.array(all_texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain_ids(t, 0)[:-1] for t in all_texts]


def huffman_cost(weights):
    heap, cost = list(weights), 0
    heapify(heap)
    while len(heap) > 1:
        both = heappop(heap) + heappop(heap)
        cost += both
        heappush(heap, both)
    return cost


def test_code_lengths():
    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 50):
        weights = np.array([rnd.randint(1, 10 ** rnd.randint(0, 6)) for _ in range(n)])
        lengths = huffman.code_lengths(weights, 40)
        assert n == 1 or (weights * lengths).sum() == huffman_cost(weights.tolist())
        assert (huffman.code_lengths(weights, 6) <= 6).all() and (2.0 ** -huffman.code_lengths(weights, 6)).sum() <= 1
    best = min((sum(w * b for w, b in zip((1, 1, 5, 40, 300), bits)) for bits in product(range(1, 4), repeat=5) if sum(2.0**-b for b in bits) <= 1))
    assert (huffman.code_lengths(np.array([1, 1, 5, 40, 300]), 3) * [1, 1, 5, 40, 300]).sum() == best


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 5000])
def test_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 3000).astype(np.uint32)
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    book = huffman.Codebook(symbols, huffman.code_lengths(counts[symbols]))
    assert (book.unpack(*book.pack(ids), n) == ids).all()


def test_token_files(spark, plain_ids, tmp_path):
    rows = list(enumerate(texts(200)))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", ids string").repartition(5)
    huffman.write_ids(frame, f"file://{tmp_path}/out")
    got = sorted(tuple(r) for r in huffman.read_digest(spark, f"file://{tmp_path}/out").collect())
    want, start = [], 0
    for doc, text in sorted(rows):
        ids = plain_ids(text, 2)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert {r.doc_id: r.ids for r in huffman.read_ids(spark, f"file://{tmp_path}/out").collect()} == {d: plain_ids(t, 2) for d, t in rows}


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    huffman.write_ids(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], DOCS), f"file://{tmp_path}/out")
    got = huffman.read_digest(spark, f"file://{tmp_path}/out").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]
    huffman.write_ids(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none")
    assert huffman.read_digest(spark, f"file://{tmp_path}/none").count() == 0


def test_hilbert_curve_is_continuous():
    points = np.array(list(product(range(8), repeat=3)))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, plain_ids):
    rows = [*enumerate(texts(150)), (None, "lost"), (7, texts(2)[7])]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length > 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.SIZE or at & (at - 1) == 0 and at < packing.SIZE
    for doc, text in rows:
        if doc == 7:
            continue
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist() == plain_ids(text, 1)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))] and {r.doc_tokens for r in parts} == {len(plain_ids(text, 1))}
    assert sum(r.length for r in by_doc[7]) == 2 * by_doc[7][0].doc_tokens
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_keeps_similar_documents_near():
    rnd, rows = random.Random(4), []
    for group in range(20):
        vocabulary = [rnd.randint(1, 49_000) for _ in range(60)]
        rows += [(group, [rnd.choice(vocabulary) for _ in range(200)]) for _ in range(20)]
    rnd.shuffle(rows)
    ids, first = np.array([i for _, x in rows for i in x]), np.arange(0, 200 * len(rows) + 1, 200)
    order = np.argsort(packing.Projection(49_408).keys(ids, first))
    groups = np.array([g for g, _ in rows])[order]
    assert (groups[1:] == groups[:-1]).mean() > 0.3  # 0.05 by chance


# ---- language identification -----------------------------------------------------------------------

LANGS = {"en": "the of and with thing ation house over".split(), "de": "der und nicht schön über straße haus ein".split(), "fr": "le de être où garçon maison avec leur".split(), "es": "el los niño casa está corazón pero una".split()}


def test_language_held_out_accuracy(spark):
    rnd = random.Random(9)
    say = lambda code: " ".join(rnd.choice(LANGS[code]) for _ in range(rnd.randint(2, 40)))
    rows = [(i, say(c), c, "src") for i, c in enumerate(rnd.choice("en en en de fr es".split()) for _ in range(600))]
    rows += [(1000, None, "en", ""), (1001, "", "de", ""), (1002, "12 ?! — 😀", None, ""), (None, say("de"), "de", ""), (1003, say("fr"), None, ""), (1003, say("fr"), None, "")]
    frame = spark.createDataFrame(rows, DOCS + ", lang string, score string")
    got = language.identify_languages(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in truth)
    assert sum(by[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert [(by[d].lang_pred, by[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "de" and not by[None].held_out and by[1003].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_known_languages(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(truth) | {None, 1003}


def test_language_ignores_labels_it_must_not_use(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(LANGS[c]) for _ in range(12)), c) for i, c in enumerate(["en", "fr"] * 60)]
    frame = spark.createDataFrame(rows, DOCS + ", lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    wrong = frame.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(language.identify_languages(frame).collect()) == sorted(language.identify_languages(wrong).collect())


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "the house", None)], DOCS + ", lang string")
    assert [tuple(r)[2:] for r in language.identify_languages(none).collect()] == [("und", 0.0)]
    assert language.identify_languages(none.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "the house", "en") for i in range(9)], DOCS + ", lang string")
    assert Counter(r.lang_pred for r in language.identify_languages(one).collect()) == {"en": 9}
