import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brindle.llm import decontam, pii, tiff

DOCS = "doc_id long, text string"


# ---- personal data -------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(x) > 9 or int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda x: (x[1], pii.RANK[x[0]]))


def test_base_spans_equal_a_scan():
    rnd, automaton = random.Random(5), pii.anchors()
    parts = ["@", ".", "a", "-", "+", " ", "1", "4", "12", "255", "(", "b.c", "%", "é", "4111 1111 1111 1111", "1.2.3.4", "\n"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [s for s in pii.find_spans(text, automaton) if s[0] in pii.BASE_KINDS] == brute_spans(text), text


def test_anchor_spans_and_digest(spark):
    text = "see https://u:p@ex.com/x. IBAN: DE89 3704 0044 0532 0130 00, Account number 1234567 +1 (555) 010-2345"
    rows = [(1, text), (2, None), (3, ""), (1, text), (None, "a@b.co")]
    got = pii.personal_data_digest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5
    assert got[0].spans == got[3].spans and {s.split(":")[0] for s in got[0].spans.split(",")} == {"url", "email", "iban", "account", "phone"}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1].base_sha256 == got[2].base_sha256 == empty and got[1].spans == ""
    assert got[4].doc_id is None and got[4].n_email == 1
    spans = pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert all(text[s.start : s.end] == s.value for s in spans if s.doc_id == 1)
    assert pii.personal_data_digest(spark.createDataFrame([], DOCS)).count() == 0


# ---- TIFF ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", "<>")
def test_tiff_round_trip(compression, tile, predictor, order):
    rng = np.random.default_rng(compression + tile + predictor)
    images = [(rng.integers(0, top, (h, w, s)).astype(t), {"compression": compression, "tile": tile, "predictor": predictor, "rows_per_strip": 5}) for h, w, s, t, top in [(1, 1, 1, "u1", 9), (23, 37, 3, "u1", 4), (130, 90, 1, "u2", 999)]]
    back = list(tiff.pages(tiff.write_tiff(images, order)))
    assert [e for _, _, e in back] == [None] * 3
    assert all((a == b).all() for (a, _), (_, b, _) in zip(images, back))


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 500, bytes(range(256)) * 40, b"ab" * 9000])
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_tiff_errors(spark):
    whole = tiff.write_tiff([(np.ones((4, 4), "u1"), {"compression": tiff.DEFLATE})])
    rows = [(1, None), (2, b""), (3, b"II*\0\xff\xff\xff\x7f"), (4, whole), (5, whole[:8] + b"\0\0\0" + whole[11:])]
    got = {r.id: r for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert 1 not in got and got[2].error and got[3].error and got[5].error
    assert got[4].error is None and bytes(got[4].data) == b"\1" * 16 and (got[4].width, got[4].height) == (4, 4)


def test_text_media_digest(spark):
    texts = [None, "", "x", "é" * 40, "a" * 64, "long text " * 30_000, "x"]
    got = sorted(tiff.text_media_digest(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect())
    for row, text in zip(got, texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[2][1:] == got[6][1:]
    assert tiff.text_media_digest(spark.createDataFrame([], DOCS)).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        if item is not None:
            for i in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, seen = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    seen |= found
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "d3lta", "e", "zeta9", "über"]
    say = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "!", "\n"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([10, 11, 14, 25, 40, 3, 5, 9, 1 if seed % 2 else 4, 12])] + [(90, None), (91, ""), (92, "..."), (93, say(12)), (94, None), (None, say(15))]
    items.append((95, items[3][1]))
    docs = [(i, say(rnd.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, say(9) + " " + (items[rnd.randrange(10)][1]) + " " + say(7)) for i in range(30)]
    docs += [(200, None), (201, ""), (202, "?!"), (100, docs[45][1]), (None, docs[46][1]), (203, items[4][1][5:] + " " + say(3000) + items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination(spark, seed, limit):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", item_id string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in decontam.contamination(frame, bench, broadcast_bytes=limit).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_contamination(docs, items), key=key)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_contamination_empty(spark, limit):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    assert [tuple(r)[1:4] for r in decontam.contamination(docs, none, broadcast_bytes=limit).collect()] == [(3, 0, 0)]
    assert decontam.contamination(docs.limit(0), none, broadcast_bytes=limit).count() == 0
