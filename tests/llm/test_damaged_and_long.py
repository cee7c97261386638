"""Damaged files, hostile values, very long texts and columns with clashing names."""

import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import language, lines, neardup, packing, pii, repeats, tiff
from brindle.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def header(width, height, compression, data, extra=(), **tags):
    """A file of one page with these sizes, whatever its data."""
    at = 8 + len(data) + len(data) % 2
    entries = [(tiff.WIDTH, 4, width), (tiff.LENGTH, 4, height), (tiff.BITS, 3, 8), (tiff.COMPRESSION, 3, compression), *extra]
    if not any(t == tiff.TILE_OFFSETS for t, _, _ in extra):
        entries += [(tiff.STRIP_OFFSETS, 4, 8), (tiff.ROWS_PER_STRIP, 4, height), (tiff.STRIP_COUNTS, 4, len(data))]
    out = b"II" + struct.pack("<HI", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(entries))
    for tag, kind, value in sorted(entries):
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<H2x", value) if kind == 3 else struct.pack("<I", value))
    return out + b"\0\0\0\0"


def tiles(wide, high, data):
    return ((tiff.TILE_WIDTH, 4, wide), (tiff.TILE_LENGTH, 4, high), (tiff.TILE_OFFSETS, 4, 8), (tiff.TILE_COUNTS, 4, len(data)))


def test_damaged_pages_are_rows(spark):
    bomb = zlib.compress(bytes(50_000_000), 9)
    files = [
        header(1 << 24, 1 << 20, tiff.DEFLATE, b"x"), header(8, 8, tiff.DEFLATE, b"x", tiles(0, 8, b"x")), header(8, 8, tiff.DEFLATE, b"x", tiles(8, 0, b"x")),
        header(8, 8, tiff.DEFLATE, b"x", tiles(1 << 30, 1 << 30, b"x")), header(0, 8, tiff.PLAIN, b"x"), header(8, 8, tiff.DEFLATE, b"garbage"), header(8, 8, tiff.LZW, b"\xff" * 9), header(8, 8, 99, b"x"), header(200, 10, tiff.PLAIN, b"x" * 2000),
        header(8, 8, tiff.DEFLATE, bomb), header(8, 8, tiff.PACKBITS, b"\x81\1" * 1000),
    ]
    got = {r.id: r for r in tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary").withColumn("page", F.lit("x")), max_samples=1000).collect()}
    assert len(got) == len(files)
    assert all(got[i].error and got[i].data is None for i in range(9)) and "1000 samples" in got[0].error and "1000 samples" in got[8].error
    assert got[9].error is None and bytes(got[9].data) == bytes(64) and got[10].error is None and bytes(got[10].data) == b"\1" * 64


@pytest.mark.parametrize("rows", [1, 2, 8, 9, 128, 129, 257, 500])
def test_stored_pages(rows):
    """PackBits, LZW and deflate, strips and tiles are all written, and what is written is read."""
    payload = np.random.default_rng(rows).integers(97, 101, rows * 64).astype(np.uint8).tobytes()
    found = list(tiff.pages(tiff.payload_tiff(payload)))
    assert all(e is None for _, _, e in found) and b"".join(p.tobytes() for _, p, _ in found) == payload
    kinds = [t[tiff.COMPRESSION][0] for t, _, _ in found]
    assert kinds == {1: [tiff.PACKBITS], 2: [tiff.LZW], 8: [tiff.LZW], 9: [tiff.DEFLATE]}.get(rows, [tiff.DEFLATE, tiff.DEFLATE, tiff.LZW, tiff.DEFLATE][: len(kinds)])
    assert [tiff.TILE_OFFSETS in t for t, _, _ in found] == [k % 2 == 1 for k in range(len(found))]
    assert rows < 9 or len(found[0][0][tiff.STRIP_OFFSETS]) == -(-min(rows, 128) // 32)


@pytest.mark.parametrize("text,spans", [
    ("IBAN ES91 2100 0418 4502 0005 1332 BANK", [("iban", "ES91 2100 0418 4502 0005 1332")]), ("account number is 123456789", [("account", "123456789")]),
    ("iBan: de89370400440532013000.", [("iban", "de89370400440532013000")]), ("iban: DE89 3704 0044 0532 0130 00x", []), ("IBAN ZZ89 3704 0044 0532 0130 00", []), ("IBAN DE88 3704 0044 0532 0130 00", []),
    ("mailto:a.b@c.de x", [("url", "mailto:a.b@c.de"), ("email", "a.b@c.de")]), ("HTTPS://Ex.com/a?b see", [("url", "HTTPS://Ex.com/a?b")]), ("https:// none", []),
    ('İ token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]), ("Bearer abcdefghijklmnop1234567 x", [("secret", "abcdefghijklmnop1234567")]),
    ("the secret abcdefghijklmnop1234567", []), ("password: hunter2", []), ("api_key=abcdefghijklmnopqrstuvwxyz", []), ("1.1.1." + "0" * 5000, [("ip", "1.1.1." + "0" * 5000)]), ("1.1.1." + "9" * 5000, []), ("1.1.1.0256", []),
])
def test_spans(text, spans):
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text, pii.anchors())] == spans


def test_long_text_of_personal_data(spark):
    text = "zeros 1.1.1." + "0" * 300_000 + " then x@y.org and 4111 1111 1111 1111, " + "9" * 200_000 + " +1 555 010 2345 " + "a" * 500_000 + "@b.cd"
    got = pii.personal_data_digest(spark.createDataFrame([(1, text, 4)], DOCS + ", n_ip int")).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_spans) for r in got] == [(1, 2, 1, 1, 1, 5)]


LONG = " ".join(f"word{i % 977} of line {i % 13}.\n" if i % 9 == 0 else f"w{i % 1009}" for i in range(300_000))


@pytest.mark.parametrize("operator", [lines.line_digest, neardup.near_duplicates, packing.pack, repeats.remove_repeats, pii.personal_data_digest, tiff.text_media_digest, language.identify_languages])
def test_long_texts_and_clashing_columns(spark, operator):
    """A text of about 2 MB beside small ones, nulls and repeats; further columns have names of results and of joins."""
    rows = [(1, LONG), (2, "short text here"), (2, "short text here"), (3, None), (None, "no id"), (4, ""), (5, LONG)]
    clash = ["component_id", "kept", "n_lines", "key", "item", "body", "line", "media", "place", "rep", "chunk", "spans", "score", "held_out", "start", "ids"]
    frame = spark.createDataFrame([(*r, "en") for r in rows], DOCS + ", lang string")
    plain = [tuple(r) for r in operator(frame).collect()]
    other = [tuple(r) for r in operator(frame.select("*", *[F.lit("x").alias(c) for c in clash])).collect()]
    assert sorted(map(repr, plain)) == sorted(map(repr, other)) and {r[0] for r in plain} == {1, 2, 3, 4, 5, None}
    assert operator(frame.limit(0)).count() == 0


def test_operators_are_named():
    assert [n for n in QUERIES if re.match(r"op\d+_", n)][:10] == sorted((n for n in QUERIES if re.match(r"op\d+_", n)), key=lambda n: int(n[2:].split("_")[0]))[:10]
