"""op5_packing against a plain version: keys, order and cuts are worked out anew, document by document."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from brindle.llm import packing, tokens
from brindle.llm.queries import op5_packing


@pytest.mark.parametrize(("axes", "bits"), [(2, 1), (2, 4), (3, 3), (4, 3)])
def test_curve_visits_every_cell_once_by_single_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_key(ids, where):
    counts = {}
    for i in ids:
        slot = int(where.slot[i])
        counts[slot] = counts.get(slot, 0) + 1
    v = [math.log1p(counts.get(b, 0)) - math.log1p(counts.get(b + packing.BUCKETS, 0)) for b in range(packing.BUCKETS)]
    norm = max(1e-9, math.sqrt(math.fsum(x * x for x in v)))
    point = []
    for axis in range(packing.AXES):
        s = math.fsum(x / norm * where.matrix[b, axis] for b, x in enumerate(v) if x)
        point.append(min((1 << packing.AXIS_BITS) - 1, max(0, int(1 / (1 + math.exp(-1.7 * s)) * (1 << packing.AXIS_BITS)))))
    return int(packing.hilbert_keys(np.array([point]), packing.AXIS_BITS)[0])


def plain_pack(docs, encode, where, size):
    """(doc, start, length, crc, total, sequence, offset) of one stretch."""
    stream = []
    for _, doc, ids in sorted((plain_key(ids, where), doc, [*ids, 1]) for doc, ids in ((d, encode(t or "")) for d, t in docs)):
        stream += [(doc, k, i, len(ids)) for k, i in enumerate(ids)]
    cuts, left = [size] * (len(stream) // size), len(stream) % size
    cuts += [1 << b for b in range(size.bit_length(), -1, -1) if left >> b & 1]
    out, at = [], 0
    for sequence, n in enumerate(cuts):
        part = stream[at : at + n]
        begin = 0
        for doc, group in itertools.groupby(part, key=lambda x: x[0]):
            piece = list(group)
            out.append((doc, piece[0][1], len(piece), zlib.crc32(np.array([x[2] for x in piece], "<u4").tobytes()), piece[0][3], sequence, begin))
            begin += len(piece)
        at += n
    return sorted(out)


@pytest.mark.parametrize("size", [2048, 32])
def test_one_stretch(spark, tmp_path, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    rnd = random.Random(size)
    words = "the river tokenizer Zürich x9 !? über-alles qqqzz and of stone cold".split()
    docs = [(i, " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.choice([0, 3, 40, 400])))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "word " * 9000), (63, docs[5][1]), (64, docs[5][1])]
    frame = spark.createDataFrame(rnd.sample(docs, len(docs)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        got = (op5_packing(spark, str(tmp_path)) if size == packing.SIZE else packing.pack(frame, size)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = min(r.sequence_id for r in got)
    have = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id - first, r.offset) for r in got)
    assert have == plain_pack(docs, encode, packing.Projection(tokens.encoder(tokens.TOKENIZER).vocabulary), size)
