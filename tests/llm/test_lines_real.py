"""Recall of fuzzy lines on the driver's documents: a part of the lines against all lines, by edit similarity alone."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from brindle.llm import lines
from brindle.llm.textops import run_hashes, runs, utf8

QUERIES = 400


def grams(forms, size, slots):
    """Counts of runs of characters by hash; one edit changes at most ``size`` of them on either side."""
    out = np.zeros((len(forms), slots), np.uint8)
    for i, form in enumerate(forms):
        code = np.frombuffer(form.encode("utf-32le"), np.uint32).astype(np.uint64)
        n = len(code) - size + 1
        if n > 0:
            h = sum(code[k : k + n] * np.uint64(1_000_003**k % 2**63) for k in range(size))
            out[i] = np.minimum(np.bincount(((h ^ (h >> np.uint64(17))) % np.uint64(slots)).astype(np.int64), minlength=slots), 255)
    return out


def similar_pairs(forms, queries):
    """All pairs of a query and a form with edit similarity 0.8; counts of runs only leave out what can't have it."""
    size, found = np.array([len(f) for f in forms]), set()
    two, three = grams(forms, 2, 256), grams(forms, 3, 512)
    for i in queries:
        most = 20 * np.maximum(size, size[i]) // 100
        near = np.flatnonzero(np.abs(size - size[i]) <= most)
        near = near[np.abs(two[near].astype(np.int16) - two[i]).sum(axis=1) <= 4 * most[near]]
        near = near[np.abs(three[near].astype(np.int16) - three[i]).sum(axis=1) <= 6 * most[near]]
        found |= {(min(i, j), max(i, j)) for j in near.tolist() if j != i and lines.edit_distance_within(forms[i], forms[j], int(most[j])) is not None}
    return found


def test_recall_on_real_lines():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    forms = sorted({f for t in texts for line in (t or "").split("\n") if (f := lines.normal_form(line))})
    pairs = sorted(similar_pairs(forms, np.random.default_rng(1).permutation(len(forms))[:QUERIES].tolist()))
    raw, at = utf8(pa.array(forms))
    begin, end = runs(lines._IN_WORD[raw], at)
    hashes, first = run_hashes(raw, begin, end), np.searchsorted(begin, at)
    keys, key_at = lines.retrieval_keys(raw, begin, end, hashes, first)
    own, sims = [set(keys[a:b].tolist()) for a, b in zip(key_at, key_at[1:])], lines.simhashes(hashes, first)
    met = [bool(own[a] & own[b]) and all(max(len(forms[a]), len(forms[b])) <= chars or int(np.bitwise_count(sims[a] ^ sims[b])) <= bits for chars, bits in lines.FAR) for a, b in pairs]
    print(f"{sum(met)} of {len(pairs)} pairs of similar lines are compared")
    assert len(pairs) >= 25 and sum(met) >= 0.9 * len(pairs)
