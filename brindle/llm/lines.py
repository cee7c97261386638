"""Fuzzy line deduplication.

A line is what line feeds separate; its normal form is its words (digits,
letters with A-Z lowered, non-ASCII characters) with single spaces between.
Lines without a word are never touched.  Two normal forms are linked when their
edit similarity ``1 - distance / longer length`` is at least ``similarity``
(``flips=None``, as the query and the pipeline have it).  Of each group of
connected lines the first occurrence stays, by (doc_id, place in the text); all
others are removed, in every document.

1. Equal normal forms (by their 128-bit BLAKE2 digests) are one item from the
   start.  Texts are read once: the forms, what names them and their keys, in
   buckets of bytes, come out of one pass.
2. A line's SimHash has 64 bits voted on by its distinct words, and up to
   BLOCKS_KEPT blocks voted on each by its own share of the line's pairs of
   neighbouring words, of about SHARE pairs (half of it in short lines).  A change touches the blocks of the
   pairs it falls in and leaves all others whole: as long as these are fewer
   than the blocks, two lines have a block in common.  (Blocks cut out of one
   SimHash would not do: similar lines differ in up to 20 of its 64 bits, spread
   over all blocks.)  A block that all its pairs must agree on is kept as their
   sum.  Lines near the border of two block sizes have both.
3. Short lines have a key for each word, and the shortest for each character,
   that is left out: these meet whatever differs in one of them, surely.
4. Lines of long words (over UNSPACED characters on average), as scripts without
   spaces, hashes and encoded data have them, have the least GRAMS_KEPT hashes of
   their runs of GRAM characters as keys: of similar lines enough runs stay.
5. Lines that share a key are compared by hubs (``hubs``), unless their lengths
   or, in all but short lines and lines of few words, too many bits of their
   SimHashes differ (FAR); then the edit similarity of the texts decides.  What
   hubs leave is compared in blocks of a key's lines, and only links come out.

Keys only retrieve; none of them decides.  What shares no key is lost: pairs of
which most words are misspelt, mainly; the README has the measured recall.

With ``flips`` (3 by default) lines are linked only if also their SimHashes
differ in at most so many bits, which leaves out most changes in short lines.
The SimHash is cut into five blocks; as three flipped bits leave two blocks
whole, lines that share any two blocks are all candidates, without loss.

Nulls: a null text is one empty line; a row with a null id is kept as it is
and makes no other line go.  Rows that repeat id and text share one fate, and
of several equal lines in one text the first stays.  Texts of any length are
read whole.  An empty table gives an empty result.  Of further columns,
whatever their names, ``line_digest`` reads none and ``drop_repeated_lines``
keeps all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hubs
from .editing import edit_distance_within, similar_texts
from .textops import ASCII_LOWER, U64, grams, mix, pieces, powers, run_hashes, runs, trim, utf8
from .workspace import Workspace, partitions

SIMILARITY = 80
BITS, FLIPS = 64, 3
#: Lines of up to so many words, or characters without spaces, have a key for each one left out.
DROP_WORDS, DROP_CHARS = 14, 24
#: Pairs of words in a block (half of it in lines of up to SHORT_PAIRS pairs), blocks kept of a line, and how near to the border of two block sizes (in powers of two) it has both.
SHARE, SHORT_PAIRS, BLOCKS_KEPT, BORDER = 3, 12, 12, 0.3
#: A block tells something if its words have so many bytes together and, in lines of over SINGLE_PAIRS pairs, if it has two pairs or more.
BLOCK_BYTES, SINGLE_PAIRS = 12, 24
#: The five blocks of a SimHash (first bit, bits) for ``flips``.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Characters a word, on average, from which lines have keys of characters; characters in a run (ASCII, others) and keys of a line.
UNSPACED, GRAM, GRAMS_KEPT = 12, (6, 4), 16
#: Of lines that share a key, those of FAR_WORDS words or more and of over so many characters are compared only if at most so many bits of their SimHashes differ.
#: Similar lines of about 40 words differ in 6 mostly and hardly ever in over 16, ones of few words in more; unrelated lines in 22 to 36.
FAR, FAR_WORDS = ((40, 24), (100, 19)), 12
HUB_ROUNDS = 3
#: Members of a key that are compared as one block at the end, on average.
REST_BLOCK = 128
#: Pairs of members whose lengths and SimHashes are looked at together.
PAIRS_SEEN = 1 << 16
#: Pairs whose edit distances are worked out together.
PAIRS_AT_ONCE = 4096
#: Bytes of what is sent to all tasks (numbers of lines to look up, lines to remove); more is joined.
BROADCAST_BYTES = 16 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def ended(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each with a line feed behind it, so that line feeds end lines and part documents."""
    raw, at = utf8(texts)
    return np.insert(raw, at[1:], 10), at + np.arange(len(at))


def simhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of the distinct hashes (40 bits of each) of every run first[i]:first[i + 1]; empty runs give 0.

    Each word counts once: otherwise a few very common words would decide the
    bits of every long line of a language.
    """
    out = np.zeros(len(first) - 1, U64)
    if not len(hashes):
        return out
    if len(out) >= 1 << 24:  # more lines than fit beside 40 bits
        half = len(out) // 2
        return np.concatenate((simhashes(hashes[: first[half]], first[: half + 1]), simhashes(hashes[first[half] :], first[half:] - first[half])))
    key = np.sort((np.repeat(np.arange(len(out), dtype=U64), np.diff(first)) << U64(40)) | (hashes >> U64(24)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    line = (key >> U64(40)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(begin, len(line)))
    parts = -(-size // 255)  # sums of at most 255 bits fit in a byte
    cuts = np.repeat(begin, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    bits, of_line, whole = mix(key & U64((1 << 40) - 1)), np.cumsum(parts) - parts, np.zeros(len(begin), U64)
    for b in range(8):  # bit b of each byte; eight counters in a number
        sums = np.add.reduceat((bits >> U64(b)) & U64(0x0101010101010101), cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        if len(cuts) > len(begin):
            sums = np.add.reduceat(sums.astype(np.int64), of_line, axis=0)
        most = (2 * sums.astype(np.int32) > size[:, None]).astype(np.uint8) << np.uint8(b)
        whole |= np.ascontiguousarray(most).view("<u8").ravel()
    out[line[begin]] = whole
    return out


def _inverse_powers(n: int) -> np.ndarray:
    """The inverses of ``powers(n)``, modulo 2**64."""
    steps = np.full(n, U64(pow(int(powers(2)[1]), -1, 1 << 64)), dtype=U64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=U64)


def _ranges(first: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each item of the runs in take, offsets between those runs)."""
    n = np.diff(first)[take]
    at = np.concatenate(([0], np.cumsum(n)))
    return np.arange(int(at[-1])) - np.repeat(at[:-1] - first[:-1][take], n), at


def _without_one(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, run) of every run, whole and with each of its items left out that has at most half of its size."""
    if not len(hashes):
        return np.empty(0, U64), np.empty(0, np.int64)
    run = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * powers(len(hashes) + 1)[: len(hashes)], dtype=U64)))
    shift, inverse = _inverse_powers(len(hashes) + 1), _inverse_powers(2)[-1]
    item = np.arange(len(hashes))
    left = (total[item] - total[at[run]] + (total[at[run + 1]] - total[item + 1]) * inverse) * shift[at[run]]
    whole = (total[at[1:]] - total[at[:-1]]) * shift[at[:-1]]
    bytes_before = np.concatenate(([0], np.cumsum(size)))
    small = 2 * size <= (bytes_before[at[1:]] - bytes_before[at[:-1]])[run]
    return mix(np.concatenate((left[small], whole))), np.concatenate((run[small], np.arange(len(whole))))


def block_keys(hashes: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, line) of the blocks of every line, in lists; each block is the sum of its share of the pairs of neighbouring words."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(line[:-1] == line[1:])
    line, pair, weight = line[at], mix(hashes[at] * U64(0x9E3779B97F4A7C15) + hashes[at + 1]), size[at] + size[at + 1]
    n, found, before = np.diff(first) - 1, [], None
    share = np.log2(np.maximum(n, 1) / np.where(n > SHORT_PAIRS, SHARE, SHARE / 2))
    for border in (-BORDER, BORDER):
        level = np.maximum(0, np.ceil(share + border)).astype(np.int64)
        block = (pair >> U64(32)) & ((U64(1) << level[line].astype(U64)) - U64(1))
        fresh = np.ones(len(n), bool) if before is None else level != before
        take = np.flatnonzero((block < BLOCKS_KEPT) & fresh[line])
        slot = line[take] * BLOCKS_KEPT + block[take].astype(np.int64)
        total = np.zeros(len(n) * BLOCKS_KEPT, U64)
        np.add.at(total, slot, mix(pair[take]))
        votes = np.bincount(slot, minlength=len(total))
        known = np.bincount(slot, weights=weight[take], minlength=len(total))
        some = np.flatnonzero((known >= BLOCK_BYTES) & (votes > np.repeat(n > SINGLE_PAIRS, BLOCKS_KEPT)))
        found.append((mix(total[some] + (some % BLOCKS_KEPT + 64 * level[some // BLOCKS_KEPT] + 1).astype(U64) * U64(0xD6E8FEB86659FD93)), some // BLOCKS_KEPT))
        before = level
    return found


def _characters(low: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the characters of the words of the lines in take, offsets of these lines in them, bytes of each line)."""
    item, at = _ranges(first, take)
    byte = np.repeat(begin[item] - (np.cumsum(size[item]) - size[item]), size[item]) + np.arange(int(size[item].sum()))
    head = np.flatnonzero((low[byte] & 0xC0) != 0x80)  # the first byte of each character
    ends = np.concatenate(([0], np.cumsum(size[item])))[at]
    return run_hashes(low[byte], head, np.append(head[1:], len(byte))), np.searchsorted(head, ends), np.diff(ends)


def gram_keys(chars: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of the GRAMS_KEPT least hashes of each line's runs of ``gram`` characters."""
    found, place = grams(chars, at, gram)
    line = np.searchsorted(at, place, side="right") - 1
    order = np.lexsort((found, line))
    found, line = found[order], line[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (line[1:] != line[:-1])
    found, line = found[fresh], line[fresh]
    least = np.arange(len(line)) - np.searchsorted(line, line) < GRAMS_KEPT
    return mix(found[least] + U64(gram)), line[least]


def retrieval_keys(low: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets of lines in them); line i has the words first[i]:first[i + 1].  Similar lines share a key, others hardly."""
    n_words, size = np.diff(first), end - begin
    bytes_before = np.concatenate(([0], np.cumsum(size)))
    found = []
    take = np.flatnonzero((n_words > 1) & (n_words <= DROP_WORDS))
    item, at = _ranges(first, take)
    key, run = _without_one(hashes[item], at, size[item])
    found.append((key, take[run]))
    take = np.flatnonzero((n_words > 0) & (bytes_before[first[1:]] - bytes_before[first[:-1]] <= 4 * DROP_CHARS))
    chars, at, _ = _characters(low, begin, size, first, take)
    short = np.flatnonzero(np.diff(at) <= DROP_CHARS)
    item, at = _ranges(at, short)
    key, run = _without_one(chars[item] ^ U64(0xD6E8FEB86659FD93), at, np.ones(len(item), np.int64))
    found.append((key, take[short][run]))
    length = bytes_before[first[1:]] - bytes_before[first[:-1]]
    take = np.flatnonzero((length > DROP_CHARS) & (length > UNSPACED * n_words))  # by bytes first, then by characters
    if len(take):
        chars, at, weight = _characters(low, begin, size, first, take)
        long = (np.diff(at) > DROP_CHARS) & (np.diff(at) > UNSPACED * n_words[take])
        for other, gram in enumerate(GRAM):
            mine = np.flatnonzero(long & ((2 * weight > 3 * np.diff(at)) == other))
            item, mine_at = _ranges(at, mine)
            key, run = gram_keys(chars[item], mine_at, gram)
            found.append((key, take[mine][run]))
    found += block_keys(hashes, size, first)
    key, run = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(run, kind="stable")
    return key[order], np.searchsorted(run[order], np.arange(len(n_words) + 1))


LINE_SCHEMA = "doc_id long, body long, line int, item long, check long, form string, bucket int, keys binary, items binary"


def _digests(data: bytes, cuts: list[int], salt: int) -> np.ndarray:
    """128 bits of each part of data, as two numbers."""
    salt_bytes = salt.to_bytes(16, "little")
    return np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16, salt=salt_bytes).digest() for a, b in zip(cuts, cuts[1:])]), "<i8").reshape(-1, 2)


def forms(low: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words of every line with single spaces between; every line has a word, and a byte follows each word."""
    keep = inside.copy()
    keep[end] = True
    keep[end[first[1:] - 1]] = False
    size = end - begin + 1
    size[first[1:] - 1] -= 1
    ends = np.cumsum(size)
    out = low[keep]
    gaps = np.ones(len(ends), bool)
    gaps[first[1:] - 1] = False
    out[ends[gaps] - 1] = 32
    return out, np.concatenate(([0], ends))[first]


def _sim_keys(sims: np.ndarray) -> np.ndarray:
    """The keys of SimHashes for ``flips``, a row each: any blocks that three flipped bits leave whole."""
    parts = [(sims >> U64(begin)) & U64((1 << bits) - 1) for begin, bits in BLOCKS]
    return np.stack([mix((parts[i] << U64(13) | parts[j]) + U64((k + 1) << 26)) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - FLIPS))], axis=1)


def _lines(docs: DataFrame, flips: int | None, digests: Callable[[bytes, list[int], int], np.ndarray], salt: int) -> DataFrame:
    """A row for each line with words, with a number, a further one to check it, and the normal form; and rows with keys of these numbers (``hubs.packed``)."""
    names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]

    def pack(keys: list[np.ndarray], items: list[np.ndarray]) -> pa.RecordBatch:
        packs = hubs.packed(np.concatenate(keys), np.concatenate(items))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([*(pa.nulls(packs.num_rows, kind) for kind in kinds), *packs.columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_items, held = [], [], 0
        for batch in (p for b in batches for p in pieces(b)):
            raw, at = ended(batch.column(1))
            low = ASCII_LOWER[raw]
            inside = _IN_WORD[low]
            begin, end = runs(inside, at[[0, -1]])
            if not len(begin):
                continue
            start = np.append(0, np.flatnonzero(raw == 10) + 1)
            first = np.searchsorted(begin, start)
            some = np.flatnonzero(np.diff(first))
            doc = np.searchsorted(at, start[some], side="right") - 1
            line = some - np.searchsorted(start, at)[doc]
            first = np.append(first[some], len(begin))
            body, form_at = forms(low, inside, begin, end, first)
            digest = digests(body.tobytes(), form_at.tolist(), salt)
            rows = pa.array(doc)
            columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(line, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            columns.append(pa.StringArray.from_buffers(len(some), pa.py_buffer(form_at.astype(np.int32)), pa.py_buffer(body)))
            columns += [pa.nulls(len(some), kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            items, take = np.unique(digest[:, 0], return_index=True)
            word, word_at = _ranges(first, take)
            hashes = run_hashes(low, begin[word], end[word])
            if flips is None:
                keys, key_at = retrieval_keys(low, begin[word], end[word], hashes, word_at)
            else:
                keys = _sim_keys(simhashes(hashes, word_at))
                keys, key_at = keys.ravel(), np.arange(len(keys) + 1) * keys.shape[1]
            held_keys.append(keys), held_items.append(np.repeat(items, np.diff(key_at)))
            held += len(keys)
            if held >= hubs.PACKED_AT_ONCE:
                yield pack(held_keys, held_items)
                held_keys, held_items, held = [], [], 0
        if held:
            yield pack(held_keys, held_items)

    return docs.select("doc_id", "text", "body").mapInArrow(run, LINE_SCHEMA)


def _numbered(docs: DataFrame, space: Workspace, flips: int | None, digests: Callable[[bytes, list[int], int], np.ndarray] = _digests) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, packed keys, different lines): a line is named by half of its digest; should two have the same half, all are digested anew with another salt."""
    salt = 0
    while True:
        table = space.write(_lines(docs, flips, digests, salt), "lines")
        lines = table.where("item is not null").select("doc_id", "body", "line", "item", "check", "form")
        distinct = lines.groupBy("item").agg(F.min(F.struct("doc_id", "body", "line")).alias("first"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        distinct = space.write(distinct, "distinct")
        if not distinct.where("low <> high").limit(1).count():
            return lines, table.where("bucket is not null").select("bucket", "keys", "items"), distinct.select("item", "first", "n")
        salt += 1


INFO_SCHEMA = "item long, sim long, size long, words int, form string"


def _infos(distinct: DataFrame) -> DataFrame:
    """The forms of distinct with their SimHashes, characters and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, "form")):
            raw, at = utf8(batch.column(1))
            begin, end = runs(_IN_WORD[raw], at)
            first = np.searchsorted(begin, at)
            more = np.concatenate(([0], np.cumsum((raw & 0xC0) == 0x80)))  # bytes that don't begin a character
            columns = [batch.column(0), pa.array(simhashes(run_hashes(raw, begin, end), first).view(np.int64)), pa.array(np.diff(at) - np.diff(more[at])), pa.array(np.diff(first), pa.int32()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INFO_SCHEMA.split(", ")])

    return distinct.select("item", "form").mapInArrow(run, INFO_SCHEMA)


def normal_form(line: str) -> str:
    raw = np.frombuffer(line.encode(), np.uint8)
    low = ASCII_LOWER[raw]
    begin, end = runs(_IN_WORD[low], np.array([0, len(low)]))
    data = low.tobytes()
    return b" ".join(data[a:b] for a, b in zip(begin.tolist(), end.tolist())).decode()


def similar_lines(a: str, b: str, similarity: int) -> bool:
    return edit_distance_within(a, b, (100 - similarity) * max(len(a), len(b)) // 100) is not None


def _similar_pairs(similarity: int):
    """Compares the members of a key, or two blocks of them, in rows that are sorted so: pairs (a, b) that are linked; each pair under its least common key alone."""

    def pairs(group: pa.Table) -> Iterator[tuple[int, int, str, str]]:
        key, one, two = (group.column(c)[0].as_py() for c in ("key", "one", "two"))
        item, component, block, size, words = (group.column(c).to_numpy() for c in ("item", "component", "block", "size", "words"))
        if component.min() == component.max():
            return
        sim = group.column("sim").to_numpy().view(U64)
        keys, forms = group.column("keys").to_pylist(), group.column("form").to_pylist()
        left = np.arange(len(item)) if one == two else np.flatnonzero(block == one)
        right = left if one == two else np.flatnonzero(block == two)
        for some in np.array_split(left, -(-len(left) * len(right) // PAIRS_SEEN)):
            i, j = (x.ravel() for x in np.meshgrid(some, right, indexing="ij"))
            fits = component[i] != component[j]
            if one == two:
                fits &= i < j
            i, j = i[fits], j[fits]
            long, short = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
            fits = 100 * (long - short) <= (100 - similarity) * long
            apart, few = np.bitwise_count(sim[j] ^ sim[i]), np.minimum(words[j], words[i]) < FAR_WORDS
            for chars, bits in FAR:
                fits &= (long <= chars) | (apart <= bits) | few
            for i, j in zip(i[fits].tolist(), j[fits].tolist()):
                if next(k for k in keys[i] if k in keys[j]) == key:  # they are in order
                    yield int(min(item[i], item[j])), int(max(item[i], item[j])), forms[i], forms[j]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []  # the rows of a group whose end isn't seen yet
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            place = np.stack([table.column(c).to_numpy() for c in ("key", "one", "two")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[-1].as_py() != table.column(c)[0].as_py() for c in ("key", "one", "two")):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            for begin, end in zip([0, *cuts.tolist()], cuts.tolist()):
                yield pa.concat_tables([*held, table.slice(begin, end - begin)]).combine_chunks()
                held = []
            held.append(table.slice(int(cuts[-1]) if len(cuts) else 0))
        if held:
            yield pa.concat_tables(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _bundles((p for g in groups(batches) for p in pairs(g)), PAIRS_AT_ONCE):
            a, b, x, y = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(similar_texts(x, y, similarity)))
        trim()

    return run


def _bundles(items: Iterator, n: int) -> Iterator[list]:
    while some := list(islice(items, n)):
        yield some


def _decided(docs: DataFrame, similarity: int, hub_rounds: int, space: Workspace, flips: int | None, broadcast_bytes: int) -> DataFrame:
    """(doc_id, body, gone): numbers of the lines to remove, to be broadcast if they are few."""
    spark, place = docs.sparkSession, F.struct("doc_id", "body", "line")
    lines, packs, distinct = _numbered(docs.where("doc_id is not null"), space, flips)
    few = lambda df, bytes_: F.broadcast(df) if bytes_ * df.count() <= broadcast_bytes else df
    crowd = hubs.shared(space, packs, "crowd", space.size("lines"))
    items = space.write(crowd.select("item").distinct(), "items")
    firsts = space.write(distinct.join(few(items, 16), "item").select("item", "first.*"), "firsts")
    texts = lines.join(few(firsts, 40), ["item", "doc_id", "body", "line"]).select("item", "form")
    near_forms = space.write(_infos(texts), "forms")  # of lines that share keys alone
    if near_forms.count() > firsts.count():  # repeated rows of documents
        near_forms = space.write(near_forms.dropDuplicates(["item"]), "forms-once")
    info = F.struct("sim", "size", "words").alias("info")
    # a key for lines of about one length: each line is in its class and the next one, as wide as similar lines may differ
    step = -math.log(similarity / 100) if 0 < similarity < 100 else 1.0
    of_size = F.floor(F.log(F.col("info.size").cast("double")) / step) if similarity > 0 else F.lit(0).cast("long")
    sized = crowd.join(few(near_forms.select("item", info), 40), "item").withColumn("class", F.explode(F.array(of_size, of_size + 1)))
    met = hubs.different(space, space.write(sized.select(F.xxhash64("key", "class").alias("key"), "item", "info"), "sized"), "met")

    def near(x: Column, y: Column) -> Column:
        """What the edit similarity implies for lengths, and for SimHashes almost surely; with ``flips`` what the definition asks of these."""
        long = F.greatest(x["size"], y["size"])
        fits = 100 * (long - F.least(x["size"], y["size"])) <= (100 - similarity) * long
        apart = F.bit_count(x["sim"].bitwiseXOR(y["sim"]))
        if flips is not None:
            return fits & (apart <= flips)
        for chars, bits in FAR:
            fits &= (long <= chars) | (apart <= bits) | (F.least(x["words"], y["words"]) < FAR_WORDS)
        return fits

    def remaining(members: DataFrame) -> DataFrame:
        """The linked pairs of different components that share a key, found block by block of a key's members: no pair leaves its task unless it is linked."""
        own = members.groupBy("item").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.first("info").alias("info"), F.first("component").alias("component"))
        own = space.write(own.join(near_forms.select("item", "form"), "item").select("item", "component", "info.*", "keys", "form"), "rest")
        dealt = members.select("key", "item").join(members.groupBy("key").agg(F.ceil(F.count("*") / REST_BLOCK).cast("int").alias("blocks")), "key")
        dealt = dealt.select("key", "item", F.pmod(F.xxhash64("item"), "blocks").cast("int").alias("block"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        rows = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "item").join(own, "item")
        rows = rows.repartition(partitions(spark, 16 * space.size("rest")), "key", "one", "two").sortWithinPartitions("key", "one", "two")  # few bytes, but much to compare
        return rows.mapInArrow(_similar_pairs(similarity), "a long, b long").distinct()

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _bundles(batches, PAIRS_AT_ONCE // 512):
                table = pa.Table.from_batches(some).combine_chunks()
                keep = similar_texts(table.column(2).to_pylist(), table.column(3).to_pylist(), similarity)
                yield from table.select([0, 1]).filter(pa.array(keep)).to_batches()
            trim()

        items = space.write(pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct(), f"items-{name}")
        texts = space.write(near_forms.join(few(items, 16), "item").select("item", "form"), f"texts-{name}")
        left, right = texts.select(F.col("item").alias("a"), F.col("form").alias("x")), texts.select(F.col("item").alias("b"), F.col("form").alias("y"))
        return space.write(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name, batch_rows=512)

    stars = hubs.components(space, met, near, confirm, hub_rounds, remaining if flips is None else None)
    of = stars.select(F.col("u").alias("item"), F.col("v").alias("group")).union(stars.select(F.col("v").alias("item"), F.col("v").alias("group")).distinct())
    of = space.write(of, "of")
    grouped = distinct.select("item", "first").join(few(of, 24), "item")
    best = grouped.groupBy("group").agg(F.min("first").alias("best"))
    best = space.write(of.join(best, "group").select("item", "best"), "best")
    stays = distinct.join(few(best, 40), "item", "left").where("n > 1 or best is not null").select("item", F.coalesce("best", "first").alias("stays"))
    stays = space.write(stays, "stays")
    gone = lines.select("doc_id", "body", "line", "item").join(few(stays, 40), "item").where(place != F.col("stays"))
    gone = space.write(gone.groupBy("doc_id", "body").agg(F.collect_set("line").alias("gone")), "gone")
    space.drop("lines", "distinct", "crowd", "items", "firsts", "forms", "forms-once", "sized", "met", "of", "best", "stays")
    size = gone.agg(F.sum(4 * F.size("gone") + 48)).first()[0] or 0
    return F.broadcast(gone) if size <= broadcast_bytes else gone


def _with_body(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("body"))


def _kept_lines(text: bytes, gone: list[int] | None) -> tuple[bytes, int]:
    if not gone:
        return text, text.count(b"\n") + 1
    lines, gone = text.split(b"\n"), set(gone)
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines)


RESULT_SCHEMA = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


def line_digest(docs: DataFrame, similarity: int = SIMILARITY, hub_rounds: int = HUB_ROUNDS, flips: int | None = FLIPS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: its lines, how many were removed, and the digest of the rest."""
    docs = _with_body(docs)
    gone = _decided(docs, similarity, hub_rounds, Workspace(docs.sparkSession, "lines"), flips, broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            kept = [_kept_lines(t or b"", g) for t, g in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
            n_gone = [len(g or ()) for g in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in kept], pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t, _ in kept], pa.string())], names=[x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return docs.join(gone, ["doc_id", "body"], "left").select("doc_id", "text", "gone").mapInArrow(run, RESULT_SCHEMA)


def drop_repeated_lines(docs: DataFrame, similarity: int = SIMILARITY, hub_rounds: int = HUB_ROUNDS, flips: int | None = FLIPS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the repeated lines taken out of ``text`` and ``n_chars``, if there is one, counted anew; null texts stay null."""
    gone = _decided(_with_body(docs), similarity, hub_rounds, Workspace(docs.sparkSession, "lines"), flips, broadcast_bytes)
    gone = gone.select(F.col("doc_id").alias("__line_id"), F.col("body").alias("__line_body"), F.col("gone").alias("__line_gone"))
    text = F.col("text").cast("string")
    lines = F.split(text, "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("__line_gone", s["i"]))
    new = F.when(F.col("__line_gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    out = docs.join(gone, (docs["doc_id"].cast("long") == F.col("__line_id")) & (F.xxhash64(text) == F.col("__line_body")), "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
