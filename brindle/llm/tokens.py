"""Token ids of whole texts with a public tokenizer file, in Arrow batches.

The tokenizer drops white space and never joins across it, so a text is cut at
spaces and line feeds, each distinct chunk of a batch is encoded once by the
``tokenizers`` library (or taken from a bounded cache), and the ids of the text
are gathered from those of its chunks.  As it lower-cases and ends a run of
letters at any mark, A-Z are lowered and ``.,;:!?`` behind a letter cut off
beforehand, which leaves fewer distinct chunks; texts that may hold a special
token are left as they are.  The result equals encoding whole texts.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import ASCII_LOWER, utf8

#: The tokenizer file: a name known to the package of public tokenizers, or a path.
TOKENIZER = "word_bpe_49k.json"
CACHE_IDS = 4_000_000
TEXT_BYTES = 2 << 20


def tokenizer_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[10] = 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b".,;:!?")] = True


def _simpler(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts for the tokenizer, with fewer distinct chunks."""
    if len(raw) < 2 or ((raw[:-1] == 60) & (raw[1:] == 124)).any():  # "<|" begins a special token
        return _SPACED[raw], at
    cuts = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
    out = np.full(len(raw) + len(cuts), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[cuts + np.arange(len(cuts))] = False
    out[keep] = _SPACED[ASCII_LOWER[raw]]
    return out, at + np.searchsorted(cuts, at)


class Encoder:
    """Encodes string arrays; keeps what it has encoded up to CACHE_IDS ids."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(self.vocabulary, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.entries = 0

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk).

        Chunks of letters only are one word each, so many are encoded as one
        text and told apart by the ids that end words.
        """
        words = [k for k, c in enumerate(chunks) if c.isalpha()]
        texts = [" ".join([chunks[k] for k in words[i : i + 512]]) for i in range(0, len(words), 512)]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            words, ids, ends = [], ids[:0], ends[:0]
        alone = np.ones(len(chunks), bool)
        alone[words] = False
        alone = np.flatnonzero(alone)
        parts = [x.ids for x in self.tokenizer.encode_batch_fast([chunks[k] for k in alone.tolist()], add_special_tokens=False)]
        sizes = np.zeros(len(chunks), np.int64)
        sizes[words] = np.diff(ends, prepend=0)
        sizes[alone] = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.empty(int(sizes.sum()), np.uint32)
        from_words = np.ones(len(chunks), bool)
        from_words[alone] = False
        mask = np.repeat(from_words, sizes)
        out[mask] = ids
        out[~mask] = np.fromiter((i for p in parts for i in p), np.uint32, len(out) - len(ids))
        return out, sizes

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Encode chunks that aren't known and return their entry numbers."""
        ids, sizes = self._encoded(chunks)
        total, n = len(ids), len(chunks)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + 2 * total, np.uint32)))
        if self.entries + n > len(self.begin):
            more = np.zeros(self.entries + 2 * n, np.int64)
            self.begin, self.size = np.concatenate((self.begin[: self.entries], more)), np.concatenate((self.size[: self.entries], more))
        self.flat[self.used : self.used + total] = ids
        numbers = np.arange(self.entries, self.entries + n)
        self.begin[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.update((c, k) for c, k in zip(chunks, numbers.tolist()) if len(c) <= 64)
        self.used, self.entries = self.used + total, self.entries + n
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end); nulls are empty."""
        if self.used > CACHE_IDS or self.entries > CACHE_IDS // 2:
            self._forget()
        raw, at = utf8(texts)
        raw, at = _simpler(raw, at)
        plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))
        chunks = pc.split_pattern(plain, " ")
        first = np.asarray(chunks.offsets)
        coded = chunks.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        entry = np.fromiter(map(self.known.get, names, [-1] * len(names)), np.int64, len(names))
        if len(new := np.flatnonzero(entry < 0)):
            entry[new] = self._add([names[i] for i in new.tolist()])
        entry = entry[np.asarray(coded.indices)]
        sizes = self.size[entry]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(int(ends[-1])) + np.repeat(self.begin[entry] - ends[:-1], sizes)
        return self.flat[take], ends[first - first[0]]


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(name)
