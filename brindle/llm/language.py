"""Language identification by hierarchical discrimination.

A text becomes one vector: hashed byte trigrams centred on letters (A-Z and
the Latin-1 capitals lowered, everything else a space), square-rooted counts
scaled to length 1.  Linear support vector machines predict the language
family first (one against the rest); within the winning family one-versus-one
machines vote between its languages, summed margins breaking ties.

The machines are fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled
documents, shared equally between the ``MAX_LANGUAGES`` most frequent languages
and picked by a hash of id and text, equal rows once.  Only rows whose crc32(id as text) mod 3 is not 1 are ever used for
fitting; the others are marked ``held_out``.  Prediction reads whole texts.

Defined cases: a null text or one without any letter is ``und`` with score 0;
so is every text if nothing can be learned.  A row with a null id is predicted
but neither learned from nor held out.  Languages outside the family table
form one family each.  Texts of any length are read whole.  Extra columns are
ignored, whatever their names, repeated rows repeat, and an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ASCII_LOWER, pieces, utf8

# Families of closely related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "cy", "gd", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "mr", "ne", "gu", "pa", "ur", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "malayic": ("id", "ms"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMENSIONS = 4096
SAMPLE_ROWS, MAX_LANGUAGES = 1200, 240
#: Below this score the pipeline takes a text for no language at all.
MIN_SCORE = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether a text has a letter) of the texts of a small batch."""
    texts = batch.column(column)
    raw, at = utf8(texts)
    low = ASCII_LOWER[raw]
    if len(low) > 1:  # Latin-1 capitals, as two UTF-8 bytes
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 32
    letter = _LETTER[low]
    low[~letter] = 32
    out = np.zeros((batch.num_rows, DIMENSIONS), np.float32)
    some = np.zeros(batch.num_rows, bool)
    padded = np.concatenate((low[:1] * 0 + 32, low, low[:1] * 0 + 32)).astype(np.uint32)
    if len(low):
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(low))]
        before, after = padded[:-2].copy(), padded[2:].copy()
        before[edge], after[edge - 1] = 32, 32
        centres = np.flatnonzero(letter)
        code = (before[centres] * np.uint32(0x9E3779B1)) ^ (padded[1:-1][centres] * np.uint32(0x85EBCA6B)) ^ (after[centres] * np.uint32(0xC2B2AE35))
        code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(20)
        first = np.searchsorted(centres, at)
        plain = np.concatenate(([0], np.cumsum(letter & (low < 128))))
        for i in range(batch.num_rows):
            if first[i + 1] > first[i]:
                v = np.sqrt(np.bincount(code[first[i] : first[i + 1]], minlength=DIMENSIONS))
                out[i] = v / np.sqrt(v @ v)
                some[i] = plain[at[i + 1]] > plain[at[i]] or any(c.isalpha() for c in texts[i].as_py())
    return out, some


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent; y is 1 or -1.

    Both sides weigh the same, whatever their sizes.
    """
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = look = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        step = look - 0.2 * (strength * look - 2 * (share * y * slack) @ x)
        look, w = step + t / (t + 3) * (step - w), step
    return w


class Model:
    """Fitted machines, small enough to send to every task."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {code: FAMILY_OF.get(code.lower().split("-")[0], f"only {code}") for code in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, code in enumerate(self.langs) if family[code] == f] for f in self.families]
        mine = np.array([self.langs.index(code) for code in langs])
        of = np.array([self.families.index(family[code]) for code in langs])
        columns = [fit_svm(x, np.where(of == k, 1, -1)) for k in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for m in self.members for k, a in enumerate(m) for b in m[k + 1 :]]
        for a, b in self.pairs:
            rows = (mine == a) | (mine == b)
            columns.append(fit_svm(x[rows], np.where(mine[rows] == a, 1, -1)))
        self.weights = np.array(columns, np.float32).T if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score from 0 to 1) of each vector."""
        n, margin = len(x), x @ self.weights[:-1] + self.weights[-1]
        chance = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -40, 40)))
        if len(self.families) > 1:
            top = margin[:, : len(self.families)]
            best, ordered = top.argmax(axis=1), np.sort(top, axis=1)
            score, margin = chance((ordered[:, -1] - ordered[:, -2]) / 2), margin[:, len(self.families) :]
        else:
            best, score = np.zeros(n, int), np.ones(n)
        votes, total = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        least = np.full((n, len(self.langs)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, k]
            for lang, v in ((a, m), (b, -m)):
                votes[:, lang] += v > 0
                total[:, lang] += v
                least[:, lang] = np.minimum(least[:, lang], v)
        lang = np.zeros(n, int)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            rank = votes[np.ix_(rows, members)] + 0.5 * np.tanh(total[np.ix_(rows, members)] / (1 + len(members)))
            lang[rows] = np.array(members)[rank.argmax(axis=1)] if len(rows) else 0
        margin = least[np.arange(n), lang]
        return lang, score * np.where(np.isinf(margin), 1.0, chance(margin))


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """A model from the columns doc_id, text and lang; None without labelled rows.

    At most ``max_languages`` counts and twice ``sample_rows`` vectors come to the driver.
    """
    usable = docs.where("lang is not null and text is not null").where(_remainder() != 1)
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    scale = 1 << 20
    share = F.create_map(*[F.lit(v) for code, n in counts.items() for v in (code, min(scale, scale * each * 5 // (4 * n) + 1))])
    row = F.xxhash64("doc_id", "text")
    picked = usable.where(F.pmod(row, F.lit(scale)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0))).withColumn("row", row).dropDuplicates(["lang", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            x, some = features(batch)
            rows = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array([x[i].astype(np.float16).tobytes() for i in rows], pa.binary())], names=["doc_id", "lang", "vector"])

    rows = sorted(picked.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, vector binary").limit(2 * sample_rows + 20 * max_languages).collect(), key=lambda r: (r[1], r[0], r[2]))
    taken: dict[str, int] = {}
    kept = [r for r in rows if taken.setdefault(r[1], 0) < each and not taken.update({r[1]: taken[r[1]] + 1})]
    if not kept:
        return None
    return Model(np.array([np.frombuffer(r[2], np.float16) for r in kept], np.float32), [r[1] for r in kept])


RESULT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; reads doc_id and text only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (p for b in batches for p in pieces(b)):
            x, some = features(batch)
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if known is not None:
                lang, sure = known.predict(x)
                names = np.where(some, np.array(known.langs, object)[lang], "und")
                score = np.where(some, sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, RESULT_SCHEMA)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of docs that are not held out, and predict all of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs, fit(docs))


def keep_known_languages(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose text is predicted a language with at least ``min_score``; all their columns stay."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent, names = docs.sparkSession.sparkContext.broadcast(fit(plain)), docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (p for b in batches for p in pieces(b)):
            x, some = features(batch, place)
            if known is None:
                some[:] = False
            else:
                some &= known.predict(x)[1] >= min_score
            yield batch.filter(pa.array(some))

    return docs.mapInArrow(run, docs.schema)
