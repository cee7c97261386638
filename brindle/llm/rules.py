"""Text quality by a sparse ensemble of rules.

1. ``statistics`` reads every whole text once and writes a row of numbers for it (``STATISTICS``).
2. At most ``SAMPLE_ROWS`` labelled rows, picked by a hash of the id, go to the driver: numbers only.  Rows whose
   crc32(id as text) mod 3 is 1 are never among them.
3. ``TREES`` small trees are grown there by gradient boosting on halves of the sample.  Every node but a root is a rule,
   the conjunction of the comparisons on its path; rules that hold for the same rows of the sample are one.
4. Logistic regression with a lasso penalty weighs the rules.  Of several penalties the one with the least loss on a
   fifth of the sample is taken, or a larger one that is not worse by more than ``SLACK``; most rules get no weight.
5. Rules with a weight become one Spark column over the numbers, so that scoring is a projection of Spark's own.

Defined cases: a null text is an empty one, and has a score like any other.  Labels that are neither 0 nor 1, and labels
of no document, count for nothing; with several labels for an id, or several rows of an id, each pair is a row.  Without
usable labels the score is 0.5, with labels of one kind it is near that kind, for all texts.  Null ids are scored but
never learned from, and not held out.  Texts of any length are read whole, repeated rows repeat, further columns are
ignored, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import U64, grams, mix, owners, pieces, run_hashes, runs, utf8
from .workspace import Workspace

SAMPLE_ROWS = 12_000
TREES, DEPTH, LEAF, BINS, RATE = 60, 3, 12, 48, 0.15
PENALTIES = (3e-2, 1e-2, 3e-3, 1e-3, 3e-4)
SLACK = 0.01

#: Shares are of bytes, words, lines or neighbours; lengths are logarithms to base 2, of one more.
STATISTICS = (
    "bytes", "words", "word_bytes", "longest_word", "line_words", "letters", "capitals", "digits", "blanks", "stops", "marks",
    "shouts", "bars", "doubled", "distinct", "repeated_lines", "repeated_runs", "short_words", "capital_words", "stop_ends", "mark_ends", "letterless",
)


def _table(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_UPPER, _DIGIT, _BLANK = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(" \t\n\v\f\r")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_ALPHA = _LETTER.copy()
_ALPHA[128:] = True
_STOP, _MARK = _table(".,;:?'\"()-"), _table("!#$%&*+/<=>@[\\]^_`{|}~")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    first = np.unique(mix(hashes + mix(owner.astype(U64) + U64(1))), return_index=True)[1]
    return np.bincount(owner[first], minlength=n)


def numbers(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, a row each."""
    raw, at = utf8(texts)
    n, size = len(at) - 1, np.diff(at)
    words_at, words_to = runs(~_BLANK[raw], at)
    first = np.searchsorted(words_at, at)
    owner, many = owners(first), np.diff(first)
    length = words_to - words_at
    hashes = run_hashes(raw, words_at, words_to)
    lines_at, lines_to = runs(raw != 10, at)
    line_owner = owners(np.searchsorted(lines_at, at))
    lines = np.bincount(line_owner, minlength=n)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[raw])))
        return total[at[1:]] - total[at[:-1]]

    of_words = lambda flags: np.bincount(owner, flags, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    three, place = grams(hashes, first, 3)
    alpha = np.concatenate(([0], np.cumsum(_ALPHA[raw])))
    begin, end = (raw[words_at], raw[words_to - 1]) if len(words_at) else (np.zeros(0, np.uint8),) * 2
    columns = [
        np.log2(1 + size), np.log2(1 + many), _share(of_words(length), many), np.log2(1 + longest), np.log2(1 + _share(many, lines)),
        _share(count(_ALPHA), size), _share(count(_UPPER), count(_LETTER)), _share(count(_DIGIT), size), _share(count(_BLANK), size), _share(count(_STOP), size), _share(count(_MARK), size),
        _share(count(_table("!")), many), _share(count(_table("|")), many), _share(of_words(same), many - 1), _share(_distinct(hashes, owner, n), many),
        _share(lines - _distinct(run_hashes(raw, lines_at, lines_to), line_owner, n), lines), _share(np.maximum(many - 2, 0) - _distinct(three, owner[place], n), many - 2),
        _share(of_words(length <= 2), many), _share(of_words(_UPPER[begin]), many), _share(of_words(_STOP[end]), many), _share(of_words(_MARK[end]), many), _share(of_words(alpha[words_to] == alpha[words_at]), many),
    ]
    return np.stack(columns, axis=1)


_ROWS = "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers(batch.column(1)).T)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether it is above, the bound)


def grow(codes: np.ndarray, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, bounds: list[np.ndarray]) -> list[tuple[Rule, np.ndarray, float]]:
    """The leaves of a tree and all nodes above them but the root: (rule, its rows of ``rows``, step).

    ``codes`` counts, for every row and statistic, the bounds that the row is above.  Second-order splits.
    """
    nodes, level = [], [((), rows)]
    width = max(len(b) for b in bounds) + 1
    offset = np.arange(codes.shape[1]) * width
    last = np.array([len(b) for b in bounds])
    for _ in range(DEPTH):
        below = []
        for rule, here in level:
            if len(here) < 2 * LEAF:
                continue
            flat = (codes[here] + offset).ravel()
            shape = (codes.shape[1], width)
            sums = [np.bincount(flat, w, shape[0] * width).reshape(shape).cumsum(axis=1) for w in (np.repeat(gradient[here], shape[0]), np.repeat(weight[here], shape[0]), None)]
            g, h, k = sums
            gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
            gain[(k < LEAF) | (k[:, -1:] - k < LEAF) | (np.arange(width) >= last[:, None])] = 0
            best = int(gain.argmax())
            f, b = divmod(best, width)
            if gain[f, b] <= 1e-9:
                continue
            above = codes[here, f] > b
            for up in (False, True):
                part = here[above == up]
                path = (*rule, (f, up, float(bounds[f][b])))
                nodes.append((path, part, gradient[part].sum() / (weight[part].sum() + 1)))
                below.append((path, part))
        level = below
    return nodes


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    """Which rows of a matrix of statistics a rule holds for."""
    return reduce(np.logical_and, [(x[:, f] > bound) if up else (x[:, f] <= bound) for f, up, bound in rule], np.ones(len(x), bool))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The different rules of boosted trees, as they hold for the rows of x."""
    rng = np.random.default_rng(20)
    bounds = []
    for column in x.T:
        cut = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf"))
        bounds.append(cut[cut < column.max()])
    codes = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)], axis=1)
    margin, found = np.zeros(len(x)), {}
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(x), max(1, len(x) // 2), replace=False))
        nodes = grow(codes, y - chance, chance * (1 - chance), rows, bounds)
        if not nodes:
            break
        parents = {path[:-1] for path, _, _ in nodes}
        for path, _, step in nodes:
            covered = holds(x, path)
            found.setdefault(covered.tobytes(), path)
            if path not in parents:
                margin += RATE * step * covered
    return list(found.values())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400) -> np.ndarray:
    """Weights and, at the end, a free constant: mean logistic loss plus penalty times the sum of absolute weights."""
    n, k = r.shape
    r = np.hstack((r, np.ones((n, 1))))
    square = np.ones(k + 1)
    for _ in range(30):
        square = r.T @ (r @ square)
        top = np.linalg.norm(square)
        square /= top
    rate = 4 * n / (1.02 * top)
    w = look = np.zeros(k + 1) if start is None else start
    limit = np.full(k + 1, rate * penalty)
    limit[-1] = 0
    t = 1.0
    for _ in range(steps):
        step = look - rate / n * (r.T @ (1 / (1 + np.exp(-np.clip(r @ look, -500, 500))) - y))
        step = np.sign(step) * np.maximum(np.abs(step) - limit, 0)
        if np.abs(step - w).max() < 1e-5 and np.abs(step - look).max() < 1e-5:
            return step
        if (look - step) @ (step - w) > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = step + (t - 1) / s * (step - w), step, s
    return w


def _loss(r: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    margin = r @ w[:-1] + w[-1]
    return float(np.mean(np.logaddexp(0, margin) - y * margin))


class RuleModel:
    """Rules with their weights and a constant."""

    def __init__(self, rules: list[Rule], weights: list[float], constant: float):
        self.rules, self.weights, self.constant = rules, weights, constant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        """From statistics and labels 0 or 1; the order of the rows decides which are held back for the penalty."""
        good = int(y.sum())
        prior = np.log((good + 0.5) / (len(y) - good + 0.5))
        if good in (0, len(y)) or len(y) < 4 * LEAF:
            return cls([], [], float(prior))
        rules = tree_rules(x, y)
        if not rules:
            return cls([], [], float(prior))
        r = np.stack([holds(x, rule) for rule in rules], axis=1).astype(np.float64)
        spread = r.std(axis=0)
        r, rules = r[:, spread > 0] / spread[spread > 0], [rule for rule, s in zip(rules, spread) if s > 0]
        spread = spread[spread > 0]
        back = np.arange(len(y)) % 5 == 0
        losses, w = [], None
        for penalty in PENALTIES:
            w = lasso(r[~back], y[~back], penalty, w)
            losses.append(_loss(r[back], y[back], w))
        chosen = next(p for p, loss in zip(PENALTIES, losses) if loss <= min(losses) + SLACK)
        w = lasso(r, y, chosen)
        some = np.flatnonzero(w[:-1])
        return cls([rules[i] for i in some], (w[some] / spread[some]).tolist(), float(w[-1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.constant)
        for rule, weight in zip(self.rules, self.weights):
            margin += np.where(holds(x, rule), weight, 0.0)
        return 1 / (1 + np.exp(-margin))

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        margin = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights):
            conditions = [(F.col(STATISTICS[f]) > bound) if up else (F.col(STATISTICS[f]) <= bound) for f, up, bound in rule]
            margin = margin + F.when(reduce(Column.__and__, conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def describe(self) -> list[str]:
        """Rules in words, heaviest first."""
        said = [(w, " and ".join(f"{STATISTICS[f]} {'>' if up else '<='} {bound:.4g}" for f, up, bound in rule)) for rule, w in zip(self.rules, self.weights)]
        return [f"{w:+.3f} if {text}" for w, text in sorted(said, key=lambda s: (-abs(s[0]), s[1]))]


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel | None:
    """A model from statistics and (doc_id, quality); None without usable labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    many = known.count()
    scale, row = 1 << 30, F.xxhash64("doc_id")
    if many > sample_rows:  # a quarter more than needed, by hash; the least hashes of these are taken below
        known = known.where(F.pmod(row, F.lit(scale)) < 5 * scale * sample_rows // (4 * many))
    picked = known.distinct().orderBy(row, "doc_id", "quality").limit(2 * sample_rows)
    rows = stats.join(F.broadcast(picked), "doc_id").orderBy(row, "doc_id", "quality", *STATISTICS).limit(sample_rows).collect()
    if not rows:
        return None
    return RuleModel.fit(np.array([[r[name] for name in STATISTICS] for r in rows]), np.array([r["quality"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = Workspace(docs.sparkSession, "quality").write(statistics(docs), "statistics")
    model = fit(stats, labels)
    score = model.column() if model else F.lit(0.5)
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
