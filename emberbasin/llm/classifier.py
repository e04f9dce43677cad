"""A quality score learnt from preferences (Bradley-Terry).

A document of label 1 is preferred to one of label 0: P(a before b) = sigmoid(w . (x_a - x_b)). The weights minimise the
logistic loss over drawn pairs, by Newton steps. The features are counts over the whole text and ratios of them, by built-in functions.
The threshold is that quantile of the training scores which parts the labels best; a score is the sigmoid of its
distance to it, so 0.5 is the threshold.

Weights are fitted on the driver from at most ``max_labelled`` labelled rows (the smallest by a hash of their id);
everything else covers all rows. Without labels of both kinds all weights are 0: every score is 0.5 and every text kept.
Null and empty texts have all features 0 and are scored like any other. Labels that are null, and rows without an id, teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import trimmed, word_array

MAX_LABELLED = 20_000
PAIRS = 200_000
RIDGE = 1e-3
QUANTILES = 1000
FEATURES = (
    "log_words", "word_length", "distinct_words", "short_words", "capitals", "digits", "marks", "bangs", "bars",
    "signs", "letters", "lines", "repeated_lines", "long_words", "repeated_neighbours",
)


def features(t: str, w: str, lines_name: str) -> list[Column]:
    """One column for each of ``FEATURES``, over staged columns: the text, its words, and its lines with words."""
    body, words, lines = F.col(t), F.col(w), F.col(lines_name)
    n = F.size(words).cast("double")
    chars = F.length(body).cast("double")
    less = lambda pattern: chars - F.length(F.regexp_replace(body, pattern, ""))
    gone = lambda marks: chars - F.length(F.translate(body, marks, ""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    made = {
        "log_words": F.log1p(n),
        "word_length": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n),
        "capitals": share(less(r"\p{Lu}+"), chars),
        "digits": share(gone("0123456789"), chars),
        "marks": share(gone(".,;:?"), n),
        "bangs": F.least(share(gone("!"), n), F.lit(2.0)),
        "bars": F.least(share(gone("|"), n), F.lit(2.0)),
        "signs": F.least(share(gone("#*$%&<>{}[]=_~^\\/@+"), n), F.lit(3.0)),
        "letters": share(less(r"\p{L}+"), chars),
        "lines": share(F.size(lines), n),
        "repeated_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "long_words": share(F.size(F.filter(words, lambda w: F.length(w) > 15)), n),
        "repeated_neighbours": share(
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))), n
        ),
    }
    return [F.coalesce(made[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES]


def staged(docs: DataFrame, t: str, w: str, lines: str, x: str, text: str = "text") -> DataFrame:
    """Adds ``x``, the array of features of a text, and what it is made of, under names that docs doesn't have."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = docs.select(
        "*",
        body.alias(t),
        word_array(body).alias(w),
        F.filter(F.split(body, F.lit("\n")), lambda line: trimmed(line) != "").alias(lines),
    )
    return split.select("*", F.array(*features(t, w, lines)).alias(x))


def with_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``x``, the array of features, of every row."""
    return staged(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "_t", "_w", "_l", "x").select("doc_id", "x")


def held_out(id_col: Column) -> Column:
    """True for the ids that no label is learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features, the threshold and the slope of the score."""

    mean: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float
    slope: float

    def score(self, x: Column) -> Column:
        """The score of an array of features, 0 to 1."""
        terms = [
            F.least(F.greatest((x[i] - self.mean[i]) / self.spread[i], F.lit(-8.0)), F.lit(8.0)) * self.weights[i]
            for i in range(len(self.weights))
        ]
        total = F.lit(0.0)
        for term in terms:
            total = total + term
        power = F.least(F.greatest((total - self.threshold) * self.slope, F.lit(-30.0)), F.lit(30.0))
        return 1.0 / (1.0 + F.exp(-power))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from features and labels of 0 and 1."""
    size = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking([0.0] * size, [1.0] * size, [0.0] * size, 0.0, 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - mean) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    pairs = min(pairs, len(good) * len(bad) * 4)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(size)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(size)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    # Of the quantiles of the score, the one that parts the labels best; the middle of those that are equal.
    cuts = np.quantile(s, np.linspace(0, 1, QUANTILES + 1))
    order = np.argsort(s)
    ones = np.concatenate([[0], np.cumsum(y[order])])
    below = np.searchsorted(s[order], cuts, "left")
    wrong = ones[below] + (len(y) - below) - (ones[-1] - ones[below])
    best = np.flatnonzero(wrong == wrong.min())
    threshold = float(cuts[best].mean())
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip((s - threshold) * slope, -30, 30)))
        curve = ((s - threshold) ** 2 * p * (1 - p)).mean() + 1e-6
        step = ((p - y) * (s - threshold)).mean() / curve
        slope = float(np.clip(slope - np.clip(step, -1, 1), 0.05, 20.0))
        if abs(step) < 1e-9:
            break
    return Ranking(mean.tolist(), spread.tolist(), w.tolist(), threshold, slope)


def training_labels(labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and y of the labels to learn from: those of ids that aren't held out; of more than ``max_labelled`` about so many, never more
    than that by much, the smallest by a hash of the id. Hashes are spread evenly, so the cut-off follows from the count."""
    order = F.xxhash64("doc_id")
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    count = known.count()
    if count <= max_labelled:
        return known
    return known.filter(order < int(2**64 * (max_labelled / count) * 0.97) - 2**63)


def learn(scored: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Ranking:
    """Fits on labelled rows that are not held out; ``scored`` has doc_id and x, of the labelled rows at least."""
    known = training_labels(labels, label, max_labelled)
    rows = (
        scored.join(known, "doc_id")
        .select("x", "y", "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x")
        .limit(max_labelled)
        .select("x", "y")
        .toPandas()
    )
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy(dtype=float))
