"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Boosting goes round the features in
turn: a shallow tree on one feature (at most LEAVES runs of bins) is fitted to the gradient of the
log loss and its steps, shrunk, are added to that feature's lookup table. Then the pairs whose joint
bins explain most of what is left get tables of their own in the same way. A score is the logistic
of the intercept plus one table entry per feature and pair, which numpy adds up for whole batches.

The model is fitted on at most `max_labelled` labelled rows, those with the smallest hashes of their
doc_id; features are computed by the executors. Every document is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 20_000
BINS, PAIR_BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 24, 8, 3, 120, 40, 6, 0.15, 2.0
FEATURES = (
    "log_words", "word_chars", "upper", "digits", "signs", "ends", "bars", "distinct", "adjacent",
    "line_repeats", "line_words", "long_words", "short_words", "top_word", "sign_words",
)
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[^\w\s.,;:!?'\"()|-]")
_SIGN_END = re.compile(r"[^\w\s.,;:?'\")]{2,}(?=\s|\Z)")


def features(text: str) -> list[float]:
    """Shape of a whole text: lengths, character classes, repetition. Nothing of its vocabulary."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = list(map(len, words))
    return [
        float(np.log1p(n)),
        sum(sizes) / n,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_SIGN.findall(text)) / chars,
        (text.count("!") + text.count("?")) / n,
        text.count("|") / n,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(x > 14 for x in sizes) / n,
        sum(x < 3 for x in sizes) / n,
        max(counts.values()) / n,
        len(_SIGN_END.findall(text)) / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(x.as_py() or "") for x in texts], pa.list_(pa.float64()))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """The steps of a least-squares tree over ordered bins with at most that many leaves."""
    n, cut = len(gradient), [0, len(gradient)]
    g, w = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + RIDGE)
    while len(cut) <= leaves:
        best = max(((value(a, k) + value(k, b) - value(a, b), k) for a, b in zip(cut, cut[1:]) for k in range(a + 1, b)), default=(0.0, 0))
        if best[0] <= 1e-9:
            break
        cut = sorted([*cut, best[1]])
    out = np.zeros(n)
    for a, b in zip(cut, cut[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + RIDGE)
    return out


@dataclass(frozen=True)
class Model:
    """Bin edges and lookup tables; score() adds up their entries."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_edges: tuple[np.ndarray, ...]
    pair_tables: tuple[np.ndarray, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, steps) in enumerate(zip(self.edges, self.tables)):
            total += steps[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), steps in zip(self.pairs, self.pair_tables):
            total += steps[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one table per feature, then of the PAIRS most telling pairs."""
    n, m = x.shape if len(x) else (0, len(FEATURES))
    rate = (y.sum() + 1) / (n + 2)
    intercept = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        none = tuple(np.empty(0) for _ in range(m))
        return Model(intercept, none, tuple(np.zeros(1) for _ in range(m)), (), none, ())
    edges = [_edges(x[:, j], BINS) for j in range(m)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, intercept)
    for _ in range(ROUNDS):
        for j in range(m):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            steps = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), LEAVES)
            tables[j] += steps
            total += steps[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(m)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)
    joint = lambda a, b: cells[a] * shape(a, b)[1] + cells[b]
    p = 1 / (1 + np.exp(-total))

    def gain(a: int, b: int) -> float:
        size = shape(a, b)[0] * shape(a, b)[1]
        return float((np.bincount(joint(a, b), y - p, size) ** 2 / (np.bincount(joint(a, b), p * (1 - p), size) + RIDGE)).sum())

    pairs = sorted(((a, b) for a in range(m) for b in range(a + 1, m)), key=lambda ab: (-gain(*ab), ab))[:PAIRS]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-total))
            where, size = joint(a, b), pair_tables[k].size
            g, w = (np.bincount(where, v, size).reshape(shape(a, b)) for v in (y - p, p * (1 - p)))
            # a tree of two levels: one cut along each feature, in the order that explains more
            rows, columns = _tree(g.sum(1), w.sum(1), 2), _tree(g.sum(0), w.sum(0), 2)
            left, right = rows != rows[-1], columns != columns[-1]
            steps = np.zeros(shape(a, b))
            for s in (left, ~left):
                for t in (right, ~right):
                    part = np.ix_(s, t)
                    steps[part] = RATE * g[part].sum() / (w[part].sum() + RIDGE)
            pair_tables[k] += steps
            total += steps.ravel()[where]
    return Model(intercept, tuple(edges), tuple(tables), tuple(pairs), tuple(coarse), tuple(pair_tables))


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, max_labelled: int = MAX_LABELLED) -> Model:
    """The model of labels.quality, from the labelled rows for which usable (a condition on doc_id)
    holds. Null labels and null texts take no part; a repeated doc_id counts with its least label and
    the text that comes first by its hash. Without usable rows every score is 0.5. The jobs run when
    this is called."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").where(usable)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    spark = docs.sparkSession
    # at most max_labelled rows of two numbers: small whatever the input is
    known = dict(chosen.toPandas().itertuples(index=False, name=None))
    few = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    rows = (
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
        .select("doc_id", "quality", F.xxhash64("text").alias("text"), _features("text").alias("x"))
        .toPandas().sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name (0 to 1, higher: label 1 is likelier), from the text alone.

    Null, empty and blank texts are scored as texts without words. An existing column of that name is
    replaced, other columns stay, repeated rows are scored each, an empty table gives no rows."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py() or "") for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return docs.drop(name).withColumn(name, score(F.col("text").cast("string")))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's labels are kept from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
