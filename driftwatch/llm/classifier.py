"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text (lengths, shares of kinds of characters, repetition,
variety of words) are cut into histograms of at most ``BINS`` bins; each tree
takes the split with the largest gain over bin sums of the gradients. The trees
are flattened into arrays and walked by numpy for all rows of a batch at once.

The fit reads at most ``max_rows`` labelled rows outside of fold 0, taken in the
order of a hash of their id. Labels, language, source and id are no inputs of a
score. Every document is scored; nulls count as the empty text. Repeated rows
get equal scores and an empty table stays empty. Without labels of both classes
every score is the mean label (0.5 without labels). Extra columns pass through;
``score`` replaces a column of its name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.labels import labelled_texts

BINS = 64
FEATURES = 14


def document_statistics(text: str) -> tuple[float, ...]:
    """``FEATURES`` numbers about a whole text."""
    words = text.split()
    n, c = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    distinct = len(set(words))
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    symbols = sum(map(text.count, "#*$%&|<>@^~=+"))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return (
        math.log1p(len(words)),
        len(text) / n,
        upper / c,
        letters / c,
        symbols / c,
        text.count("!") / n,
        text.count("|") / n,
        text.count(".") / n,
        text.count(",") / n,
        distinct / n,
        pairs / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(lines)),
        sum(map(text.count, "0123456789")) / c,
    )


class BoostedTrees:
    """Binary classifier of log-odds ``base`` and trees as flat arrays, ``depth`` levels each."""

    def __init__(
        self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, shrink: float = 1.0, least: int = 10
    ):
        mean = y.mean() if len(y) else 0.5
        self.constant = None if len(y) and 0 < mean < 1 else float(mean)
        self.depth, self.base = depth, 0.0 if self.constant is not None else math.log(mean / (1 - mean))
        self.feature, self.split, self.left, self.value, self.roots = [], [], [], [], []
        if self.constant is None:
            self._fit(x, y, rounds, rate, shrink, least)
        for name in ("feature", "left"):
            setattr(self, name, np.array(getattr(self, name), dtype=np.int32))
        for name in ("split", "value"):
            setattr(self, name, np.array(getattr(self, name), dtype=float))

    def _fit(self, x, y, rounds, rate, shrink, least) -> None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            self.roots.append(len(self.feature))
            self._add()
            level = [(self.roots[-1], np.arange(len(y)))]
            for d in range(self.depth + 1):
                deeper = []
                for node, rows in level:
                    total, weight = g[rows].sum(), h[rows].sum()
                    cut = self._best(binned[rows], edges, g[rows], h[rows], total, weight, shrink, least) if d < self.depth else None
                    if cut is None:
                        self.value[node] = -rate * total / (weight + shrink)
                        margin[rows] += self.value[node]
                        continue
                    feature, at = cut
                    under = binned[rows, feature] <= at
                    self.feature[node], self.split[node], self.left[node] = feature, edges[feature][at], len(self.feature)
                    deeper += [(self._add(), rows[under]), (self._add(), rows[~under])]
                level = deeper

    def _add(self) -> int:
        """A leaf that leads to itself: its left child lies at itself, and no value exceeds its split."""
        at = len(self.feature)
        self.feature.append(0)
        self.split.append(math.inf)
        self.left.append(at)
        self.value.append(0.0)
        return at

    @staticmethod
    def _best(binned, edges, g, h, total, weight, shrink, least) -> tuple[int, int] | None:
        best, found = 1e-6, None
        for j, own in enumerate(edges):
            if not len(own):
                continue
            size = len(own) + 1
            gs, hs, ns = (np.bincount(binned[:, j], w, size)[:-1].cumsum() for w in (g, h, None))
            gain = gs**2 / (hs + shrink) + (total - gs) ** 2 / (weight - hs + shrink) - total**2 / (weight + shrink)
            gain[(ns < least) | (len(g) - ns < least)] = -1
            if gain.max() > best:
                best, found = gain.max(), (j, int(gain.argmax()))
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin, each = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.left[at] + (x[each, self.feature[at]] > self.split[at])
            margin += self.value[at]
        return 1 / (1 + np.exp(-margin))


def _statistics(texts: pa.Array) -> np.ndarray:
    return np.array([document_statistics(x or "") for x in texts.to_pylist()], float).reshape(-1, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, folds: int = 5) -> BoostedTrees:
    """Trees from the statistics of at most ``max_rows`` labelled rows outside of fold 0."""

    @F.arrow_udf("array<double>")
    def statistics(texts: pa.Array) -> pa.Array:
        return pa.array(_statistics(texts).tolist(), pa.list_(pa.float64()))

    texts = labelled_texts(docs, labels, max_rows, folds, label)
    rows = texts.select(statistics(F.col("text")).alias("x"), "label").toArrow()
    x, y = np.array(rows["x"].to_pylist(), float).reshape(-1, FEATURES), rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return BoostedTrees(x[order], y[order])


def score(docs: DataFrame, trees: BoostedTrees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(trees.score(_statistics(texts)), pa.float64())

    return docs.withColumn(name, scored(F.col(text)))
