"""Quality rules: an isolation forest on rule statistics.

Each document gets statistics that rules look at (symbols, capitals, bars, word
lengths, plain words). Random splits on them isolate odd documents early, so a
short mean path over many trees marks an anomaly. Each tree grows on rows of its own,
drawn from all labelled rows outside of fold 0 that the base rule passes, as the method
asks, good and bad alike: a statistic that is zero in all good rows would never be split
otherwise. The threshold on the anomaly score is the one which best tells all the good
labelled rows from all the bad ones, among those that keep at least ``keep_share`` of
the good.

The fit reads every labelled row outside of fold 0 and every document is scored. Spark
holds the rows; what a fit gathers are the rows that the trees draw, whatever the input. A
base rule fails documents of under ``min_words`` words or with over half of the words in
repeated 3-word windows.

Nulls and empty texts have no words and fail the base rule. Repeated rows get
equal results, an empty table an empty one; labels of both classes that are
missing or null leave the threshold open, and then only the base rule decides.
Extra columns pass through; the operator's own names replace columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.islands import running_total
from driftwatch.llm.labels import held_out
from driftwatch.session import materialize, scratch

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "capitals", "marks", "bars", "letters", "plain_words")
SPACE_BYTES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """The counts of ``COUNTS`` over a whole text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACE_BYTES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE_BYTES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def rule_features(text: str, counts: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    """The statistics of ``FEATURES``: shares of the document's words or of the characters in them."""
    n, chars, symbols = counts[:3]
    n, c = max(n, 1), max(chars, 1)
    return (
        chars / n,
        symbols / c,
        sum(map(str.isupper, text)) / c,
        (text.count("!") + text.count("?")) / n,
        text.count("|") / n,
        sum(map(str.isalpha, text)) / c,
        sum(map(str.isalpha, text.split())) / n,
    )


def _path_bound(n: int) -> float:
    """The mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class IsolationForest:
    """Trees of random splits as flat arrays; ``score`` is near 1 for odd rows and under 0.5 for common ones.

    The trees draw from ``rows``, or grow on the rows that ``drawn`` holds for each of them.
    """

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 128, seed: int = 7, drawn: list[np.ndarray] | None = None):
        draw = np.random.default_rng(seed)
        sample = max(map(len, drawn)) if drawn else min(sample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(sample, 2))))
        self.bound = _path_bound(sample) or 1.0
        nodes: list[list[float]] = []
        self.roots = []
        for own in drawn or (rows[draw.choice(len(rows), sample, replace=False)] for _ in range(trees)):
            self.roots.append(len(nodes))
            self._grow(own, 0, draw, nodes)
        table = np.array(nodes)
        self.feature, self.left, self.right = (table[:, i].astype(np.int32) for i in (0, 2, 3))
        self.split, self.path = table[:, 1], table[:, 4]

    def _grow(self, rows: np.ndarray, depth: int, draw, nodes: list[list[float]]) -> int:
        at = len(nodes)
        nodes.append([0, math.inf, at, at, depth + _path_bound(len(rows))])
        if depth < self.depth and len(rows) > 1:
            low, high = rows.min(0), rows.max(0)
            if len(open_ := np.flatnonzero(high > low)):
                feature = draw.choice(open_)
                split = draw.uniform(low[feature], high[feature])
                under = rows[:, feature] < split
                left = self._grow(rows[under], depth + 1, draw, nodes)
                right = self._grow(rows[~under], depth + 1, draw, nodes)
                nodes[at] = [feature, split, left, right, 0]
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The anomaly score of each row."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                at = np.where(rows[each, self.feature[at]] < self.split[at], self.left[at], self.right[at])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / self.bound)


def threshold(good: np.ndarray, bad: np.ndarray, keep_share: float) -> float:
    """The score above which a row is rejected: the best of those that keep ``keep_share`` of the good rows."""
    if not len(good) or not len(bad):
        return math.inf
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, cuts[-1:]])
    kept = np.searchsorted(np.sort(good), cuts, side="right") / len(good)
    missed = np.searchsorted(np.sort(bad), cuts, side="right") / len(bad)
    gain = np.where(kept >= keep_share, kept - missed, -math.inf)
    return float(cuts[gain.argmax()])


def exact_threshold(scored: DataFrame, keep_share: float) -> float:
    """``threshold`` of all rows ``(score, label)``, added up by score and by ranges of it; no task or driver holds them."""
    good, bad = (F.sum(F.when(F.col("label") == n, 1).otherwise(0)) for n in (1, 0))
    counts = materialize(scored.groupBy("score").agg(good.alias("good"), bad.alias("bad")), "score-counts")
    n_good, n_bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good or not n_bad:
        return math.inf
    upto = running_total(counts, "score", {"kept": "good", "missed": "bad"})
    gain = F.col("kept") / F.lit(n_good) - F.col("missed") / F.lit(n_bad)
    best = upto.where(F.col("kept") / F.lit(n_good) >= keep_share).agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("score")))).first()[0]
    at = -best["score"]
    after = counts.where(F.col("score") > at).agg(F.min("score")).first()[0]
    return at if after is None else (at + after) / 2


def labelled_statistics(docs: DataFrame, labels: DataFrame, folds: int, min_words: int, repeat_percent: int) -> DataFrame:
    """``doc_id``, ``features`` and ``label`` of all labelled ids outside of fold 0 that the base rule passes, a row each.

    Rows with a null id or label are left out. A document with several labels has the largest. Statistics are taken before the join, so texts are not shuffled.
    """
    known = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)
    chosen = labels.where(known & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    stats = docs.where(known).select("doc_id", statistics_of("text").alias("s")).select("doc_id", "s.*")
    stats = stats.select("doc_id", F.struct(base_failure(min_words, repeat_percent).alias("failed"), "features").alias("s"))
    # filtered after the groups, as Spark would take the statistics twice for a filter before them
    each = stats.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("s").alias("s"), F.min("label").alias("label"))
    return each.where("not s.failed").select("doc_id", "s.features", "label")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = 200,
    sample: int = 128,
    keep_share: float = 0.995,
    min_words: int = 50,
    repeat_percent: int = 50,
    folds: int = 5,
    seed: int = 7,
) -> tuple[IsolationForest | None, float]:
    """A forest and its threshold from all labelled rows outside of fold 0.

    Each tree draws some 1.5 times ``sample`` of all rows by a hash, and takes the first ``sample`` of them in the order of another.
    """
    with scratch(docs.sparkSession):
        rows = materialize(labelled_statistics(docs, labels, folds, min_words, repeat_percent), "labelled-statistics")
        if not (n := rows.count()):
            return None, math.inf
        forest = IsolationForest(np.zeros((0, len(FEATURES))), seed=seed, drawn=drawn_rows(rows, n, trees, sample, seed))
        return forest, exact_threshold(rows.select(scores_of("features", forest).alias("score"), "label"), keep_share)


def drawn_rows(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """The rows of each tree, at most ``sample``, drawn from all ``n`` rows ``(doc_id, features)``."""
    share = int(min(1.0, (1.5 * sample + 30) / n) * (1 << 40))
    of = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.pmod(F.xxhash64("doc_id", tree, F.lit(seed)), F.lit(1 << 40)) < share)
    some = rows.select("doc_id", "features", F.explode(of).alias("tree"))
    got = some.select("tree", F.xxhash64("doc_id", "tree", F.lit(seed + 1)).alias("place"), "features").toArrow()
    x, tree, place = np.array(got["features"].to_pylist(), float).reshape(-1, len(FEATURES)), got["tree"].to_numpy(), got["place"].to_numpy()
    order = np.lexsort((*x.T, place, tree))
    ends = np.searchsorted(tree[order], np.arange(trees + 1))
    return [x[order[i:j][:sample]] for i, j in zip(ends[:-1], ends[1:], strict=True) if j > i]


def scores_of(features: str, forest: IsolationForest) -> Column:
    """A column of the anomaly scores of rows of ``features``."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(forest.score(np.array(rows.to_pylist(), float).reshape(-1, len(FEATURES))), pa.float64())

    return score(F.col(features))


def base_failure(min_words: int, repeat_percent: int) -> Column:
    """Whether the base rule fails a row of counts."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def statistics_of(text: str, forest: IsolationForest | None = None):
    """A column of the counts, the features and, with a forest, the anomaly score of the texts."""
    fields = [*(f"{name} long" for name in COUNTS), "features array<double>", "anomaly double"]

    @F.arrow_udf(", ".join(fields))
    def statistics(texts: pa.Array) -> pa.Array:
        values = [x or "" for x in texts.to_pylist()]
        counts = [rule_counts(x) for x in values]
        rows = np.array([rule_features(x, c) for x, c in zip(values, counts, strict=True)], float).reshape(-1, len(FEATURES))
        scores = forest.score(rows) if forest else np.zeros(len(rows))
        arrays = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
        arrays += [pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(arrays, [*COUNTS, "features", "anomaly"])

    return statistics(F.col(text))


def apply_rules(
    docs: DataFrame,
    forest: IsolationForest | None,
    cut: float,
    text: str = "text",
    min_words: int = 50,
    repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with the counts, ``anomaly``, ``base_failed`` and ``kept``."""
    out = docs.withColumn("_rules", statistics_of(text, forest))
    out = out.withColumns({name: F.col(f"_rules.{name}") for name in (*COUNTS, "anomaly")}).drop("_rules")
    return out.withColumn("base_failed", base_failure(min_words, repeat_percent)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(cut)))
