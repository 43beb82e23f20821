"""Models that score windows: isolation forest, kernel density, and any batch function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.arrays import grouped
from driftwatch.session import materialize

NODE = "tree int, node int, feature int, split double, left int, right int, size int"


def _common_path(n: float) -> float:
    """The mean depth of an unsuccessful search among ``n`` rows, the unit of path lengths."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(x: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    draw, depth = np.random.default_rng([seed, tree]), max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(x, 0, None, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([tree, at, -1, 0.0, -1, -1, len(rows)])
        if parent is not None:
            nodes[parent][4 + side] = at
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(0)
        if level < depth and len(rows) > 1 and (spread > 0).any():
            f = int(draw.choice(np.flatnonzero(spread > 0)))
            cut = draw.uniform(rows[:, f].min(), rows[:, f].max())
            under = rows[:, f] <= cut
            nodes[at][2:4] = [f, cut]
            todo += [(rows[~under], level + 1, at, 1), (rows[under], level + 1, at, 0)]
    return pd.DataFrame(nodes, columns=[c.split(" ")[0] for c in NODE.split(", ")])


def fit_isolation_forest(rows: DataFrame, features: str, key: str, trees: int = 1000, sample: int = 256, seed: int = 42) -> DataFrame:
    """The trees of a forest as rows of nodes; each grows in a task of its own on ``sample`` rows, fewer where there are fewer. Null vectors, and those with a null component, are left out; without any there are no trees.

    Each tree draws about 1.5 times ``sample`` rows and takes as many of them. Rows that no tree draws leave by a hash of their key before Python sees them.
    """
    rows = rows.where(_whole(features))
    n = rows.count()
    share = min(1.0, (1.5 * sample + 30) / max(n, 1))
    # the gaps between a row's trees are geometric: the first one is drawn here, of the hash alone
    uniform = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = rows if share == 1.0 else rows.where(uniform < 1 - (1 - share) ** trees)

    @F.pandas_udf("array<int>")
    def trees_of(hashes: pd.Series) -> pd.Series:
        return pd.Series([_drawn(int(h) & 0x7FFFFFFFFFFFFFFF, trees, share, seed) for h in hashes])

    def grow(key_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_key").reset_index(drop=True)
        draw = np.random.default_rng([seed, int(key_[0]), 1])
        pick = draw.choice(len(frame), min(sample, len(frame)), replace=False)
        return _grow(np.stack(frame["_x"].to_numpy()[np.sort(pick)]).astype(float), int(key_[0]), seed)

    drawn = some.select(F.col(key).alias("_key"), F.col(features).alias("_x"), F.explode(trees_of(F.xxhash64(key))).alias("tree"))
    return drawn.groupBy("tree").applyInPandas(grow, NODE)


def _drawn(value: int, trees: int, share: float, seed: int) -> list[int]:
    """The trees that draw a row which at least one draws: each with the chance ``share``, by geometric gaps."""
    if share >= 1:
        return [*range(trees)]
    draw = np.random.default_rng([seed, value])
    first = math.floor(math.log1p(-draw.uniform() * (1 - (1 - share) ** trees)) / math.log1p(-share))
    out = [min(first, trees - 1)]
    while (at := out[-1] + int(draw.geometric(share))) < trees:
        out.append(at)
    return out


def _flat(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    base = nodes.groupby("tree")["node"].transform("size").groupby(nodes["tree"]).first().cumsum().shift(fill_value=0)
    start = nodes["tree"].map(base).to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    at = np.arange(len(nodes))
    return {
        "roots": base.to_numpy(), "leaf": leaf, "feature": np.where(leaf, 0, nodes["feature"]), "split": nodes["split"].to_numpy(),
        "left": np.where(leaf, at, nodes["left"] + start), "right": np.where(leaf, at, nodes["right"] + start),
        "size": nodes["size"].to_numpy(),
    }


def _whole(features: str) -> Column:
    """Whether a vector is there and has no null component."""
    return F.col(features).isNotNull() & F.forall(features, lambda v: v.isNotNull())


def score_isolation_forest(rows: DataFrame, forest: DataFrame, features: str, name: str = "score") -> DataFrame:
    """``-2 ** (-mean path / common path)``: low is anomalous. The forest, of bounded size, is sent to all tasks.

    A vector that is null, has a null or NaN component or fewer than the trees ask for has a null score; so have all rows if the forest has no trees.
    """
    nodes = forest.toPandas()
    if nodes.empty:
        return rows.withColumn(name, F.lit(None).cast("double"))
    tree = _flat(nodes)
    extra = np.array([_common_path(n) for n in tree["size"]])
    unit, width = _common_path(tree["size"][tree["roots"]].max()) or 1.0, int(tree["feature"].max()) + 1

    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        out, good = np.zeros(len(values)), np.zeros(len(values), bool)
        for own, make in grouped([values]):
            x = make(own)[0]
            known = ~np.isnan(x).any(1) if x.shape[1] >= width else np.zeros(len(x), bool)
            own, x = own[known], x[known]
            each, total = np.arange(len(x)), np.zeros(len(x))
            for root in tree["roots"]:
                at, depth = np.full(len(x), root), np.zeros(len(x))
                while not (done := tree["leaf"][at]).all():
                    depth += ~done
                    at = np.where(x[each, tree["feature"][at]] <= tree["split"][at], tree["left"][at], tree["right"][at])
                total += depth + extra[at]
            out[own], good[own] = -(2.0 ** (-total / len(tree["roots"]) / unit)), True
        return pa.array(out, mask=~good)

    return rows.withColumn(name, score(F.col(features)))


BLOCKS = "block long, ids array<long>, x binary"
#: Sums of kernels are kept in steps of so many units of the logarithm.
STEP = 64
#: Bytes of background that rows meet in one group of block pairs.
HELD = 32 << 20


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """``(_id, _x)`` as blocks of at most ``most`` rows, named by their first id."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                ids, xs = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([xs, x]) if len(xs) else x
            while len(ids) >= most:
                yield one(ids[:most], xs[:most])
                ids, xs = ids[most:], xs[most:]
        if len(ids):
            yield one(ids, xs)

    def one(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])

    return rows.select("_id", "_x").mapInArrow(packed, BLOCKS)


def _copied(blocks: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Blocks in one of ``n_own`` groups, by a hash, with a copy for each of the ``n_other`` groups of the other side."""
    dealt = blocks.withColumn(own, F.pmod(F.xxhash64(blocks.columns[0]), F.lit(n_own)))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>")))


def score_kde(rows: DataFrame, background: DataFrame, features: str, bandwidth: float = 0.5, most: int = 2_048, name: str = "score") -> DataFrame:
    """Minus the log density of each row under Gaussian kernels at background rows; null without any.

    Rows and background are packed into blocks of ``most`` vectors and dealt out to a grid of groups: each group of row blocks meets each of background blocks,
    of some ``HELD`` bytes, in a shuffle, so each pair of blocks meets once and gives the logarithm of each row's sum of kernels. A block is copied once for each group of
    the other side, which are about as many as shuffle partitions in all, and no side is broadcast: Spark would take copies for as small as what is copied. What pairs give for a row
    is added up by key: logarithms are cut into a multiple of ``STEP`` and a rest, rests are added up as numbers for each multiple, before the shuffle too, and
    the few multiples of a row are put together last. Rows are written once.

    Vectors that are null, have a null or NaN component, or another number of components than the longest of the background don't count there and have a null score.
    """
    good = background.where(_whole(features)).select(F.transform(features, lambda v: v.cast("double")).alias("_x")).where(~F.exists("_x", F.isnan))
    dims = good.agg(F.max(F.size("_x"))).first()[0]
    if not dims:
        return rows.withColumn(name, F.lit(None).cast("double"))
    good = good.where(F.size("_x") == dims).withColumn("_id", F.monotonically_increasing_id())
    points = materialize(_blocks(good, most).select("x", F.size("ids").alias("n")), "background")
    n, n_blocks = points.agg(F.sum("n"), F.count("*")).first()
    known = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "densities")
    asked = known.select("_id", F.transform(features, lambda v: v.cast("double")).alias("_x")).where(_whole("_x") & (F.size("_x") == dims)).where(~F.exists("_x", F.isnan))
    across = math.ceil(n_blocks * most * dims * 8 / HELD)
    down = max(1, min(math.ceil(known.count() / most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // across))
    left = _copied(_blocks(asked, most), "row_group", down, "group", across)
    right = _copied(points.select(F.col("x").alias("y")), "group", across, "row_group", down)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(i)[row].as_py()).reshape(-1, dims) for i in (1, 2))
                logs = log_sums(x, y, bandwidth)
                step = np.floor(logs / STEP)
                ids = batch.column(0).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(step.astype(np.int64)), pa.array(np.exp(logs - STEP * step))], ["_id", "step", "part"])

    parts = left.join(right.hint("merge"), ["row_group", "group"]).select("ids", "x", "y").mapInArrow(sums, "_id long, step long, part double")
    added = parts.groupBy("_id", "step").agg(F.sum("part").alias("part"))
    per_row = added.groupBy(F.col("_id").alias("_of")).agg(F.collect_list(F.struct("step", "part")).alias("_s"), F.max("step").alias("_top"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["part"] * F.exp(STEP * (s["step"] - F.col("_top")).cast("double")))
    constant = math.log(n) + dims * math.log(bandwidth * math.sqrt(2 * math.pi))
    logs = per_row.select("_of", (F.lit(constant) - F.log(total) - STEP * F.col("_top")).alias("_score"))
    return known.join(logs, F.col("_id") == F.col("_of"), "left").withColumn(name, F.col("_score")).drop("_id", "_of", "_score")


def log_sums(x: np.ndarray, points: np.ndarray, bandwidth: float) -> np.ndarray:
    """The logarithm of each row's sum of Gaussian kernels at the points."""
    squares, out = (points**2).sum(1), np.empty(len(x))
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        far = -np.maximum((part**2).sum(1)[:, None] + squares - 2 * part @ points.T, 0) / (2 * bandwidth**2)
        top = far.max(1)
        out[i : i + 256] = top + np.log(np.exp(far - top[:, None]).sum(1))
    return out


def score_model(rows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], features: str, flip: bool = False, batch: int = 256, name: str = "score") -> DataFrame:
    """Any function of a matrix of windows to scores, in batches of windows of one length; ``flip`` changes the sign.

    A batch that fails has null scores and its error in ``error``; the job goes on. A null or empty window has a null score and an error.
    """

    @F.arrow_udf(f"{name} double, error string")
    def score(values: pa.Array) -> pa.Array:
        out, errors = np.zeros(len(values)), np.full(len(values), "ValueError: a window is null or empty", object)
        for rows_, make in grouped([values]):
            for i in range(0, len(rows_), batch):
                own = rows_[i : i + batch]
                try:
                    got = np.asarray(scorer(make(own)[0]), float)
                    out[own], errors[own] = (-got if flip else got), None
                except Exception as failure:  # noqa: BLE001
                    errors[own] = f"{type(failure).__name__}: {failure}"
        failed = np.array([e is not None for e in errors], bool)
        return pa.StructArray.from_arrays([pa.array(out, mask=failed), pa.array(errors.tolist(), pa.string())], [name, "error"])

    scored = rows.withColumn("_scored", score(F.col(features)))
    return scored.withColumn(name, F.col(f"_scored.{name}")).withColumn("error", F.col("_scored.error")).drop("_scored")
