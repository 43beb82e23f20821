"""Post-processing of score streams: rows of ``(stream..., idx, score)`` with the order in ``idx``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.islands import keyed, runs
from driftwatch.functions.quantiles import at_places, quantiles
from driftwatch.session import materialize


def finite(value: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def finite_rows(rows: DataFrame, columns: list[str], arrays: list[str] | None = None) -> DataFrame:
    """Rows whose numbers, and all elements of whose arrays, are finite."""
    keep = [finite(F.col(c).cast("double")) for c in columns]
    keep += [F.forall(c, lambda x: finite(x.cast("double"))) for c in arrays or []]
    return rows.where(F.lit(True) if not keep else _all(keep))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def dropped_rows(rows: DataFrame, by: str, column: str) -> DataFrame:
    """How many rows of each ``by`` are kept, and dropped as not finite."""
    ok = finite(F.col(column).cast("double"))
    return rows.groupBy(by).agg(F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))


def _framed(rows: DataFrame, width: int, by: list[str], order: str, chunk: int | None):
    """The rows, a frame of ``width`` of them around each, and what tells a row's own copy from a neighbour chunk's.

    With ``chunk``, a stream is cut into pieces of so many rows and each piece gets the rows of its neighbours that its
    frames reach, so a stream of any length spreads over tasks. ``order`` must then count up by one from row to row.
    """
    keys, own = [*by], F.lit(True)
    if chunk:
        at = lambda off: F.floor((F.col(order) + off) / chunk)
        rows = rows.withColumn("_chunk", F.explode(F.sequence(at(-((width - 1) // 2)), at(width // 2))))
        keys, own = [*by, "_chunk"], F.col("_chunk") == at(0)
    return rows, Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2), own


def tophat_smooth(
    rows: DataFrame, width: int, by: list[str], order: str = "idx", score: str = "score", name: str = "smooth", chunk: int | None = None
) -> DataFrame:
    """Moving mean of ``width`` rows; beyond the ends the scores count as zero. ``chunk`` splits long streams."""
    rows, frame, own = _framed(rows, width, by, order, chunk)
    return rows.withColumn(name, F.sum(score).over(frame) / width).where(own).drop("_chunk")


def valid_smooth(
    rows: DataFrame, width: int, by: list[str], order: str = "idx", score: str = "score", name: str = "smooth", chunk: int | None = None
) -> DataFrame:
    """Moving mean of full frames only; rows without one go. ``chunk`` splits long streams."""
    rows, frame, own = _framed(rows, width, by, order, chunk)
    out = rows.withColumn(name, F.sum(score).over(frame) / width).withColumn("_n", F.count("*").over(frame))
    return out.where(own & (F.col("_n") == width)).drop("_n", "_chunk")


def veto_long_runs(rows: DataFrame, share: float, max_run: int, by: list[str], order: str = "idx", score: str = "smooth", width: int = 4096) -> DataFrame:
    """Rows without runs of over ``max_run`` rows in a row that lie under the ``share`` quantile of all scores. ``order`` counts up by one in each stream.

    The rows are written once, as they are read for the quantile, for runs and for the result. Rows leave by a join on stream and
    on pieces of ``width`` places, of which a run has as many as it touches: no row of a run is listed, and a hot stream spreads.
    """
    rows = materialize(rows, "scored")
    cut = quantiles(rows, score, {"_cut": share})
    low = rows.crossJoin(F.broadcast(cut)).where(F.col(score) < F.col("_cut"))
    long = runs(low, by, order, 1).where(F.col("n") > max_run)
    piece = lambda c: F.floor(F.col(c) / width)
    names, same = keyed(long, by)
    gone = long.select(*names, "first", "last", F.explode(F.sequence(piece("first"), piece("last"))).alias("_piece"))
    at = F.col(order)
    return rows.join(gone, same & (piece(order) == F.col("_piece")) & at.between(F.col("first"), F.col("last")), "left_anti")


def threshold(rows: DataFrame, level: float, score: str = "score") -> DataFrame:
    """One row ``threshold``: the ``level``-th smallest score from zero if ``level >= 1``, else the interpolated quantile; nulls and NaN don't count."""
    if level < 1:
        return quantiles(rows, score, {"threshold": level})
    return at_places(rows, score, {"threshold": lambda n: F.least(F.lit(int(level)), n - 1)})


def threshold_from_far(background: DataFrame, seconds: float, score: str = "score", year: float = 3.154e7) -> DataFrame:
    """The quantile ``1 - seconds / year`` of background scores, and their smallest and largest."""
    ends = background.agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))
    return quantiles(background, score, {"threshold": 1 - seconds / year}).crossJoin(F.broadcast(ends))


def select_outliers(rows: DataFrame, cut: DataFrame, by: list[str], psd_length: int, rate: float = 1.0, score: str = "score") -> DataFrame:
    """Rows strictly under the threshold, of streams longer than the ``psd_length`` seconds that fill the spectrum.

    Streams are counted before the shuffle; only rows under the threshold meet the counts.
    """
    long = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rate * psd_length)
    names, same = keyed(long, by)
    low = rows.crossJoin(F.broadcast(cut)).where(F.col(score) < F.col("threshold")).drop("threshold")
    return low.join(long.select(*names), same, "left_semi")


def cluster_outliers(rows: DataFrame, gap: float, by: list[str], pad: float | None = None, time: str = "t", score: str = "score", digits: int = 2) -> DataFrame:
    """Outliers to intervals: a step of over ``gap`` seconds splits. ``pad`` is half the gap unless given. A stream of any length spreads over tasks."""
    pad = gap / 2 if pad is None else pad
    found = runs(rows, by, time, gap, {"min_score": score})
    out = found.select(*by, (F.col("first") - pad).alias("start"), (F.col("last") + pad).alias("end"), F.round("min_score", digits).alias("min_score"), "n")
    return out.withColumn("duration", F.col("end") - F.col("start"))


def worst_segments(outliers: DataFrame, n: int, segment: str) -> DataFrame:
    """The ``n`` segments of most outliers; the smaller name wins a tie."""
    return outliers.groupBy(segment).agg(F.count("*").alias("n_outliers")).orderBy(F.desc("n_outliers"), segment).limit(n)


def outlier_rate(outliers: DataFrame, spans: DataFrame, width: float, by: list[str], time: str = "t", shift: str | None = None) -> DataFrame:
    """Outliers in each bin of ``width`` seconds of the spans ``(by..., first, last)``; bins without any have zero."""
    at = F.col(time) + F.col(shift) if shift else F.col(time)
    counts = outliers.groupBy(*by, F.floor(at / width).cast("long").alias("bin")).agg(F.count("*").alias("_n"))
    ids = F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor(F.col("last") / width).cast("long"))
    grid = spans.select(*by, F.explode(ids).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("_n", F.lit(0)).alias("n"))


def score_summary(rows: DataFrame, by: list[str], share: float, score: str = "score") -> DataFrame:
    """Count, smallest, largest and ``share`` quantile of each group."""
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest"))
    return ends.join(quantiles(rows, score, {"cut": share}, by), by, "left")
