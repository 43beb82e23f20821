"""Recovery of injections, detection efficiency and ROC curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.grids import bin_of
from driftwatch.functions.islands import running_total, runs

#: Signal types whose amplitude is a strain and is read in units of 1e-22.
STRAIN_TYPES = ("SG", "WNB", "GA")


def index_to_gps(idx: Column, gps_start: Column, seconds: float) -> Column:
    """The time at which the ``idx``-th window begins."""
    return gps_start + idx * seconds


def snr_proxy(amplitude: Column, kind: Column, strain_types: tuple[str, ...] = STRAIN_TYPES) -> Column:
    """The amplitude as a measure of strength."""
    return F.when(kind.isin(*strain_types), amplitude / 1e-22).otherwise(amplitude)


def efficiency_vs_snr(rows: DataFrame, bins: int = 14, signal: str = "signal", snr: str = "snr", recovered: str = "recovered") -> DataFrame:
    """Per signal, logarithmic bins ``[low, high)`` from the smallest positive value (0.1 at least) to the largest, which falls out.

    Rows: ``bin``, ``center``, ``n``, ``efficiency`` and its binomial error; both are zero in an empty bin.
    """
    positive = F.when(F.col(snr) > 0, F.col(snr))
    spans = rows.groupBy(signal).agg(F.greatest(F.lit(0.1), F.min(positive)).alias("_low"), F.max(snr).alias("_high")).where("_high > _low")
    at = lambda i: F.col("_low") * F.pow(F.col("_high") / F.col("_low"), i / F.lit(float(bins)))
    grid = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("_from", at(F.col("bin"))).withColumn("_to", F.when(F.col("bin") == bins - 1, F.col("_high")).otherwise(at(F.col("bin") + 1)))
    place = F.floor(F.log(F.col(snr) / F.col("_low")) / F.log(F.col("_high") / F.col("_low")) * bins).cast("int")
    near = F.explode(F.array(place - 1, place, place + 1))  # a logarithm may be off at an edge: the edges decide
    inside = rows.join(F.broadcast(spans), signal).where(F.col(snr).between(F.col("_low"), F.col("_high"))).withColumn("bin", near)
    edges = grid.select(signal, "bin", "_from", "_to")
    hits = inside.join(F.broadcast(edges), [signal, "bin"]).where((F.col(snr) >= F.col("_from")) & (F.col(snr) < F.col("_to")))
    counts = hits.groupBy(signal, "bin").agg(F.count("*").alias("_n"), F.avg(F.col(recovered).cast("double")).alias("_e"))
    out = grid.join(counts, [signal, "bin"], "left")
    e, n = F.coalesce("_e", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    return out.select(
        signal, "bin", ((F.col("_from") + F.col("_to")) / 2).alias("center"), n.alias("n"), e.alias("efficiency"),
        F.when(n > 0, F.sqrt(e * (1 - e) / n)).otherwise(0.0).alias("error"),
    )


def overall_efficiency(rows: DataFrame, kind: str, signal: str, recovered: str = "recovered") -> DataFrame:
    """Recovered and all injections per signal, per type (null signal) and in total (both null)."""
    out = rows.rollup(kind, signal).agg(F.count_if(recovered).alias("n_recovered"), F.count("*").alias("n"))
    return out.withColumn("efficiency", F.col("n_recovered") / F.col("n"))


def detected_by_class_bin(rows: DataFrame, cut: float, direction: str, grid: list[float], by: str, value: str, score: str = "score", center: str = "arithmetic") -> DataFrame:
    """The share of detected rows per class and bin of given edges; values outside or on the last edge count nowhere, empty bins are null."""
    hit = F.col(score) < cut if direction == "low" else F.col(score) > cut
    counts = rows.withColumn("bin", bin_of(F.col(value).cast("double"), grid, closed=False)).groupBy(by, "bin").agg(
        F.count("*").alias("_n"), F.avg(hit.cast("double")).alias("share")
    )
    middle = [((a + b) / 2 if center == "arithmetic" else (a * b) ** 0.5) for a, b in zip(grid, grid[1:], strict=False)]
    bins = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(middle)), "bin int, center double"))
    full = rows.select(by).distinct().crossJoin(bins)
    return full.join(counts, [by, "bin"], "left").select(by, "bin", "center", F.coalesce("_n", F.lit(0)).alias("n"), "share")


def detected_fraction(rows: DataFrame, cut: float, direction: str, by: str, score: str = "score") -> DataFrame:
    """The share of detected rows per class."""
    hit = F.col(score) < cut if direction == "low" else F.col(score) > cut
    return rows.groupBy(by).agg(F.avg(hit.cast("double")).alias("share"))


def injection_clusters(windows: DataFrame, by: list[str], flag: str = "has_injection", order: str = "idx") -> DataFrame:
    """Runs of consecutive flagged windows: first index, length, and distance from the start of the run before. Only runs, not windows, are put in order by stream."""
    found = runs(windows.where(flag), by, order, 1).select(*by, F.col("first").alias("start"), F.col("n").alias("length"))
    before = F.lag("start").over(Window.partitionBy(*by).orderBy("start"))
    return found.withColumn("distance", F.col("start") - before)


def cluster_distances(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Smallest, largest and mean distance between the starts of runs."""
    return clusters.groupBy(*by).agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.avg("distance").alias("mean"))


def valid_clusters(clusters: DataFrame, n_background: int) -> DataFrame:
    """Runs with ``n_background`` windows before them: from the stream's begin for the first one, from the run before for others."""
    return clusters.where(F.coalesce("distance", "start") >= n_background)


def roc_curve(rows: DataFrame, score: str, positive: str, by: str | None = None) -> DataFrame:
    """False and true positive rates at each distinct score, from the highest on; with ``by``, one curve for each class.

    Scores are dealt out by range, so no task sorts all of them, nor all of a class.
    """
    keys = [by] if by else []
    at = rows.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    return _curve(at, score, keys)


def _curve(at: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """The curve of counts ``_p`` and ``_n`` at each distinct score."""
    summed = running_total(at, score, {"_tp": "_p", "_fp": "_n"}, descending=True, by=keys)
    totals = at.groupBy(*keys).agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    joined = summed.join(F.broadcast(totals), keys) if keys else summed.crossJoin(F.broadcast(totals))
    return joined.select(*keys, score, (F.col("_fp") / F.col("_ns")).alias("fpr"), (F.col("_tp") / F.col("_ps")).alias("tpr"), "_p", "_n", "_tp", "_ps", "_ns")


def roc_auc(curve: DataFrame, by: str | None = None) -> DataFrame:
    """The area under a curve of ``roc_curve`` by trapezoids, from each step on its own: no order is needed."""
    area = F.col("_n") / F.col("_ns") * (F.col("_tp") - F.col("_p") / 2) / F.col("_ps")
    return curve.groupBy(*([by] if by else [])).agg(F.sum(area).alias("auc"))


def roc_by_class(rows: DataFrame, score: str, by: str, background: list) -> DataFrame:
    """The curve of each signal class, as ``against``, beside all background rows.

    Rows are counted for each class and score before the background is set beside every class: what is repeated are its distinct scores.
    """
    back = F.col(by).isin(*background)
    counts = rows.groupBy(F.when(~back, F.col(by)).alias("against"), score).agg(F.count("*").alias("_k"))
    signals = counts.where("against IS NOT NULL").select("against", score, F.col("_k").alias("_p"), F.lit(0).cast("long").alias("_n"))
    classes = rows.where(~back).select(F.col(by).alias("against")).distinct()
    noise = counts.where("against IS NULL").drop("against").crossJoin(F.broadcast(classes)).select("against", score, F.lit(0).cast("long").alias("_p"), F.col("_k").alias("_n"))
    at = signals.unionByName(noise).groupBy("against", score).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return _curve(at, score, ["against"])


def snr_by_class(rows: DataFrame, by: str, background: list, snr: str = "snr") -> DataFrame:
    """Smallest, largest and mean strength of each class that isn't background."""
    return rows.where(~F.col(by).isin(*background)).groupBy(by).agg(
        F.min(snr).alias("lowest"), F.max(snr).alias("highest"), F.avg(snr).alias("mean"), F.count("*").alias("n")
    )


def snr_histograms(rows: DataFrame, by: str, background: list, bins: int = 50, snr: str = "snr") -> DataFrame:
    """For each class that isn't background, the counts of ``bins`` equal bins between its smallest and largest strength, with their bounds; empty bins have zero.

    Two passes: the bounds of classes, a row each, meet the rows again. Null and NaN strengths don't count; a class of one value has it in the middle of a span of one.
    """
    x = F.col(snr).cast("double")
    own = rows.where(~F.col(by).isin(*background) & x.isNotNull() & ~F.isnan(x)).select(by, x.alias("_x"))
    ends = own.groupBy(by).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(F.col(by).alias("_of"), F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_low"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    met = own.join(F.broadcast(ends), F.col(by) == F.col("_of"))  # a row for each class
    at = F.least(F.floor((F.col("_x") - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = met.groupBy("_of", at.alias("bin")).agg(F.count("*").alias("_n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, ["_of", "bin"], "left")
    return out.select(F.col("_of").alias(by), "bin", (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("_n", F.lit(0)).alias("n"))
