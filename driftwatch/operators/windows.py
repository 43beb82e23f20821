"""Cutting series into windows. Series are rows of sample arrays or of ``(stream, idx, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling_starts(total: Column, kernel: int, lead: int, extra: int) -> Column:
    """First samples of consecutive windows after ``lead`` samples; ``start + kernel + extra <= total``."""
    last = total - kernel - extra
    return F.when(last >= lead, F.sequence(F.lit(lead).cast("long"), last.cast("long"), F.lit(kernel).cast("long"))).otherwise(
        F.array().cast("array<long>")
    )


def tumbling_windows(series: DataFrame, kernel: int, lead: int, extra: int, samples: str = "samples") -> DataFrame:
    """One row for each window: ``start`` and the window's own samples."""
    starts = tumbling_starts(F.size(samples), kernel, lead, extra)
    out = series.withColumn("start", F.explode(starts))
    return out.withColumn("window", F.slice(samples, (F.col("start") + 1).cast("int"), F.lit(kernel))).drop(samples)


def windows_at(marks: DataFrame, series: DataFrame, by: str, kernel: int, lead: int, extra: int, rate: int, seconds: bool) -> DataFrame:
    """Windows that begin at given samples (or seconds), where the lead-in and the window itself fit.

    ``series`` has ``by`` and its length ``total``; ``marks`` has ``by`` and ``at``.
    """
    idx = (F.col("at") * rate if seconds else F.col("at")).cast("long")
    out = marks.withColumn("start", idx).join(series.select(by, "total"), by)
    return out.where((F.col("start") >= lead) & (F.col("start") + kernel + extra <= F.col("total"))).select(by, "start")


def sliding_windows(series: DataFrame, kernel: int, stride: int, samples: str = "samples") -> DataFrame:
    """Overlapping windows every ``stride`` samples that fit whole."""
    last = F.size(samples) - kernel
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    out = series.select("*", F.posexplode(starts).alias("window_no", "start"))
    return out.withColumn("window", F.slice(samples, F.col("start") + 1, F.lit(kernel))).drop(samples)


def block_samples(batch: int, stride: int, kernel: int, extra: int) -> int:
    """Samples that a block of ``batch`` overlapping windows needs."""
    return (batch - 1) * stride + kernel + extra


def context_windows(anchors: DataFrame, rows: DataFrame, by: str, before: int, after: int, strict: bool = False, value: str = "value") -> DataFrame:
    """For each anchor ``(by, idx)`` the values of the rows around it, in order, as ``context``.

    Anchors too near an end are dropped: ``before`` rows must lie before and ``after`` behind, one more on either side where ``strict``.
    Only the anchors' neighbours are asked for, by an equi-join.
    """
    n = rows.groupBy(by).agg((F.max("idx") + 1).alias("_n"))
    room = (F.col("idx") > before) & (F.col("idx") < F.col("_n") - (after + 1)) if strict else (
        (F.col("idx") >= before) & (F.col("idx") + after < F.col("_n"))
    )
    fit = anchors.select(by, "idx").join(n, by).where(room).select(by, F.col("idx").alias("anchor"))
    wanted = fit.withColumn("idx", F.explode(F.sequence(F.col("anchor") - before, F.col("anchor") + after)))
    got = wanted.join(rows.select(by, "idx", F.col(value).alias("_value")), [by, "idx"])
    packed = got.groupBy(by, "anchor").agg(F.array_sort(F.collect_list(F.struct("idx", "_value"))).alias("_c"))
    return packed.select(by, "anchor", F.transform("_c", lambda c: c["_value"]).alias("context"))


def quota_across_files(rows: DataFrame, quota: int, file: str, order: str) -> DataFrame:
    """Rows of the files in order until ``quota`` rows are taken; only per-file counts are put in order in one task."""
    counts = rows.groupBy(file).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(file, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base")).where(F.col("_base") < quota)
    place = F.row_number().over(Window.partitionBy(file).orderBy(order)) + F.col("_base")
    return rows.join(base, file).withColumn("_place", place).where(F.col("_place") <= quota).drop("_base", "_place")


def std(values: Column, ddof: int) -> Column:
    """Standard deviation of an array with ``ddof`` degrees of freedom less, in one pass; null if too short."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n, off = s["n"] + 1.0, x.cast("double") - s["mean"]
        mean = s["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + off * (x.cast("double") - mean)).alias("m2"))

    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > ddof, F.sqrt(s["m2"] / (s["n"] - ddof))))


def unit_std(series: DataFrame, column: str, least: float | None = None, name: str = "scaled") -> DataFrame:
    """Each array divided by its own sample standard deviation, which is taken as ``least`` at least if given."""
    own = std(F.col(column), 1)
    own = F.greatest(own, F.lit(least)) if least is not None else own
    out = series.withColumn("_std", own)
    return out.withColumn(name, F.transform(column, lambda x: x.cast("double") / F.col("_std"))).drop("_std")


def equalize_lengths(series: DataFrame, by: str, samples: str = "samples") -> DataFrame:
    """Arrays of a segment cut to the shortest of them."""
    shortest = F.min(F.size(samples)).over(Window.partitionBy(by))
    return series.withColumn("_least", shortest).withColumn(samples, F.slice(samples, F.lit(1), F.col("_least"))).drop("_least")
