"""Vetoes by thresholds: ``{metric: {"min": x or None, "max": y or None}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.quantiles import quantiles
from driftwatch.operators.scores import finite


def _failures(metric: str, bounds: dict) -> list[Column]:
    """A text for each bound that a metric fails. A value that isn't finite fails each bound that is set."""
    value, out = F.col(metric).cast("double"), []
    for side, sign, miss in (("min", "<", lambda b: value < b), ("max", ">", lambda b: value > b)):
        bound = bounds.get(side)
        if bound is not None:
            out.append(F.when(~finite(value) | miss(F.lit(float(bound))), F.lit(f"{metric} {sign} {bound:g}")))
    return out


def apply_vetoes(rows: DataFrame, thresholds: dict[str, dict]) -> DataFrame:
    """Adds ``failed_cuts``, ``n_failed_cuts`` and ``vetoed``."""
    failed = [text for metric, bounds in thresholds.items() for text in _failures(metric, bounds)]
    cuts = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return rows.withColumn("failed_cuts", cuts).withColumn("n_failed_cuts", F.size("failed_cuts")).withColumn("vetoed", F.col("n_failed_cuts") > 0)


def recalculate_vetoes(results: DataFrame, thresholds: dict[str, dict]) -> DataFrame:
    """The vetoes by other thresholds, over rows of ``success``; metrics that the table doesn't have are passed over."""
    own = {m: b for m, b in thresholds.items() if m in results.columns}
    return apply_vetoes(results.where("success").drop("failed_cuts", "n_failed_cuts", "vetoed"), own)


def metric_summary(rows: DataFrame, thresholds: dict[str, dict]) -> DataFrame:
    """For each metric over its finite values: count, mean, median, population deviation, range, and how many lie beyond its bounds."""
    pairs = ", ".join(f"'{m}', cast({m} as double), cast({b.get('min')!r} as double), cast({b.get('max')!r} as double)" for m, b in thresholds.items())
    long = rows.selectExpr(f"stack({len(thresholds)}, {pairs}) as (metric, value, low, high)".replace("None", "null"))
    good = long.where(finite(F.col("value")))
    stats = good.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.count_if(F.col("value") < F.col("low")).alias("n_below"), F.count_if(F.col("value") > F.col("high")).alias("n_above"),
    )
    return stats.join(quantiles(good, "value", {"median": 0.5}, ["metric"]), "metric")


def veto_totals(rows: DataFrame) -> DataFrame:
    """How many rows passed and how many were vetoed."""
    return rows.agg(F.count_if(~F.col("vetoed")).alias("n_passed"), F.count_if("vetoed").alias("n_vetoed"))


def passing_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """Over the finite scores of rows that aren't vetoed: count, mean, median, population deviation and range; no row where there are none."""
    good = rows.where(~F.col("vetoed") & finite(F.col(score).cast("double"))).select(F.col(score).cast("double").alias("_v"))
    stats = good.agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"))
    return stats.where("n > 0").crossJoin(F.broadcast(quantiles(good, "_v", {"median": 0.5})))


def preselect(rows: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Rows that no bound rejects. NaN passes here, unlike in ``apply_vetoes``, and so does null."""
    reject = F.lit(False)
    for metric, bound in least.items():
        x = F.col(metric).cast("double")
        reject = reject | F.coalesce(~F.isnan(x) & (x < bound), F.lit(False))
    for metric, bound in most.items():
        x = F.col(metric).cast("double")
        reject = reject | F.coalesce(~F.isnan(x) & (x > bound), F.lit(False))
    return rows.where(~reject)
