"""False-alarm rates and significance. ``direction`` says whether low or high scores are anomalous; it has no default."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.islands import running_total

YEAR = 31_536_000


def _check(direction: str) -> bool:
    if direction not in ("low", "high"):
        raise ValueError("direction is low or high")
    return direction == "low"


def far_table(scores: DataFrame, num: int, seconds: float, direction: str, score: str = "score") -> DataFrame:
    """``num`` evenly spaced thresholds from the smallest to the largest score, and the rate of scores as anomalous, bounds included.

    Scores are counted into the steps between thresholds once; the rates are running totals over those ``num`` counts.
    """
    low = _check(direction)
    spark = scores.sparkSession
    ends = scores.agg(F.min(score).cast("double").alias("_low"), F.max(score).cast("double").alias("_high"), F.count("*").alias("_n"))
    step = (F.col("_high") - F.col("_low")) / (num - 1)
    at = lambda i: F.when(i == num - 1, F.col("_high")).otherwise(F.col("_low") + i * step)
    x = F.col(score).cast("double")
    guess = F.when(step == 0, 0).otherwise((F.ceil if low else F.floor)((x - F.col("_low")) / F.when(step != 0, step))).cast("int")
    guess = F.greatest(F.lit(0), F.least(F.lit(num - 1), guess))
    # the first threshold that takes the score; division may be off by one step at an edge
    place = F.when((guess > 0) & (x <= at(guess - 1)), guess - 1).when((guess < num - 1) & (x > at(guess)), guess + 1).otherwise(guess)
    if not low:
        place = F.when((guess < num - 1) & (x >= at(guess + 1)), guess + 1).when((guess > 0) & (x < at(guess)), guess - 1).otherwise(guess)
    counts = scores.crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("i")).agg(F.count("*").alias("n"))
    grid = spark.range(num).withColumnRenamed("id", "i").crossJoin(ends)
    pairs = grid.join(F.broadcast(counts.withColumnRenamed("i", "j")), F.col("j") <= F.col("i") if low else F.col("j") >= F.col("i"), "left")
    return pairs.groupBy("i").agg(F.first(at(F.col("i"))).alias("threshold"), (F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(seconds))).alias("far")).drop("i")


def score_to_far(scores: DataFrame, cut: float, seconds: float, direction: str, score: str = "score") -> DataFrame:
    """The rate of scores as anomalous as ``cut``, itself included."""
    hit = F.col(score) <= cut if _check(direction) else F.col(score) >= cut
    return scores.agg((F.count_if(hit) / F.lit(float(seconds))).alias("far"))


def ifar_curve(scores: DataFrame, seconds: float, direction: str, score: str = "score") -> DataFrame:
    """For each distinct score the number of scores as anomalous (ties share the highest count) and its inverse rate in years."""
    low = _check(direction)
    counts = scores.groupBy(score).agg(F.count("*").alias("n"))
    out = running_total(counts, score, {"count": "n"}, descending=not low)
    return out.select(score, "count", (F.lit(float(seconds)) / (F.col("count") * YEAR)).alias("ifar_years"))


def thin_log_levels(curve: DataFrame, max_points: int) -> DataFrame:
    """The curve itself up to ``max_points`` rows. Beyond, for each level k * 10^e the row of the smallest count that reaches it, and both ends.

    A count belongs to the largest level that it reaches; the smallest of each level is the first to reach it, and all levels up to it from the count before.
    """
    n, lowest, highest = curve.agg(F.count("*"), F.min("count"), F.max("count")).first()
    if n <= max_points:
        return curve
    unit = F.pow(F.lit(10), F.length(F.col("count").cast("string")) - 1).cast("long")
    reach = curve.groupBy((F.floor(F.col("count") / unit) * unit).alias("level")).agg(F.min("count").alias("_reach")).select("_reach")
    ends = curve.sparkSession.createDataFrame([(lowest,), (highest,)], "_reach long")
    return curve.join(F.broadcast(reach.unionByName(ends)), F.col("count") == F.col("_reach"), "left_semi")


def poisson_quantiles(shares: list[float], mean: float) -> list[int]:
    """For each share the smallest k whose Poisson distribution function reaches it, summed over 12 deviations around the mean."""
    reach = 12 * math.sqrt(mean)
    first, last = max(0, math.floor(mean - reach - 10)), math.ceil(mean + reach + 30)
    k = np.arange(first, last + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(k[1:]))])
    weights = np.exp(logs - logs.max())
    below = np.cumsum(weights) / weights.sum()
    return [first + int(np.searchsorted(below, share * (1 - 1e-15))) for share in shares]


BANDS = (0.682689, 0.954499, 0.9973)


def poisson_bands(curve: DataFrame, points: int = 1000) -> DataFrame:
    """Bands of 1, 2 and 3 sigma around expected counts from 1.2 times the largest count down to 0.001.

    The expected counts are dealt out to tasks; the work for one follows the root of the count.
    """
    spark = curve.sparkSession
    names = ["expected", *(f"{side}{i}" for i in (1, 2, 3) for side in ("low", "high"))]
    shares = [share for band in BANDS for share in ((1 - band) / 2, (1 + band) / 2)]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def bands(places: pa.Array, tops: pa.Array) -> pa.Array:
        rows = []
        for i, top in zip(places.to_pylist(), tops.to_pylist(), strict=True):
            start = math.log10(top * 1.2)
            mean = 10 ** (start + (-3 - start) * i / max(points - 1, 1))
            found = poisson_quantiles(shares, mean)
            rows.append([mean, *(max(k - 0.5, 0.0) if j % 2 == 0 else k + 0.5 for j, k in enumerate(found))])
        table = np.array(rows).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(len(names))], names)

    top = curve.agg(F.max("count").alias("top")).where("top > 0")
    grid = spark.range(points).repartition("id").crossJoin(F.broadcast(top))
    return grid.select(bands("id", "top").alias("b")).select("b.*")
