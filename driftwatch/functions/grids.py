"""Bins: equal-width, logarithmic or of given edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(low: float, high: float, bins: int, log: bool = False) -> list[float]:
    """The ``bins + 1`` edges of a grid."""
    if log:
        ratio = (high / low) ** (1 / bins)
        return [low * ratio**i for i in range(bins)] + [high]
    return [low + (high - low) * i / bins for i in range(bins)] + [high]


def bin_of(value: Column, grid: list[float], closed: bool) -> Column:
    """The number of the bin ``[edge, next edge)`` of a value, null outside; the last edge counts where ``closed``."""
    out = F.lit(None).cast("int")
    for i in range(len(grid) - 1):
        upper = value <= F.lit(grid[i + 1]) if closed and i == len(grid) - 2 else value < F.lit(grid[i + 1])
        out = F.when((value >= F.lit(grid[i])) & upper, i).otherwise(out)
    return out


def histogram(rows: DataFrame, value: str, bins: int, by: list[str] | None = None, span: tuple[float, float] | None = None, density: bool = False) -> DataFrame:
    """Counts of equal-width bins, the last one closed. Without ``span`` it is that of all values, taken in one pass.

    Rows: ``by``, ``bin``, ``n`` and, where ``density``, the share per unit of width. Values outside the span are left out.
    """
    by = by or []
    if span is None:
        ends = rows.agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
        rows = rows.crossJoin(F.broadcast(ends))
    else:
        rows = rows.withColumn("_low", F.lit(float(span[0]))).withColumn("_high", F.lit(float(span[1])))
    x, width = F.col(value).cast("double"), (F.col("_high") - F.col("_low")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((x - F.col("_low")) / F.when(width != 0, width)), F.lit(bins - 1))).cast("int")
    inside = rows.where(x.between(F.col("_low"), F.col("_high"))).withColumn("bin", at).withColumn("_width", width)
    out = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("_width").alias("_width"))
    if density:
        from pyspark.sql import Window

        total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        out = out.withColumn("density", F.col("n") / total / F.col("_width"))
    return out.drop("_width")
