"""Runs of rows and running totals without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.session import materialize


def runs(rows: DataFrame, by: list[str], order: str, gap: float, least: dict[str, str] | None = None) -> DataFrame:
    """``(by, first, last, n)`` of runs of rows, which a step of over ``gap`` in the numeric ``order`` ends, with the smallest of the columns ``least`` by name.

    Rows are dealt out by ranges of (by, order), and runs are found within each. Of those, only the first and the last of a range can go on in another one:
    they, at most two for a range and group, are put in order by group and joined where they touch. No task sees all rows of a group.
    The ranges are written to the shared folder, of the columns needed here alone. Rows with a null order are in no run.
    """
    least = least or {}
    kept = rows.where(F.col(order).isNotNull()).select(*by, F.col(order).alias("_at"), *[F.col(c).alias(name) for name, c in least.items()])
    dealt = materialize(kept.repartitionByRange(*by, "_at").withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range", *by).orderBy("_at")
    step = F.col("_at") - F.lag("_at").over(within)
    number = F.sum(F.when(step > gap, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    of = [F.min(name).alias(name) for name in least]
    pieces = dealt.withColumn("_run", number).groupBy("_range", *by, "_run").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"), *of)
    pieces = materialize(pieces, "runs")
    most = pieces.groupBy("_range", *by).agg(F.max("_run").alias("_most"))
    names, same = keyed(most, by)
    marked = pieces.join(most.select(*names, F.col("_range").alias("_of"), "_most"), same & (F.col("_range") == F.col("_of"))).drop("_of", *[f"_by_{c}" for c in by])
    edge = F.col("_run").isin(0) | (F.col("_run") == F.col("_most"))
    ordered = Window.partitionBy(*by).orderBy("first", "_range")
    far = F.col("first") - F.lag("last").over(ordered) > gap
    joined = marked.where(edge).withColumn("_far", far)
    joined = joined.withColumn("_run", F.sum(F.when(F.col("_far"), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), *of)
    columns = [*by, "first", "last", "n", *least]
    return marked.where(~edge).select(*columns).unionByName(joined.select(*columns))


def running_total(rows: DataFrame, order: str, totals: dict[str, str], descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds, for each name of ``totals``, the sum of its column over all rows (of the group ``by``) up to this one in the order of a column without ties.

    Rows are dealt out by ranges of ``by`` and ``order`` and summed within each range; the offsets are the totals of
    earlier ranges, of which there is one for each partition and group in it. No task sees all rows of a group. The ranges are written to the
    shared folder, as totals and rows must see the same ones.
    """
    by = by or []
    key = F.col(order).desc() if descending else F.col(order).asc()
    dealt = materialize(rows.repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_range").agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_base_{name}") for name in totals]
    names, same = keyed(sums, by)
    offsets = sums.select(*names, F.col("_range").alias("_of"), *bases)
    within = Window.partitionBy("_range", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range, and in it for each group: broadcast by Spark where its size allows
    joined = dealt.join(offsets if by else F.broadcast(offsets), same & (F.col("_range") == F.col("_of")))
    added = {name: F.col(f"_base_{name}") + F.sum(value).over(within) for name, value in totals.items()}
    return joined.withColumns(added).drop("_range", "_of", *[f"_base_{name}" for name in totals], *[f"_by_{c}" for c in by])


def keyed(rows: DataFrame, by: list[str]) -> tuple[list[Column], Column]:
    """Columns of ``rows`` that carry the keys ``by`` under other names, and the condition that they equal ``by``, nulls included."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return [rows[c].alias(f"_by_{c}") for c in by], same
