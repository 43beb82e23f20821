"""Exact quantiles and cuts of any number of rows, in total or by group, narrowed by sketches.

A KLL sketch of a group, small and added up before the shuffle, tells between which two values a wanted rank lies. One more pass counts exactly what lies under and between
them; if the rank isn't there, the margin is widened and the pass repeated. While many values are left between, the next sketch is of those only. Only the values of the last
window, about a hundredth of all rows after one sketch, are shuffled and put in order. Ties fall into one value with a count.

These functions run jobs while the plan is built, and read their rows some three times: give them a table, or rows that are written already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.islands import keyed, running_total
from driftwatch.session import materialize

#: Values between two bounds that one task puts in order.
MOST = 1 << 20
#: The size of a sketch, the ranks that it is asked for, and how far a wanted rank may lie off.
SIZE, GRID, MARGIN = 1000, 512, 0.005


def _meeting(rows: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with each window of their group that holds them."""
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    if not by:
        return rows.crossJoin(F.broadcast(windows)).where(inside)  # a row for each wanted rank
    names, same = keyed(windows, by)
    named = windows.select(*names, *[c for c in windows.columns if c not in by])
    return rows.join(named, same & inside).drop(*[f"_by_{c}" for c in by])


def _narrowed(rows: DataFrame, places: dict[str, Callable[[Column], Column]], by: list[str], most: int) -> DataFrame:
    """Windows ``(by, _name, _place, _lo, _hi, _below, _inside)`` of the values ``_x``, each of which holds the values at its place and the next one, counted from zero."""
    ends = rows.groupBy(*by).agg(F.count("*").alias("_inside"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_inside > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), of(F.col("_inside")).cast("double").alias("_place")) for name, of in places.items()]))
    windows = ends.select(*by, "_lo", "_hi", "_inside", F.lit(0).cast("long").alias("_below"), F.lit(MARGIN).alias("_margin"), wanted.alias("_w"))
    windows = windows.select(*by, "_w._name", "_w._place", "_lo", "_hi", "_below", "_inside", "_margin").where("_place >= 0")
    windows = materialize(windows, "windows")
    crowded = (F.col("_inside") > most) & (F.col("_lo") < F.col("_hi")) & (F.col("_margin") < 1)
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    key = [*by, "_name"]
    while not (open_ := windows.where(crowded)).isEmpty():
        sketched = _meeting(rows, open_, by).groupBy(*key).agg(F.kll_sketch_agg_double("_x", F.lit(SIZE)).alias("_s"))
        names, same = keyed(sketched, key)
        rank = (F.col("_place") - F.col("_below")) / F.col("_inside")
        low, high = F.floor((rank - F.col("_margin")) * GRID), F.ceil((rank + F.col("_margin")) * GRID)
        told = open_.join(sketched.select(*names, F.kll_sketch_get_quantile_double("_s", grid).alias("_q")), same)
        told = told.withColumn("_a", F.when(low > 0, F.get("_q", low.cast("int"))).otherwise(F.col("_lo")))
        told = told.withColumn("_b", F.when(high < GRID, F.get("_q", high.cast("int"))).otherwise(F.col("_hi")))
        told = materialize(told.select(*key, "_lo", "_hi", "_a", "_b"), "windows")
        under, between = F.col("_x") < F.col("_a"), F.col("_x").between(F.col("_a"), F.col("_b"))
        counted = _meeting(rows, told, by).groupBy(*key).agg(F.count_if(under).alias("_under"), F.count_if(between).alias("_between"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
        names, same = keyed(counted, key)
        found = open_.join(counted.select(*names, "_under", "_between", "_a", "_b"), same)
        below = F.col("_below") + F.col("_under")
        hit = (below <= F.floor("_place")) & (F.ceil("_place") < below + F.col("_between"))
        pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
        # where a window isn't half as full as before, the next one wouldn't be either: ties, so that is the last
        margin = F.when(~hit, F.col("_margin") * 4).when(F.col("_between") * 2 < F.col("_inside"), MARGIN).otherwise(1.0).alias("_margin")
        found = found.select(*key, "_place", pick(F.col("_a"), "_lo"), pick(F.col("_b"), "_hi"), pick(below, "_below"), pick(F.col("_between"), "_inside"), margin)
        windows = materialize(windows.where(~crowded).unionByName(found), "windows")
    return windows


def _picked(rows: DataFrame, windows: DataFrame, by: list[str], most: int) -> DataFrame:
    """``(by, _name, _low, _high, _part, _under)``: the values at a place and behind it, the place's fraction, and how many values are smaller than the first."""
    key = [*by, "_name"]
    values = _meeting(rows, windows, by).groupBy(*key, "_x").agg(F.count("*").alias("_n"), F.first("_place").alias("_place"), F.first("_below").alias("_below"))
    if windows.where((F.col("_inside") > most) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
        values = values.withColumn("_upto", upto)
    else:
        values = running_total(values, "_x", {"_upto": "_n"}, by=key)
    first, last = F.col("_below") + F.col("_upto") - F.col("_n"), F.col("_below") + F.col("_upto")
    at = lambda rank, of: F.max(F.when((first <= rank) & (rank < last), of))
    low, high = F.floor("_place"), F.ceil("_place")
    return values.groupBy(*key).agg(
        at(low, F.col("_x")).alias("_low"), at(high, F.col("_x")).alias("_high"), F.max(F.col("_place") - low).alias("_part"), at(low, first).alias("_under")
    )


def _numbers(rows: DataFrame, value: Column, by: list[str], *others: Column) -> DataFrame:
    x = value.cast("double")
    return rows.where(x.isNotNull() & ~F.isnan(x)).select(*by, (x + 0.0).alias("_x"), *others)


def quantiles(rows: DataFrame, value: str, levels: dict[str, float], by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """Linearly interpolated quantiles, a column for each name of ``levels``; nulls and NaN don't count. A group without values has no row."""
    return at_places(rows, value, {name: lambda n, level=level: F.lit(float(level)) * (n - 1) for name, level in levels.items()}, by, most)


def at_places(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """The values at places, counted from zero, that follow from the number of values of a group; between two values linearly interpolated."""
    by = by or []
    numbers = _numbers(rows, F.col(value), by)
    found = _picked(numbers, _narrowed(numbers, places, by, most), by, most)
    out = F.when(F.col("_part") == 0, F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    picks = [F.max(F.when(F.col("_name") == name, out)).alias(name) for name in places]
    return found.groupBy(*by).agg(*picks) if by else found.agg(*picks, F.count("*").alias("_k")).where("_k > 0").drop("_k")


def cuts(rows: DataFrame, order: Column, taken: Callable[[Column], Column], by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """``(by, cut)``: the largest of the first ``taken(n)`` values of a group of ``n`` in a numeric order without ties, in the order's own type.

    Values are narrowed as doubles; those that are one double are told apart at the end. A group of which none is taken has no row. Null and NaN are never taken.
    """
    by = by or []
    numbers = _numbers(rows, order, by, order.alias("_o"))
    found = _picked(numbers, _narrowed(numbers, {"_cut": lambda n: taken(n) - 1}, by, most), by, most)
    ends = found.select(*by, F.col("_low").alias("_lo"), F.col("_low").alias("_hi"), F.col("_under"))
    sizes = numbers.groupBy(*by).agg(taken(F.count("*")).alias("_k"))
    names, same = keyed(sizes, by)
    ends = ends.join(sizes.select(*names, "_k"), same).drop(*[f"_by_{c}" for c in by]) if by else ends.crossJoin(F.broadcast(sizes))
    equal = _meeting(numbers, ends, by)
    place = F.row_number().over(Window.partitionBy(*by, "_x").orderBy("_o"))
    return equal.withColumn("_i", place).where(F.col("_i") <= F.col("_k") - F.col("_under")).groupBy(*by).agg(F.max("_o").alias("cut")).where("cut IS NOT NULL")


def first_rows(rows: DataFrame, order: Column, n: int, most: int = MOST) -> DataFrame:
    """The ``n`` first rows in a numeric order without ties, by one comparison with the last one's value: no row is moved."""
    cut = cuts(rows, order, lambda size: F.least(size, F.lit(n)), most=most)
    return rows.withColumn("_order", order).crossJoin(F.broadcast(cut)).where("_order <= cut").drop("_order", "cut")
