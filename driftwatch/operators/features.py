"""Standardizers, correlations of detector pairs, and the preparation of training sets."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.islands import keyed
from driftwatch.functions.quantiles import cuts, first_rows, quantiles


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def freq_cos(h: Column, l: Column) -> Column:  # noqa: E741
    """The cosine of the one-sided spectra of two real arrays of equal, even length, without transforming them.

    Of N samples the one-sided sum of products is (N * <h, l> + sum h * sum l + alternating sum h * alternating sum l) / 2.
    """
    h, l = (F.transform(x, lambda v: v.cast("double")) for x in (h, l))  # noqa: E741
    signed = lambda x: _sum(F.transform(x, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v)))
    half = lambda a, b: (F.size(a) * _sum(F.zip_with(a, b, lambda x, y: x * y)) + _sum(a) * _sum(b) + signed(a) * signed(b)) / 2
    return half(h, l) / (F.sqrt(half(h, h)) * F.sqrt(half(l, l)) + 1e-8)


def hrss(plus: Column, cross: Column, dt: float) -> Column:
    """Root sum square of two polarizations over time."""
    return F.sqrt(_sum(F.zip_with(plus, cross, lambda p, c: (p.cast("double") * p + c.cast("double") * c))) * dt)


def fit_standardizer(rows: DataFrame, column: str, sample: bool = False, least: float | None = None) -> DataFrame:
    """``(dim, mean, std)`` of an array column: population deviation, or the sample one, of ``least`` at least if given."""
    flat = rows.select(F.posexplode(column).alias("dim", "x"))
    spread = (F.stddev_samp if sample else F.stddev_pop)(F.col("x").cast("double"))
    spread = F.greatest(spread, F.lit(least)) if least is not None else spread
    return flat.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), spread.alias("std"))


def standardizer_row(fitted: DataFrame) -> DataFrame:
    """The standardizer as one row of two arrays, to be broadcast: its size is that of an embedding."""
    packed = fitted.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    return packed.select(F.transform("_s", lambda s: s["mean"]).alias("means"), F.transform("_s", lambda s: s["std"]).alias("stds"))


def standardize(rows: DataFrame, fitted: DataFrame, column: str, name: str = "features", extra: str | None = None) -> DataFrame:
    """``(x - mean) / (std + 1e-8)`` for each dimension; the column ``extra`` is appended as one more."""
    joined = rows.crossJoin(F.broadcast(standardizer_row(fitted)))
    centered = F.zip_with(column, "means", lambda x, m: x.cast("double") - m)
    scaled = F.zip_with(centered, "stds", lambda x, s: x / (s + 1e-8))
    if extra:
        scaled = F.concat(scaled, F.array(F.col(extra).cast("double")))
    return joined.withColumn(name, scaled).drop("means", "stds")


def select_background(rows: DataFrame, label: str) -> DataFrame:
    """Rows whose label is one of the two largest."""
    return rows.join(F.broadcast(rows.select(label).distinct().orderBy(F.desc(label)).limit(2)), label, "left_semi")


def split_files(files: DataFrame, name: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Files in order of name: the first part train, then val, the rest test. One row for each file."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)) - 1
    train, upto = F.floor(n * F.lit(1 - val - test)), F.floor(n * F.lit(val))
    return files.withColumn("split", F.when(place < train, "train").when(place < train + upto, "val").otherwise("test"))


#: A prime under 2^31; products of two numbers below it fit a long.
PRIME = (1 << 31) - 1


def split_factors(seed: int) -> tuple[int, int]:
    """Factor and offset of the hash of ``split_rows``, those of different seeds unrelated."""
    drawn = int.from_bytes(sha256(str(seed).encode()).digest(), "big")
    return 1 + drawn % (PRIME - 1), drawn // PRIME % PRIME


def split_rows(rows: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """``is_val`` for about ``percent`` of the rows, always the same ones for a seed: by ``(factor * key + offset) mod PRIME``.

    Any long is a key; strings are hashed first. A null key is never in the validation set.
    """
    factor, offset = split_factors(seed)
    value = F.col(key) if rows.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key)
    mixed = F.pmod(F.pmod(value.cast("long"), F.lit(PRIME)) * F.lit(factor) + F.lit(offset), F.lit(PRIME))
    return rows.withColumn("is_val", F.coalesce(F.col(key).isNotNull() & (mixed * 100 < F.lit(percent) * F.lit(PRIME).cast("long")), F.lit(False)))


def split_stratified(rows: DataFrame, by: str, order: Column, share: float = 0.5) -> DataFrame:
    """``is_val`` for the first ``share`` of each class in a numeric order without ties; a null order is never first.

    The value at which the share of a class ends is found first, from the order and the class alone; then each row is compared with
    its class's value in one pass, and none is moved.
    """
    ends = cuts(rows, order, lambda n: F.floor(n * F.lit(share)), [by])
    names, same = keyed(ends, [by])
    joined = rows.join(F.broadcast(ends.select(*names, "cut")), same, "left")  # a row for each class
    return joined.withColumn("is_val", F.coalesce(order <= F.col("cut"), F.lit(False))).drop("cut", f"_by_{by}")


def class_quotas(classes: DataFrame, batch: int, rebalance: bool = False) -> DataFrame:
    """Rows of a batch for each class ``(class, group_label)``, in order of class: equal shares, the first ones take the rest.

    With ``rebalance`` each group has an equal share, which its classes split, rounded down; what is missing goes to the first.
    One row for each class.
    """
    everything = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everything)
    place = F.row_number().over(everything.orderBy("class")) - 1
    if not rebalance:
        return classes.withColumn("quota", F.floor(F.lit(batch) / n) + (place < F.lit(batch) % n).cast("long"))
    groups = classes.select("group_label").distinct().agg(F.count("*").alias("_groups"))
    out = classes.crossJoin(F.broadcast(groups)).withColumn("_each", F.floor(F.floor(F.lit(batch) / F.col("_groups")) / F.count("*").over(Window.partitionBy("group_label"))))
    missing = F.lit(batch) - F.sum("_each").over(everything)
    return out.withColumn("quota", F.col("_each") + F.floor(missing / n) + (place < F.pmod(missing, n)).cast("long")).drop("_groups", "_each")


def sample_per_class(rows: DataFrame, n: int, by: list[str], order: Column) -> DataFrame:
    """The first ``n`` rows of each class in the order of a hash. ``rank`` filters are pushed into the sort, so tasks keep ``n`` rows of a class."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def mix_in(rows: DataFrame, others: DataFrame, quota: int, order: str) -> DataFrame:
    """``rows`` and the first ``quota`` of ``others``, in order, with ``is_mixed``."""
    return rows.withColumn("is_mixed", F.lit(False)).unionByName(others.orderBy(order).limit(quota).withColumn("is_mixed", F.lit(True)))


def corner_histograms(rows: DataFrame, column: str, label: str, bins: int = 19, share: float = 0.001) -> DataFrame:
    """Per dimension and label, densities between the ``share`` and ``1 - share`` quantiles; values outside are dropped."""
    flat = rows.select(label, F.posexplode(column).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    spans = quantiles(flat, "x", {"_low": share, "_high": 1 - share}, ["dim"])
    width = (F.col("_high") - F.col("_low")) / bins
    inside = flat.join(F.broadcast(spans), "dim").where((F.col("x") >= F.col("_low")) & (F.col("x") <= F.col("_high")) & (F.col("_high") > F.col("_low")))
    at = F.least(F.floor((F.col("x") - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy("dim", label, at.alias("bin"), width.alias("_w")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("dim", label))
    return counts.withColumn("density", F.col("n") / total / F.col("_w")).drop("_w")


def paired_density(a: DataFrame, b: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Per dimension, densities of two sets over the range of both. ``side`` is ``a`` or ``b``."""
    flat = lambda df, side: df.select(F.posexplode(column).alias("dim", "x")).select(F.lit(side).alias("side"), "dim", F.col("x").cast("double").alias("x"))
    both = flat(a, "a").unionByName(flat(b, "b"))
    spans = both.groupBy("dim").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.least(F.floor((F.col("x") - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = both.join(F.broadcast(spans), "dim").where("_high > _low").groupBy("side", "dim", at.alias("bin"), width.alias("_w")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("side", "dim"))
    return counts.withColumn("density", F.col("n") / total / F.col("_w")).drop("_w")


def compare_embeddings(a: DataFrame, b: DataFrame, column: str, order: Column | None = None) -> DataFrame:
    """Per common dimension, the means and deviations of two sets, their differences, and whether those are small.

    With a numeric ``order`` without ties, both sets are cut to as many of their first rows as the smaller one has.
    """
    if order is not None:
        n = min(a.count(), b.count())
        a, b = first_rows(a, order, n), first_rows(b, order, n)
    left = fit_standardizer(a, column).select("dim", F.col("mean").alias("mean_a"), F.col("std").alias("std_a"))
    right = fit_standardizer(b, column).select("dim", F.col("mean").alias("mean_b"), F.col("std").alias("std_b"))
    out = left.join(right, "dim")
    for name in ("mean", "std"):
        x, y = F.col(f"{name}_a"), F.col(f"{name}_b")
        out = out.withColumn(f"{name}_diff", F.abs(x - y)).withColumn(f"{name}_rel", F.abs(x - y) / (F.abs(y) + 1e-10))
        out = out.withColumn(f"{name}_close", F.abs(x - y) <= 0.01 + 0.1 * F.abs(y))
    return out


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: ranges of the differences, correlations of the vectors of means and of deviations, and whether all are close."""
    stats = [f(f"{name}_diff").alias(f"{name}_{label}") for name in ("mean", "std") for label, f in (("least", F.min), ("most", F.max), ("avg", F.avg), ("sd", F.stddev_pop))]
    both = [F.corr(f"{name}_a", f"{name}_b").alias(f"{name}_corr") for name in ("mean", "std")]
    return compared.agg(*stats, *both, F.bool_and(F.col("mean_close") & F.col("std_close")).alias("all_close"))


def with_label_dim(rows: DataFrame, dim: DataFrame, by: str, background: list) -> DataFrame:
    """Rows with their group's label and name, and ``is_signal``: the class isn't background. The dimension is a row for each class."""
    return rows.join(F.broadcast(dim), by, "left").withColumn("is_signal", ~F.col(by).isin(*background))
