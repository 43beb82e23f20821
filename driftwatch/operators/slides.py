"""Planning of time slides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifts_required(wanted: float, livetime: float, step: float) -> int:
    """The least number of shifts, each ``step`` seconds more, that give ``wanted`` seconds of background; 1 (no shift) for none.

    Raises ValueError where the livetime can't give as much.
    """
    if wanted == 0:
        return 1
    half = step / 2 - livetime
    inside = half * half - 2 * step * wanted
    if inside < 0:
        raise ValueError(f"{livetime} s of livetime can't give {wanted} s of background in steps of {step} s")
    return math.ceil((livetime - step / 2 - math.sqrt(inside)) / step)


def shifts_column(wanted: Column, livetime: Column, step: float) -> Column:
    """The same as a column; null where the livetime doesn't suffice."""
    half = F.lit(step / 2) - livetime
    inside = half * half - 2 * step * wanted
    n = F.ceil((livetime - F.lit(step / 2) - F.sqrt(inside)) / F.lit(float(step)))
    return F.when(wanted == 0, F.lit(1)).when(inside >= 0, n).cast("long")


def plan_slides(files: DataFrame, n_shifts: int, unit: list[float], still: bool = False) -> DataFrame:
    """Each file with each of ``n_shifts`` shift vectors ``unit * (k + 1)``, all zero where ``still``.

    ``slide_id`` is a stable 32-bit number of start, stop and k. Files no longer than their largest shift are left out.
    """
    spark = files.sparkSession
    shifts = F.array(*[(F.lit(float(u)) * (F.col("k") + 1) if not still else F.lit(0.0)) for u in unit])
    planned = files.crossJoin(F.broadcast(spark.range(n_shifts).withColumnRenamed("id", "k"))).withColumn("shifts", shifts)
    label = F.concat(F.col("start").cast("string"), F.col("stop").cast("string"), F.col("k").cast("string"))
    planned = planned.withColumn("slide_id", F.crc32(label.cast("binary")))
    return planned.where(F.array_max("shifts") < F.col("stop") - F.col("start"))


def slide_livetime(planned: DataFrame) -> DataFrame:
    """Usable seconds of each slide number over all files, and over all slides in the row of null ``k``."""
    usable = F.greatest(F.lit(0.0), F.col("stop") - F.col("start") - F.array_max("shifts"))
    return planned.rollup("k").agg(F.sum(usable).alias("seconds"), F.count("*").alias("n"))


def chunk_plan(streams: DataFrame, kernel: int, stride: int) -> DataFrame:
    """The chunks of each ``(stream, size, shift)`` in samples: the last one is filled up by ``pad`` samples.

    ``n_scores`` are the chunk's scores that don't come from filling.
    """
    left = F.col("size") - F.col("shift")
    n = F.ceil(left / kernel).cast("long")
    rows = streams.where(left > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    pad = F.greatest(F.lit(0).cast("long"), (F.col("chunk") + 1) * kernel - left)
    return rows.withColumn("first", F.col("shift") + F.col("chunk") * kernel).withColumn("pad", pad).withColumn(
        "n_scores", (F.lit(kernel // stride) - F.floor(F.col("pad") / stride)).cast("long")
    )


def balance_files(files: DataFrame, nodes: int, name: str = "path") -> DataFrame:
    """Files split over ``nodes`` in order of name; the first nodes get one more where it doesn't come out even.

    Rows are one for each file, not for each sample, so one task can number them.
    """
    return files.withColumn("node", F.ntile(nodes).over(Window.orderBy(name)))
