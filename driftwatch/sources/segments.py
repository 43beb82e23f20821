"""Segment lists and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators.intervals import range_join

NAME = r"segments\.(.+)\.([a-z]\d)$"
SPAN, SHIFT = r"(\d{10}(?:\.\d+)?)-(\d+(?:\.\d+)?)", r"-\d+(?:\.\d+)?_(\d+(?:\.\d+)?)"


def parse_segments(lines: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """Lines ``START END``, as integers or as numbers with a fraction, to ``(seg_type, ifo, start, stop)``; other lines are left out."""
    parts = F.split(F.btrim(F.col(text)), r"\s+")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double").cast("bigint")
    return lines.select(
        F.regexp_extract(path, NAME, 1).alias("seg_type"), F.regexp_extract(path, NAME, 2).alias("ifo"), number(1).alias("start"), number(2).alias("stop")
    ).where("start is not null and stop is not null")


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segment lists of any text files that are named ``segments.<type>.<ifo>``, in order of start."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_segments(lines).orderBy("seg_type", "ifo", "start")


def parse_file_keys(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """``t0``, ``length`` and ``shift`` (null if none) from file names, and the files whose name doesn't tell."""
    name = F.element_at(F.split(path, "/"), -1)
    value = lambda pattern, i: F.regexp_extract(name, pattern, i).try_cast("double")
    keyed = files.withColumn("t0", value(SPAN, 1)).withColumn("length", value(SPAN, 2)).withColumn("shift", value(SHIFT, 1))
    return keyed.where("t0 is not null"), keyed.where("t0 is null").drop("t0", "length", "shift")


def files_overlapping(files: DataFrame, requests: DataFrame, width: float = 86_400) -> DataFrame:
    """For each request ``(request_id, ifo, start, stop)`` the files of its detector whose half-open span overlaps it."""
    spans = files.withColumn("f_start", F.col("t0")).withColumn("f_stop", F.col("t0") + F.col("length"))
    return range_join(requests, spans.select("path", "ifo", "f_start", "f_stop"), width, ("start", "stop"), ("f_start", "f_stop"), ["ifo"]).orderBy("request_id", "path")
