"""Sources and sinks of strain, triggers, scores, outliers and thresholds. Data are Parquet tables or JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIGGER = ("time", "frequency", "tstart", "tend", "fstart", "fend", "snr", "q", "amplitude", "phase")
DATA_NAMES, LABEL_NAMES = ("data", "X", "inputs", "waves", "pulses", "processed"), ("labels", "y", "targets", "class", "classes")
OUTLIER = ("t0", "length", "shift", "start", "end", "duration", "min_score")


def rechunk(strain: DataFrame, samples: str, size: int = 135_168) -> DataFrame:
    """Samples as 32-bit floats in chunks of ``size``; the last one may be shorter. An empty or null array has no chunk."""
    n = F.ceil(F.size(samples) / size).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = strain.withColumn(samples, F.col(samples).cast("array<float>")).withColumn("chunk_id", F.explode(ids))
    return out.withColumn(samples, F.slice(samples, F.col("chunk_id") * size + 1, F.lit(size)))


def merge_triggers(triggers: DataFrame, detectors: list[str]) -> DataFrame:
    """The triggers of all requested detectors; none at all if one of them has none."""
    own = triggers.where(F.col("ifo").isin(*detectors)).select("ifo", *TRIGGER)
    whole = own.agg((F.count_distinct("ifo") == len(set(detectors))).alias("_whole"))
    return own.crossJoin(F.broadcast(whole)).where("_whole").drop("_whole")


def merge_scores(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Score streams under each other with the name they come from; the order is that of (``file``, ``idx``)."""
    out = parts[0].withColumn("file", F.lit(names[0]))
    for part, name in zip(parts[1:], names[1:], strict=True):
        out = out.unionByName(part.withColumn("file", F.lit(name)))
    return out


def drop_warmup(scores: DataFrame, rate: float, psd_length: float, idx: str = "idx", t0: str | None = None) -> DataFrame:
    """Scores after the seconds that fill the spectrum, with their time ``t``."""
    t = F.col(idx) / rate + (F.col(t0) if t0 else 0)
    return scores.where(F.col(idx) >= int(rate * psd_length)).withColumn("t", t)


def pick_array_column(rows: DataFrame) -> tuple[str, Column]:
    """The name of the data column (a known name, else the first array) and the label column, -1 where there is none."""
    arrays = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    data = next((n for n in DATA_NAMES if n in arrays), arrays[0] if arrays else None)
    if data is None:
        raise ValueError("no column is an array")
    label = next((n for n in LABEL_NAMES if n in rows.columns), None)
    return data, (F.col(label) if label else F.lit(-1)).alias("label")


def flatten_injections(groups: DataFrame) -> DataFrame:
    """Groups ``(name, type, params array<struct>)`` to a row for each injection; the name stands in for a missing type."""
    return groups.select(F.col("name").alias("signal_name"), F.coalesce("type", "name").alias("signal_type"), F.inline("params"))


def read_thresholds(spark: SparkSession, text: str) -> DataFrame:
    """``{metric: {min, max, description}}`` as rows; a null bound is no cut."""
    row = spark.range(1).select(F.from_json(F.lit(text), "map<string, struct<min: double, max: double, description: string>>").alias("m"))
    return row.select(F.explode("m").alias("metric", "b")).select("metric", "b.min", "b.max", "b.description")


def thresholds(rows: DataFrame) -> dict[str, dict]:
    """The rows of ``read_thresholds``, one for each metric, as the vetoes take them."""
    return {r["metric"]: {"min": r["min"], "max": r["max"]} for r in rows.collect()}


def write_batch(rows: DataFrame, path: str, batch: str, by: list[str] | None = None) -> None:
    """Writes a batch of a table: the folder ``batch=...`` of it, with one folder for each value of ``by``.

    The batch's folder is replaced as a whole and no other is touched, so a job that is repeated, also with other rows or after it was cut off,
    leaves the table as one run would. Readers of the table get ``batch`` as a column.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch's name has letters, digits, dots, - and _")
    rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/batch={batch}")


def write_stream(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None):
    """Writes what is there of a stream, a batch for each micro-batch by its number: one that is run again replaces what its first run left."""
    added = lambda rows, number: write_batch(rows, path, f"{number:012d}", by)
    return stream.writeStream.foreachBatch(added).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_by_class(samples: DataFrame, path: str, batch: str, by: str = "class") -> None:
    """Adds a batch of samples to a table of one folder for each class."""
    write_batch(samples, path, batch, [by])


def write_scores(scores: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of scores with their keys as columns, a folder for each shift."""
    write_batch(scores.repartition("shift", "seg_start").sortWithinPartitions("shift", "seg_start", "idx"), path, batch, ["shift"])


def write_outliers(outliers: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of the catalogue's seven columns."""
    write_batch(outliers.select(*OUTLIER), path, batch)


def write_results_csv(results: DataFrame, path: str, lists: str = "failed_cuts") -> None:
    """Writes veto results as CSV, the list column joined by ``;``."""
    results.withColumn(lists, F.concat_ws(";", lists)).write.mode("overwrite").csv(path, header=True)


def read_results_csv(spark: SparkSession, path: str, schema: str, lists: str = "failed_cuts") -> DataFrame:
    """Reads them back; an empty text is an empty list."""
    rows = spark.read.csv(path, header=True, schema=schema)
    whole = F.split(lists, ";")
    return rows.withColumn(lists, F.when(F.coalesce(F.col(lists), F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole))
