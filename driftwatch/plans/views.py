"""The test tables seen as score streams, segments, detector windows, injections and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.operators.intervals import merge_hours
from driftwatch.session import table

#: Common table expressions in SQL by name.
SQL_TABLES = {
    "scores": """scores AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch_us(ts) / 1e6 AS t, value AS score, event_type, event_id FROM events)""",
    "segments": """hours AS (SELECT DISTINCT event_type AS ifo, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS hour FROM events),
segments AS (SELECT ifo, min(hour) * 3600 AS start, (max(hour) + 1) * 3600 AS stop FROM
  (SELECT ifo, hour, hour - row_number() OVER (PARTITION BY ifo ORDER BY hour) AS run FROM hours) GROUP BY ifo, run)""",
    "pairs": """pairs AS (SELECT a.vec_id, a.label, a.embedding AS h, b.embedding AS l FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "injections": """injections AS (SELECT event_id AS injection_id, epoch_us(ts) / 1e6 AS time, value AS amplitude, user_id % 4 AS signal,
  event_id AS inj_order, concat('user', user_id % 7) AS inj_type FROM events WHERE event_type = 'purchase')""",
    "triggers": """triggers AS (SELECT event_id, epoch_us(ts) / 1e6 AS time, value AS snr FROM events WHERE event_type = 'error')""",
    "files": """files AS (SELECT concat('/data/', event_type, '/sequence_', day, '-86400_', n % 5, '.h5') AS path, event_type AS ifo, day, n
  FROM (SELECT event_type, CAST(floor(epoch_us(ts) / 8.64e10) AS BIGINT) * 86400 AS day, count(*) AS n FROM events GROUP BY ALL))""",
    "classes": """classes AS (SELECT l_returnflag AS class, CAST(l_quantity AS DOUBLE) AS snr, CAST(l_extendedprice AS DOUBLE) AS hrss,
  CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS score, l_orderkey, l_linenumber, l_linestatus FROM lineitem)""",
    "flat": """flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)""",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t``, their time without zone as seconds since 1970."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").withColumn("t", micros / F.lit(1e6))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score stream of each user, in order of time."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("stream"), "t", F.col("value").alias("score"), "event_type", "event_id")
    place = F.row_number().over(Window.partitionBy("stream").orderBy("t", "event_id"))
    return rows.withColumn("idx", (place - 1).cast("long"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with an event, for each event type as a detector."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("ifo"), F.floor(F.col("t") / 3600).cast("long").alias("hour"))
    return merge_hours(rows, "ifo")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two detectors: a vector and the one with the next id."""
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("l"))
    return rows.select("vec_id", "label", F.col("embedding").alias("h")).join(other, "vec_id")


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as injections."""
    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    return rows.select(
        F.col("event_id").alias("injection_id"), F.col("t").alias("time"), F.col("value").alias("amplitude"), (F.col("user_id") % 4).alias("signal"),
        F.col("event_id").alias("inj_order"), F.concat(F.lit("user"), F.col("user_id") % 7).alias("inj_type"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as triggers."""
    return events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.col("t").alias("time"), F.col("value").alias("snr"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each day and event type."""
    day = (F.floor(F.col("t") / 86_400) * 86_400).cast("long").alias("day")
    rows = events(spark, sf_dir).groupBy(F.col("event_type").alias("ifo"), day).agg(F.count("*").alias("n"))
    path = F.concat(F.lit("/data/"), "ifo", F.lit("/sequence_"), "day", F.lit("-86400_"), F.col("n") % 5, F.lit(".h5"))
    return rows.withColumn("path", path)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled rows: class, strength and score."""
    rows = table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return rows.select(F.col("l_returnflag").alias("class"), q.alias("snr"), p.alias("hrss"), (p / q).alias("score"), "l_orderkey", "l_linenumber", "l_linestatus")
