"""Queries over score streams: smoothing, vetoes, thresholds, outliers, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.grids import histogram
from driftwatch.operators import scores as S
from driftwatch.operators import significance as G
from driftwatch.plans import views as V
from driftwatch.plans.registry import query, with_tables
from driftwatch.session import fresh_path
from driftwatch.sources import tables

GAP, PAD = 21_600, 1_800
#: Rows of a stream that one task smooths.
CHUNK = 1 << 16
SMOOTH = """+smooth AS (SELECT *, sum(score) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS smooth FROM scores)"""
CLUSTERS = f"""+cut AS (SELECT quantile_cont(score, 0.1) AS threshold FROM scores),
sized AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM scores),
low AS (SELECT stream, t, score FROM sized, cut WHERE n > 40 AND score < threshold),
steps AS (SELECT *, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS step FROM low),
runs AS (SELECT *, sum(CASE WHEN step IS NULL OR step > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM steps)"""


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(with_tables("scores", SMOOTH + "\nSELECT stream, idx, round(smooth, 6) AS smooth FROM smooth"))
def tophat_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return S.tophat_smooth(V.scores(spark, d), 4, ["stream"], chunk=CHUNK).select("stream", "idx", _r("smooth"))


@query(with_tables("scores", """+f AS (SELECT *, sum(score) OVER w / 5 AS smooth, count(*) OVER w AS n FROM scores WINDOW w AS (PARTITION BY stream ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT stream, idx, round(smooth, 6) AS smooth FROM f WHERE n = 5"""))
def valid_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return S.valid_smooth(V.scores(spark, d), 5, ["stream"], chunk=CHUNK).select("stream", "idx", _r("smooth"))


@query(with_tables("scores", SMOOTH + """,
flagged AS (SELECT s.*, smooth < (SELECT quantile_cont(smooth, 0.3) FROM smooth) AS low FROM smooth s),
runs AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idx) - row_number() OVER (PARTITION BY stream, low ORDER BY idx) AS run FROM flagged),
sized AS (SELECT *, count(*) OVER (PARTITION BY stream, low, run) AS n FROM runs)
SELECT stream, idx, round(smooth, 6) AS smooth FROM sized WHERE NOT (low AND n > 3)"""))
def long_run_veto(spark: SparkSession, d: str) -> DataFrame:
    smooth = S.tophat_smooth(V.scores(spark, d), 4, ["stream"])
    return S.veto_long_runs(smooth, 0.3, 3, ["stream"]).select("stream", "idx", _r("smooth"))


@query("SELECT round(quantile_cont(value, 0.01), 6) AS threshold FROM events")
def quantile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return S.threshold(V.scores(spark, d), 0.01).select(_r("threshold"))


@query("SELECT value AS threshold FROM events ORDER BY value LIMIT 1 OFFSET 25")
def kth_threshold(spark: SparkSession, d: str) -> DataFrame:
    return S.threshold(V.scores(spark, d), 25)


@query("SELECT event_type, round(quantile_cont(value, 1 - 3.154e6 / 3.154e7), 6) AS threshold, min(value) AS lowest, max(value) AS highest, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def far_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d).where("event_type = 'click'")
    n = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(S.threshold_from_far(rows, 3.154e6)).select("event_type", _r("threshold"), "lowest", "highest", "n")


@query(with_tables("scores", CLUSTERS + "\nSELECT stream, round(t, 6) AS t, score FROM low"))
def outliers(spark: SparkSession, d: str) -> DataFrame:
    return _outliers(spark, d).select("stream", _r("t"), "score")


def _outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    return S.select_outliers(rows, S.threshold(rows, 0.1), ["stream"], 40)


@query(with_tables("scores", CLUSTERS + f"""
SELECT stream, round(min(t) - {PAD}, 6) AS start, round(max(t) + {PAD}, 6) AS "end", round(max(t) - min(t) + {2 * PAD}, 6) AS duration, round(min(score), 2) AS min_score, count(*) AS n
FROM runs GROUP BY stream, run"""))
def outlier_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = S.cluster_outliers(_outliers(spark, d), GAP, ["stream"], PAD)
    return out.select("stream", _r("start"), _r("end"), _r("duration"), "min_score", "n")


@query(with_tables("scores", CLUSTERS + f"""
SELECT stream AS t0, CAST(0 AS INTEGER) AS shift, round(min(t) - {PAD}, 6) AS start, round(min(score), 2) AS min_score FROM runs GROUP BY stream, run"""))
def outlier_catalogue(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "catalogue")
    found = S.cluster_outliers(_outliers(spark, d), GAP, ["stream"], PAD).withColumnRenamed("stream", "t0")
    tables.write_outliers(found.withColumn("length", F.lit(0)).withColumn("shift", F.lit(0)), path, "all")
    return spark.read.parquet(path).select("t0", "shift", _r("start"), "min_score")


@query(with_tables("scores", CLUSTERS + f""",
clusters AS (SELECT stream, count(*) AS n_rows, max(t) - min(t) + {2 * PAD} AS duration, min(score) AS min_score FROM runs GROUP BY stream, run),
worst AS (SELECT stream, count(*) AS n_outliers FROM low GROUP BY stream ORDER BY 2 DESC, 1 LIMIT 10)
SELECT w.stream, w.n_outliers, count(*) AS n_clusters, round(sum(c.duration), 3) AS seconds, round(min(c.min_score), 2) AS min_score
FROM worst w JOIN clusters c USING (stream) GROUP BY w.stream, w.n_outliers"""))
def worst_streams(spark: SparkSession, d: str) -> DataFrame:
    low = _outliers(spark, d)
    worst = S.worst_segments(low, 10, "stream")
    clusters = S.cluster_outliers(low, GAP, ["stream"], PAD)
    return (
        clusters.join(F.broadcast(worst), "stream")
        .groupBy("stream", "n_outliers")
        .agg(F.count("*").alias("n_clusters"), F.round(F.sum("duration"), 3).alias("seconds"), F.round(F.min("min_score"), 2).alias("min_score"))
    )


@query(with_tables("scores", """+cut AS (SELECT quantile_cont(score, 0.1) AS c FROM scores),
low AS (SELECT event_type, CAST(floor(t / 21600) AS BIGINT) AS bin, count(*) AS n FROM scores, cut WHERE score < c GROUP BY ALL),
spans AS (SELECT event_type, CAST(floor(min(t) / 21600) AS BIGINT) AS a, CAST(floor(max(t) / 21600) AS BIGINT) AS b FROM scores GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(a, b)) AS bin FROM spans)
SELECT g.event_type, g.bin, coalesce(l.n, 0) AS n FROM grid g LEFT JOIN low l USING (event_type, bin)"""))
def outlier_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    low = rows.crossJoin(F.broadcast(S.threshold(rows, 0.1))).where("score < threshold")
    spans = rows.groupBy("event_type").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return S.outlier_rate(low, spans, 21_600, ["event_type"])


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin FROM events, e),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT bin, n, round(n / (SELECT sum(n) FROM c) / ((SELECT hi - lo FROM e) / 50), 9) AS density FROM c""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(V.scores(spark, d), "score", 50, density=True).select("bin", "n", _r("density", 9))


@query("""SELECT event_type, count(*) AS n, min(value) AS lowest, max(value) AS highest, round(quantile_cont(value, 0.05), 6) AS cut FROM events GROUP BY 1""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.score_summary(V.scores(spark, d), ["event_type"], 0.05).select("event_type", "n", "lowest", "highest", _r("cut"))


@query("""SELECT event_type, count(*) FILTER (value < 400) AS n_kept, count(*) FILTER (value >= 400) AS n_dropped FROM events GROUP BY 1""")
def dropped_scores(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("inf"))
    rows = V.scores(spark, d).withColumn("score", F.when(F.col("score") < 400, F.col("score")).otherwise(bad))
    return S.dropped_rows(rows, "event_type", "score")


@query("SELECT event_id, value AS score FROM events WHERE value < 400")
def finite_scores(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("-inf"))
    rows = V.scores(spark, d).withColumn("score", F.when(F.col("score") < 400, F.col("score")).otherwise(bad))
    return S.finite_rows(rows, ["score"]).select("event_id", "score")


FAR = """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS threshold FROM e, (SELECT unnest(generate_series(0, 99)) AS i))
SELECT round(threshold, 6) AS threshold, round((SELECT count(*) FROM events WHERE value {op} threshold) / 86400.0, 9) AS far FROM g"""


@query(FAR.format(op="<="))
def far_table_low(spark: SparkSession, d: str) -> DataFrame:
    return G.far_table(V.scores(spark, d), 100, 86_400, "low").select(_r("threshold"), _r("far", 9))


@query(FAR.format(op=">="))
def far_table_high(spark: SparkSession, d: str) -> DataFrame:
    return G.far_table(V.scores(spark, d), 100, 86_400, "high").select(_r("threshold"), _r("far", 9))


@query("SELECT round(count(*) FILTER (value <= 50) / 86400.0, 9) AS far, count(*) AS n FROM events")
def score_to_far(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    return G.score_to_far(rows, 50, 86_400, "low").crossJoin(rows.agg(F.count("*").alias("n"))).select(_r("far", 9), "n")


IFAR = """WITH c AS (SELECT value AS score, CAST(sum(count(*)) OVER (ORDER BY value) AS BIGINT) AS "count" FROM events GROUP BY value)"""


@query(IFAR + ' SELECT score, "count", round(86400 / ("count" * 31536000.0), 12) AS ifar_years FROM c')
def ifar_curve(spark: SparkSession, d: str) -> DataFrame:
    return G.ifar_curve(V.scores(spark, d), 86_400, "low").select("score", "count", _r("ifar_years", 12))


@query(IFAR + """, levels AS (SELECT DISTINCT k * 10 ** e AS level FROM (SELECT unnest(generate_series(1, 10)) AS k), (SELECT unnest(generate_series(0, 8)) AS e)),
picked AS (SELECT min("count") AS c FROM c, levels WHERE "count" >= level GROUP BY level UNION SELECT min("count") FROM c UNION SELECT max("count") FROM c)
SELECT score, "count" FROM c WHERE "count" IN (SELECT c FROM picked)""")
def thinned_ifar_curve(spark: SparkSession, d: str) -> DataFrame:
    return G.thin_log_levels(G.ifar_curve(V.scores(spark, d), 86_400, "low"), 50).select("score", "count")


@query("""WITH top AS (SELECT log10(count(*) * 1.2::DOUBLE) AS a FROM events),
grid AS (SELECT i, 10 ** (a + (-3 - a) * i / 999.0::DOUBLE) AS m FROM top, (SELECT unnest(range(1000)) AS i)),
terms AS (SELECT i, m, unnest(range(greatest(0, floor(m - 9 * sqrt(m) - 10))::BIGINT, ceil(m + 9 * sqrt(m) + 20)::BIGINT)) AS k FROM grid),
sums AS (SELECT i, m, k, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY i ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM terms),
found AS (SELECT m, """ + ", ".join(f"min(k) FILTER (cdf >= {share!r}::DOUBLE) {half} AS {name}" for band, n in zip(G.BANDS, "123", strict=True) for share, half, name in (((1 - band) / 2, "- 0.5::DOUBLE", "low" + n), ((1 + band) / 2, "+ 0.5::DOUBLE", "high" + n))) + """ FROM sums GROUP BY i, m)
SELECT round(m, 9) AS expected, greatest(low1, 0) AS low1, high1, greatest(low2, 0) AS low2, high2, greatest(low3, 0) AS low3, high3 FROM found""")
def poisson_bands(spark: SparkSession, d: str) -> DataFrame:
    out = G.poisson_bands(G.ifar_curve(V.scores(spark, d), 86_400, "low"))
    return out.withColumn("expected", F.round("expected", 9))


@query(with_tables("scores", "SELECT stream, idx, idx / 4 + stream AS t, score FROM scores WHERE idx >= 16"))
def warmed_up_scores(spark: SparkSession, d: str) -> DataFrame:
    return tables.drop_warmup(V.scores(spark, d).drop("t"), 4, 4, t0="stream").select("stream", "idx", "t", "score")


@query(with_tables("scores", "SELECT concat('part', stream % 3) AS file, stream, idx, score FROM scores"))
def merged_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d).select("stream", "idx", "score")
    return tables.merge_scores([rows.where(F.col("stream") % 3 == i) for i in range(3)], [f"part{i}" for i in range(3)])
