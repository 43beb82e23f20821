"""Queries over segments, injections, triggers, slides and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators import efficiency as E
from driftwatch.operators import intervals as I
from driftwatch.operators import slides as L
from driftwatch.operators import windows as W
from driftwatch.plans import views as V
from driftwatch.plans.registry import query, with_tables
from driftwatch.session import fresh_path, table
from driftwatch.sources import segments as G
from driftwatch.sources import spanned
from driftwatch.sources import tables

DETECTORS = ["click", "purchase", "error"]


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(with_tables("segments", "SELECT 'hours' AS seg_type, concat(substr(ifo, 1, 1), '1') AS ifo, start, stop FROM segments"))
def parsed_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = V.segments(spark, d)
    whole = F.concat_ws("  ", F.col("start").cast("string"), F.concat(F.col("stop").cast("string"), F.lit(".000000")))
    path = F.concat(F.lit("file:/lists/segments.hours."), F.substring("ifo", 1, 1), F.lit("1"))
    return G.parse_segments(rows.select(whole.alias("value"), path.alias("path")))


@query(with_tables("segments", """SELECT greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM segments a, segments b
WHERE a.ifo = 'purchase' AND b.ifo = 'error' AND greatest(a.start, b.start) < least(a.stop, b.stop)"""))
def intersected_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = V.segments(spark, d)
    return I.intersect_segments(rows.where("ifo = 'purchase'"), rows.where("ifo = 'error'"))


ALL = """+ab AS (SELECT greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM segments a, segments b
  WHERE a.ifo = 'click' AND b.ifo = 'purchase' AND greatest(a.start, b.start) < least(a.stop, b.stop)),
abc AS (SELECT greatest(ab.start, c.start) AS start, least(ab.stop, c.stop) AS stop FROM ab, segments c
  WHERE c.ifo = 'error' AND greatest(ab.start, c.start) < least(ab.stop, c.stop))"""


@query(with_tables("segments", ALL + "\nSELECT start, stop FROM abc"))
def coincident_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.intersect_all(V.segments(spark, d), DETECTORS)


@query(with_tables("segments", ALL + "\nSELECT count(*) AS n, CAST(coalesce(sum(stop - start), 0) AS BIGINT) AS seconds FROM abc"))
def coincident_livetime(spark: SparkSession, d: str) -> DataFrame:
    return I.livetime(I.intersect_all(V.segments(spark, d), DETECTORS))


@query(with_tables("segments", "SELECT ifo, start, stop FROM segments WHERE stop - start > 7200"))
def long_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.min_duration(V.segments(spark, d), 7_200)


@query(with_tables("injections triggers", """SELECT i.injection_id, round(i.time, 6) AS time,
EXISTS (SELECT 1 FROM triggers t WHERE abs(t.time - i.time) <= 600) AS recovered FROM injections i"""))
def recovered_injections(spark: SparkSession, d: str) -> DataFrame:
    return I.match_triggers(V.injections(spark, d), V.triggers(spark, d), 600).select("injection_id", _r("time"), "recovered")


WINDOWS = "+windows AS (SELECT event_id AS window_id, epoch_us(ts) / 1e6 AS gps FROM events WHERE event_type <> 'purchase')"


@query(with_tables("injections", WINDOWS + """,
hits AS (SELECT w.window_id, arg_max(i.inj_type, i.inj_order) AS inj_type FROM windows w JOIN injections i ON w.gps < i.time + 120 AND w.gps + 60 > i.time - 120 GROUP BY 1)
SELECT w.window_id, h.inj_type, h.window_id IS NOT NULL AS has_injection FROM windows w LEFT JOIN hits h USING (window_id)"""))
def labelled_windows(spark: SparkSession, d: str) -> DataFrame:
    out = I.label_windows(_windows(spark, d), V.injections(spark, d), 60, 120)
    return out.select("window_id", "inj_type", "has_injection")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return V.events(spark, d).where("event_type <> 'purchase'").select(F.col("event_id").alias("window_id"), F.col("t").alias("gps"))


@query(with_tables("injections", WINDOWS + """
SELECT count(DISTINCT i.inj_order) AS n_touched FROM injections i JOIN windows w ON w.gps < i.time + 120 AND w.gps + 60 > i.time - 120"""))
def touched_injections(spark: SparkSession, d: str) -> DataFrame:
    return I.touched_injections(_windows(spark, d), V.injections(spark, d), 60, 120)


SPANS = WINDOWS + ", marks AS (SELECT time - snr AS tstart, time + snr AS tend FROM triggers)"


def _split(spark: SparkSession, d: str, clean: bool) -> DataFrame:
    spans = _windows(spark, d).select("window_id", F.col("gps").alias("start"), (F.col("gps") + 60).alias("stop"))
    marks = V.triggers(spark, d).select((F.col("time") - F.col("snr")).alias("tstart"), (F.col("time") + F.col("snr")).alias("tend"))
    return I.split_by_triggers(spans, marks, clean, 600).select("window_id")


@query(with_tables("triggers", SPANS + " SELECT window_id FROM windows WHERE NOT EXISTS (SELECT 1 FROM marks WHERE tstart < gps + 60 AND tend > gps)"))
def clean_windows(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, True)


@query(with_tables("triggers", SPANS + " SELECT window_id FROM windows WHERE EXISTS (SELECT 1 FROM marks WHERE tstart < gps + 60 AND tend > gps)"))
def glitch_windows(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, False)


@query(with_tables("scores", """+shifts AS (SELECT unnest([1, 2, 5]) AS shift)
SELECT a.stream AS segment, s.shift::INTEGER AS shift, a.idx AS idx_a, b.idx AS idx_b, round(a.score + b.score, 6) AS total
FROM scores a CROSS JOIN shifts s JOIN scores b ON b.stream = a.stream AND b.idx = a.idx + s.shift * 4"""))
def slid_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d).select(F.col("stream").alias("segment"), "idx", F.col("score").alias("value"))
    shifts = spark.createDataFrame([(1,), (2,), (5,)], "shift int")
    out = I.slide_pairs(rows, rows, shifts, 4)
    return out.select("segment", "shift", "idx_a", "idx_b", F.round(F.col("value_a") + F.col("value_b"), 6).alias("total"))


@query("""WITH chunks AS (SELECT label AS t0, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c, embedding FROM embeddings),
series AS (SELECT t0, flatten(list(embedding ORDER BY c)) AS x, count(*) AS n FROM chunks GROUP BY t0),
wanted AS (SELECT t0, n, 16 * (1 + t0 % 2) AS delay, x FROM series)
SELECT t0 AS outlier_id, 'H1' AS ifo, 160::INTEGER AS n, round(list_sum(list_transform(x[(100 + delay - 20 + 1):(100 + delay - 20 + 160)], lambda v: v::DOUBLE)), 4) AS total FROM wanted""")
def fetched_strain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    strain = table(spark, d, "embeddings").select(F.col("label").alias("t0"), F.lit("H1").alias("ifo"), place.alias("chunk_id"), F.col("embedding").alias("samples"))
    asked = strain.select("t0", "ifo").distinct().select(
        F.col("t0").alias("outlier_id"), "t0", "ifo", (F.col("t0") + 100.0).alias("start"), (16.0 * (1 + F.col("t0") % 2)).alias("delay")
    )
    got = I.fetch_chunks(asked, strain, 20, 160, 1, 64)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("outlier_id", "ifo", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


@query(with_tables("files", "SELECT path, ifo, CAST(day AS DOUBLE) AS t0, 86400.0::DOUBLE AS length, CAST(n % 5 AS DOUBLE) AS shift FROM files"))
def file_keys(spark: SparkSession, d: str) -> DataFrame:
    return G.parse_file_keys(V.files(spark, d))[0].select("path", "ifo", "t0", "length", "shift")


@query(with_tables("files", "SELECT replace(path, 'sequence_', 'bad') AS path FROM files WHERE false UNION ALL SELECT concat(ifo, '/notes', n, '.txt') FROM files"))
def rejected_files(spark: SparkSession, d: str) -> DataFrame:
    rows = V.files(spark, d)
    odd = rows.withColumn("path", F.concat("ifo", F.lit("/notes"), F.col("n").cast("string"), F.lit(".txt")))
    return G.parse_file_keys(rows.unionByName(odd))[1].select("path")


@query(with_tables("files injections", """+requests AS (SELECT injection_id AS request_id, 'click' AS ifo, time - 4000 AS start, time + 4000 AS stop FROM injections)
SELECT r.request_id, f.path FROM requests r JOIN files f ON f.ifo = r.ifo AND f.day < r.stop AND f.day + 86400 > r.start"""))
def requested_files(spark: SparkSession, d: str) -> DataFrame:
    keyed = G.parse_file_keys(V.files(spark, d))[0]
    asked = V.injections(spark, d).select(
        F.col("injection_id").alias("request_id"), F.lit("click").alias("ifo"), (F.col("time") - 4000).alias("start"), (F.col("time") + 4000).alias("stop")
    )
    return G.files_overlapping(keyed, asked).select("request_id", "path")


@query(with_tables("segments", """+t AS (SELECT ifo, sum(stop - start)::DOUBLE AS live FROM segments GROUP BY ifo)
SELECT ifo, CAST(ceil((live - 0.5 - sqrt((0.5 - live) * (0.5 - live) - 2.0 * 31557600)) / 1.0) AS BIGINT) AS n_shifts FROM t"""))
def needed_shifts(spark: SparkSession, d: str) -> DataFrame:
    live = I.livetime(V.segments(spark, d), ["ifo"])
    return live.select("ifo", L.shifts_column(F.lit(31_557_600.0), F.col("seconds").cast("double"), 1.0).alias("n_shifts"))


PLAN = "+plan AS (SELECT ifo, start, stop, k, 900.0 * (k + 1) AS shift FROM segments, (SELECT unnest(generate_series(0, 9)) AS k) WHERE 900.0 * (k + 1) < stop - start)"


@query(with_tables("segments", PLAN + " SELECT ifo, start, stop, k, 0.0::DOUBLE AS shift_a, shift::DOUBLE AS shift_b FROM plan"))
def slide_plan(spark: SparkSession, d: str) -> DataFrame:
    out = L.plan_slides(V.segments(spark, d), 10, [0, 900])
    return out.select("ifo", "start", "stop", "k", F.col("shifts")[0].alias("shift_a"), F.col("shifts")[1].alias("shift_b"))


@query(with_tables("segments", PLAN + " SELECT k, sum(stop - start - shift)::DOUBLE AS seconds, count(*) AS n FROM plan GROUP BY ROLLUP (k)"))
def slide_livetimes(spark: SparkSession, d: str) -> DataFrame:
    return L.slide_livetime(L.plan_slides(V.segments(spark, d), 10, [0, 900]))


@query(with_tables("segments", """+s AS (SELECT ifo, start, (stop - start) * 4 AS size, 100 AS shift FROM segments),
c AS (SELECT *, unnest(generate_series(0, CAST(ceil((size - shift) / 4096.0) AS BIGINT) - 1)) AS chunk FROM s WHERE size > shift),
p AS (SELECT *, greatest(0, (chunk + 1) * 4096 - (size - shift)) AS pad FROM c)
SELECT ifo, start, chunk, shift + chunk * 4096 AS first, pad, CAST(4096 // 64 - pad // 64 AS BIGINT) AS n_scores FROM p"""))
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    streams = V.segments(spark, d).select("ifo", "start", ((F.col("stop") - F.col("start")) * 4).alias("size"), F.lit(100).cast("long").alias("shift"))
    return L.chunk_plan(streams, 4096, 64).select("ifo", "start", "chunk", "first", "pad", "n_scores")


@query(with_tables("files", "SELECT path, CAST(ntile(7) OVER (ORDER BY path) AS INTEGER) AS node FROM files"))
def balanced_files(spark: SparkSession, d: str) -> DataFrame:
    return L.balance_files(V.files(spark, d), 7).select("path", "node")


@query("""WITH s AS (SELECT vec_id, embedding, unnest([8, 24, 40]) AS start FROM embeddings)
SELECT vec_id, start::BIGINT AS start, 16::INTEGER AS n, embedding[start + 1]::DOUBLE AS first FROM s""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    out = W.tumbling_windows(table(spark, d, "embeddings"), 16, 8, 8, "embedding")
    return out.select("vec_id", "start", F.size("window").alias("n"), F.col("window")[0].cast("double").alias("first"))


@query(with_tables("scores", """+sizes AS (SELECT stream, count(*) AS total FROM scores GROUP BY stream)
SELECT stream, CAST(floor(score) AS BIGINT) AS start FROM scores JOIN sizes USING (stream) WHERE floor(score) >= 8 AND floor(score) + 12 <= total"""))
def windows_at_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    sizes = rows.groupBy("stream").agg(F.count("*").alias("total"))
    return W.windows_at(rows.select("stream", F.col("score").alias("at")), sizes, "stream", 10, 8, 2, 1, seconds=True)


@query("""WITH s AS (SELECT vec_id, embedding, unnest(generate_series(0, 48, 12)) AS start FROM embeddings)
SELECT vec_id, CAST(start // 12 AS INTEGER) AS window_no, round(list_sum(list_transform(embedding[start + 1:start + 16], lambda v: v::DOUBLE)), 5) AS total FROM s""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = W.sliding_windows(table(spark, d, "embeddings"), 16, 12, "embedding")
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", "window_no", F.round(total, 5).alias("total"))


@query(with_tables("scores", """+w AS (SELECT *, max(idx) OVER (PARTITION BY stream) + 1 AS n, sum(score) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 3 FOLLOWING) AS total FROM scores)
SELECT stream, idx AS anchor, 24::INTEGER AS n, round(total, 5) AS total FROM w WHERE event_type = 'purchase' AND idx >= 20 AND idx + 3 < n"""))
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    out = W.context_windows(rows.where("event_type = 'purchase'"), rows, "stream", 20, 3, value="score")
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x)
    return out.select("stream", "anchor", F.size("context").alias("n"), F.round(total, 5).alias("total"))


@query(with_tables("scores", "SELECT stream, idx, score FROM scores ORDER BY stream, idx LIMIT 1234"))
def quota_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.quota_across_files(V.scores(spark, d), 1234, "stream", "idx").select("stream", "idx", "score")


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
m AS (SELECT vec_id, x, list_sum(x) / 64 AS mean FROM s)
SELECT vec_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda v: (v - mean) * (v - mean))) / 63), 5) AS first FROM m""")
def unit_windows(spark: SparkSession, d: str) -> DataFrame:
    out = W.unit_std(table(spark, d, "embeddings"), "embedding", 1e-8)
    return out.select("vec_id", F.round(F.col("scaled")[0], 5).alias("first"))


@query("""WITH c AS (SELECT vec_id, label, CAST(32 + vec_id % 5 AS BIGINT) AS n FROM embeddings)
SELECT vec_id, CAST(min(n) OVER (PARTITION BY label) AS INTEGER) AS n FROM c""")
def equalized_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("samples", F.slice("embedding", F.lit(1), (32 + F.col("vec_id") % 5).cast("int")))
    return W.equalize_lengths(rows, "label").select("vec_id", F.size("samples").alias("n"))


@query("""WITH c AS (SELECT vec_id, embedding, unnest(generate_series(0, 3)) AS chunk_id FROM embeddings)
SELECT vec_id, chunk_id::INTEGER AS chunk_id, CASE WHEN chunk_id < 3 THEN 20 ELSE 4 END::INTEGER AS n, embedding[chunk_id * 20 + 1]::DOUBLE AS first FROM c""")
def rechunked_strain(spark: SparkSession, d: str) -> DataFrame:
    out = tables.rechunk(table(spark, d, "embeddings"), "embedding", 20)
    return out.select("vec_id", "chunk_id", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("first"))


@query("""SELECT event_type AS ifo, round(epoch_us(ts) / 1e6, 6) AS time, value AS snr FROM events WHERE event_type IN ('click', 'error')""")
def merged_triggers(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d).withColumn("ifo", F.col("event_type")).withColumn("time", F.col("t")).withColumn("snr", F.col("value"))
    for name in tables.TRIGGER:
        rows = rows if name in rows.columns else rows.withColumn(name, F.col("value"))
    return tables.merge_triggers(rows, ["click", "error"]).select("ifo", _r("time"), "snr")


@query("SELECT vec_id, CAST(-1 AS INTEGER) AS label, embedding[1]::DOUBLE AS first FROM embeddings")
def picked_column(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    data, label = tables.pick_array_column(rows)
    return rows.select("vec_id", label, F.col(data)[0].cast("double").alias("first"))


@query("SELECT event_type AS signal_name, CASE WHEN event_type = 'click' THEN 'SG' ELSE event_type END AS signal_type, event_id, value AS amplitude FROM events")
def flat_injections(spark: SparkSession, d: str) -> DataFrame:
    groups = V.events(spark, d).groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 64).alias("part")).agg(
        F.collect_list(F.struct("event_id", F.col("value").alias("amplitude"))).alias("params")
    )
    return tables.flatten_injections(groups.withColumn("type", F.when(F.col("name") == "click", "SG")))


@query("SELECT event_type AS class, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def appended_by_class(spark: SparkSession, d: str) -> DataFrame:
    path, rows = fresh_path(spark, "classes"), V.events(spark, d).select(F.col("event_type").alias("class"), "event_id", "value")
    for half in (0, 1, 1):  # the second batch is repeated
        tables.append_by_class(rows.where(F.col("event_id") % 2 == half), path, f"part-{half}")
    return spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(with_tables("scores", "SELECT stream AS seg_start, CAST(stream % 4 AS INTEGER) AS shift, idx, score FROM scores"))
def written_scores(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "scores")
    rows = V.scores(spark, d).select(F.col("stream").alias("seg_start"), (F.col("stream") % 4).cast("int").alias("shift"), "idx", "score")
    for _ in range(2):
        tables.write_scores(rows, path, "all")
    return spark.read.parquet(path).select("seg_start", "shift", "idx", "score")


@query("""SELECT injection_id, round(start + idx * 0.25, 6) AS gps FROM (SELECT event_id AS injection_id, epoch_us(ts) / 1e6 AS start, user_id AS idx FROM events)""")
def index_times(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d)
    return rows.select(F.col("event_id").alias("injection_id"), F.round(E.index_to_gps(F.col("user_id"), F.col("t"), 0.25), 6).alias("gps"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN round(value * 1e-22 / 1e-22, 6) ELSE round(value * 1e-22, 30) END AS snr FROM events")
def snr_proxies(spark: SparkSession, d: str) -> DataFrame:
    rows = V.events(spark, d)
    snr = E.snr_proxy(F.col("value") * 1e-22, F.col("event_type"), ("click", "error"))
    return rows.select("event_id", F.when(F.col("event_type").isin("click", "error"), F.round(snr, 6)).otherwise(F.round(snr, 30)).alias("snr"))


RECOVERED = "+found AS (SELECT i.*, EXISTS (SELECT 1 FROM triggers t WHERE abs(t.time - i.time) <= 600) AS recovered FROM injections i)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return I.match_triggers(V.injections(spark, d), V.triggers(spark, d), 600)


@query(with_tables("injections triggers", RECOVERED + """,
spans AS (SELECT signal, greatest(0.1, min(amplitude) FILTER (amplitude > 0)) AS lo, max(amplitude) AS hi FROM found GROUP BY signal),
grid AS (SELECT signal, bin::INTEGER AS bin, lo * pow(hi / lo, bin / 14.0) AS a, CASE WHEN bin = 13 THEN hi ELSE lo * pow(hi / lo, (bin + 1) / 14.0) END AS b
  FROM spans, (SELECT unnest(generate_series(0, 13)) AS bin)),
c AS (SELECT g.signal, g.bin, any_value((a + b) / 2) AS center, count(f.injection_id) AS n, coalesce(avg(f.recovered::INTEGER), 0) AS e
  FROM grid g LEFT JOIN found f ON f.signal = g.signal AND f.amplitude >= a AND f.amplitude < b GROUP BY 1, 2)
SELECT signal, bin, round(center, 6) AS center, n, round(e, 6) AS efficiency, CASE WHEN n > 0 THEN round(sqrt(e * (1 - e) / n), 6) ELSE 0 END AS error FROM c"""))
def efficiency_by_snr(spark: SparkSession, d: str) -> DataFrame:
    out = E.efficiency_vs_snr(_found(spark, d), snr="amplitude")
    return out.select("signal", "bin", _r("center"), "n", _r("efficiency"), _r("error"))


@query(with_tables("injections triggers", RECOVERED + """
SELECT inj_type, signal, count(*) FILTER (recovered) AS n_recovered, count(*) AS n, round(avg(recovered::INTEGER), 6) AS efficiency FROM found GROUP BY ROLLUP (inj_type, signal)"""))
def overall_efficiency(spark: SparkSession, d: str) -> DataFrame:
    out = E.overall_efficiency(_found(spark, d), "inj_type", "signal")
    return out.withColumn("efficiency", F.round("efficiency", 6))


CLUSTERED = """+marked AS (SELECT stream, idx, idx - row_number() OVER (PARTITION BY stream ORDER BY idx) AS run FROM scores WHERE event_type = 'click'),
runs AS (SELECT stream, min(idx) AS start, count(*) AS length FROM marked GROUP BY stream, run),
far AS (SELECT *, start - lag(start) OVER (PARTITION BY stream ORDER BY start) AS distance FROM runs)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d).withColumn("has_injection", F.col("event_type") == "click")
    return E.injection_clusters(rows, ["stream"])


@query(with_tables("scores", CLUSTERED + " SELECT stream, start, length, distance FROM far"))
def injection_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@query(with_tables("scores", CLUSTERED + " SELECT stream, min(distance) AS least, max(distance) AS most, round(avg(distance), 6) AS mean FROM far GROUP BY stream"))
def cluster_distances(spark: SparkSession, d: str) -> DataFrame:
    return E.cluster_distances(_clusters(spark, d), ["stream"]).withColumn("mean", F.round("mean", 6))


@query(with_tables("scores", CLUSTERED + " SELECT stream, start, length, distance FROM far WHERE coalesce(distance, start) >= 6"))
def valid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return E.valid_clusters(_clusters(spark, d), 6)


@query("""SELECT event_id, value, CAST(floor(epoch_us(ts) / 8.64e10) AS BIGINT) * 86400 AS t0 FROM events
WHERE floor(epoch_us(ts) / 8.64e10) * 86400 >= (SELECT floor(min(epoch_us(ts)) / 8.64e10) * 86400 + 3 * 86400 FROM events)
AND (floor(epoch_us(ts) / 8.64e10) + 1) * 86400 < (SELECT floor(min(epoch_us(ts)) / 8.64e10) * 86400 + 20 * 86400 FROM events)""")
def spanned_events(spark: SparkSession, d: str) -> DataFrame:
    """Files of a day each, of which those of some days are opened."""
    path, rows = fresh_path(spark, "days"), V.events(spark, d)
    day = (F.floor(F.col("t") / 86_400) * 86_400).cast("long")
    rows.select("event_id", "value", F.concat(F.lit("H1-"), day, F.lit("-86400")).alias("span")).repartition("span").write.partitionBy("span").parquet(path)
    first = rows.agg(F.min(day)).first()[0]
    out = spanned.read_spanned(spark, path, "event_id long, value double")
    return out.where((F.col("t0") >= first + 3 * 86_400.0) & (F.col("stop") < first + 20 * 86_400.0)).select("event_id", "value", F.col("t0").cast("long").alias("t0"))
