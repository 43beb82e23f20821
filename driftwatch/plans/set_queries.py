"""Queries over classes, embeddings and thresholds: vetoes, ROC curves, standardizers, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.grids import edges
from driftwatch.operators import efficiency as E
from driftwatch.operators import features as X
from driftwatch.operators import models as M
from driftwatch.operators import vetoes as V_
from driftwatch.plans import views as V
from driftwatch.plans.registry import query, with_tables
from driftwatch.session import fresh_path, table
from driftwatch.sources import tables

CUTS = """{"snr": {"min": 5, "max": 45, "description": "strength"}, "hrss": {"min": null, "max": 60000, "description": "amplitude"},
 "score": {"min": 950, "max": null, "description": "score"}}"""
FAILED = """+failed AS (SELECT *, list_filter([CASE WHEN snr < 5 THEN 'snr < 5' END, CASE WHEN snr > 45 THEN 'snr > 45' END,
  CASE WHEN hrss > 60000 THEN 'hrss > 60000' END, CASE WHEN score < 950 THEN 'score < 950' END], lambda x: x IS NOT NULL) AS cuts FROM classes)"""


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _vetoed(spark: SparkSession, d: str) -> DataFrame:
    return V_.apply_vetoes(V.classes(spark, d), tables.thresholds(tables.read_thresholds(spark, CUTS)))


@query(with_tables("classes", FAILED + """
SELECT l_orderkey, l_linenumber, array_to_string(cuts, ';') AS failed, CAST(len(cuts) AS INTEGER) AS n_failed_cuts, len(cuts) > 0 AS vetoed FROM failed"""))
def vetoes(spark: SparkSession, d: str) -> DataFrame:
    return _vetoed(spark, d).select("l_orderkey", "l_linenumber", F.concat_ws(";", "failed_cuts").alias("failed"), "n_failed_cuts", "vetoed")


@query(with_tables("classes", FAILED + """
SELECT l_orderkey, l_linenumber, array_to_string(cuts, ';') AS failed, snr FROM failed WHERE l_linestatus = 'F' AND len(cuts) > 0"""))
def veto_results_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "results")
    rows = _vetoed(spark, d).where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "failed_cuts", "snr")
    tables.write_results_csv(rows, path)
    back = tables.read_results_csv(spark, path, "l_orderkey long, l_linenumber long, failed_cuts string, snr double")
    return back.where(F.size("failed_cuts") > 0).select("l_orderkey", F.col("l_linenumber").cast(dict(rows.dtypes)["l_linenumber"]), F.concat_ws(";", "failed_cuts").alias("failed"), "snr")


@query(with_tables("classes", """SELECT l_orderkey, l_linenumber, CAST((snr < 10)::INTEGER + (hrss > 50000)::INTEGER AS INTEGER) AS n_failed_cuts FROM classes WHERE l_linestatus = 'F'"""))
def recalculated_vetoes(spark: SparkSession, d: str) -> DataFrame:
    rows = _vetoed(spark, d).withColumn("success", F.col("l_linestatus") == "F")
    cuts = {"snr": {"min": 10, "max": None}, "hrss": {"min": None, "max": 50_000}, "unknown": {"min": 1, "max": None}}
    return V_.recalculate_vetoes(rows, cuts).select("l_orderkey", "l_linenumber", "n_failed_cuts")


def _summary_sql(metric: str, low: str, high: str) -> str:
    return f"""SELECT '{metric}' AS metric, count(*) AS n, round(avg({metric}), 4) AS mean, round(median({metric}), 4) AS median, round(stddev_pop({metric}), 4) AS std,
min({metric}) AS lowest, max({metric}) AS highest, count(*) FILTER ({metric} < {low}) AS n_below, count(*) FILTER ({metric} > {high}) AS n_above FROM classes"""


@query(with_tables("classes", _summary_sql("snr", "5", "45") + " UNION ALL " + _summary_sql("hrss", "NULL", "60000")))
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    out = V_.metric_summary(V.classes(spark, d), {"snr": {"min": 5, "max": 45}, "hrss": {"min": None, "max": 60_000}})
    return out.select("metric", "n", _r("mean", 4), _r("median", 4), _r("std", 4), "lowest", "highest", "n_below", "n_above")


@query(with_tables("classes", FAILED + " SELECT count(*) FILTER (len(cuts) = 0) AS n_passed, count(*) FILTER (len(cuts) > 0) AS n_vetoed FROM failed"))
def veto_totals(spark: SparkSession, d: str) -> DataFrame:
    return V_.veto_totals(_vetoed(spark, d))


@query(with_tables("classes", FAILED + """ SELECT count(*) AS n, round(avg(hrss), 4) AS mean, round(median(hrss), 4) AS median, round(stddev_pop(hrss), 4) AS std, min(hrss) AS lowest, max(hrss) AS highest
FROM failed WHERE len(cuts) = 0"""))
def passing_scores(spark: SparkSession, d: str) -> DataFrame:
    return V_.passing_scores(_vetoed(spark, d), "hrss").select("n", _r("mean", 4), _r("median", 4), _r("std", 4), "lowest", "highest")


@query(with_tables("classes", "SELECT l_orderkey, l_linenumber FROM classes WHERE (l_linenumber = 1 OR snr >= 10) AND hrss <= 50000"))
def preselected(spark: SparkSession, d: str) -> DataFrame:
    rows = V.classes(spark, d).withColumn("snr", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("snr")))
    return V_.preselect(rows, {"snr": 10}, {"hrss": 50_000}).select("l_orderkey", "l_linenumber")


GRID = """+edges AS (SELECT i::INTEGER AS bin, a, b FROM (SELECT i, {lo} AS a, {hi} AS b FROM (SELECT unnest(generate_series(0, 9)) AS i)))"""
BY_BIN = """
SELECT k.class, e.bin, round({center}, 6) AS center, count(c.score) AS n, round(avg((c.score < 1200)::INTEGER), 6) AS share
FROM (SELECT DISTINCT class FROM classes) k CROSS JOIN edges e LEFT JOIN classes c ON c.class = k.class AND c.{value} >= e.a AND c.{value} < e.b GROUP BY 1, 2, a, b"""


@query(with_tables("classes", GRID.format(lo="4 + 26.0::DOUBLE * i / 10", hi="CASE WHEN i = 9 THEN 30.0::DOUBLE ELSE 4 + 26.0::DOUBLE * (i + 1) / 10 END") + BY_BIN.format(center="(a + b) / 2", value="snr")))
def detected_by_snr(spark: SparkSession, d: str) -> DataFrame:
    out = E.detected_by_class_bin(V.classes(spark, d), 1_200, "low", edges(4, 30, 10), "class", "snr")
    return out.select("class", "bin", _r("center"), "n", _r("share"))


@query(with_tables("classes", GRID.format(lo="1000 * pow(80.0::DOUBLE, i / 10.0::DOUBLE)", hi="1000 * pow(80.0::DOUBLE, (i + 1) / 10.0::DOUBLE)") + BY_BIN.format(center="sqrt(a * b)", value="hrss")))
def detected_by_hrss(spark: SparkSession, d: str) -> DataFrame:
    out = E.detected_by_class_bin(V.classes(spark, d), 1_200, "low", edges(1_000, 80_000, 10, log=True), "class", "hrss", center="geometric")
    return out.select("class", "bin", _r("center"), "n", _r("share"))


@query(with_tables("classes", "SELECT class, round(avg((score > 1500)::INTEGER), 6) AS share FROM classes GROUP BY class"))
def detected_fractions(spark: SparkSession, d: str) -> DataFrame:
    return E.detected_fraction(V.classes(spark, d), 1_500, "high", "class").select("class", _r("share"))


ROC = """+hits AS (SELECT {key} hrss, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM src GROUP BY {key} hrss),
curve AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER t AS ps, sum(n) OVER t AS ns FROM hits
  WINDOW w AS ({part} ORDER BY hrss DESC ROWS UNBOUNDED PRECEDING), t AS ({part}))"""


@query(with_tables("classes", ROC.replace("+hits", "+src AS (SELECT *, class <> 'N' AS positive FROM classes), hits").format(key="", part="") + """
SELECT hrss, round(fp / ns::DOUBLE, 9) AS fpr, round(tp / ps::DOUBLE, 9) AS tpr FROM curve"""))
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = V.classes(spark, d).withColumn("positive", F.col("class") != "N")
    return E.roc_curve(rows, "hrss", "positive").select("hrss", _r("fpr", 9), _r("tpr", 9))


AGAINST = """+src AS (SELECT class AS against, hrss, true AS positive FROM classes WHERE class <> 'N'
  UNION ALL SELECT k.class, c.hrss, false FROM classes c, (SELECT DISTINCT class FROM classes WHERE class <> 'N') k WHERE c.class = 'N'), hits"""


@query(with_tables("classes", ROC.replace("+hits", AGAINST).format(key="against,", part="PARTITION BY against") + """
SELECT against, round(sum(n / ns::DOUBLE * (tp - p / 2) / ps), 9) AS auc FROM curve GROUP BY against"""))
def roc_by_class(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_auc(E.roc_by_class(V.classes(spark, d), "hrss", "class", ["N"]), "against").select("against", _r("auc", 9))


@query(with_tables("classes", "SELECT class, min(snr) AS lowest, max(snr) AS highest, round(avg(snr), 6) AS mean, count(*) AS n FROM classes WHERE class <> 'N' GROUP BY class"))
def snr_by_class(spark: SparkSession, d: str) -> DataFrame:
    return E.snr_by_class(V.classes(spark, d), "class", ["N"]).select("class", "lowest", "highest", _r("mean"), "n")


@query(with_tables("classes", """+s AS (SELECT class, hrss FROM classes WHERE class <> 'N'),
e AS (SELECT class, min(hrss) AS lo, max(hrss) AS hi FROM s GROUP BY 1),
g AS (SELECT class, lo, (hi - lo) / 50 AS w, b.bin FROM e, (SELECT unnest(range(50)) AS bin) b),
c AS (SELECT class, least(floor((hrss - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM s JOIN e USING (class) GROUP BY ALL)
SELECT class, g.bin::INTEGER AS bin, round(lo + g.bin * w, 6) AS low, round(lo + (g.bin + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (class, bin)"""))
def snr_histograms(spark: SparkSession, d: str) -> DataFrame:
    return E.snr_histograms(V.classes(spark, d), "class", ["N"], snr="hrss").select("class", "bin", _r("low"), _r("high"), "n")


@query(with_tables("classes", """SELECT l_orderkey, l_linenumber, CASE class WHEN 'A' THEN 4 WHEN 'R' THEN 4 ELSE 7 END::INTEGER AS group_label,
CASE class WHEN 'N' THEN 'noise' ELSE 'string' END AS group_name, class <> 'N' AS is_signal FROM classes"""))
def labelled_classes(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("A", 4, "string"), ("R", 4, "string"), ("N", 7, "noise")], "class string, group_label int, group_name string")
    return X.with_label_dim(V.classes(spark, d), dim, "class", ["N"]).select("l_orderkey", "l_linenumber", "group_label", "group_name", "is_signal")


@query(with_tables("pairs", """+x AS (SELECT vec_id, list_transform(h, lambda v: v::DOUBLE) AS h, list_transform(l, lambda v: v::DOUBLE) AS l FROM pairs),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(h, l), lambda p: p[1] * p[2])) AS hl, list_sum(list_transform(h, lambda v: v * v)) AS hh, list_sum(list_transform(l, lambda v: v * v)) AS ll,
  list_sum(h) AS sh, list_sum(l) AS sl, list_sum(list_transform(h, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE -v END)) AS ah, list_sum(list_transform(l, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE -v END)) AS al FROM x)
SELECT vec_id, round((64 * hl + sh * sl + ah * al) / 2 / (sqrt((64 * hh + sh * sh + ah * ah) / 2) * sqrt((64 * ll + sl * sl + al * al) / 2) + 1e-8), 6) AS cosine FROM s"""))
def frequency_cosine(spark: SparkSession, d: str) -> DataFrame:
    return V.pairs(spark, d).select("vec_id", F.round(X.freq_cos(F.col("h"), F.col("l")), 6).alias("cosine"))


@query(with_tables("pairs", """SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(h, l), lambda p: p[1]::DOUBLE * p[1] + p[2]::DOUBLE * p[2])) / 4096), 6) AS hrss FROM pairs"""))
def root_sum_square(spark: SparkSession, d: str) -> DataFrame:
    return V.pairs(spark, d).select("vec_id", F.round(X.hrss(F.col("h"), F.col("l"), 1 / 4096), 6).alias("hrss"))


@query(with_tables("flat", "SELECT dim::INTEGER AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM flat GROUP BY dim"))
def standardizer(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_standardizer(table(spark, d, "embeddings"), "embedding").select("dim", _r("mean"), _r("std"))


@query(with_tables("flat", "SELECT dim::INTEGER AS dim, round(greatest(stddev_samp(x), 0.13), 6) AS std FROM flat GROUP BY dim"))
def sample_standardizer(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_standardizer(table(spark, d, "embeddings"), "embedding", sample=True, least=0.13).select("dim", _r("std"))


@query(with_tables("flat", """+m AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM flat GROUP BY dim)
SELECT vec_id, round(max(CASE WHEN dim = 0 THEN (x - mean) / (std + 1e-8) END), 5) AS first, round(sum((x - mean) / (std + 1e-8)) + vec_id, 4) AS total FROM flat JOIN m USING (dim) GROUP BY vec_id"""))
def standardized(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    out = X.standardize(rows, X.fit_standardizer(rows, "embedding"), "embedding", extra="vec_id")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.round(F.col("features")[0], 5).alias("first"), F.round(total, 4).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (SELECT DISTINCT label FROM embeddings ORDER BY label DESC LIMIT 2)")
def background_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.select_background(table(spark, d, "embeddings"), "label").select("vec_id", "label")


@query()
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    forest = M.fit_isolation_forest(X.select_background(rows, "label"), "x", "vec_id", trees=100)
    return M.score_isolation_forest(rows, forest, "x").select("vec_id", "label", "score")


@query(with_tables("flat", """+b AS (SELECT vec_id AS other, x AS y, dim FROM flat WHERE label >= 8),
sq AS (SELECT vec_id, other, sum((x - y) * (x - y)) AS d2 FROM flat JOIN b USING (dim) GROUP BY ALL)
SELECT vec_id, round(-ln(sum(exp(-d2 / 0.5)) / count(*) / pow(2 * pi() * 0.25, 32)), 6) AS score FROM sq GROUP BY vec_id"""))
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return M.score_kde(rows, rows.where("label >= 8"), "embedding").select("vec_id", _r("score"))


@query("SELECT vec_id, round(-list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)), 6) AS score, CAST(NULL AS VARCHAR) AS error FROM embeddings")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.score_model(table(spark, d, "embeddings"), lambda x: (x**2).sum(1), "embedding", flip=True).select("vec_id", _r("score"), "error")


@query(with_tables("files", """+n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM files)
SELECT path, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM n"""))
def split_files(spark: SparkSession, d: str) -> DataFrame:
    return X.split_files(V.files(spark, d), "path").select("path", "split")


@query("SELECT vec_id, (vec_id % {2} * {0} + {1}) % {2} * 100 < 20::BIGINT * {2} AS is_val FROM embeddings".format(*X.split_factors(3), X.PRIME))
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.split_rows(table(spark, d, "embeddings"), "vec_id", 20, seed=3).select("vec_id", "is_val")


@query("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.5) AS is_val FROM embeddings")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return X.split_stratified(table(spark, d, "embeddings"), "label", F.col("vec_id")).select("vec_id", "is_val")


@query("""WITH c AS (SELECT DISTINCT label AS class FROM embeddings), n AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT class, CAST(128 // n + (i < 128 % n)::INTEGER AS BIGINT) AS quota FROM n""")
def class_quotas(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "embeddings").select(F.col("label").alias("class")).distinct()
    return X.class_quotas(names.withColumn("group_label", F.col("class") % 3), 128).select("class", "quota")


@query("""WITH c AS (SELECT DISTINCT label AS class FROM embeddings), e AS (SELECT class, floor(42 / count(*) OVER (PARTITION BY class % 3)) AS each FROM c),
n AS (SELECT class, each, row_number() OVER (ORDER BY class) - 1 AS i, count(*) OVER () AS n, 128 - sum(each) OVER () AS missing FROM e)
SELECT class, CAST(each + floor(missing / n) + (i < missing % n)::INTEGER AS BIGINT) AS quota FROM n""")
def rebalanced_quotas(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "embeddings").select(F.col("label").alias("class")).distinct()
    return X.class_quotas(names.withColumn("group_label", F.col("class") % 3), 128, rebalance=True).select("class", "quota")


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 104729, vec_id) <= 10")
def class_samples(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(F.col("vec_id") * 7919 % 104_729, "vec_id")
    return X.sample_per_class(table(spark, d, "embeddings"), 10, ["label"], order).select("vec_id", "label")


@query("""SELECT vec_id, false AS is_mixed FROM embeddings WHERE label < 8 UNION ALL (SELECT vec_id, true FROM embeddings WHERE label >= 8 ORDER BY vec_id LIMIT 30)""")
def mixed_glitches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return X.mix_in(rows.where("label < 8"), rows.where("label >= 8"), 30, "vec_id").select("vec_id", "is_mixed")


@query(with_tables("flat", """+s AS (SELECT dim, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM flat GROUP BY dim),
b AS (SELECT dim, label, least(CAST(floor((x - lo) / ((hi - lo) / 19)) AS INTEGER), 18) AS bin, (hi - lo) / 19 AS w FROM flat JOIN s USING (dim) WHERE x >= lo AND x <= hi),
c AS (SELECT dim, label, bin, any_value(w) AS w, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT dim::INTEGER AS dim, label, bin, n, round(n / sum(n) OVER (PARTITION BY dim, label) / w, 6) AS density FROM c"""))
def corner_histograms(spark: SparkSession, d: str) -> DataFrame:
    out = X.corner_histograms(table(spark, d, "embeddings"), "embedding", "label")
    return out.select("dim", "label", "bin", "n", _r("density"))


@query(with_tables("flat", """+s AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM flat GROUP BY dim),
b AS (SELECT dim, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, least(CAST(floor((x - lo) / ((hi - lo) / 60)) AS INTEGER), 59) AS bin, (hi - lo) / 60 AS w FROM flat JOIN s USING (dim)),
c AS (SELECT side, dim, bin, any_value(w) AS w, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT side, dim::INTEGER AS dim, bin, n, round(n / sum(n) OVER (PARTITION BY side, dim) / w, 6) AS density FROM c"""))
def paired_density(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return X.paired_density(rows.where("label < 5"), rows.where("label >= 5"), "embedding").select("side", "dim", "bin", "n", _r("density"))


COMPARE = """+m AS (SELECT dim, avg(x) FILTER (label < 5) AS ma, avg(x) FILTER (label >= 5) AS mb, stddev_pop(x) FILTER (label < 5) AS sa, stddev_pop(x) FILTER (label >= 5) AS sb FROM flat GROUP BY dim)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return X.compare_embeddings(rows.where("label < 5"), rows.where("label >= 5"), "embedding")


@query(with_tables("flat", COMPARE + """ SELECT dim::INTEGER AS dim, round(abs(ma - mb), 6) AS mean_diff, round(abs(sa - sb), 6) AS std_diff, round(abs(sa - sb) / (abs(sb) + 1e-10), 5) AS std_rel,
abs(ma - mb) <= 0.01 + 0.1 * abs(mb) AS mean_close, abs(sa - sb) <= 0.01 + 0.1 * abs(sb) AS std_close FROM m"""))
def compared_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("dim", _r("mean_diff"), _r("std_diff"), _r("std_rel", 5), "mean_close", "std_close")


@query(with_tables("flat", COMPARE + """ SELECT round(min(abs(ma - mb)), 6) AS mean_least, round(max(abs(ma - mb)), 6) AS mean_most, round(avg(abs(sa - sb)), 6) AS std_avg, round(corr(ma, mb), 5) AS mean_corr,
round(corr(sa, sb), 5) AS std_corr, bool_and(abs(ma - mb) <= 0.01 + 0.1 * abs(mb) AND abs(sa - sb) <= 0.01 + 0.1 * abs(sb)) AS all_close FROM m"""))
def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    out = X.comparison_summary(_compared(spark, d))
    return out.select(_r("mean_least"), _r("mean_most"), _r("std_avg"), _r("mean_corr", 5), _r("std_corr", 5), "all_close")


@query(with_tables("flat", """+k AS (SELECT vec_id, label < 5 AS low, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) AS i FROM embeddings),
n AS (SELECT min(n) AS n FROM (SELECT max(i) AS n FROM k GROUP BY low)),
m AS (SELECT dim, avg(x) FILTER (low) AS ma, avg(x) FILTER (NOT low) AS mb, stddev_pop(x) FILTER (low) AS sa, stddev_pop(x) FILTER (NOT low) AS sb FROM flat JOIN k USING (vec_id), n WHERE i <= n.n GROUP BY dim)
SELECT dim::INTEGER AS dim, round(abs(ma - mb), 6) AS mean_diff, round(abs(sa - sb), 6) AS std_diff FROM m"""))
def compared_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same over as many first vectors of either set as the smaller one has."""
    rows = table(spark, d, "embeddings")
    return X.compare_embeddings(rows.where("label < 5"), rows.where("label >= 5"), "embedding", F.col("vec_id")).select("dim", _r("mean_diff"), _r("std_diff"))


@query("SELECT DISTINCT label FROM (SELECT label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT label + 20 FROM embeddings)")
def united_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.where("vec_id % 2 = 0").select("label").unionByName(rows.select((F.col("label") + 20).alias("label"))).distinct()
