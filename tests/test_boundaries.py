"""Hand-made cases of edges, ties, gaps and bad numbers."""

import math

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.grids import bin_of, histogram
from driftwatch.functions.islands import running_total
from driftwatch.functions.quantiles import quantiles
from driftwatch.operators import efficiency, features, intervals, models, scores, significance, slides, vetoes, windows
from driftwatch.session import fresh_path, materialize, remove, scratch, shared_folder
from driftwatch.sources import segments, tables


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_touching_segments_do_not_overlap(frame):
    a = frame([(0, 10), (20, 300_000)], "start long, stop long")
    b = frame([(10, 20), (25, 26), (100_000, 500_000)], "start long, stop long")
    assert pairs(intervals.intersect_segments(a, b), "start", "stop") == [(25, 26), (100_000, 300_000)]
    none = frame([], "start long, stop long")
    assert intervals.intersect_segments(a, none).count() == 0
    assert intervals.livetime(none).collect()[0].asDict() == {"n": 0, "seconds": 0}


def test_range_join_finds_each_pair_once(frame):
    import random

    random.seed(3)
    spans = lambda: [(i, (s := random.uniform(-50, 50)), s + random.uniform(0, 30)) for i in range(60)]
    a, b = spans(), spans()
    got = intervals.range_join(frame(a, "i long, a double, b double"), frame(b, "j long, c double, d double"), 7.0, ("a", "b"), ("c", "d"))
    assert pairs(got, "i", "j") == sorted((i, j) for i, s, t in a for j, u, v in b if s < v and u < t)


def test_trigger_at_the_limit_counts(frame):
    inj = frame([(1, 10.0), (2, 20.0), (3, 30.0)], "injection_id long, time double")
    trig = frame([(10.5,), (19.4,), (19.5,), (100.0,)], "time double")
    assert pairs(intervals.match_triggers(inj, trig, 0.5), "injection_id", "recovered") == [(1, True), (2, True), (3, False)]


def test_window_edge_on_the_pad_does_not_touch(frame):
    win = frame([(1, 0.0), (2, 8.0), (3, 9.0), (4, 11.0)], "window_id long, gps double")
    inj = frame([(1, "a", 10.0), (2, "b", 10.5)], "inj_order long, inj_type string, time double")
    got = intervals.label_windows(win, inj, 1.0, 1.0)
    assert pairs(got, "window_id", "has_injection") == [(1, False), (2, False), (3, True), (4, True)]
    assert {r["inj_type"] for r in got.where("window_id = 3").collect()} == {"b"}


def test_windows_and_marks_equal_brute_force(frame):
    """Labels, touched injections and triggers on windows, at bounds that are equal too, and no pairs of rows in the plan."""
    import contextlib
    import io
    import random

    draw = random.Random(6)
    for kernel, pad, step in ((1.0, 1.0, 0.5), (0.3, 0.1, 0.1), (4.0, 0.25, 0.25), (0.0, 1.5, 0.5)):
        wins = [(i, draw.randint(-60, 60) * step) for i in range(80)] + [(200, float("nan")), (201, None)]
        injs = [(draw.choice([i, None]), draw.choice(["a", "b", None]), draw.randint(-90, 90) * step) for i in range(40)] + [(99, "n", float("nan"))]
        trigs = [(s, s + draw.randint(0, 30) * step) for s in (draw.randint(-60, 60) * step for _ in range(12))]
        meets = lambda w, t: w is not None and w == w and t == t and w < t + pad and w + kernel > t - pad  # noqa: E731, B023
        want = []
        for i, w in wins:
            hit = [(o, k) for o, k, t in injs if meets(w, t)]
            of = [x for x in hit if x[0] is not None]
            want.append((i, max(of, key=lambda x: x[0])[1] if of else None, bool(hit)))
        win, inj = frame(wins, "window_id long, gps double"), frame(injs, "inj_order long, inj_type string, time double")
        got = intervals.label_windows(win, inj, kernel, pad)
        assert sorted(tuple(r) for r in got.select("window_id", "inj_type", "has_injection").collect()) == want
        touched = len({o for o, _, t in injs if any(meets(w, t) for _, w in wins)})
        assert intervals.touched_injections(win, inj, kernel, pad).first()[0] == touched
        spans = frame([(i, w, w + kernel) for i, w in wins[:80]], "window_id long, start double, stop double")
        on = {i for i, w in wins[:80] if any(a < w + kernel and b > w for a, b in trigs)}
        marks = frame(trigs, "tstart double, tend double")
        assert {r["window_id"] for r in intervals.split_by_triggers(spans, marks, False, 2.0).collect()} == on
        assert {r["window_id"] for r in intervals.split_by_triggers(spans, marks, True, 2.0).collect()} == {*range(80)} - on
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert text.getvalue().count("Join") == 1  # of windows and what is found for them


def test_smoothing_pads_with_zero(frame):
    import numpy as np

    x = [1.0, 2.0, 4.0, 8.0, 16.0]
    rows = frame([(0, i, v) for i, v in enumerate(x)], "s long, idx long, score double")
    for width in (1, 2, 3, 4, 5):
        got = [v for _, v in pairs(scores.tophat_smooth(rows, width, ["s"]), "idx", "smooth")]
        assert got == pytest.approx(np.convolve(x, np.ones(width) / width, "same"))
        for chunk in (2, 3):
            cut = [v for _, v in pairs(scores.tophat_smooth(rows, width, ["s"], chunk=chunk), "idx", "smooth")]
            assert cut == pytest.approx(got)
        valid = [v for _, v in pairs(scores.valid_smooth(rows, width, ["s"], chunk=2), "idx", "smooth")]
        assert valid == pytest.approx(np.convolve(x, np.ones(width) / width, "valid"))


def test_a_run_of_the_limit_stays(frame):
    flags = [1] * 3 + [0] * 10 + [1] * 4 + [0] * 10 + [1] * 2
    rows = frame([(0, i, 0.0 if f else 1.0 + i) for i, f in enumerate(flags)], "s long, idx long, smooth double")
    kept = {i for i, in pairs(scores.veto_long_runs(rows, 0.3, 3, ["s"]), "idx")}
    assert kept == set(range(29)) - {13, 14, 15, 16}


def test_thresholds(frame):
    rows = frame([(float(v),) for v in [5, 1, 3, 2, 4]], "score double")
    assert scores.threshold(rows, 1).first()[0] == 2.0
    assert scores.threshold(rows, 0.25).first()[0] == 2.0
    assert scores.threshold(rows, 0.125).first()[0] == 1.5
    assert scores.threshold(rows.where("score > 9"), 0.5).count() == 0


def test_quantiles_equal_numpy(frame):
    import numpy as np

    values = [(i % 3, float(i * 7919 % 503)) for i in range(2000)] + [(0, float("nan")), (1, None), (7, 2.0)]
    rows = frame(values, "g int, x double")
    levels = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.999, "e": 1.0}
    for r in quantiles(rows, "x", levels, ["g"]).collect():
        own = [x for g, x in values if g == r["g"] and x is not None and x == x]
        assert [r[n] for n in levels] == pytest.approx([float(np.quantile(own, q)) for q in levels.values()])
    own = [x for _, x in values if x is not None and x == x]
    assert quantiles(rows, "x", levels).first()["b"] == pytest.approx(float(np.quantile(own, 0.013)))


def test_gap_of_the_limit_stays_one_cluster(frame):
    rows = frame([(0, float(t), t / 10) for t in (0, 16, 33, 100)], "s long, t double, score double")
    got = pairs(scores.cluster_outliers(rows, 16, ["s"], 0.5), "start", "end", "duration", "n")
    assert got == [(-0.5, 16.5, 17.0, 2), (32.5, 33.5, 1.0, 1), (99.5, 100.5, 1.0, 1)]


def test_bins(frame):
    rows = frame([(float(v),) for v in (0, 1, 2, 3, 4)], "x double")
    got = rows.select(bin_of(F.col("x"), [0, 2, 4], closed=False).alias("b")).collect()
    assert sorted(str(r["b"]) for r in got) == ["0", "0", "1", "1", "None"]
    assert pairs(histogram(rows, "x", 2), "bin", "n") == [(0, 2), (1, 3)]
    assert pairs(histogram(frame([(1.0,), (1.0,)], "x double"), "x", 4), "bin", "n") == [(0, 2)]


def test_far_and_ranks(frame):
    rows = frame([(float(v),) for v in (1, 1, 2, 5)], "score double")
    assert pairs(significance.far_table(rows, 5, 2.0, "low"), "threshold", "far") == [(1, 1.0), (2, 1.5), (3, 1.5), (4, 1.5), (5, 2.0)]
    assert pairs(significance.far_table(rows, 5, 2.0, "high"), "threshold", "far") == [(1, 2.0), (2, 1.0), (3, 0.5), (4, 0.5), (5, 0.5)]
    assert pairs(significance.ifar_curve(rows, 31_536_000.0, "low"), "score", "count", "ifar_years") == [(1, 2, 0.5), (2, 3, 1 / 3), (5, 4, 0.25)]
    assert pairs(significance.ifar_curve(rows, 1.0, "high"), "score", "count") == [(1, 4), (2, 2), (5, 1)]
    with pytest.raises(ValueError):
        significance.score_to_far(rows, 1, 1, "")
    assert significance.far_table(frame([(3.0,)] * 4, "score double"), 5, 4.0, "low").agg(F.max("far")).first()[0] == 1.0


def test_poisson_quantiles():
    for mean in (0.001, 0.5, 3.0, 40.0):
        cdf, k, p = 0.0, 0, math.exp(-mean)
        want = []
        for share in (0.05, 0.5, 0.95):
            while cdf + p < share:
                cdf, k, p = cdf + p, k + 1, p * mean / (k + 1)
            want.append(k)
        assert significance.poisson_quantiles([0.05, 0.5, 0.95], mean) == want
    low, middle, high = significance.poisson_quantiles([0.158655, 0.5, 0.841345], 1e8)
    assert middle == 10**8 and abs(10**8 - low - 10**4) < 3 and abs(high - 10**8 - 10**4) < 3


def test_running_total_needs_no_single_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(1).alias("v"))
    got = running_total(rows, "k", {"n": "v"}).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    down = running_total(rows, "k", {"n": "v"}, descending=True).orderBy(F.desc("k")).collect()
    assert [r["n"] for r in down] == list(range(1, 1001))


def test_shifts(spark):
    assert [slides.shifts_required(b, 1_200_000, 1) for b in (86_400, 2_678_400, 31_557_600)] == [1, 3, 27]
    assert slides.shifts_required(0, 100, 1) == 1
    with pytest.raises(ValueError):
        slides.shifts_required(1e9, 100, 1)
    row = spark.range(1).select(slides.shifts_column(F.lit(2_678_400.0), F.lit(1_200_000.0), 1.0).alias("a"), slides.shifts_column(F.lit(1e9), F.lit(100.0), 1.0).alias("b")).first()
    assert (row["a"], row["b"]) == (3, None)


def test_vetoes_and_nan(frame):
    nan = float("nan")
    rows = frame([(1, 5.0), (2, nan), (3, None), (4, 0.0), (5, 20.0)], "i long, cc double")
    got = pairs(vetoes.apply_vetoes(rows, {"cc": {"min": 1, "max": 10}}), "i", "n_failed_cuts")
    assert got == [(1, 0), (2, 2), (3, 2), (4, 1), (5, 1)]
    assert pairs(vetoes.preselect(rows, {"cc": 1}, {"cc": 10}), "i") == [(1,), (2,), (3,)]
    assert pairs(vetoes.apply_vetoes(rows, {"cc": {}}), "i", "vetoed")[0] == (1, False)
    assert pairs(scores.finite_rows(rows, ["cc"]), "i") == [(1,), (4,), (5,)]


def test_roc_with_ties(frame):
    rows = frame([(1.0, True), (1.0, False), (0.0, False), (2.0, True)], "x double, p boolean")
    assert efficiency.roc_auc(efficiency.roc_curve(rows, "x", "p")).first()["auc"] == pytest.approx(0.875)
    same = frame([(1.0, True), (1.0, False)], "x double, p boolean")
    assert efficiency.roc_auc(efficiency.roc_curve(same, "x", "p")).first()["auc"] == pytest.approx(0.5)


def test_files_and_segments(spark, frame, tmp_path):
    (tmp_path / "segments.cat.x-1.h1").write_text("30 40\n10.000000 20.000000\nnot a line\n")
    got = segments.read_segments(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("cat.x-1", "h1", 10, 20), ("cat.x-1", "h1", 30, 40)]
    files = frame([("/a/sequence_1234567890-64_3.h5",), ("b.h5",), ("/a/x-1234567890.5-8.gwf",)], "path string")
    good, bad = segments.parse_file_keys(files)
    assert pairs(good, "t0", "length") == [(1234567890.0, 64.0), (1234567890.5, 8.0)] and pairs(bad, "path") == [("b.h5",)]


def test_merge_triggers_needs_all_detectors(frame):
    rows = frame([("H1", *[1.0] * 10)], "ifo string, " + ", ".join(f"{n} double" for n in tables.TRIGGER))
    assert tables.merge_triggers(rows, ["H1", "L1"]).count() == 0
    assert tables.merge_triggers(rows, ["H1"]).count() == 1


def test_outlier_catalogue_round_trip(spark, frame):
    path = fresh_path(spark, "outliers")
    rows = frame([(1, 2, 0, 1.0, 2.0, 1.0, -3.5)], "t0 long, length int, shift int, start double, end double, duration double, min_score double")
    tables.write_outliers(rows, path, "one")
    tables.write_outliers(rows.withColumn("t0", F.lit(9).cast("long")), path, "two")
    tables.write_outliers(rows, path, "one")  # again
    assert pairs(spark.read.parquet(path), *tables.OUTLIER) == [(1, 2, 0, 1.0, 2.0, 1.0, -3.5), (9, 2, 0, 1.0, 2.0, 1.0, -3.5)]
    with pytest.raises(ValueError):
        tables.write_outliers(rows, path, "../other")


def test_batches_are_replaced_whole(spark, frame):
    path = fresh_path(spark, "samples")
    rows = frame([(i, "abc"[i % 3]) for i in range(30)], "id long, class string")
    tables.append_by_class(rows, path, "b1")
    tables.append_by_class(rows.where("class <> 'a'"), path, "b2")
    tables.append_by_class(rows.where("class <> 'c'"), path, "b1")  # fewer classes than before
    got = spark.read.parquet(path)
    assert {tuple(r) for r in got.groupBy("batch", "class").count().collect()} == {("b1", "a", 10), ("b1", "b", 10), ("b2", "b", 10), ("b2", "c", 10)}


def test_a_stream_that_is_run_again_writes_once(spark, frame):
    source, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    for i in range(2):
        frame([(i, "a"), (i + 10, "b")], "id long, class string", 1).write.mode("append").parquet(source)
        for _ in range(2):  # each with a checkpoint of its own: both runs number their batches from zero
            tables.write_stream(spark.readStream.schema("id long, class string").parquet(source), path, fresh_path(spark, "state"), ["class"]).awaitTermination()
        assert pairs(spark.read.parquet(path), "id", "class") == sorted((j + k, c) for j in range(i + 1) for k, c in ((0, "a"), (10, "b")))


def test_thresholds_from_json(spark):
    rows = tables.read_thresholds(spark, '{"cc": {"min": 0.5, "max": null, "description": "x"}}')
    assert tables.thresholds(rows) == {"cc": {"min": 0.5, "max": None}}


def test_context_windows_at_the_ends(frame):
    rows = frame([(0, i, float(i)) for i in range(6)], "s long, idx long, value double")
    loose = windows.context_windows(rows, rows, "s", 2, 1)
    assert pairs(loose, "anchor") == [(2,), (3,), (4,)]
    assert pairs(windows.context_windows(rows, rows, "s", 2, 1, strict=True), "anchor") == [(3,)]
    assert loose.where("anchor = 2").first()["context"] == [0.0, 1.0, 2.0, 3.0]


def test_forest_ranks_the_odd_row_first(frame):
    import random

    random.seed(5)
    rows = frame([(i, [random.gauss(0, 1), random.gauss(0, 1)]) for i in range(2000)] + [(9999, [9.0, -9.0])], "id long, x array<double>")
    forest = models.fit_isolation_forest(rows, "x", "id", trees=60, sample=128)
    scored = models.score_isolation_forest(rows, forest, "x")
    assert scored.orderBy("score").first()["id"] == 9999
    assert forest.select("tree").distinct().count() == 60 and scored.agg(F.max("score")).first()[0] < 0


def test_model_failure_stays_in_its_batch(frame):
    rows = frame([(i, [float(i)]) for i in range(6)], "id long, x array<double>", 1)

    def scorer(x):
        if (x == 3).any():
            raise RuntimeError("bad window")
        return x[:, 0]

    got = models.score_model(rows, scorer, "x", batch=1).orderBy("id").collect()
    assert [r["score"] for r in got] == [0, 1, 2, None, 4, 5] and got[3]["error"] == "RuntimeError: bad window"


def test_picks_an_array_column(frame):
    rows = frame([(1, [1.0], [2.0])], "y int, z array<double>, data array<double>")
    name, label = tables.pick_array_column(rows)
    assert name == "data" and rows.select(label).first()["label"] == 1
    with pytest.raises(ValueError):
        tables.pick_array_column(rows.select("y"))


def test_split_rows_is_stable(spark):
    rows = features.split_rows(spark.range(20_000), "id", 20)
    assert abs(rows.where("is_val").count() - 4_000) < 300
    far = spark.range(9_000_000_000_000_000_000, 9_000_000_000_000_002_000).withColumn("id", F.when(F.col("id") % 100 > 0, F.col("id")))
    one, two = (features.split_rows(far, "id", 20, seed=s).where("is_val") for s in (1, 2))
    assert 300 < one.count() < 500 and one.join(two, "id").count() < 0.4 * one.count() and one.where("id is null").count() == 0
    names = features.split_rows(spark.range(1000).selectExpr("concat('k', id) as k"), "k", 50)
    assert 400 < names.where("is_val").count() < 600


@pytest.fixture
def ranges(spark):
    """Ranges stay apart, however small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("most,margin", [(1 << 20, 0.005), (50, 5e-4)])
def test_narrowed_quantiles_are_exact(frame, monkeypatch, ranges, most, margin):
    import numpy as np
    from driftwatch.functions import quantiles as Q

    monkeypatch.setattr(Q, "MARGIN", margin)  # so small a margin misses, and widens
    monkeypatch.setattr(Q, "SIZE", 16)
    draw = np.random.default_rng(4)
    groups = {"a": draw.normal(size=3000), "b": draw.integers(0, 4, 900).astype(float), None: np.array([5.0]), "c": np.array([1.0, np.inf, -np.inf, 0.0, -0.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("none", None)]
    levels = {"low": 0.013, "mid": 0.5, "top": 1.0}
    got = {r["g"]: r for r in Q.quantiles(frame(rows, "g string, x double"), "x", levels, ["g"], most).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        if g != "c":
            assert [got[g][n] for n in levels] == pytest.approx([np.quantile(xs, q) for q in levels.values()], abs=1e-12)
    assert (got["c"]["mid"], got["c"]["top"]) == (0.0, float("inf"))
    every = Q.quantiles(frame(rows[:3900], "g string, x double"), "x", {"mid": 0.37}, most=most).first()["mid"]
    assert every == pytest.approx(np.quantile(np.concatenate([groups["a"], groups["b"]]), 0.37), abs=1e-12)
    assert Q.quantiles(frame([], "g string, x double"), "x", {"mid": 0.5}).count() == 0


@pytest.mark.parametrize("most", [100, 1 << 20])
def test_cuts_tell_longs_of_one_double_apart(spark, most):
    from driftwatch.functions import quantiles as Q

    far = 1 << 60  # 256 longs in a row are one double here
    rows = spark.range(far, far + 1000).selectExpr("id", "if(id % 2 = 0, 'a', null) as c").unionByName(spark.createDataFrame([(None, "a")], "id long, c string"))
    got = {r["c"]: r["cut"] - far for r in Q.cuts(rows, F.col("id"), lambda n: F.floor(n * 0.3), ["c"], most).collect()}
    assert got == {"a": 298, None: 299}
    assert sorted(r["id"] - far for r in Q.first_rows(rows, -F.col("id"), 3, most).collect()) == [997, 998, 999]
    assert Q.cuts(rows, F.col("id"), lambda n: n * 0, ["c"], most).count() == 0


def test_only_the_window_is_shuffled(spark):
    from driftwatch.functions import quantiles as Q

    rows = spark.range(400_000).select(F.rand(3).alias("_x"))
    windows = Q._narrowed(rows, {"t": lambda n: (n - 1) * 0.3}, [], 10_000).collect()
    assert len(windows) == 1 and windows[0]["_inside"] < 0.02 * 400_000
    assert windows[0]["_below"] == rows.where(F.col("_x") < windows[0]["_lo"]).count() and windows[0]["_below"] <= 0.3 * 399_999 < windows[0]["_below"] + windows[0]["_inside"]


def test_runs_touch_over_the_edges_of_ranges(frame, ranges):
    import random

    from driftwatch.functions import islands

    random.seed(8)
    rows = [(s, t, float(t % 7)) for s in ("a", "b", None) for t in random.sample(range(400), 300)] + [("a", 3, -1.0), ("long", None, 0.0)]
    rows += [("long", t, 1.0) for t in range(2000)]
    for gap in (1, 3):
        want = []
        for s in {r[0] for r in rows}:
            now = []
            for t, x in sorted((t, x) for k, t, x in rows if k == s and t is not None):
                if now and t - now[-1][0] > gap:
                    want.append((s, now[0][0], now[-1][0], len(now), min(v for _, v in now)))
                    now = []
                now.append((t, x))
            want.append((s, now[0][0], now[-1][0], len(now), min(v for _, v in now)))
        got = [tuple(r) for r in islands.runs(frame(rows, "s string, t long, x double"), ["s"], "t", gap, {"least": "x"}).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_no_window_over_a_whole_stream(frame):
    low = frame([("a", 1.0, 0.5)], "s string, t double, score double")
    plan = scores.cluster_outliers(low, 16, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" not in plan and plan.count("Window ") == 2  # over edges only: what is within ranges is written already


@pytest.mark.parametrize("lists", [1, 3])
def test_sweeps_equal_second_by_second(frame, ranges, lists):
    import random

    random.seed(lists)
    rows = []
    for i in range(lists):
        t = 0
        while t < 300:
            rows.append((f"d{i}", t, t := t + random.randrange(1, 60)))
            t += random.choice([0, 0, 3, 11])
    rows += [("d0", 50, 50), ("other", 0, 400)]
    own = [r for r in rows if r[0] != "other" and r[1] < r[2]]
    on = [s for s in range(400) if all(any(n == f"d{i}" and a <= s < b for n, a, b in own) for i in range(lists))]
    bounds = {x for _, a, b in own for x in (a, b)}
    want, start = [], None
    for s in on:
        if start is None or s in bounds or s - 1 not in on:
            start = s
            want.append([s, s + 1])
        want[-1][1] = s + 1
    got = pairs(intervals.intersect_all(frame(rows, "ifo string, start long, stop long"), [f"d{i}" for i in range(lists)]), "start", "stop")
    assert got == [tuple(w) for w in want]


def test_stratified_places_and_classes_by_range(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'a', if(id < 990, 'b', null)) as c")
    got = features.split_stratified(rows, "c", -F.col("id"), 0.3)
    assert got.columns == ["id", "c", "is_val"]
    assert {r["c"]: (r["n"], r["low"]) for r in got.where("is_val").groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()} == {
        "a": (270, 630), "b": (27, 963), None: (3, 997),
    }


def test_curves_of_classes_beside_one_background(frame):
    rows = frame([("n", 1.0), ("n", 2.0), ("a", 1.5), ("a", 3.0), ("b", 2.0)], "c string, x double")
    got = {r["against"]: r["auc"] for r in efficiency.roc_auc(efficiency.roc_by_class(rows, "x", "c", ["n"]), "against").collect()}
    assert got == pytest.approx({"a": 0.75, "b": 0.75})


def test_density_in_blocks(frame):
    import numpy as np
    from driftwatch.operators import models

    points = np.random.default_rng(2).normal(size=(30, 3))
    rows = frame([(i, x.tolist()) for i, x in enumerate(points)], "i int, x array<double>")
    want = [-np.log(np.mean(np.exp(-((x - points) ** 2).sum(1) / 0.5)) / (2 * np.pi * 0.25) ** 1.5) for x in points]
    for most in (7, 100):
        got = models.score_kde(rows, rows, "x", most=most).orderBy("i").collect()
        assert [r["score"] for r in got] == pytest.approx(want)
    assert models.score_kde(rows, rows.limit(0), "x").where("score is not null").count() == 0
    far = rows.withColumn("x", F.transform("x", lambda v: v * 300))  # sums of kernels beyond a double's range
    alone = models.score_kde(far, far, "x", bandwidth=1.0, most=4).agg(F.min("score"), F.max("score")).first()
    assert alone[0] == pytest.approx(alone[1]) and 6 < alone[0] < 6.2
    away = models.score_kde(far, rows, "x", bandwidth=1.0, most=4).orderBy("i").collect()
    squares = [((300 * x - points) ** 2).sum(1) / 2 for x in points]
    assert [r["score"] for r in away] == pytest.approx([s.min() - np.log(np.exp(s.min() - s).sum()) + np.log(30) + 1.5 * np.log(2 * np.pi) for s in squares])


def test_density_shuffles_the_copies_of_blocks(frame, spark, monkeypatch):
    """Copies of the background aren't broadcast, and a grid of several groups a side gives the same densities."""
    import contextlib
    import io

    import numpy as np
    from driftwatch.operators import models

    points = np.random.default_rng(3).normal(size=(60, 2))
    rows = frame([(i, x.tolist()) for i, x in enumerate(points)], "i int, x array<double>")
    whole = [r["score"] for r in models.score_kde(rows, rows, "x").orderBy("i").collect()]
    monkeypatch.setattr(models, "HELD", 5 * 2 * 8 * 6, raising=False)
    got, text = models.score_kde(rows, rows, "x", most=5), io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert "SortMergeJoin [row_group" in text.getvalue() and "BroadcastHashJoin [group" not in text.getvalue()
    assert [r["score"] for r in got.orderBy("i").collect()] == pytest.approx(whole)


def test_models_over_nulls_and_without_background(frame, spark):
    rows = frame([(1, [0.1, 0.2]), (2, None), (3, [0.1, None]), (4, [0.3]), (5, []), (6, [float("nan"), 1.0]), (7, [0.1, 0.2])], "id long, x array<double>")
    none = spark.createDataFrame([], "id long, x array<double>")
    kde = {r["id"]: r["score"] for r in models.score_kde(rows, rows, "x").collect()}
    assert {i for i, v in kde.items() if v is not None} == {1, 7} and kde[1] == kde[7]
    forest = models.fit_isolation_forest(rows.where("id in (1, 2, 3, 7)"), "x", "id", trees=5)
    got = {r["id"]: r["score"] for r in models.score_isolation_forest(rows, forest, "x").collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and got[6] is None
    assert models.score_isolation_forest(rows, models.fit_isolation_forest(none, "x", "id", trees=5), "x").where("score is not null").count() == 0
    assert models.score_kde(none, rows, "x").count() == 0
    got = {r["id"]: (r["score"], r["error"]) for r in models.score_model(rows, lambda x: x.sum(1), "x").collect()}
    assert got[1][1] is None and got[4] == (0.3, None) and got[2][0] is None and got[5][1].startswith("ValueError")


def test_forest_scores_equal_a_recursive_walk(frame):
    import numpy as np
    from driftwatch.operators import models

    points = np.random.default_rng(3).normal(size=(400, 3))
    rows = frame([(i, x.tolist()) for i, x in enumerate(points)], "i long, x array<double>")
    forest = models.fit_isolation_forest(rows, "x", "i", trees=15, sample=64)
    nodes = {(r["tree"], r["node"]): r for r in forest.collect()}
    common = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def depth(x, tree, node=0):
        r = nodes[tree, node]
        return common(r["size"]) if r["feature"] < 0 else 1 + depth(x, tree, r["left"] if x[r["feature"]] <= r["split"] else r["right"])

    assert len({t for t, _ in nodes}) == 15 and {r["size"] for (_, n), r in nodes.items() if n == 0} == {64}
    got = models.score_isolation_forest(rows, forest, "x").orderBy("i").collect()
    for r, x in zip(got[:40], points, strict=False):
        assert r["score"] == pytest.approx(-(2 ** (-np.mean([depth(x, t) for t in range(15)]) / common(64))))


def test_files_beyond_the_times_are_not_opened(spark, frame, tmp_path):
    from driftwatch.sources import spanned

    frame([(1, 0.5), (2, 1.5)], "idx long, score double", 1).coalesce(1).write.parquet(f"{tmp_path}/H1-1234567890-64")
    for name in ("H1-1234567954-64", "L1-1234568018.5-10_3", "notes"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.parquet").write_text("this is no Parquet file")
    rows = spanned.read_spanned(spark, str(tmp_path), "idx long, score double")
    early = rows.where("stop <= 1234567954 and score > 1")
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in early.collect()] == [(1234567890.0, 1234567954.0, None, False, 2, 1.5)]
    assert "Filter" in plan and "stop" not in plan.split("Filter", 1)[1].split("\n")[0]  # Spark filters by score only
    assert [r["path"].split("/")[-2] for r in rows.where("rejected").collect()] == ["notes"]
    files = spanned.read_spanned(spark, str(tmp_path))
    assert sorted((r["t0"] or 0, r["rejected"]) for r in files.collect()) == [(0, True), (1234567890.0, False), (1234567954.0, False), (1234568018.5, False)]
    assert spanned.read_spanned(spark, str(tmp_path)).where("t0 > 2e9").count() == 0


def test_scratch_folders_go_with_what_was_written_within(spark, frame):
    import os

    rows = frame([(float(i),) for i in range(100)], "x double")
    outside = materialize(rows, "kept")
    with scratch(spark) as folder:
        kept = [r["threshold"] for r in scores.threshold(rows, 0.5, "x").collect()]
        assert materialize(rows, "gone").count() == 100 and os.listdir(folder)
        with scratch(spark) as inner:
            assert inner.startswith(folder) and fresh_path(spark, "x").startswith(inner)
        assert fresh_path(spark, "x").startswith(folder) and not fresh_path(spark, "x").startswith(inner)
    assert kept == [49.5] and not os.path.exists(folder) and outside.count() == 100
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        materialize(rows, "gone").count() / 0
    assert not os.path.exists(folder) and fresh_path(spark, "x").rpartition("/")[0] == shared_folder(spark)
    remove(spark, folder)  # again, of nothing
