"""Live operators over updates that come out of order and in several batches."""

from pyspark.sql import functions as F

from driftwatch.session import fresh_path
from driftwatch.streaming import streams


def fed(spark, rows, schema, of, name):
    """Runs ``of`` over batches of rows that arrive one after the other, with the state kept in between."""
    path, live = fresh_path(spark, "in"), fresh_path(spark, "live")
    out = None
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        out = streams.run_once(of(source), name, spark, live)
    return out


def test_snapshots_wait_for_earlier_requests(spark):
    schema = "sequence_id long, request_id long, samples array<double>, is_end boolean"
    batches = [[(1, 1, [3.0, 4.0], None), (2, 0, [9.0], True)], [(1, 0, [1.0, 2.0], False), (2, 0, [8.0], True)], [(1, 2, [5.0], False)]]
    got = fed(spark, batches, schema, lambda s: streams.snapshot_stream(s, 3), "snap").orderBy("sequence_id", "request_id").collect()
    assert sorted((r["sequence_id"], r["request_id"], r["first"], r["n_new"], r["samples"]) for r in got) == [
        (1, 0, 0, 2, [1.0, 2.0]), (1, 1, 0, 2, [1.0, 2.0, 3.0, 4.0]), (1, 2, 1, 1, [2.0, 3.0, 4.0, 5.0]), (2, 0, 0, 1, [8.0]), (2, 0, 0, 1, [9.0]),
    ]


def test_tails_over_many_batches_and_idle_sequences(spark, monkeypatch):
    from datetime import datetime, timedelta

    monkeypatch.setattr(streams, "SPARE", 5)
    t, schema = datetime(2024, 1, 1), "sequence_id long, request_id long, samples array<double>, is_end boolean, ts timestamp"
    x = [[float(10 * i + j) for j in range(i % 4)] for i in range(12)]
    order = [0, 3, 1, 5, 4, 2, 2, 6, 8, 7, 9, 11]  # request 2 comes twice, 10 never
    batches = [[(1, i, x[i], None, t) for i in order[k : k + 4]] for k in range(0, 12, 4)]
    batches += [[(2, 0, None, True, t + timedelta(days=3))], [(1, 0, [7.0], True, t + timedelta(days=6))]]  # the first sequence is idle for long
    got = fed(spark, batches, schema, lambda s: streams.snapshot_stream(s, 6, "ts"), "tails").where("sequence_id < 3")
    want, seen = [], []
    for i in range(10):
        tail = seen[-6:]
        want.append((1, i, len(seen) - len(tail), len(x[i]), tail + x[i]))
        seen += x[i]
    want += [(2, 0, 0, 0, []), (1, 0, 0, 1, [7.0])]
    assert sorted((r["sequence_id"], r["request_id"], r["first"], r["n_new"], r["samples"]) for r in got.collect()) == sorted(want)


def test_assembly_and_its_timeout(spark):
    from datetime import datetime, timedelta

    schema = "sequence_id long, request_id long, is_end boolean, n_pad int, scores array<double>, ts timestamp"
    t = datetime(2024, 1, 1)
    batches = [
        [(1, 1, True, 1, [3.0, 4.0], t), (2, 0, False, 0, [7.0], t)],
        [(1, 0, False, 0, [1.0, 2.0], t)],
        [(3, 0, True, 0, [5.0], t + timedelta(days=3))],
        [(4, 0, True, 0, [6.0], t + timedelta(days=6))],
    ]
    got = fed(spark, batches, schema, streams.ordered_assembly, "whole").orderBy("sequence_id").collect()
    pieces = fed(spark, batches[:2], schema, lambda s: streams.ordered_assembly(s, most_pad=1), "pieces").where("sequence_id = 1").orderBy("first").collect()
    assert [(r["first"], r["scores"], r["complete"]) for r in pieces] == [(0, [1.0, 2.0, 3.0], True)]
    early = [[(1, 0, False, 0, [1.0, 2.0, 3.0], t)], [(1, 1, True, 1, [4.0], t)]]
    pieces = fed(spark, early, schema, lambda s: streams.ordered_assembly(s, most_pad=1), "pieces").orderBy("first").collect()
    assert [(r["first"], r["scores"], r["complete"]) for r in pieces] == [(0, [1.0, 2.0], None), (2, [3.0], True)]
    assert [(r["sequence_id"], r["scores"], r["complete"]) for r in got] == [
        (1, [1.0, 2.0, 3.0], True), (2, [7.0], False), (3, [5.0], True), (4, [6.0], True),
    ]


def test_sessions_merge_at_the_gap(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [[("a", t + timedelta(seconds=s), 0.0) for s in (0, 16, 33, 34)] + [("a", t + timedelta(days=1), 0.0), ("a", t, 9.0)], [("b", t + timedelta(days=2), 0.0)]]
    got = fed(spark, rows, "k string, ts timestamp, score double", lambda s: streams.stream_outliers(s, 1.0, "16 seconds", "1 hour", "k"), "sessions")
    spans = sorted((r["first"].timestamp() - t.timestamp(), r["n"]) for r in got.where(F.col("k") == "a").collect())
    assert [n for _, n in spans][:2] == [2, 2]


def test_windows_of_whitened_snapshots_equal_brute_force(spark):
    import numpy as np

    from driftwatch.functions import spectra

    x, rate = np.random.default_rng(5).normal(size=200), 64.0
    prepare = streams.whitening(rate, 32, 16, 0.125, 2.0, 30.0, 9)
    rows = [(1, i, x[8 * i : 8 * i + 8].tolist(), i == 24) for i in range(25)]
    schema, keep = "sequence_id long, request_id long, samples array<double>, is_end boolean", 64
    of = lambda s: streams.stream_windows(streams.snapshot_stream(s, keep), 16, 4, lambda w: np.abs(w).max(1), prepare)
    got = {r["start"]: r["score"] for r in fed(spark, [rows[12:], rows[:12]], schema, of, "white").collect()}
    want = {}
    for upto in range(8, 201, 8):
        seen = x[max(0, upto - 8 - keep) : upto]
        first = upto - len(seen)
        if len(seen) > 32 + 9:
            white = spectra.whiten(spectra.bandpass(seen[32:], rate, 2.0, 30.0, 9), spectra.psd(seen[:32], rate, 16), rate, 0.125, 2.0)
            for s in range(0, 200, 4):
                at = s - first - 36
                if 0 <= at and at + 16 <= len(white) and s not in want:
                    w = white[at : at + 16]
                    want[s] = np.abs(w / w.std(ddof=1)).max()
    assert got.keys() == want.keys() and len(got) > 30
    assert all(abs(got[s] - want[s]) < 1e-9 for s in got)


def test_outliers_within_the_second_of_the_watermark(spark, tmp_path):
    """A session that ends in the watermark's second, before or behind it, is still open by the SQL; one of a second before is not."""
    import duckdb
    from oracle import assert_same

    from driftwatch.plans import catalogue

    con = duckdb.connect()
    spans = "(1, 0.1), (2, 0.9), (3, -0.1), (3, -21600.1), (4, 1.0), (5, 25200.5)"
    con.sql(f"CREATE TABLE events AS SELECT u::BIGINT AS user_id, TIMESTAMP '2024-01-02' + to_microseconds((s * 1e6)::BIGINT) AS ts, 1.5::DOUBLE AS value FROM (VALUES {spans}) t(u, s)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalogue.queries()["live_outliers"](spark, str(tmp_path))
    assert_same(df, con.sql(catalogue.oracle_sql()["live_outliers"]))
    assert [r["user_id"] for r in df.collect()] == [3]
