"""Interval algebra and joins on time.

Range joins are equi-joins on time buckets: each row is filed under every bucket
it touches and a pair is found in the first bucket that both share, so no pair
appears twice and nothing has to be made distinct. ``width`` is a bucket's
length; about the usual length of the intervals is right. A row longer than
that only costs more buckets. Where only the best or any of the rows that a row
overlaps is wanted, no pairs are made: both sides of a bucket are put in order and
a running maximum tells. Where whole lists of segments meet, their bounds are
swept instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.islands import runs
from driftwatch.session import materialize


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def range_join(
    left: DataFrame,
    right: DataFrame,
    width: float,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    keys: list[str] | None = None,
    closed: bool = False,
) -> DataFrame:
    """Pairs of rows whose spans overlap: ``ls < rt and rs < lt``, with ``<=`` where ``closed``.

    Spans are columns of each side; all columns but ``keys`` must have different names.
    """
    (ls, lt), (rs, rt), keys = left_span, right_span, keys or []
    filed = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(a), width), _bucket(F.col(b), width))))
    pairs = filed(left.where(F.col(ls) <= F.col(lt)), ls, lt).join(
        filed(right.where(F.col(rs) <= F.col(rt)), rs, rt), ["_bucket", *keys]
    )
    first = F.col("_bucket") == F.greatest(_bucket(F.col(ls), width), _bucket(F.col(rs), width))
    meets = (F.col(ls) <= F.col(rt)) & (F.col(rs) <= F.col(lt)) if closed else (F.col(ls) < F.col(rt)) & (F.col(rs) < F.col(lt))
    return pairs.where(first & meets).drop("_bucket")


def overlapping(probes: DataFrame, marks: DataFrame, width: float, span: tuple[str, str], mark: tuple[str, str]) -> DataFrame:
    """The rows of ``probes`` whose span overlaps any of ``marks``, ``ps < mt and ms < pt``; a row comes once for each bucket in which it does.

    In a bucket, the latest end of the marks that begin before a probe ends is a running maximum: work grows with the rows, not with the pairs.
    """
    (ps, pt), (ms, mt) = span, mark
    filed = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(a), width), _bucket(F.col(b), width))))
    asked = filed(probes.where(F.col(ps) <= F.col(pt)), ps, pt).withColumns({"_at": F.col(pt), "_is": F.lit(0)})
    known = filed(marks.where(F.col(ms) <= F.col(mt)), ms, mt).select("_bucket", F.col(ms).alias("_at"), F.lit(1).alias("_is"), F.col(mt).alias("_end"))
    upto = Window.partitionBy("_bucket").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_end", F.max("_end").over(upto))
    return both.where((F.col("_is") == 0) & (F.col(ps) < F.col("_end"))).select(*probes.columns)


def best_touched(spans: DataFrame, marks: DataFrame, width: float) -> DataFrame:
    """``(_window, _best)`` of the spans ``(_window, _from, _to)`` that overlap marks ``(_low, _high, _best)``; the largest ``_best`` of a span is in one of its rows.

    Spans have one length and marks have one, and ``width`` is both together. So the marks that a span overlaps follow each other in time: of the first bucket that it reaches
    they are the last ones, of the others the first ones. Both are running maxima: work grows with the rows, not with the pairs.
    """
    size = 0.75 * width  # all marks of a span's first bucket begin before it ends
    known = marks.where((F.col("_low") <= F.col("_high")) & ~F.isnan("_low")).withColumn("_bucket", _bucket(F.col("_high"), size))
    asked = spans.where((F.col("_from") <= F.col("_to")) & ~F.isnan("_from")).withColumn("_first", _bucket(F.col("_from"), size))
    asked = asked.withColumn("_bucket", F.explode(F.sequence("_first", _bucket(F.col("_from") + 1.125 * width, size))))
    late = F.col("_bucket") == F.col("_first")
    probes = asked.select("_window", "_bucket", late.alias("_late"), F.when(late, -F.col("_from")).otherwise(F.col("_to")).alias("_at"), F.lit(0).alias("_is"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("_late"), (-F.col("_high")).alias("_at")), F.struct(F.lit(False).alias("_late"), F.col("_low").alias("_at"))))
    twice = known.withColumn("_s", sides).select("_bucket", "_s._late", "_s._at", F.lit(1).alias("_is"), "_best")
    upto = Window.partitionBy("_bucket", "_late").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    both = probes.unionByName(twice, allowMissingColumns=True).withColumn("_best", F.max("_best").over(upto))
    return both.where((F.col("_is") == 0) & F.col("_best").isNotNull()).select("_window", "_best")


def sweep(segments: DataFrame, lists: list[Column]) -> DataFrame:
    """The spans ``[start, stop)`` in which a segment of every list is on, broken at every bound of a segment; ``lists`` says of a segment whether it is in each.

    Each segment is two events, so its length doesn't matter. Events are added up by time and dealt out by ranges of it; how many segments of each list are on is what earlier ranges add up
    to, and what their own do. A task sees its range alone, and the number of lists doesn't add passes. Empty segments are nothing.
    """
    on = [F.when(of, 1).otherwise(0).alias(f"_d{i}") for i, of in enumerate(lists)]
    names = [f"_d{i}" for i in range(len(lists))]
    some = segments.where("start < stop").select("start", "stop", *on)
    events = some.select(F.col("start").alias("_t"), *names).unionByName(some.select(F.col("stop").alias("_t"), *[(-F.col(n)).alias(n) for n in names]))
    summed = events.groupBy("_t").agg(*[F.sum(n).alias(n) for n in names])
    dealt = materialize(summed.repartitionByRange("_t").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(F.min("_t").alias("_first"), *[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("_range", F.lead("_first").over(order).alias("_then"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b{n}") for n in names])
    inner = Window.partitionBy("_range").orderBy("_t")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce(F.lead("_t").over(inner), F.col("_then")).alias("stop")
    sums = [(F.col(f"_b{n}") + F.sum(n).over(upto)).alias(n) for n in names]
    spans = dealt.join(F.broadcast(bases), "_range").select(F.col("_t").alias("start"), stop, *sums)
    return spans.where(reduce(lambda a, n: a & (F.col(n) > 0), names, F.lit(True))).select("start", "stop")


def intersect_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """All spans ``[start, stop)`` that both lists of segments have, broken at every bound of a segment; segments that only touch have none in common."""
    both = a.select("start", "stop", F.lit(0).alias("_list")).unionByName(b.select("start", "stop", F.lit(1).alias("_list")))
    return sweep(both, [F.col("_list") == 0, F.col("_list") == 1])


def intersect_all(segments: DataFrame, detectors: list[str], by: str = "ifo") -> DataFrame:
    """The spans in which all detectors are on, broken at every bound of a segment of one of them. Any number of detectors is one sweep."""
    return sweep(segments.where(F.col(by).isin(*detectors)), [F.col(by) == name for name in detectors])


def livetime(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The number of segments and their total seconds."""
    return segments.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("seconds"))


def min_duration(segments: DataFrame, seconds: float) -> DataFrame:
    """Segments longer than ``seconds``."""
    return segments.where(F.col("stop") - F.col("start") > seconds)


def merge_hours(rows: DataFrame, by: str, hour: str = "hour") -> DataFrame:
    """Runs of consecutive hours of each ``by`` as segments of seconds."""
    found = runs(rows.select(by, hour).distinct(), [by], hour, 1)
    return found.select(by, (F.col("first") * 3600).alias("start"), ((F.col("last") + 1) * 3600).alias("stop"))


def match_triggers(injections: DataFrame, triggers: DataFrame, within: float, key: str = "injection_id", time: str = "time") -> DataFrame:
    """Injections with ``recovered``: whether any trigger lies at most ``within`` seconds away, bounds included."""
    bucket = _bucket(F.col(time), within)
    near = injections.select(key, F.col(time).alias("_t")).withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col("_t"), within) - 1, _bucket(F.col("_t"), within) + 1))
    )
    seen = triggers.select(F.col(time).alias("_s"), bucket.alias("_bucket"))
    hit = near.join(seen, (near._bucket == seen._bucket) & (F.abs(near._t - seen._s) <= within), "left_semi").select(F.col(key).alias("_hit")).distinct()
    return injections.join(hit, F.col(key) == F.col("_hit"), "left").withColumn("recovered", F.col("_hit").isNotNull()).drop("_hit")


def label_windows(
    windows: DataFrame, injections: DataFrame, kernel: float, pad: float, window: str = "window_id", time: str = "gps"
) -> DataFrame:
    """Windows with ``has_injection`` and ``inj_type`` of the last injection, by ``inj_order``, that they touch.

    A window ``[gps, gps + kernel)`` touches ``[time - pad, time + pad]`` strictly on both sides.
    """
    spans = windows.select(F.col(window).alias("_window"), F.col(time).alias("_from"), (F.col(time) + kernel).alias("_to"))
    best = F.struct("inj_order", F.when(F.col("inj_order").isNotNull(), F.col("inj_type")).alias("inj_type"))
    marks = injections.select((F.col("time") - pad).alias("_low"), (F.col("time") + pad).alias("_high"), best.alias("_best"))
    hits = best_touched(spans, marks, kernel + 2 * pad)
    found = hits.groupBy("_window").agg(F.max("_best")["inj_type"].alias("inj_type"))
    out = windows.join(found, F.col(window) == F.col("_window"), "left")
    return out.withColumn("has_injection", F.col("_window").isNotNull()).drop("_window")


def touched_injections(windows: DataFrame, injections: DataFrame, kernel: float, pad: float, time: str = "gps") -> DataFrame:
    """How many injections touch at least one window."""
    spans = windows.select(F.col(time).alias("_from"), (F.col(time) + kernel).alias("_to"))
    marks = injections.select("inj_order", (F.col("time") - pad).alias("_low"), (F.col("time") + pad).alias("_high"))
    hits = overlapping(marks, spans, kernel + 2 * pad, ("_low", "_high"), ("_from", "_to"))
    return hits.select("inj_order").distinct().agg(F.count("*").alias("n_touched"))


def split_by_triggers(windows: DataFrame, triggers: DataFrame, clean: bool, width: float, window: str = "window_id") -> DataFrame:
    """Windows away from all triggers (``clean``) or on one: ``tstart < stop and tend > start``."""
    spans = windows.select(F.col(window).alias("_window"), F.col("start").alias("_from"), F.col("stop").alias("_to"))
    hit = overlapping(spans, triggers, width, ("_from", "_to"), ("tstart", "tend")).select("_window").distinct()
    return windows.join(hit, F.col(window) == F.col("_window"), "left_anti" if clean else "left_semi")


def slide_pairs(a: DataFrame, b: DataFrame, shifts: DataFrame, rate: int, by: str = "segment") -> DataFrame:
    """Samples of one detector beside those of another ``shift`` seconds later, for each shift.

    The few shifts are broadcast and move keys only; ``a`` and ``b`` are ``(segment, idx, value)``.
    """
    moved = a.crossJoin(F.broadcast(shifts.select("shift"))).select(
        by, "shift", F.col("idx").alias("idx_a"), F.col("value").alias("value_a"), (F.col("idx") + F.col("shift") * rate).cast("long").alias("idx_b")
    )
    return moved.join(b.select(by, F.col("idx").alias("idx_b"), F.col("value").alias("value_b")), [by, "idx_b"])


def fetch_chunks(outliers: DataFrame, strain: DataFrame, lead: float, length: float, rate: int, chunk: int) -> DataFrame:
    """For each outlier and detector the samples from ``start - t0 - lead`` on, ``length`` seconds, as one array.

    ``strain`` is ``(t0, ifo, chunk_id, samples)`` with ``chunk`` samples in each row; a detector's ``delay`` column of
    ``outliers`` moves its window. The outliers ask for chunks by id, so the join is an equi-join.
    """
    first = F.greatest(F.lit(0), F.round((F.col("start") - F.col("t0") - lead + F.col("delay")) * rate)).cast("long")
    wanted = outliers.withColumn("_first", first).withColumn("_last", F.col("_first") + int(length * rate) - 1)
    ids = F.sequence((F.col("_first") / chunk).cast("long"), (F.col("_last") / chunk).cast("long"))
    keyed = wanted.withColumn("chunk_id", F.explode(ids)).join(strain, ["t0", "ifo", "chunk_id"])
    gathered = keyed.groupBy("outlier_id", "ifo").agg(
        F.min("chunk_id").alias("_c"), F.min("_first").alias("_first"), F.array_sort(F.collect_list(F.struct("chunk_id", "samples"))).alias("_parts")
    )
    flat = F.flatten(F.transform("_parts", lambda p: p["samples"]))
    begin = (F.col("_first") - F.col("_c") * chunk + 1).cast("int")
    return gathered.select("outlier_id", "ifo", F.slice(flat, begin, F.lit(int(length * rate))).alias("samples"))
