"""Live forms of the jobs, on Structured Streaming with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from driftwatch.functions import spectra

SNAPSHOT = "sequence_id long, request_id long, first long, n_new int, samples array<double>"
ASSEMBLED = "sequence_id long, first long, scores array<double>, complete boolean"


#: The provider that list, map and timer state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples of a list that no reader needs any more, from which on it is written anew.
SPARE = 1024


class _Ordered(StatefulProcessor):
    """Requests of a key taken in order of their number: what comes early waits in a map, samples that are still needed are a list of pieces, a timer ends idle keys.

    Samples are bytes of doubles throughout. A piece is appended to the list; of its first samples, ``skip`` are no longer needed, and once
    they are many the list is written anew without them, so that a sample is rewritten once or so.
    """

    names: tuple[str, ...]

    def __init__(self, keep: int, timed: bool, idle_ms: int):
        self.keep, self.timed, self.idle_ms = keep, timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "done long, upto long, last long, pad long, seen long, timer long, waiting long, held long, skip long")
        self.pieces = handle.getListState("pieces", "x binary")
        self.early = handle.getMapState("early", "request long", "x binary")

    def close(self) -> None:
        pass

    def forget(self, timer: int) -> None:
        for state in (self.meta, self.pieces, self.early):
            state.clear()
        if timer >= 0 and self.timed:
            self.handle.deleteTimer(timer)

    def held(self, skip: int) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.frombuffer(x) for (x,) in self.pieces.get())])[skip:]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, upto, end, pad, seen, timer, waiting, held, skip = self.meta.get() if self.meta.exists() else (0, 0, -1, 0, 0, -1, 0, 0, 0)
        come: dict[int, np.ndarray] = {}
        for frame in rows:
            for request, x, is_end, n_pad, at in zip(*(frame[c] for c in ("request", "x", "ends", "pad", "ms")), strict=True):
                if request >= upto:
                    come[int(request)] = np.zeros(0) if x is None else np.asarray(x, float)
                    if is_end:
                        end, pad = int(request), int(n_pad)
                seen = max(seen, int(at))
        before, ready = self.held(skip) if held else np.zeros(0), []
        while True:
            if upto in come:
                new = come.pop(upto)
                if waiting and self.early.containsKey((upto,)):  # the later one of a request counts
                    self.early.removeKey((upto,))
                    waiting -= 1
            elif waiting and self.early.containsKey((upto,)):
                new = np.frombuffer(self.early.getValue((upto,))[0])
                self.early.removeKey((upto,))
                waiting -= 1
            else:
                break
            ready.append((upto, new))
            upto += 1
        for request, x in come.items():
            waiting += not self.early.containsKey((request,))
            self.early.updateValue((request,), (x.tobytes(),))
        over = 0 <= end < upto
        out, needed = self.made(key[0], before, ready, done, pad, over)
        if over:
            self.forget(timer)
        else:
            samples = np.concatenate([np.zeros(0), *(x for _, x in ready)])
            skip, held = skip + len(before) + len(samples) - needed, needed
            if skip >= max(SPARE, self.keep):
                self.pieces.put([(np.concatenate([before, samples])[len(before) + len(samples) - needed :].tobytes(),)] if needed else [])
                skip = 0
            elif len(samples):
                self.pieces.appendValue((samples.tobytes(),))
            if self.timed:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                timer = max(seen, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
                self.handle.registerTimer(timer)
            self.meta.update((self.first_held(done, before, samples, needed), upto, end, pad, seen, timer, waiting, held, skip))
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self.left(key[0])
        self.forget(-1)
        yield out

    def first_held(self, done: int, before: np.ndarray, samples: np.ndarray, needed: int) -> int:
        """What ``done`` is next time."""
        raise NotImplementedError

    def made(self, key, before: np.ndarray, ready: list[tuple[int, np.ndarray]], done: int, pad: int, over: bool) -> tuple[pd.DataFrame, int]:
        """The rows of what came in order, and how many of the last samples are still needed."""
        raise NotImplementedError

    def left(self, key) -> pd.DataFrame:
        """The rows of a key whose timer has expired."""
        return pd.DataFrame([], columns=list(self.names))


class _Snapshots(_Ordered):
    """``done`` counts all samples that came in order."""

    names = ("sequence_id", "request_id", "first", "n_new", "samples")

    def first_held(self, done: int, before: np.ndarray, samples: np.ndarray, needed: int) -> int:
        return done + len(samples)

    def made(self, key, before, ready, done, pad, over):
        out = []
        for request, new in ready:
            whole = np.concatenate([before, new])
            out.append((key, request, done - len(before), len(new), whole))
            done += len(new)
            before = whole[len(whole) - min(self.keep, len(whole)) :]
        return pd.DataFrame(out, columns=list(self.names)), len(before)


class _Assembly(_Ordered):
    """``done`` counts the scores that are out."""

    names = ("sequence_id", "first", "scores", "complete")

    def first_held(self, done: int, before: np.ndarray, samples: np.ndarray, needed: int) -> int:
        return done + len(before) + len(samples) - needed

    def piece(self, key, first: int, scores: np.ndarray, complete: bool | None) -> pd.DataFrame:
        out = pd.DataFrame([(key, first, scores)], columns=["sequence_id", "first", "scores"])
        return out.assign(complete=pd.array([complete], dtype="boolean"))

    def made(self, key, before, ready, done, pad, over):
        whole = np.concatenate([before, *(x for _, x in ready)])
        if over:
            return self.piece(key, done, whole[: max(0, len(whole) - pad)], True), 0
        needed = min(self.keep, len(whole))
        out = self.piece(key, done, whole[: len(whole) - needed], None)
        return (out if len(whole) > needed else out.iloc[:0]), needed

    def left(self, key) -> pd.DataFrame:
        done, skip = (self.meta.get()[i] for i in (0, 8)) if self.meta.exists() else (0, 0)
        late = sorted((r, x) for (r,), (x,) in self.early.iterator())
        return self.piece(key, done, np.concatenate([self.held(skip), *(np.frombuffer(x) for _, x in late)]), False)


def _with_state(updates: DataFrame, processor: _Ordered, schema: str, samples: str, pad: Column, time: str | None, late: str) -> DataFrame:
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    marked = updates.withWatermark(time, late) if time else updates
    ms = F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0)) if time else F.lit(0)
    x = F.transform(samples, lambda v: v.cast("double"))
    own = [F.col("request_id").alias("request"), x.alias("x"), F.coalesce("is_end", F.lit(False)).cast("boolean").alias("ends"), F.coalesce(pad, F.lit(0)).alias("pad"), ms.cast("long").alias("ms")]
    rows = marked.where(F.col("request_id").isNotNull()).select("sequence_id", *own, *([F.col(time).alias("at")] if time else []))
    return rows.groupBy("sequence_id").transformWithStateInPandas(processor, schema, "Append", "EventTime" if time else "None")


def snapshot_stream(updates: DataFrame, keep: int, time: str | None = None, late: str = "1 hour", idle_ms: int = 60_000_000) -> DataFrame:
    """Each update ``(sequence_id, request_id, samples, is_end)`` with the last ``keep`` samples of its sequence before it.

    Requests are taken in order of ``request_id``; one that comes early waits in the state for those before it. The first
    update of a sequence has nothing before it. ``first`` is the number of the first sample that is emitted, ``n_new`` how many are new.
    The state of a sequence goes with the update flagged ``is_end``, a null flag being none, or, if updates have a ``time``, once the watermark has
    left its last update ``idle_ms`` behind. Null samples are none; a null ``request_id`` is nothing. The session's state stores are set to RocksDB.
    """
    return _with_state(updates, _Snapshots(keep, time is not None, idle_ms), SNAPSHOT, "samples", F.lit(0), time, late)


def ordered_assembly(replies: DataFrame, most_pad: int = 1024, idle_ms: int = 60_000_000, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Replies ``(sequence_id, request_id, is_end, n_pad, scores, ts)`` put in order, in pieces that follow each other as ``first`` tells.

    What is in order is emitted at once, but for the last ``most_pad`` scores: the reply flagged ``is_end`` tells how many of these come from
    padding and are cut off. So the state holds these and the replies that wait for earlier ones, not the sequence. The last piece of
    a sequence has ``complete``: true, or false where the watermark has left its last reply ``idle_ms`` behind; what then waits is emitted as it is.
    """
    return _with_state(replies, _Assembly(most_pad, True, idle_ms), ASSEMBLED, "scores", F.col("n_pad"), time, late)


def whitening(rate: float, psd_samples: int, size: int, duration: float, low: float | None = None, high: float | None = None, taps: int = 0) -> Callable[[np.ndarray], tuple[np.ndarray, int, int]]:
    """How ``stream_windows`` prepares a snapshot: its first samples give the spectrum, the others are band-passed (where a band is given) and whitened.

    It returns the series with how many samples are lost before and behind it.
    """
    half = int(duration * rate) // 2

    def prepared(x: np.ndarray) -> tuple[np.ndarray, int, int]:
        before, data = x[:psd_samples], x[psd_samples:]
        if len(before) < psd_samples or len(data) <= 2 * half + 1:
            return x[:0], psd_samples + half, half
        power = spectra.psd(before, rate, size)
        if high is not None:
            data = spectra.bandpass(data, rate, low, high, taps)
        return spectra.whiten(data, power, rate, duration, low or 0.0), psd_samples + half, half

    return prepared


def stream_windows(snapshots: DataFrame, kernel: int, stride: int, scorer: Callable[[np.ndarray], np.ndarray], prepare: Callable[[np.ndarray], tuple[np.ndarray, int, int]] | None = None) -> DataFrame:
    """Scores of the windows of ``kernel`` samples, every ``stride`` of the sequence, that end within the newest update.

    ``snapshots`` come from ``snapshot_stream``, live or as a table, with ``keep`` of ``kernel`` samples or more, and of what ``prepare`` loses besides.
    Windows are scaled by their own standard deviation. The windows of an update that the scorer fails on have NaN.
    """

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sequence, first, samples, n_new in zip(frame["sequence_id"], frame["first"], frame["samples"], frame["n_new"], strict=True):
                x = np.asarray(samples, float)
                x, before, behind = prepare(x) if prepare else (x, 0, 0)
                first, end = first + before, first + before + len(x)
                start = max(first, end - n_new - kernel + 1)
                starts = np.arange(-(-start // stride) * stride, end - kernel + 1, stride)
                if len(x) and len(starts):
                    windows = np.stack([x[s - first : s - first + kernel] for s in starts])
                    scaled = windows / np.maximum(windows.std(1, ddof=1, keepdims=True), 1e-8)
                    try:
                        values = [float(v) for v in scorer(scaled)]
                    except Exception:  # noqa: BLE001  a scorer's failure doesn't end the stream
                        values = [float("nan")] * len(starts)
                    rows += [(sequence, int(s), v) for s, v in zip(starts, values, strict=True)]
            yield pd.DataFrame(rows, columns=["sequence_id", "start", "score"])

    return snapshots.mapInPandas(score, "sequence_id long, start long, score double")


def stream_outliers(scores: DataFrame, cut: float, gap: str, late: str, by: str, time: str = "ts", score: str = "score") -> DataFrame:
    """Scores under ``cut`` as sessions that a gap of over ``gap`` ends; the watermark ``late`` bounds the state."""
    low = scores.where(F.col(score) < cut).withWatermark(time, late)
    sessions = low.groupBy(by, F.session_window(time, gap).alias("_w"))
    out = sessions.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.min(score).alias("min_score"), F.count("*").alias("n"))
    return out.drop("_w")


def run_once(stream: DataFrame, name: str, spark, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, appends to a Parquet table in the shared folder, and reads that."""
    path = f"{checkpoint}/{name}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
