"""Signal transforms applied to rows of detector windows, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions import spectra
from driftwatch.functions.arrays import grouped, lists
from driftwatch.functions.islands import keyed
from driftwatch.session import materialize


def _each(columns: list[pa.Array], of: Callable[..., list[np.ndarray]]) -> tuple[list[dict[int, np.ndarray]], list[str | None]]:
    """What ``of`` makes of matrices, by row, and each row's error. Rows fail alone."""
    n = len(columns[0])
    out: list[dict[int, np.ndarray]] = []
    errors: list[str | None] = ["ValueError: a window is null or empty"] * n
    for rows, matrices in grouped(columns):
        for part in ([rows], [rows[i : i + 1] for i in range(len(rows))]):
            failed = False
            for own in part:
                try:
                    made = of(own, *matrices(own))
                except Exception as failure:  # noqa: BLE001  then row by row, so that one bad row stays alone
                    failed = True
                    errors[own[0]] = f"{type(failure).__name__}: {failure}"
                    continue
                out = out or [{} for _ in made]
                for i, row in enumerate(own.tolist()):
                    errors[row] = None
                    for column, values in zip(out, made, strict=True):
                        column[row] = values[i]
            if not failed:
                break
    return out, errors


def map_windows(rows: DataFrame, column: str, name: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds the array column of what ``of`` makes of matrices of windows of one length, and ``{name}_error``.

    A window that is null, empty or too short has a null array and its error; the others of its batch aren't touched by it.
    """

    @F.arrow_udf("made array<double>, error string")
    def mapped(values: pa.Array) -> pa.Array:
        found, errors = _each([values], lambda _, x: [of(x)])
        return pa.StructArray.from_arrays([lists(found[0] if found else {}, len(values)), pa.array(errors, pa.string())], ["made", "error"])

    out = rows.withColumn("_mapped", mapped(F.col(column)))
    return out.withColumns({name: F.col("_mapped.made"), f"{name}_error": F.col("_mapped.error")}).drop("_mapped")


def spectrum_of(rows: DataFrame, column: str, rate: float, size: int, name: str = "psd") -> DataFrame:
    """Adds the power spectral density of each window."""
    return map_windows(rows, column, name, lambda x: spectra.psd(x, rate, size))


def bandpassed(rows: DataFrame, column: str, rate: float, low: float, high: float, taps: int, name: str = "filtered") -> DataFrame:
    """Adds each window's band-passed samples."""
    return map_windows(rows, column, name, lambda x: spectra.bandpass(x, rate, low, high, taps))


def whitened(rows: DataFrame, column: str, rate: float, size: int, duration: float, highpass: float = 0.0, name: str = "white") -> DataFrame:
    """Adds each window whitened by its own spectrum."""
    return map_windows(rows, column, name, lambda x: spectra.whiten(x, spectra.psd(x, rate, size), rate, duration, highpass))


def delayed(rows: DataFrame, column: str, rate: float, tau: float, name: str = "delayed") -> DataFrame:
    """Adds each window ``tau`` seconds ahead, by the phase of its spectrum."""
    return map_windows(rows, column, name, lambda x: spectra.fractional_delay(x, rate, tau))


METRICS = ("rho", "edr", "cc", "scc", "coh_max", "coh_mean", "corr_mag_fd", "corr_real_fd")
EXTRA = ("tau", "xcorr", "lag", "zero_lag", "corr_imag_fd", "corr_phase_fd", "c_energy", "n_energy", "e_total", "e_max", "l_energy", "nbins",
         "corr_mag_fd_best", "corr_real_fd_best", "corr_imag_fd_best", "corr_phase_fd_best")


def metric_batch(left: pa.Array, right: pa.Array, rate: float, low: float, high: float, delay: float, delays: int, segment: int, nfft: int | None, white: bool) -> pa.StructArray:
    """The metrics of a batch of pairs of windows, in blocks of rows, so that memory follows the batch and not its delays."""
    names = [*METRICS, *EXTRA]

    def of(_: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        if a.shape != b.shape:
            raise ValueError("windows differ in length")
        size = min(segment, a.shape[-1])
        f, one = spectra.band_spectra(a, rate, low, high, nfft, None if white else size)
        two = spectra.band_spectra(b, rate, low, high, nfft, None if white else size)[1]
        made = spectra.scan_delays(f, one, two, delay, delays) | spectra.coherence(a, b, rate, low, high, size, size // 2)
        made |= spectra.band_correlation(f, one, two) | spectra.cross_correlation(a, b)
        made |= {f"{name}_best": x for name, x in spectra.band_correlation(f, one, two, made["tau"]).items()}
        return [np.stack([np.asarray(made[n], float) for n in names], 1)]

    found, errors = _each([left, right], of)
    table = np.stack([found[0][i] if found and i in found[0] else np.zeros(len(names)) for i in range(len(left))]) if len(left) else np.zeros((0, len(names)))
    bad = np.array([e is not None for e in errors], bool)
    columns = [pa.array(table[:, i], pa.float64(), mask=bad) for i in range(len(names))]
    return pa.StructArray.from_arrays([*columns, pa.array(~bad), pa.array(errors, pa.string())], [*names, "success", "error"])


def compute_metrics(rows: DataFrame, h: str, l: str, rate: float, low: float, high: float, delay: float = 0.01, delays: int = 81, segment: int = 256, nfft: int | None = 4096, white: bool = True) -> DataFrame:  # noqa: E741
    """Adds the coherence metrics of two detectors' windows, with ``success`` and ``error``; without ``white`` their spectra are flattened first.

    The correlation of spectra comes without delay, and as ``corr_..._best`` at the delay of largest ``cc``.
    A row that fails has null metrics and its error; the others of its batch aren't touched by it. ``nfft`` is the length of the transforms,
    that of the windows if None.
    """
    names = [*METRICS, *EXTRA]

    @F.arrow_udf(", ".join([*(f"{n} double" for n in names), "success boolean", "error string"]))
    def metrics(left: pa.Array, right: pa.Array) -> pa.Array:
        return metric_batch(left, right, rate, low, high, delay, delays, segment, nfft, white)

    out = rows.withColumn("_metrics", metrics(F.col(h), F.col(l)))
    return out.withColumns({n: F.col(f"_metrics.{n}") for n in [*names, "success", "error"]}).drop("_metrics")


def inject_waveforms(rows: DataFrame, h: str, l: str, wave_h: str, wave_l: str, snr: str, rate: float, size: int) -> DataFrame:  # noqa: E741
    """Adds ``h_injected``, ``l_injected`` and ``inject_error``: windows with their row's waveform at its target SNR; a null SNR leaves them as they are.

    A row whose windows or waveforms are null, empty, too short or of different lengths has null arrays and its error.
    """

    @F.arrow_udf("h array<double>, l array<double>, error string")
    def injected(a: pa.Array, b: pa.Array, wa: pa.Array, wb: pa.Array, target: pa.Array) -> pa.Array:
        wanted = pc.fill_null(target.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)

        def of(own: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
            if x.shape != y.shape or p.shape != q.shape:
                raise ValueError("windows differ in length")
            window = np.stack([x, y], 1)
            made = spectra.inject(window, np.stack([p, q], 1), spectra.psd(window, rate, size), rate, wanted[own])
            return [made[:, 0], made[:, 1]]

        found, errors = _each([a, b, wa, wb], of)
        found = found or [{}, {}]
        return pa.StructArray.from_arrays([lists(found[0], len(a)), lists(found[1], len(a)), pa.array(errors, pa.string())], ["h", "l", "error"])

    done = rows.withColumn("_i", injected(F.col(h), F.col(l), F.col(wave_h), F.col(wave_l), F.col(snr)))
    return done.withColumns({"h_injected": F.col("_i.h"), "l_injected": F.col("_i.l"), "inject_error": F.col("_i.error")}).drop("_i")


def with_halo(chunks: DataFrame, by: list[str], column: str, size: int, before: int, after: int, first: int = 0) -> DataFrame:
    """``(by, chunk, column, start)``: each chunk with up to ``before`` samples of the series in front of it and ``after`` behind it.

    Chunk k of a series holds its samples from ``k * size`` on; the last one may be shorter. Samples before ``first`` are left out, and so are chunks of those only.
    ``start`` is the number of the first sample. Each chunk is sent to its own row and the parts that neighbours need
    to theirs: one shuffle, of the samples and the borrowed ones.
    """
    near, far = -(-before // size), -(-after // size)
    at = F.col("chunk") * size
    sent = chunks.select(*by, "chunk", F.col(column).alias("_x"), F.explode(F.sequence(F.lit(-far), F.lit(near))).alias("_off"))
    low = F.greatest((F.col("chunk") + F.col("_off")) * size - before, F.lit(first))
    high = (F.col("chunk") + F.col("_off") + 1) * size + after
    begin = F.greatest(low, at)
    part = F.slice("_x", (begin - at + 1).cast("int"), F.greatest(F.least(high, at + F.size("_x")) - begin, F.lit(0)).cast("int"))
    sent = sent.select(*by, (F.col("chunk") + F.col("_off")).alias("_to"), F.struct(begin.alias("at"), part.alias("x"), (F.col("_off") == 0).alias("own")).alias("_p"))
    whole = sent.where((F.size("_p.x") > 0) & (F.col("_to") >= 0)).groupBy(*by, "_to").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    own = whole.where(F.exists("_p", lambda p: p["own"]) & ((F.col("_to") + 1) * size > first))
    return own.select(*by, F.col("_to").alias("chunk"), F.flatten(F.transform("_p", lambda p: p["x"])).alias(column), F.col("_p")[0]["at"].alias("start"))


def filtered_series(
    chunks: DataFrame, by: list[str], column: str, rate: float, size: int, psd_samples: int, psd_size: int, duration: float, low: float, high: float, taps: int, grid: int | None = None
) -> DataFrame:
    """``(by, chunk, start, filtered)``: series of any length, cut into chunks, band-passed and whitened as if each were one array.

    A series' first ``psd_samples`` give its spectrum; the others are band-passed, evenly reflected at both ends of the series, and whitened with that spectrum, at the cost of half of ``duration``
    at either end. Chunks are as ``with_halo`` takes them, and borrow what both filters reach, so results don't depend on ``size``. ``grid`` is the number of samples of the whitening filter's
    frequencies (those of the spectrum unless given). What the filters add up to is known per chunk, so the mean is taken off
    afterwards: filtered samples are written once. Series that are too short, or have a null or an empty chunk, have no rows there.
    """
    half, n = int(duration * rate) // 2, grid or psd_size
    lead = chunks.where(F.col("chunk") * size < psd_samples).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", F.col(column).alias("x")))).alias("_p"))
    lead = lead.select(*by, F.slice(F.flatten(F.transform("_p", lambda p: p["x"])), 1, psd_samples).alias("_lead")).where(F.size("_lead") == psd_samples)
    lead = map_windows(lead, "_lead", "_taps", lambda x: spectra.whitening_taps(spectra.psd(x, rate, psd_size), rate, duration, low, n)).select(*by, "_taps")
    reach = taps + half
    extended = with_halo(chunks, by, column, size, reach, reach, psd_samples)
    ends = chunks.groupBy(*by).agg(F.max(F.col("chunk") * size + F.size(column)).alias("_end"))
    names, same = keyed(lead.join(ends, by), by)
    ready = extended.join(lead.join(ends, by).select(*names, "_taps", "_end"), same).drop(*[f"_by_{c}" for c in by])
    begin, stop = F.greatest(F.col("chunk") * size - reach, F.lit(psd_samples)), F.least((F.col("chunk") + 1) * size + reach, "_end")
    ready = ready.where((F.col("start") == begin) & (F.size(column) == stop - begin) & F.col("_taps").isNotNull())  # no gap

    @F.arrow_udf("white array<double>, first long, total double, n long, gain double")
    def filtered(xs: pa.Array, filters: pa.Array, numbers: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for x, own, k, start, end in zip(xs, filters, numbers.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            x, own = (np.asarray(v.values.to_numpy(zero_copy_only=False), float) for v in (x, own))
            a, b = max(k * size, psd_samples), min((k + 1) * size, end)  # the chunk's own samples
            passed = spectra.bandpass(x, rate, low, high, taps)
            sure = passed[a - start : b - start]
            # samples next to an end that isn't the series' own are wrong after the band pass, and the whitening doesn't reach them
            first, last = max(a, psd_samples + half), min(b, end - half)
            white = spectra.convolved(passed, own)[first - start : max(first, last) - start]
            out.append((white, first, float(sure.sum()), len(sure), float(own.sum())))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = [pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["white", "first", "total", "n", "gain"])

    done = ready.withColumn("_f", filtered(F.col(column), "_taps", "chunk", "start", "_end")).select(*by, "chunk", "_f.*")
    done = materialize(done, "filtered")
    means = done.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("_mean"))
    names, same = keyed(means, by)
    joined = done.where(F.size("white") > 0).join(means.select(*names, "_mean"), same)
    return joined.select(*by, "chunk", F.col("first").alias("start"), F.transform("white", lambda v: v - F.col("_mean") * F.col("gain")).alias("filtered"))


def timeslide_whitened(chunks: DataFrame, shifts: DataFrame, by: str, h: str, l: str, rate: float, size: int, duration: float, psd_samples: int, chunk: int) -> DataFrame:  # noqa: E741
    """Whitened pairs of chunks for each shift of whole chunks; the last chunk of a segment and shift is dropped.

    ``chunks`` is ``(by, chunk, h, l)``, each of ``chunk`` samples. The ``psd_samples`` in front of a chunk, in its own detector, give its spectrum; chunks without so many have no pair. Each detector's
    chunks are whitened once, before the shifts: pairs are made by one equi-join.
    """
    last = chunks.groupBy(by).agg(F.max("chunk").alias("_last"))

    def white(column: str) -> DataFrame:
        led = with_halo(chunks, [by], column, chunk, psd_samples, 0).where(F.col("chunk") * chunk - F.col("start") == psd_samples)
        apart = lambda x: spectra.whiten(x[..., psd_samples:], spectra.psd(x[..., :psd_samples], rate, size), rate, duration)
        return map_windows(led, column, f"{column}_white", apart).select(by, "chunk", f"{column}_white")

    left = white(h).crossJoin(F.broadcast(shifts.select("shift"))).withColumn("_chunk", F.col("chunk") + F.col("shift"))
    pairs = left.join(white(l).withColumnRenamed("chunk", "_chunk"), [by, "_chunk"]).join(last, by).where(F.col("_chunk") < F.col("_last"))
    return pairs.select(by, "shift", "chunk", f"{h}_white", f"{l}_white")
