"""Spectra of detector windows: small numpy helpers over arrays of shape (rows, samples)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., :: size - overlap, :]
    return view - view.mean(-1, keepdims=True)


def median_bias(n: int) -> float:
    """The median of the mean of exponentials over ``n`` segments, as a share of the mean."""
    k = np.arange(1, (n - 1) // 2 + 1)
    return 1 + float((1 / (2 * k + 1) - 1 / (2 * k)).sum())


def psd(x: np.ndarray, rate: float, size: int, overlap: int | None = None, average: str = "median") -> np.ndarray:
    """One-sided power spectral density by Welch's method: Hann windows, half overlap, median (or mean) of segments."""
    overlap = size // 2 if overlap is None else overlap
    window = hann(size)
    power = np.abs(np.fft.rfft(_segments(x, size, overlap) * window)) ** 2 / (rate * (window**2).sum())
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    if average == "mean":
        return power.mean(-2)
    return np.median(power, axis=-2) / median_bias(power.shape[-2])


def bandpass(x: np.ndarray, rate: float, low: float, high: float, taps: int) -> np.ndarray:
    """Zero-phase band pass: a windowed-sinc filter (Hamming, unit gain at the band's centre) over the series, evenly reflected by half the filter, forward and back."""
    n = np.arange(taps) - (taps - 1) / 2
    sinc = lambda f: 2 * f / rate * np.sinc(2 * f / rate * n)
    h = (sinc(high) - sinc(low)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    h /= np.abs((h * np.exp(-2j * np.pi * (low + high) / 2 / rate * np.arange(taps))).sum())
    pad = min(taps // 2, x.shape[-1] - 1)
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(pad, pad)], mode="reflect")
    size, at = wide.shape[-1], taps // 2
    gain = np.fft.rfft(h, size + taps)
    passed = lambda y: np.fft.irfft(np.fft.rfft(y, size + taps) * gain, size + taps)[..., at : at + size]
    return passed(passed(wide)[..., ::-1])[..., ::-1][..., pad : pad + x.shape[-1]]


def _response(power: np.ndarray, rate: float, duration: float, highpass: float, n: int) -> np.ndarray:
    """The whitening filter of each spectrum over ``n`` samples, lag zero first, cut to under half of ``duration`` seconds on either side."""
    f = np.fft.rfftfreq(n, 1 / rate)
    grid = np.fft.rfftfreq(2 * (power.shape[-1] - 1), 1 / rate)
    inverse = np.stack([np.interp(f, grid, row) for row in power.reshape(-1, power.shape[-1])]).reshape(*power.shape[:-1], -1) ** -0.5
    inverse[..., f < highpass] = 0
    inverse[..., 0] = 0
    response = np.fft.irfft(inverse, n)
    half = int(duration * rate) // 2
    window = hann(int(duration * rate))[half:]
    response[..., :half] *= window
    response[..., n - half + 1 :] *= window[1:][::-1]
    response[..., half : n - half + 1] = 0
    return response


def whiten(x: np.ndarray, power: np.ndarray, rate: float, duration: float, highpass: float = 0.0) -> np.ndarray:
    """The series divided by its amplitude spectrum; the filter is cut to ``duration`` seconds, half of which go at either end."""
    n, half = x.shape[-1], int(duration * rate) // 2
    response = _response(power, rate, duration, highpass, n)
    out = np.fft.irfft(np.fft.rfft(x - x.mean(-1, keepdims=True)) * np.fft.rfft(response), n) * np.sqrt(2 / rate)
    return out[..., half : n - half]


def whitening_taps(power: np.ndarray, rate: float, duration: float, highpass: float, n: int) -> np.ndarray:
    """The whitening filter as taps from the earliest lag to the latest, of a grid of ``n`` samples: the same for a series of any length."""
    half = int(duration * rate) // 2
    return np.roll(_response(power, rate, duration, highpass, n), half - 1, -1)[..., : 2 * half - 1] * np.sqrt(2 / rate)


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The series under a filter of an odd number of centred taps, without samples beyond its ends."""
    size = x.shape[-1] + taps.shape[-1] - 1
    at = taps.shape[-1] // 2
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[..., at : at + x.shape[-1]]


def fractional_delay(x: np.ndarray, rate: float, tau: float | np.ndarray) -> np.ndarray:
    """The series ``tau`` seconds ahead, so that later samples come earlier, by the phase of its spectrum; an array of delays adds an axis in front."""
    tau = np.asarray(tau)
    f = np.fft.rfftfreq(x.shape[-1], 1 / rate)
    phase = np.exp(2j * np.pi * f * tau.reshape(tau.shape + (1,) * x.ndim))
    return np.fft.irfft(np.fft.rfft(x) * phase, x.shape[-1])


STATISTICS = ("cc", "rho", "scc", "edr", "c_energy", "n_energy", "e_total", "e_max", "l_energy", "nbins")
EPS = 1e-12


def band_spectra(x: np.ndarray, rate: float, low: float, high: float, nfft: int | None = None, segment: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies of a band and the spectra there, of ``nfft`` points (as many as samples unless given) under a symmetric Hann window.

    White noise of unit density has unit energy in a bin. With ``segment``, series that aren't whitened are divided by the root of their
    own mean Welch spectrum of segments of that size.
    """
    n = x.shape[-1]
    nfft = nfft or n
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))
    f = np.fft.rfftfreq(nfft, 1 / rate)
    band = (f >= low) & (f <= high)
    out = np.fft.rfft(x * window, nfft)[..., band] / np.sqrt(rate * nfft / 2 * (window**2).mean())
    if segment:
        power, grid = psd(x, rate, segment, average="mean"), np.fft.rfftfreq(segment, 1 / rate)
        density = np.stack([np.interp(f[band], grid, row) for row in power.reshape(-1, power.shape[-1])]).reshape(out.shape)
        out = out / np.sqrt(density + 1e-30)
    return f[band], out


@lru_cache(maxsize=8)
def _phases(f: bytes, taus: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of all frequencies at all delays: two matrices (bins, delays)."""
    angle = 2 * np.pi * np.outer(np.frombuffer(f), np.frombuffer(taus))
    return np.cos(angle), np.sin(angle)


def cross_energies(f: np.ndarray, a: np.ndarray, b: np.ndarray, taus: np.ndarray) -> np.ndarray:
    """The cross energy of each pair of spectra for each delay, (rows, delays): of the cross spectrum's parts, one matrix product each.

    With ``b`` moved ahead by tau, it is ``2 Re(sum a conj(b) exp(-2 pi i f tau))``, so no spectrum is moved.
    """
    cos, sin = _phases(np.ascontiguousarray(f, float).tobytes(), np.ascontiguousarray(taus, float).tobytes())
    cross = a * b.conj()
    return 2 * (cross.real @ cos + cross.imag @ sin)


def _from_cross(c: np.ndarray, total: np.ndarray, largest: np.ndarray, bins: int) -> dict[str, np.ndarray]:
    """The statistics from cross energies; the null energy is half of what is left of the total, the common one half of both together."""
    null, common = np.maximum(total - c, 0) / 2, np.maximum(total + c, 0) / 2
    plus, gain = np.maximum(c, 0), total - largest
    return {
        "cc": c / (np.abs(c) + null + EPS),
        "rho": np.sqrt(plus),
        "scc": gain / (gain + (total - common) + bins),
        "edr": null / np.maximum(plus, EPS),
        "c_energy": c,
        "n_energy": null,
        "e_total": np.broadcast_to(total, c.shape),
        "e_max": np.broadcast_to(largest, c.shape),
        "l_energy": common,
        "nbins": np.full(c.shape, float(bins)),
    }


def _energies(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ea, eb = np.abs(a) ** 2, np.abs(b) ** 2
    return (ea + eb).sum(-1), np.maximum(ea, eb).sum(-1)


def coherent_statistics(f: np.ndarray, a: np.ndarray, b: np.ndarray, taus: np.ndarray) -> dict[str, np.ndarray]:
    """Coherent and null energies of two spectra at frequencies ``f``, for each time ``taus`` by which the second is moved ahead: arrays of shape (taus, rows).

    C is the cross energy, N the energy that isn't common, E the total. ``cc`` = C / (|C| + N),
    ``rho`` = sqrt(C / (K - 1)) for K = 2 detectors, ``edr`` = N / C, ``scc`` = (E - Em) / ((E - Em) + (E - L) + n)
    with Em the sum over frequencies of the larger detector's energy, L the common energy and n the number of bins. An empty band gives NaN.
    The energies themselves are ``c_energy``, ``n_energy``, ``e_total``, ``e_max``, ``l_energy``, and ``nbins``.
    """
    if not len(f):
        nothing = np.full((len(taus), *a.shape[:-1]), np.nan)
        return dict.fromkeys(STATISTICS, nothing) | {"nbins": np.zeros_like(nothing)}
    return _from_cross(cross_energies(f, a, b, taus).T, *_energies(a, b), len(f))


def scan_delays(f: np.ndarray, a: np.ndarray, b: np.ndarray, most: float = 0.01, n: int = 81) -> dict[str, np.ndarray]:
    """The statistics at the delay of largest finite ``cc``, the first of equal ones, with that delay as ``tau``.

    Only cross energies are kept for all delays: rows times delays numbers. ``cc`` follows from them and the total.
    """
    taus = np.linspace(-most, most, n)
    if not len(f):
        return {name: x[0] for name, x in coherent_statistics(f, a, b, taus).items()} | {"tau": np.full(a.shape[:-1], np.nan)}
    c, (total, largest) = cross_energies(f, a, b, taus), _energies(a, b)
    cc = c / (np.abs(c) + np.maximum(total[:, None] - c, 0) / 2 + EPS)
    best = np.where(np.isfinite(cc), cc, -np.inf).argmax(1)
    out = _from_cross(np.take_along_axis(c, best[:, None], 1)[:, 0], total, largest, len(f))
    return out | {"tau": np.where(np.isfinite(out["cc"]), taus[best], np.nan)}


def coherence(h: np.ndarray, l: np.ndarray, rate: float, low: float, high: float, size: int = 256, overlap: int = 128) -> dict[str, np.ndarray]:  # noqa: E741
    """Mean and largest magnitude-squared coherence in the band."""
    window = hann(size)
    a, b = (np.fft.rfft(_segments(x, size, overlap) * window) for x in (h, l))
    cross = np.abs((a * b.conj()).mean(-2)) ** 2
    both = (np.abs(a) ** 2).mean(-2) * (np.abs(b) ** 2).mean(-2)
    f = np.fft.rfftfreq(size, 1 / rate)
    value = (cross / np.maximum(both, 1e-300))[..., (f >= low) & (f <= high)]
    if not value.shape[-1]:
        return dict.fromkeys(("coh_mean", "coh_max"), np.full(value.shape[:-1], np.nan))
    return {"coh_mean": value.mean(-1), "coh_max": value.max(-1)}


def band_correlation(f: np.ndarray, a: np.ndarray, b: np.ndarray, tau: float | np.ndarray = 0.0) -> dict[str, np.ndarray]:
    """The complex correlation of two spectra at frequencies ``f``, with the second moved ahead by ``tau``."""
    if not len(f):
        return dict.fromkeys(("corr_mag_fd", "corr_real_fd", "corr_imag_fd", "corr_phase_fd"), np.full(a.shape[:-1], np.nan))
    b = b * np.exp(2j * np.pi * f * np.asarray(tau)[..., None])
    r = (a * b.conj()).sum(-1) / (np.sqrt((np.abs(a) ** 2).sum(-1) * (np.abs(b) ** 2).sum(-1)) + EPS)
    return {"corr_mag_fd": np.abs(r), "corr_real_fd": r.real, "corr_imag_fd": r.imag, "corr_phase_fd": np.angle(r)}


def cross_correlation(h: np.ndarray, l: np.ndarray) -> dict[str, np.ndarray]:  # noqa: E741
    """The normalised cross-correlation: the value of largest size, its lag, and the value at lag zero; NaN for constant series."""
    n = h.shape[-1]
    a, b = (x - x.mean(-1, keepdims=True) for x in (h, l))
    size = 2 * n - 1
    full = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size).conj(), size)
    norm = np.sqrt((a**2).sum(-1) * (b**2).sum(-1))
    good = norm > 1e-300 if n > 1 else np.zeros(norm.shape, bool)
    full = np.where(good[..., None], np.roll(full, n - 1, -1) / np.where(good, norm, 1)[..., None], np.nan)
    at = np.where(good, np.abs(np.nan_to_num(full)).argmax(-1), n - 1)
    return {"xcorr": np.take_along_axis(full, at[..., None], -1)[..., 0], "lag": at - (n - 1), "zero_lag": full[..., n - 1]}


def inject(window: np.ndarray, waveform: np.ndarray, power: np.ndarray, rate: float, target: np.ndarray) -> np.ndarray:
    """Windows of shape (rows, detectors, samples) plus their waveforms, each centred on its largest sample and scaled to a network SNR of its ``target``."""
    n, m = window.shape[-1], waveform.shape[-1]
    peak = np.abs(waveform).max(1).argmax(-1)
    at = np.arange(n) - n // 2 + peak[:, None]
    placed = np.take_along_axis(waveform, np.clip(at, 0, m - 1)[:, None, :], -1) * ((at >= 0) & (at < m))[:, None, :]
    spectrum = np.abs(np.fft.rfft(placed) / rate) ** 2
    f, grid = np.fft.rfftfreq(n, 1 / rate), np.fft.rfftfreq(2 * (power.shape[-1] - 1), 1 / rate)
    density = np.stack([np.interp(f, grid, row) for row in power.reshape(-1, power.shape[-1])]).reshape(spectrum.shape)
    snr = np.sqrt((4 * spectrum / density).sum((-2, -1)) * rate / n)
    return window + placed * np.where(snr > 0, target / np.where(snr > 0, snr, 1), 0.0)[:, None, None]
