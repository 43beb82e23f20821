"""Numpy helpers against what is known of them."""

import numpy as np
import pytest

from driftwatch.functions import spectra as S
from driftwatch.operators.features import freq_cos

draw = np.random.default_rng(11)


def test_white_noise_has_a_flat_spectrum():
    x = draw.normal(size=(4, 1 << 15))
    for average in ("median", "mean"):
        power = S.psd(x, 256.0, 256, average=average)
        assert power[:, 2:-2].mean() == pytest.approx(2 / 256, rel=0.05)


def test_whitening_flattens_and_crops():
    x = np.cumsum(draw.normal(size=(2, 1 << 14)), axis=1)
    white = S.whiten(x, S.psd(x, 256.0, 512), 256.0, 1.0, 8.0)
    assert white.shape == (2, (1 << 14) - 256)
    power = S.psd(white, 256.0, 256)
    assert power[:, 20:-8].std() / power[:, 20:-8].mean() < 0.5
    assert white.std() == pytest.approx(1, rel=0.15)


def test_bandpass_keeps_the_band_without_delay():
    t = np.arange(4096) / 1024
    inside, outside = np.sin(2 * np.pi * 100 * t), np.sin(2 * np.pi * 400 * t)
    got = S.bandpass(inside + outside, 1024.0, 50, 200, 257)
    assert np.abs(got - inside)[600:-600].max() < 0.02


def test_delay_is_recovered_by_the_scan():
    x = draw.normal(size=(3, 4096))
    moved = S.fractional_delay(x, 4096.0, -0.004)
    assert np.roll(x, 1, axis=1) == pytest.approx(S.fractional_delay(x, 4096.0, -1 / 4096))  # positive is ahead
    scan = lambda a, b, low=32, high=1024: S.scan_delays(*S.band_spectra(a, 4096.0, low, high), S.band_spectra(b, 4096.0, low, high)[1])
    found = scan(x, moved)
    assert found["tau"] == pytest.approx([0.004] * 3) and (found["cc"] > 0.95).all() and (found["edr"] < 0.05).all()
    other = scan(x, draw.normal(size=(3, 4096)))
    assert (other["cc"] < 0.3).all()
    assert np.isnan(scan(x, moved, 5000, 6000)["cc"]).all()


def test_coherence_and_correlation():
    x = draw.normal(size=(2, 4096))
    assert S.coherence(x, x, 4096.0, 32, 1024)["coh_mean"] == pytest.approx([1, 1])
    assert S.coherence(x, draw.normal(size=(2, 4096)), 4096.0, 32, 1024)["coh_mean"].max() < 0.2
    f, a = S.band_spectra(x, 4096.0, 32, 1024)
    assert S.band_correlation(f, a, -a)["corr_real_fd"] == pytest.approx([-1, -1])
    lagged = S.cross_correlation(x, np.roll(x, 7, axis=1))
    assert (lagged["lag"] == -7).all() and (lagged["xcorr"] > 0.99).all()
    assert np.isnan(S.cross_correlation(np.ones((1, 8)), x[:1, :8])["xcorr"]).all()
    brute = np.correlate(x[0] - x[0].mean(), x[1] - x[1].mean(), "full")
    got = S.cross_correlation(x[:1], x[1:])
    assert got["lag"][0] == np.abs(brute).argmax() - 4095
    assert got["zero_lag"][0] == pytest.approx(np.corrcoef(x)[0, 1])


def test_injection_has_its_strength():
    window, rate = draw.normal(size=(2, 4096)), 1024.0
    wave = np.sin(np.arange(400) / 9) * np.hanning(400)
    power = np.full((2, 513), 2 / rate)
    strong = S.inject(window[None], np.stack([wave, wave])[None], power[None], rate, np.array([20.0]))[0] - window
    spectrum = np.abs(np.fft.rfft(strong) / rate) ** 2
    assert np.sqrt((4 * spectrum / (2 / rate)).sum() * rate / 4096) == pytest.approx(20, rel=0.01)
    assert abs(int(np.abs(strong[0]).argmax()) - 2048) <= 1


def test_freq_cos_is_the_cosine_of_spectra(spark):
    rows = [(draw.normal(size=64).tolist(), draw.normal(size=64).tolist()) for _ in range(20)]
    got = spark.createDataFrame(rows, "h array<double>, l array<double>").select(freq_cos("h", "l").alias("c")).collect()
    for (h, l), r in zip(rows, got, strict=True):
        a, b = np.fft.rfft(h), np.fft.rfft(l)
        assert r["c"] == pytest.approx((a * b.conj()).sum().real / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8))


def plain_statistics(h, l, rate, low, high, tau, nfft):  # noqa: E741
    """The statistics of one pair, bin by bin."""
    n = len(h)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    norm = np.sqrt(0.5 * rate * nfft) * np.sqrt(np.mean(np.square(window)))
    out = dict.fromkeys(("c", "null", "total", "largest", "common", "bins", "cross", "ea", "eb"), 0.0)
    for k in range(nfft // 2 + 1):
        f = k * rate / nfft
        if low <= f <= high:
            a, b = (sum(w * v * np.exp(-2j * np.pi * k * i / nfft) for i, (w, v) in enumerate(zip(window, x, strict=True))) / norm for x in (h, l))
            out["cross"], out["ea"], out["eb"] = out["cross"] + a * b.conjugate(), out["ea"] + abs(a) ** 2, out["eb"] + abs(b) ** 2
            b *= np.exp(2j * np.pi * f * tau)
            mean = (a + b) / 2
            out["c"] += abs(a + b) ** 2 - abs(a) ** 2 - abs(b) ** 2
            out["null"] += abs(a - mean) ** 2 + abs(b - mean) ** 2
            out["total"] += abs(a) ** 2 + abs(b) ** 2
            out["largest"] += max(abs(a) ** 2, abs(b) ** 2)
            out["common"] += 2 * abs(mean) ** 2
            out["bins"] += 1
    gain, c = out["total"] - out["largest"], out["c"]
    corr = out["cross"] / np.sqrt(out["ea"] * out["eb"])
    return {
        "cc": c / (abs(c) + out["null"]), "rho": np.sqrt(max(c, 0)), "edr": out["null"] / max(c, 1e-12), "scc": gain / (gain + out["total"] - out["common"] + out["bins"]),
        "c_energy": c, "n_energy": out["null"], "e_total": out["total"], "e_max": out["largest"], "l_energy": out["common"], "nbins": out["bins"],
    }, corr


@pytest.mark.parametrize("n,nfft", [(64, 64), (50, 128), (64, 32)])
def test_statistics_equal_plain_sums(n, nfft):
    h, l = draw.normal(size=(2, 3, n))  # noqa: E741
    taus = np.array([-0.02, 0.0, 0.013])
    f, a = S.band_spectra(h, 64.0, 2.0, 30.0, nfft)
    b = S.band_spectra(l, 64.0, 2.0, 30.0, nfft)[1]
    got = S.coherent_statistics(f, a, b, taus)
    assert set(got) == set(S.STATISTICS)
    for i, tau in enumerate(taus):
        for j in range(3):
            x, y = (np.where(np.arange(n) < nfft, v, 0) for v in (h[j], l[j]))
            want, corr = plain_statistics(x, y, 64.0, 2.0, 30.0, tau, nfft)
            assert {k: got[k][i, j] for k in want} == pytest.approx(want)
            if not i:
                r = S.band_correlation(f, a, b)
                assert [r["corr_mag_fd"][j], r["corr_real_fd"][j], r["corr_imag_fd"][j]] == pytest.approx([abs(corr), corr.real, corr.imag])


def test_a_bad_window_fails_alone(spark):
    good = draw.normal(size=64).tolist()
    rows = spark.createDataFrame([(1, good, good), (2, good[:5], good), (3, None, good)], "i long, h array<double>, l array<double>").coalesce(1)
    from driftwatch.operators import signal
    from driftwatch.operators.signal import compute_metrics

    for of in (
        lambda d: signal.spectrum_of(d, "h", 64.0, 16), lambda d: signal.whitened(d, "h", 64.0, 16, 0.25), lambda d: signal.bandpassed(d, "h", 64.0, 2, 30, 33),
        lambda d: signal.delayed(d, "h", 64.0, 0.1),
    ):
        name = of(rows).columns[-2]
        got = {r["i"]: (r[name], r[f"{name}_error"]) for r in of(rows).collect()}
        assert got[1][1] is None and len(got[1][0]) > 8 and got[3][0] is None and got[3][1] and (got[2][1] is None) == (got[2][0] is not None)
    waved = rows.selectExpr("i", "h", "l", "h p", "l q", "if(i = 1, 5D, null) snr")
    got = {r["i"]: r for r in signal.inject_waveforms(waved, "h", "l", "p", "q", "snr", 64.0, 16).collect()}
    assert got[1]["inject_error"] is None and got[1]["h_injected"] != good and got[2]["inject_error"] and got[3]["l_injected"] is None
    got = compute_metrics(rows, "h", "l", 64.0, 2.0, 30.0, segment=16).orderBy("i").collect()
    assert [r["success"] for r in got] == [True, False, False] and got[1]["cc"] is None and got[1]["error"]
    assert got[0]["cc"] > 0.99 and got[0]["tau"] == 0


def test_flat_spectra_have_unit_energy():
    x = np.cumsum(draw.normal(size=(2, 4096)), axis=1)
    for y, segment in ((x, 256), (draw.normal(size=(2, 4096)) * np.sqrt(128), None)):
        assert np.abs(S.band_spectra(y, 256.0, 16, 100, None, segment)[1] ** 2).mean() == pytest.approx(1, rel=0.25)


def test_metrics_of_long_windows_stay_small():
    import tracemalloc

    import pyarrow as pa

    from driftwatch.operators.signal import metric_batch

    x = draw.normal(size=(1024, 4096))
    column = pa.ListArray.from_arrays(pa.array(np.arange(1025, dtype=np.int32) * 4096), pa.array(x.ravel()))
    tracemalloc.start()
    got = metric_batch(column, column, 4096.0, 30.0, 2048.0, 0.01, 81, 256, 4096, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and got.field("cc").to_numpy().min() > 0.99 and set(got.field("tau").to_pylist()) == {0.0}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_filtered_chunks_equal_the_filtered_whole(spark, parts):
    from driftwatch.operators.signal import filtered_series

    x, rate, psd_samples = np.cumsum(draw.normal(size=700)), 64.0, 150
    size = -(-700 // parts)
    rows = [("a", k, x[k * size : (k + 1) * size].tolist()) for k in range(parts)] + [("short", 0, [1.0] * 40), ("null", 0, None), ("null", 1, [1.0] * 30)]
    rows += [("gap", k, None if k == 3 else x[k * size : (k + 1) * size].tolist()) for k in range(parts) if parts > 3]
    chunks = spark.createDataFrame(rows, "s string, chunk long, x array<double>").repartition(3)
    got = filtered_series(chunks, ["s"], "x", rate, size, psd_samples, 32, 0.25, 2.0, 30.0, 33, 256).orderBy("s", "chunk").collect()
    taps = S.whitening_taps(S.psd(x[:psd_samples], rate, 32), rate, 0.25, 2.0, 256)
    passed = S.bandpass(x[psd_samples:], rate, 2.0, 30.0, 33)
    want = S.convolved(passed - passed.mean(), taps)[8:-8]
    own = [r for r in got if r["s"] == "a"]
    assert {r["s"] for r in got} - {"a"} <= {"gap"} and own[0]["start"] == psd_samples + 8
    assert np.concatenate([r["filtered"] for r in own]) == pytest.approx(want, abs=1e-9)
    assert all(b["start"] == a["start"] + len(a["filtered"]) for a, b in zip(own, own[1:]))


def test_taps_are_what_whitening_convolves_with():
    x = draw.normal(size=256)
    power = S.psd(x, 64.0, 32)
    assert S.convolved(x - x.mean(), S.whitening_taps(power, 64.0, 0.5, 4.0, 256))[16:-16] == pytest.approx(S.whiten(x, power, 64.0, 0.5, 4.0))
