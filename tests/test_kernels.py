"""Kernels against plain NumPy restatements of their definitions."""

import numpy as np
import pandas as pd
import pytest

from vitalgrid.operators import augment, hrv, normalize, resample, spectral

RNG = np.random.default_rng(7)
X = RNG.normal(size=500)


def frames_of(df):
    p = df.toPandas().sort_values("frame")
    return np.stack(p.x)


def values_of(df):
    return df.toPandas().sort_values("t").value.to_numpy()


def test_psd(series):
    w, hop, nfft, fs = 64, 16, 128, 32
    padded = np.concatenate([np.zeros(w // 2), X, np.zeros(w // 2)])
    taper = np.blackman(w)
    rows = []
    for j in range(len(X) // hop + 1):
        seg = padded[j * hop : j * hop + w]
        s = np.abs(np.fft.rfft((seg - seg.mean()) * taper, nfft)) ** 2 / (fs * (taper**2).sum())
        s[1:-1] *= 2
        rows.append(np.log(s[1:25] + np.finfo(float).eps))
    assert np.allclose(frames_of(spectral.psd(series(a=X), fs, w, w - hop, nfft, 0, 6)), rows)


def test_autocorr_psd(series):
    w, hop, fs = 32, 8, 32
    n = len(X)
    padded = np.concatenate([np.zeros(w // 2), X, np.zeros(w // 2)])
    z = lambda v: (v - v.mean()) / (v.std() + np.finfo(float).eps)
    f = np.arange(w // 2 + 1) * fs / w
    keep = (f > 0) & (f <= 6)
    got = frames_of(spectral.autocorr_psd(series(a=X), fs, w, w - hop, 0, 6))
    for j in range(n // hop + 1):
        a = j * hop
        if a < w // 2 or a + w - 1 > len(padded) - w // 2 - 1:
            continue
        zp = np.zeros(2 * w)
        zp[w // 2 : -w // 2] = z(padded[a : a + w])
        c = np.correlate(z(padded[a - w // 2 : a + w + w // 2]), zp, mode="full")[w // 2 : -w // 2]
        p = np.abs(np.fft.fft(c * np.hanning(len(c)), n=w)[: w // 2 + 1]) ** 2 / (fs * w)
        assert np.allclose(got[j], np.log(p + np.finfo(float).eps)[keep]), j
    assert (got[0] == 0).all()


def test_butterworth_recursion(series):
    """The truncated response equals running the recursion, here for order 1."""
    fs, cut = 32, 2.0
    k = np.tan(np.pi * cut / fs)
    b, a = np.array([1, -1]) / (1 + k), (k - 1) / (k + 1)
    y, prev_x, prev_y = [], 0.0, 0.0
    for v in X:
        out = b[0] * v + b[1] * prev_x - a * prev_y
        y.append(out)
        prev_x, prev_y = v, out
    assert np.allclose(values_of(spectral.highpass(series(a=X), fs, cut, order=1)), y)


@pytest.mark.parametrize("order", [2, 5])
def test_bandpass_gain(order):
    h = spectral.butterworth_response(order, 32, 0.5, 8)
    f = np.fft.rfftfreq(1 << 16, 1 / 32)
    gain = np.abs(np.fft.rfft(h, 1 << 16))
    for cut in (0.5, 8):
        assert np.interp(cut, f, gain) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert np.interp(2, f, gain) == pytest.approx(1, abs=1e-2) and gain[0] < 1e-6


def test_downsample_keeps_slow_waves(series):
    t = np.arange(2000)
    slow = np.sin(2 * np.pi * t / 400)
    got = values_of(resample.downsample(series(a=slow + np.sin(2 * np.pi * t / 3)), 8, 2)[0])
    assert len(got) == 500
    assert np.abs(got - slow[::4])[20:-20].max() < 1e-2


def test_tv_denoise(series):
    d = np.diff(np.eye(len(X)), axis=0)
    dual = np.zeros(len(X) - 1)
    for _ in range(200):
        x = X - d.T @ dual
        dual = np.clip(dual + d @ x / 4, -1, 1)
    assert np.allclose(values_of(spectral.tv_denoise(series(a=X), chunk=128)), x, atol=1e-12)


def test_tv_skips_quiet_records(series):
    quiet = np.tile([0.01, -0.01], 100)
    assert np.array_equal(values_of(spectral.tv_denoise(series(a=quiet))), quiet)


def test_pca(spark):
    x = RNG.normal(size=(300, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame(pd.DataFrame({"record": "a", "t": range(300), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    got = normalize.pca(df, ["x", "y", "z"], 2).toPandas().sort_values("t")
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    for k, name in enumerate(("pc1", "pc2")):
        axis = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose(got[name], c @ axis)


def test_sample_entropy():
    x = np.round(RNG.random(60) * 2) / 2
    n, r = len(x) - 2, 0.2 * x.std()
    a = b = 0
    for i in range(n):
        for j in range(i + 1, n):
            if max(abs(x[i + k] - x[j + k]) for k in range(2)) <= r:
                b += 1
                a += abs(x[i + 2] - x[j + 2]) <= r
    assert hrv.sample_entropy(x) == pytest.approx(-np.log(a / b))


@pytest.mark.parametrize("rows,knots", [(33, 2), (40, 3), (50, 4), (64, 9)])
def test_spline_basis_reproduces_cubics(rows, knots):
    basis = augment.spline_basis(rows, knots)
    at = np.arange(knots) * (rows - 1) / (knots - 1)
    degree = min(3, knots - 1)
    f = lambda t: sum((t / rows) ** k for k in range(degree + 1))
    assert np.allclose(basis @ f(at), f(np.arange(rows)))


def test_superlet_recovers_amplitude(series):
    """A unit tone gives the largest magnitude at its own frequency."""
    t = np.arange(2000) / 32
    got = frames_of(spectral.superlet(series(a=np.sin(2 * np.pi * 4 * t)), 32, [2, 3, 4, 5, 6], 3, c_1=3))
    assert got[1000].argmax() == 2


def test_mel_filters_shape():
    m = spectral.mel_filters(8, 64, 32)
    assert m.shape == (8, 33) and (m >= 0).all() and m.max() <= 1
