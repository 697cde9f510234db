"""Spectral and time-frequency kernels.

Frame-based spectra run on dense ``(frames, width)`` matrices from ``frame_map``;
filters and wavelets run per halo chunk. Kernels are small numpy functions, Spark
does the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.model import CHUNK, DEFAULT, EPS, Layout, next_power_of_two
from vitalgrid.operators.chunks import floor_div, frame_map, halo_map
from vitalgrid.session import attach

# ---- frame spectra ----------------------------------------------------------------


def band(fs: float, nfft: int, f_min: float, f_max: float) -> np.ndarray:
    f = np.arange(nfft // 2 + 1) * fs / nfft
    return (f > f_min) & (f <= f_max)


def _bin_maximum(s: np.ndarray, size: int) -> np.ndarray:
    """Sliding maximum along the last axis (even sizes lean back), every ``size``-th bin."""
    if size <= 1:
        return s
    bins = s.shape[1]
    starts = np.arange(0, bins, size)
    return np.stack(
        [s[:, max(0, i - size // 2) : i + size - size // 2].max(axis=1) for i in starts], axis=1
    )


def psd(
    df: DataFrame, fs: float, window: int, noverlap: int, nfft: int, f_min: float, f_max: float,
    f_sub: int = 1, lay: Layout = DEFAULT,
) -> DataFrame:
    """Log power spectral density of Blackman frames centred on multiples of the hop."""
    hop = window - noverlap
    taper = np.blackman(window)
    keep = band(fs, nfft, f_min, f_max)
    gain = np.full(nfft // 2 + 1, 2.0)
    gain[0] = 1.0
    if nfft % 2 == 0:
        gain[-1] = 1.0
    gain /= fs * (taper**2).sum()

    def kernel(x, j, n):
        x = (x - x.mean(axis=1, keepdims=True)) * taper
        s = np.abs(np.fft.rfft(x, n=nfft, axis=1)) ** 2 * gain
        return np.log(_bin_maximum(s[:, keep], f_sub) + EPS)

    return frame_map(df, lay.keys, lay.t, lay.value, window, hop, kernel, offset=-(window // 2), need=0)


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + EPS)


def autocorr_psd(
    df: DataFrame, fs: float, window: int, noverlap: int, f_min: float, f_max: float,
    normalize: bool = True, lay: Layout = DEFAULT,
) -> DataFrame:
    """Log spectrum of a frame's correlation with its widened neighbourhood; border frames are 0."""
    hop = round(window * (1 - noverlap / window))
    nfft = next_power_of_two(window)
    keep = band(fs, nfft, f_min, f_max)
    half = window // 2
    length = 3 * window - 1
    taper = np.hanning(length)
    size = next_power_of_two(4 * window)

    def kernel(x, j, n):
        frame = x[:, half : half + window]
        wide = x
        if normalize:
            frame, wide = _standard(frame), _standard(wide)
        centred = np.zeros_like(x)
        centred[:, half : half + window] = frame
        # Full correlation through the FFT, lags -(2w-1)..(2w-1).
        spec = np.fft.rfft(wide, size, axis=1) * np.conj(np.fft.rfft(centred, size, axis=1))
        circular = np.fft.irfft(spec, size, axis=1)
        lags = np.concatenate([circular[:, -(2 * window - 1) :], circular[:, : 2 * window]], axis=1)
        cut = lags[:, half : half + length] * taper
        power = np.abs(np.fft.rfft(cut[:, :nfft], nfft, axis=1)) ** 2 / (fs * nfft)
        out = np.log(power[:, keep] + EPS)
        inside = (j * hop >= half) & (j * hop + half - 1 <= n)
        out[~inside] = 0.0
        return out

    return frame_map(df, lay.keys, lay.t, lay.value, 2 * window, hop, kernel, offset=-window, need=0)


def mel_filters(filters: int, nfft: int, fs: float) -> np.ndarray:
    """Triangular filters equally spaced in mel over 0..fs/2, shape ``(filters, bins)``."""
    top = 2595 * np.log10(1 + fs / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, filters + 2) / 2595) - 1)
    edge = np.floor((nfft + 1) * hz / fs)
    k = np.arange(nfft // 2 + 1)
    out = np.zeros((filters, len(k)))
    for m in range(filters):
        left, centre, right = edge[m : m + 3]
        rising = (k >= left) & (k < centre)
        falling = (k >= centre) & (k < right)
        out[m, rising] = (k[rising] - left) / (centre - left)
        out[m, falling] = (right - k[falling]) / (right - centre)
    return out


def _power_frames(x: np.ndarray, nfft: int, preemphasis: float) -> np.ndarray:
    """Frames carry one leading sample for the pre-emphasis difference."""
    y = x[:, 1:] - preemphasis * x[:, :-1]
    return np.abs(np.fft.rfft(y * np.hanning(y.shape[1]), n=nfft, axis=1)) ** 2 / nfft


def truncate_record(df: DataFrame, fs: float, max_seconds: float = 9 * 3600, t: str = "t") -> DataFrame:
    """First ``max_seconds`` of a recording."""
    return df.where(F.col(t) < F.lit(int(max_seconds * fs)))


def log_filterbank(
    df: DataFrame, fs: float, window: int, noverlap: int, nfft: int, numcep: int,
    lay: Layout = DEFAULT, preemphasis: float = 0.97,
) -> DataFrame:
    """Log mel filterbank energies of Hann frames."""
    mel = mel_filters(numcep, nfft, fs).T

    def kernel(x, j, n):
        energy = _power_frames(x, nfft, preemphasis) @ mel
        return np.log(np.where(energy == 0, EPS, energy) + EPS)

    return frame_map(
        df, lay.keys, lay.t, lay.value, window + 1, window - noverlap, kernel,
        offset=-(window // 2) - 1, need=0,
    )


def mfcc(
    df: DataFrame, fs: float, window: int, noverlap: int, nfft: int, numcep: int,
    lay: Layout = DEFAULT, preemphasis: float = 0.97, lifter: int = 22,
) -> DataFrame:
    """Cepstral coefficients; the first one is the log frame energy."""
    filters = 2 * numcep
    mel = mel_filters(filters, nfft, fs).T
    k = np.arange(filters)
    dct = np.cos(np.pi * np.outer(k + 0.5, np.arange(numcep)) / filters) * np.sqrt(2 / filters)
    dct[:, 0] /= np.sqrt(2)
    lift = 1 + lifter / 2 * np.sin(np.pi * np.arange(numcep) / lifter)

    def kernel(x, j, n):
        power = _power_frames(x, nfft, preemphasis)
        energy = power @ mel
        out = (np.log(np.where(energy == 0, EPS, energy)) @ dct) * lift
        total = power.sum(axis=1)
        out[:, 0] = np.log(np.where(total == 0, EPS, total))
        return out

    return frame_map(
        df, lay.keys, lay.t, lay.value, window + 1, window - noverlap, kernel,
        offset=-(window // 2) - 1, need=0,
    )


# ---- convolution on chunks ----------------------------------------------------------


def _convolve_same(x: np.ndarray, taps: np.ndarray, size: int, spectrum: np.ndarray) -> np.ndarray:
    """``mode='same'`` convolution through a precomputed spectrum of ``x``."""
    full = np.fft.ifft(spectrum * np.fft.fft(taps, size))
    start = (len(taps) - 1) // 2
    return full[start : start + len(x)]


def _pooled(mag: np.ndarray, wanted: np.ndarray, size: int) -> np.ndarray:
    """Maximum over ``[i - size//2, i + size - size//2 - 1]`` at the wanted positions."""
    if size <= 1:
        return mag[wanted]
    lo, hi = size // 2, size - size // 2 - 1
    padded = np.concatenate([np.full(lo, -np.inf), mag, np.full(hi, -np.inf)])
    view = np.lib.stride_tricks.sliding_window_view(padded, size)
    return view[wanted].max(axis=1)


def _time_frequency(df, lay, reach, size, stride, columns, chunk):
    """Shared driver: ``columns(x)`` yields one full-length real series per output feature."""

    def kernel(pdf, wanted):
        x = pdf[lay.value].to_numpy(dtype=float)
        cols = [_pooled(c, wanted, size) for c in columns(x)]
        return {"x": np.stack(cols, axis=1)}

    data = df.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias(lay.value))
    out = halo_map(
        data, lay.keys, lay.t, reach + size, reach + size, kernel, {"x": "array<double>"}, chunk, stride
    )
    return out.select(*lay.keys, floor_div(F.col(lay.t), stride).alias("frame"), "x")


def wavelet_scales(count: int = 64) -> np.ndarray:
    return np.logspace(1, 7, count, base=2)


def wavelet(
    df: DataFrame, scales: Sequence[float] | None = None, lay: Layout = DEFAULT, chunk: int = CHUNK,
    pool: int = 1, magnitude: bool = False,
) -> DataFrame:
    """Real Morlet transform on log-spaced scales (largest scale first in ``x``).

    ``pool`` > 1 keeps every ``pool``-th sample of the sliding maximum.
    """
    scales = wavelet_scales() if scales is None else np.asarray(scales, dtype=float)
    reach = int(np.ceil(8 * scales.max()))

    def columns(x):
        size = next_power_of_two(len(x) + 2 * reach + 1)
        spectrum = np.fft.fft(x, size)
        for a in scales[::-1]:
            m = int(np.ceil(8 * a))
            u = np.arange(-m, m + 1) / a
            psi = np.where(np.abs(u) <= 8, np.exp(-(u**2) / 2) * np.cos(5 * u), 0.0) / np.sqrt(a)
            c = _convolve_same(x, psi, size, spectrum).real
            yield np.abs(c) if magnitude else c

    return _time_frequency(df, lay, reach, pool, pool, columns, chunk)


def wavelet_pooled(
    df: DataFrame, sub: int = 16, scales: Sequence[float] | None = None, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    """Magnitude, sliding maximum over ``sub`` samples, every ``sub``-th sample."""
    return wavelet(df, scales, lay, chunk, pool=sub, magnitude=True)


def superlet_wavelet(scale: float, cycles: float, dt: float, deviations: float = 5.0) -> np.ndarray:
    """Sampled Morlet of the superlet formulation, normalised to the harmonic amplitude.

    The Gaussian spans ``deviations`` standard deviations over its ``cycles``.
    """
    points = 10 * scale * cycles / dt
    phase = (np.arange(int(np.ceil(points))) - (points - 1) / 2) * dt / scale
    decay = deviations / (2 * np.pi * cycles)
    height = decay / (scale * np.sqrt(2 * np.pi)) * np.sqrt(dt) / (4 * np.pi)
    return height * np.exp(1j * phase - (decay * phase) ** 2 / 2)


def superlet_weights(
    freqs: np.ndarray, order_min: int, order_max: int, adaptive: bool
) -> list[list[tuple[int, float]]]:
    """Per frequency: the orders to combine and the exponent of each magnitude.

    Multiplicative: every order with exponent ``1/orders``. Adaptive: the order
    grows linearly with frequency and the last one enters with its fraction.
    """
    if not adaptive:
        orders = range(order_min, order_max + 1)
        return [[(o, 1 / len(orders)) for o in orders] for _ in freqs]
    if order_min == order_max:
        return [[(order_min, 1.0)] for _ in freqs]
    top = order_min + (order_max - order_min) * (freqs - freqs[0]) / (freqs[-1] - freqs[0])
    out = []
    for o in top:
        whole = int(np.floor(o))
        share = 1 / (o - order_min + 1)
        terms = [(k, share) for k in range(order_min, whole + 1)]
        if o > whole:
            terms.append((whole + 1, (o - whole) * share))
        out.append(terms)
    return out


def superlet(
    df: DataFrame, fs: float, freqs: Sequence[float], order_max: int, order_min: int = 1, c_1: float = 3,
    adaptive: bool = False, lay: Layout = DEFAULT, chunk: int = 16_384, pool: int = 1, stride: int = 1,
) -> DataFrame:
    """Geometric mean of Morlet magnitudes over a set of cycle counts."""
    freqs = np.asarray(freqs, dtype=float)
    weights = superlet_weights(freqs, order_min, order_max, adaptive)
    dt = 1 / fs
    scales = 1 / (2 * np.pi * freqs)
    reach = max(
        int(np.ceil(10 * s * c_1 * max(o for o, _ in w) / dt)) // 2 + 2 for s, w in zip(scales, weights)
    )

    def columns(x):
        size = next_power_of_two(len(x) + 2 * reach)
        spectrum = np.fft.fft(x, size)
        for s, terms in zip(scales, weights):
            total = np.ones(len(x))
            for order, power in terms:
                taps = superlet_wavelet(s, c_1 * order, dt)
                total *= np.abs(_convolve_same(x, taps, size, spectrum)) ** power
            yield total

    return _time_frequency(df, lay, reach, pool, stride, columns, max(chunk, reach))


def superlet_frames(
    df: DataFrame, fs: int, nfft: int, f_min: float, f_max: float, f_sub: int, lay: Layout = DEFAULT,
    order_max: int = 10, c_1: float = 5,
) -> DataFrame:
    """Multiplicative superlets, sliding maximum over one second, every ``f_sub``-th sample."""
    foi = np.linspace(f_min + 1 / nfft, f_max, nfft) + EPS
    return superlet(df, fs, foi, order_max, 1, c_1, False, lay, pool=int(fs), stride=int(f_sub))


# ---- causal IIR filters as truncated impulse responses -------------------------------


def _analog_poles(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections from conjugate poles and real zeros."""
    upper = [p for p in poles if p.imag > 1e-12]
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    zs = list(zeros.real)
    out = []
    for p in upper:
        b = np.poly([zs.pop(), zs.pop(0)]) if len(zs) > 1 else np.poly([zs.pop()])
        out.append((b, np.array([1.0, -2 * p.real, abs(p) ** 2])))
    for p in real:
        out.append((np.poly([zs.pop()]) if zs else np.array([1.0]), np.array([1.0, -p])))
    out[0] = (out[0][0] * gain, out[0][1])
    return out


def butterworth_response(order: int, fs: float, low: float | None, high: float | None, tolerance: float = 1e-15) -> np.ndarray:
    """Impulse response of a bilinear-transform Butterworth band- or high-pass filter.

    Cut where the remaining tail stays below ``tolerance`` of the peak.
    """
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    base = _analog_poles(order)
    if high is None:
        poles, zeros, gain = warp(low) / base, np.zeros(order), 1.0
    else:
        w1, w2 = warp(low), warp(high)
        half = base * (w2 - w1) / 2
        root = np.sqrt(half**2 - w1 * w2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), (w2 - w1) ** order
    digital = (2 * fs + poles) / (2 * fs - poles)
    gain = gain * np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - poles))
    dzeros = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(poles) - len(zeros))])
    length = int(np.ceil(np.log(tolerance) / np.log(np.abs(digital).max()))) + 64
    h = np.zeros(length)
    h[0] = 1.0
    for b, a in _sections(np.sort(dzeros), digital, gain):
        y = np.zeros(length)
        z1 = z2 = 0.0
        b = np.pad(b, (0, 3 - len(b)))
        a = np.pad(a, (0, 3 - len(a)))
        for i, v in enumerate(h):
            out = b[0] * v + z1
            z1 = b[1] * v - a[1] * out + z2
            z2 = b[2] * v - a[2] * out
            y[i] = out
        h = y
    big = np.flatnonzero(np.abs(h) > tolerance * np.abs(h).max())
    return h[: big[-1] + 1]


def _causal(df: DataFrame, h: np.ndarray, lay: Layout, chunk: int) -> DataFrame:
    """Causal FIR with a left halo only: filter state never crosses a chunk."""
    back = len(h) - 1

    def kernel(pdf, wanted):
        x = pdf[lay.value].to_numpy(dtype=float)
        size = next_power_of_two(len(x) + len(h))
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)
        return {lay.value: y[: len(x)][wanted]}

    data = df.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias(lay.value))
    return halo_map(data, lay.keys, lay.t, back, 0, kernel, {lay.value: "double"}, max(chunk, 4 * back))


def bandpass(
    df: DataFrame, fs: float, lowcut: float, highcut: float, order: int = 5, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    return _causal(df, butterworth_response(order, fs, lowcut, highcut), lay, chunk)


def highpass(
    df: DataFrame, fs: float, highcut: float, order: int = 10, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    return _causal(df, butterworth_response(order, fs, highcut, None), lay, chunk)


def tv_denoise(
    df: DataFrame, lmbd: float = 2.0, iterations: int = 200, lay: Layout = DEFAULT, chunk: int = CHUNK,
    channel: int | None = None, channel_col: str = "channel",
) -> DataFrame:
    """Total-variation denoising of every channel, or of one.

    One iteration moves information by one sample, so a halo of ``iterations``
    samples makes chunks exact. Near-silent recordings pass unchanged.
    """
    alpha, bound = 4.0, lmbd / 2
    data = df if channel is None else df.where(F.col(channel_col) == channel)
    data = data.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias(lay.value))
    stats = data.groupBy(*lay.keys).agg(F.stddev_pop(lay.value).alias("_s"), F.avg(lay.value).alias("_m"))
    quiet = (F.col("_s") > 0.009) & (F.col("_s") < 0.011) & (F.col("_m") < 1e-4)
    flagged = attach(data, stats.select(*lay.keys, quiet.alias("_quiet")), lay.keys, lay.t)

    def kernel(pdf, wanted):
        y = pdf[lay.value].to_numpy(dtype=float)
        if len(y) < 2 or bool(pdf["_quiet"].iloc[0]):
            return {lay.value: y[wanted]}
        # Dual variable between samples; its zero ends are the zero-flux borders.
        flux = np.zeros(len(y) + 1)
        for _ in range(iterations):
            x = y + np.diff(flux)
            flux[1:-1] = np.clip(flux[1:-1] + np.diff(x) / alpha, -bound, bound)
        return {lay.value: x[wanted]}

    return halo_map(
        flagged, lay.keys, lay.t, iterations + 1, iterations + 1, kernel, {lay.value: "double"}, chunk
    )
