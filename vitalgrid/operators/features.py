"""Epoch features.

Single time-domain features are one ``groupBy`` over exploded samples. Differences are
taken once per sample (chunked ``lag``) before the explode, so the epochs need
no window of their own and the aggregation combines map-side. Feature sets, which
mix them with spectra over several extensions, run as kernels over matrices of
epochs in one shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions import rows
from vitalgrid.model import CHUNK, DEFAULT, EPS, Layout, next_power_of_two
from vitalgrid.operators import rolling
from vitalgrid.operators.chunks import epoch_map, epoch_table, floor_div, over_chunks
from vitalgrid.operators.normalize import axis_flip
from vitalgrid.operators.resample import explode_epochs
from vitalgrid.session import attach, spread

# ---- aggregate builders over columns x, d1, d2, d3 of an epoch ----------------


def energy() -> Column:
    return F.avg(F.col("_x") * F.col("_x"))


def heart_rate() -> Column:
    return F.lit(60.0) / (F.avg("_x") + F.lit(1e-9))


def rmssd() -> Column:
    return F.sqrt(F.avg(F.col("_d1") * F.col("_d1")))


def sdsd() -> Column:
    return F.stddev_pop("_d1")


def sdnn() -> Column:
    return F.stddev_pop("_x")


def value_range() -> Column:
    return F.max("_x") - F.min("_x")


def quantile(q: float) -> Column:
    """Exact; an epoch holds a bounded number of samples."""
    return F.percentile("_x", F.lit(float(q)))


def activity() -> Column:
    return F.var_pop("_x")


def mobility() -> Column:
    return F.sqrt(F.var_pop("_d1") / (F.var_pop("_x") + F.lit(1e-9)))


def complexity() -> Column:
    of_diff = F.sqrt(F.var_pop("_d2") / (F.var_pop("_d1") + F.lit(1e-9)))
    return F.sqrt(of_diff / (mobility() + F.lit(1e-9)))


TIME_DOMAIN: dict[str, Callable[..., Column]] = {
    "energy": energy, "heart_rate": heart_rate, "rmssd": rmssd, "sdsd": sdsd, "sdnn": sdnn,
    "range": value_range, "quantile": quantile, "activity": activity, "mobility": mobility,
    "complexity": complexity,
}


def epoch_features(
    df: DataFrame, window: int, ext: int, features: dict[str, Column], lay: Layout = DEFAULT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Aggregate features of extended epochs (``window`` and ``ext`` in samples)."""

    def differences(d, w):
        d = d.withColumn("_p1", F.lag("_x", 1).over(w)).withColumn("_p2", F.lag("_x", 2).over(w))
        return d

    x = df.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias("_x"))
    wide = explode_epochs(over_chunks(x, lay.keys, lay.t, 2, 0, differences, chunk), lay.t, window, ext)
    first = F.greatest(F.col("epoch") * window - ext, F.lit(0))
    wide = wide.withColumn("_d1", F.when(F.col(lay.t) - 1 >= first, F.col("_x") - F.col("_p1")))
    wide = wide.withColumn(
        "_d2", F.when(F.col(lay.t) - 2 >= first, F.col("_x") - 2 * F.col("_p1") + F.col("_p2"))
    )
    named = [c.alias(n) for n, c in features.items()]
    out = wide.groupBy(*lay.keys, "epoch").agg(*named, F.sum("_core").alias("_own"))
    return out.where(F.col("_own") == window).drop("_own")


# ---- spectral bands -----------------------------------------------------------


def band_power_kernel(window: int, fs: float, bands: Sequence[tuple]) -> Callable[[np.ndarray], np.ndarray]:
    """Summed log power of bands ``(low, high[, (low, high)])`` of every row of a matrix, from one FFT.

    The FFT length is the next power of two of ``window``; a longer epoch is cut to it after the taper.
    """
    nfft = next_power_of_two(window)
    f = np.arange(nfft // 2 + 1) * fs / nfft
    inside = lambda low, high: (f > low) & (f <= high)
    taken = [(inside(*band[:2]), inside(*band[2]) if len(band) > 2 and band[2] is not None else None) for band in bands]

    def kernel(x: np.ndarray) -> np.ndarray:
        width = min(nfft, x.shape[1])
        spectrum = np.fft.rfft(x[:, :width] * np.hanning(x.shape[1])[:width], n=nfft, axis=1)
        power = np.log(np.abs(spectrum) ** 2 / (fs * nfft) + 1)
        some = power.sum(axis=1) > 0
        out = np.empty((len(x), len(taken)))
        for k, (band, other) in enumerate(taken):
            out[:, k] = power[:, band].sum(axis=1)
            if other is not None:
                out[some, k] /= power[some][:, other].sum(axis=1) + EPS
        return out

    return kernel


def band_power(
    df: DataFrame, fs: float, window: int, ext: int, bands: dict[str, tuple], lay: Layout = DEFAULT
) -> DataFrame:
    """Band powers of extended epochs; ``bands`` maps name -> (low, high[, (low, high)])."""
    kernel = band_power_kernel(window, fs, list(bands.values()))
    return epoch_table(df, lay.keys, lay.t, lay.value, window, [(ext, kernel, list(bands))])


def user_feature(
    df: DataFrame, fun: Callable[[np.ndarray], Sequence[float]], window: int, ext: int,
    outputs: Sequence[str], lay: Layout = DEFAULT,
) -> DataFrame:
    """Any function of an epoch's samples, applied chunk-wise on Arrow batches."""
    return epoch_map(df, lay.keys, lay.t, lay.value, window, ext, fun, outputs)


def mean_crossings(x: np.ndarray) -> list[float]:
    """Steps of an epoch that change side of its mean; NaN where it has no step between two samples.

    Rounding decides the side of a sample that equals the mean. The mean is summed in time order, as SQL's ``avg``
    does (``np.mean`` sums eight strands), and a step starts at its end less the difference. Missing samples (NaN)
    are left out, and so are the steps that touch them.
    """
    step = np.diff(x)
    there = ~np.isnan(step)
    if not there.any():
        return [np.nan]
    mean = np.nancumsum(x)[-1] / np.count_nonzero(~np.isnan(x))
    now = x[1:][there]
    return [np.count_nonzero(np.sign(now - mean) != np.sign((now - step[there]) - mean))]


class _Epochs:
    """Statistics of the rows of a matrix of epochs; missing samples (NaN) are left out where there are any."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.gaps = bool(np.isnan(x).any())

    def step(self, order: int) -> np.ndarray:
        return np.diff(self.x, n=order, axis=1)

    def _of(self, plain: Callable, careful: Callable, a: np.ndarray) -> np.ndarray:
        if a.shape[1] == 0:
            return np.full(len(a), np.nan)
        with warnings.catch_warnings():
            # An epoch without a single value has no statistic; numpy says so for each.
            warnings.simplefilter("ignore", RuntimeWarning)
            return (careful if self.gaps else plain)(a, axis=1)

    def mean(self, a: np.ndarray) -> np.ndarray:
        return self._of(np.mean, np.nanmean, a)

    def var(self, a: np.ndarray) -> np.ndarray:
        return self._of(np.var, np.nanvar, a)

    def range(self) -> np.ndarray:
        return self._of(np.max, np.nanmax, self.x) - self._of(np.min, np.nanmin, self.x)

    def percentiles(self, q: Sequence[float]) -> np.ndarray:
        take = lambda f: lambda a, axis: f(a, q, axis=axis)
        return self._of(take(np.percentile), take(np.nanpercentile), self.x)


def signal_kernel(window: int, fs: float) -> Callable[[np.ndarray], np.ndarray]:
    """The eleven features of ``signal_feature_set`` of every epoch in a matrix."""
    # Very low, low and high frequency band in Hz.
    bands = band_power_kernel(window, fs, [(0.0033, 0.04), (0.04, 0.15), (0.15, 0.4)])

    def kernel(x: np.ndarray) -> np.ndarray:
        e = _Epochs(x)
        plain = [e.mean(x * x), np.sqrt(e.var(x)), np.sqrt(e.var(e.step(1))), e.range(), *e.percentiles([10, 25, 75, 90])]
        return np.column_stack([*plain, bands(x)])

    return kernel


SIGNAL_FEATURES = ("energy", "sdnn", "sdsd", "range", "q10", "q25", "q75", "q90", "vlf", "lf", "hf")


def signal_feature_set(
    df: DataFrame, fs: int, window: int, window_ext: Sequence[int], lay: Layout = DEFAULT
) -> DataFrame:
    """Eleven features per extension (seconds), suffixed with it: one shuffle of the samples for all extensions."""
    kernel = signal_kernel(window * fs, fs)
    parts = [(ext * fs, kernel, [f"{n}_{ext}" for n in SIGNAL_FEATURES]) for ext in window_ext]
    return epoch_table(df, lay.keys, lay.t, lay.value, window * fs, parts)


def hrv_spectral_set(df: DataFrame, fs: int, window: int, lay: Layout = DEFAULT, ext: int = 120) -> DataFrame:
    """Band powers of extended epochs, energy and heart rate of plain ones, from one shuffle."""
    bands = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.5), "lf_hf": (0.04, 0.15, (0.15, 0.5))}

    def plain(x: np.ndarray) -> np.ndarray:
        e = _Epochs(x)
        return np.column_stack([e.mean(x * x), 60.0 / (e.mean(x) + 1e-9)])

    spectral = band_power_kernel(window * fs, fs, list(bands.values()))
    parts = [(ext * fs, spectral, list(bands)), (0, plain, ["mean_energy", "hr"])]
    return epoch_table(df, lay.keys, lay.t, lay.value, window * fs, parts)


def movement_feature_set(df: DataFrame, fs: int, window: int, lay: Layout = DEFAULT, ext: int = 120) -> DataFrame:
    """Band powers of extended epochs, energy and Hjorth parameters of plain ones, from one shuffle."""
    bands = {"lf": (0.04, 0.5), "hf": (5, 14)}

    def plain(x: np.ndarray) -> np.ndarray:
        e = _Epochs(x)
        v0, v1, v2 = e.var(x), e.var(e.step(1)), e.var(e.step(2))
        moves = np.sqrt(v1 / (v0 + 1e-9))
        return np.column_stack([e.mean(x * x), v0, moves, np.sqrt(np.sqrt(v2 / (v1 + 1e-9)) / (moves + 1e-9))])

    spectral = band_power_kernel(window * fs, fs, list(bands.values()))
    parts = [(ext * fs, spectral, list(bands)), (0, plain, ["mean_energy", "activity", "mobility", "complexity"])]
    return epoch_table(df, lay.keys, lay.t, lay.value, window * fs, parts)


def sample_rr(df: DataFrame, fs: int, lay: Layout = DEFAULT) -> DataFrame:
    """Every ``fs``-th sample."""
    return df.where(F.pmod(F.col(lay.t), F.lit(int(fs))) == 0)


# ---- statistics of clock-time epochs -------------------------------------------


def epoch_stats_current(
    df: DataFrame, value: str, keys: Sequence[str] = ("record",), us: str = "us",
    interval: float = 30, bins: Sequence[int] = (20, 200), names: Sequence[str] | None = None,
) -> DataFrame:
    """Mean, sample deviation, range, mean absolute deviation and histogram entropies per bin.

    ``us`` are microseconds; an epoch holds the samples of ``interval`` seconds,
    so everything that needs the epoch mean or extremes runs inside the one
    partitioning by (record, epoch).
    """
    step = int(interval * 1_000_000)
    keys = list(keys)
    by = [*keys, "epoch"]
    w = Window.partitionBy(*by)
    base = (
        df.select(*keys, floor_div(F.col(us), step).alias("epoch"), F.col(value).alias("_v"))
        .withColumn("_m", F.avg("_v").over(w))
        .withColumn("_lo", F.min("_v").over(w))
        .withColumn("_hi", F.max("_v").over(w))
        .withColumn("_n", F.count("_v").over(w))
    )
    aggs = [
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        (F.max("_v") - F.min("_v")).alias("range"),
        F.avg(F.abs(F.col("_v") - F.col("_m"))).alias("mad"),
    ]
    for b in bins:
        base = base.withColumn(f"_b{b}", histogram_bin(F.col("_v"), F.col("_lo"), F.col("_hi"), b))
        c = F.count("_v").over(Window.partitionBy(*by, f"_b{b}"))
        # Every row of a bin carries ln(p)/n; summing rows gives sum(p ln p).
        base = base.withColumn(f"_h{b}", F.log(c / F.col("_n")) / F.col("_n"))
        aggs.append((-F.sum(f"_h{b}")).alias(f"entropy{b}"))
    return base.groupBy(*by).agg(*aggs)


def histogram_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin over [lo, hi], last bin closed; a zero range is widened by one half."""
    flat = lo == hi
    left = F.when(flat, lo - F.lit(0.5)).otherwise(lo)
    width = F.when(flat, F.lit(1.0)).otherwise(hi - lo)
    return F.least(F.floor((v - left) / width * F.lit(float(bins))), F.lit(bins - 1)).cast("int")


def hist_entropy(
    df: DataFrame, value: str, by: Sequence[str], bins: int
) -> DataFrame:
    """Shannon entropy (nats) of an equal-width histogram per group of bounded size.

    Extremes, then counts per bin, both combined map-side.
    """
    by = list(by)
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    binned = df.join(ends, by).withColumn("_b", histogram_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins))
    p = F.col("_c") / F.col("_n")
    return (
        binned.groupBy(*by, "_n", "_b").agg(F.count("*").alias("_c"))
        .groupBy(*by).agg((-F.sum(p * F.log(p))).alias("entropy"))
    )


def mad(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute deviation around the mean per epoch."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    return df.join(means, list(by)).groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


STAT_NAMES = ("mean", "std", "range", "mad", "entropy20", "entropy200")
DIFF_SECONDS = (30, 60, 120)


def epoch_stats(
    df: DataFrame, value: str, keys: Sequence[str] = ("record",), us: str = "us", interval: float = 30,
    chunk: int = CHUNK, diff_seconds: Sequence[int] = DIFF_SECONDS,
) -> DataFrame:
    """The six statistics plus differences of the mean to earlier and later epochs.

    Empty epochs inside a record's span appear as NULL rows.
    """
    keys = list(keys)
    step = int(interval * 1_000_000)
    stats = epoch_stats_current(df, value, keys, us, interval)
    span = df.groupBy(*keys).agg(
        floor_div(F.min(us), step).alias("_a"), floor_div(F.max(us), step).alias("_z")
    )
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_z")).alias("epoch"))
    full = calendar.join(stats, [*keys, "epoch"], "left")
    reach = max(rolling._steps(s, interval) for s in diff_seconds)

    def build(d, w):
        first = F.lag("epoch").over(w).isNull()
        last = F.lead("epoch").over(w).isNull()
        for s in diff_seconds:
            k = rolling._steps(s, interval)
            prev = F.col("mean") - F.avg("mean").over(w.rowsBetween(-k, -1))
            nxt = F.avg("mean").over(w.rowsBetween(1, k)) - F.col("mean")
            d = d.withColumn(f"prev{s}", F.when(first, F.lit(0.0)).otherwise(prev))
            d = d.withColumn(f"next{s}", F.when(last, F.lit(0.0)).otherwise(nxt))
        return d

    return over_chunks(full, keys, "epoch", reach, reach, build, chunk)


def epoch_stats_of(
    df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("record",), us: str = "us", interval: float = 30,
    chunk: int = CHUNK, diff_seconds: Sequence[int] = DIFF_SECONDS, bins: Sequence[int] = (20, 200),
    times: DataFrame | None = None,
) -> DataFrame:
    """``epoch_stats`` of several signals side by side, columns ``<signal>_<statistic>``.

    ``times`` is a cheaper table of the same rows' keys and times, for the span of each record.

    Samples are shuffled once and not repeated per signal; histogram counts of all signals come from one
    aggregation inside that partitioning, as groups of (epoch, signal, bin).
    """
    keys, step = list(keys), int(interval * 1_000_000)
    by = [*keys, "epoch"]
    w = Window.partitionBy(*by)
    base = df.select(*by[:-1], floor_div(F.col(us), step).alias("epoch"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    # A sample unfolds to an entry per signal and histogram behind the shuffle.
    base = spread(base, *by)
    own = {"_m": F.avg, "_lo": F.min, "_hi": F.max, "_n": F.count, "_s": F.stddev_samp}
    base = base.withColumns({f"{n}{i}": f(f"_v{i}").over(w) for i in range(len(values)) for n, f in own.items()})
    entries = [
        F.struct(
            F.lit(i).alias("signal"), F.lit(b).alias("bins"),
            histogram_bin(F.col(f"_v{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), b).alias("bin"),
            F.abs(F.col(f"_v{i}") - F.col(f"_m{i}")).alias("dev"),
            *[F.col(f"{n}{i}").alias(n) for n in own],
        )
        for i in range(len(values)) for b in bins
    ]
    placed = base.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")
    counted = placed.groupBy(*by, "signal", "bins", "bin").agg(
        F.count("dev").alias("_c"), F.sum("dev").alias("_d"), *[F.first(n).alias(n) for n in own]
    )
    share = F.col("_c") / F.col("_n")
    aggs = []
    for i, v in enumerate(values):
        of = F.col("signal") == i
        pick = lambda c, of=of: F.max(F.when(of, c))
        aggs += [
            pick(F.col("_m")).alias(f"{v}_mean"), pick(F.col("_s")).alias(f"{v}_std"),
            pick(F.col("_hi") - F.col("_lo")).alias(f"{v}_range"),
            (F.sum(F.when(of & (F.col("bins") == bins[0]), F.col("_d"))) / pick(F.col("_n"))).alias(f"{v}_mad"),
        ]
        aggs += [
            (-F.sum(F.when(of & (F.col("bins") == b) & (F.col("_c") > 0), share * F.log(share)))).alias(f"{v}_entropy{b}")
            for b in bins
        ]
    stats = counted.groupBy(*by).agg(*aggs)
    span = (df if times is None else times).groupBy(*keys).agg(
        floor_div(F.min(us), step).alias("_a"), floor_div(F.max(us), step).alias("_z")
    )
    full = span.select(*keys, F.explode(F.sequence("_a", "_z")).alias("epoch")).join(stats, by, "left")
    reach = max(rolling._steps(s, interval) for s in diff_seconds)

    def build(d, w):
        first, last = F.lag("epoch").over(w).isNull(), F.lead("epoch").over(w).isNull()
        new = {}
        for v in values:
            mean = F.col(f"{v}_mean")
            for s in diff_seconds:
                k = rolling._steps(s, interval)
                new[f"{v}_prev{s}"] = F.when(first, F.lit(0.0)).otherwise(mean - F.avg(mean).over(w.rowsBetween(-k, -1)))
                new[f"{v}_next{s}"] = F.when(last, F.lit(0.0)).otherwise(F.avg(mean).over(w.rowsBetween(1, k)) - mean)
        return d.withColumns(new)

    return over_chunks(full, keys, "epoch", reach, reach, build, chunk)


def surrogate_signals(
    df: DataFrame, keys: Sequence[str] = ("record",), t: str = "t", us: str = "us",
    x: str = "x", y: str = "y", z: str = "z",
) -> DataFrame:
    """Sample-rate ENMO, z-angle and inactivity index after orientation correction."""
    flipped = axis_flip(df, keys, t, x, y, z)
    cols = [F.col(c) for c in (x, y, z)]
    s = flipped.withColumn("enmo", rows.enmo(*cols)).withColumn("angle_z", rows.tilt(cols[2], cols[0], cols[1]))
    return rolling.lids(s.drop(x, y, z), keys, us, "enmo")


def movement_epoch_features(
    df: DataFrame, keys: Sequence[str] = ("record",), t: str = "t", us: str = "us", interval: float = 30,
    x: str = "x", y: str = "y", z: str = "z", diff_seconds: Sequence[int] = DIFF_SECONDS,
) -> DataFrame:
    """Epoch statistics of ENMO, z-angle and inactivity index: 36 columns."""
    signals = surrogate_signals(df, keys, t, us, x, y, z)
    names = ("enmo", "angle_z", "lids")
    stats = epoch_stats_of(signals, names, keys, us, interval, diff_seconds=diff_seconds, times=df)
    own = [*STAT_NAMES, *[f"{d}{s}" for s in diff_seconds for d in ("prev", "next")]]
    return stats.select(*keys, "epoch", *[f"{s}_{n}" for s in names for n in own])


# ---- small aggregates ------------------------------------------------------------


def t_quantile(confidence: float, dof: int) -> float:
    """Student-t quantile by bisection on the distribution function (regularised beta)."""
    import math

    target = (1 + confidence) / 2

    def cdf(x: float) -> float:
        # Continued fraction of the incomplete beta function (Lentz).
        a, b = dof / 2, 0.5
        z = dof / (dof + x * x)
        swap = z > (a + 1) / (a + b + 2)
        p, q, u = (b, a, 1 - z) if swap else (a, b, z)
        c, d = 1.0, 1 / max(1 - (p + q) * u / (p + 1), 1e-300)
        h = d
        for m in range(1, 500):
            even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
            for k in (even, odd):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        front = math.exp(
            math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(u) + q * math.log(1 - u)
        )
        beta = front * h / p
        beta = 1 - beta if swap else beta
        return 1 - beta / 2

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < target else (lo, mid)
    return (lo + hi) / 2


def mean_ci(df: DataFrame, value: str, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Mean with its confidence bounds.

    The t quantile is evaluated once per distinct group size, in tasks.
    """
    @F.pandas_udf("double")
    def quantile_of(dof: pd.Series) -> pd.Series:
        known = {n: t_quantile(confidence, int(n)) if n > 0 else float("nan") for n in dof.dropna().unique()}
        return dof.map(known)

    g = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n")
    )
    half = quantile_of(F.col("_n") - 1) * F.col("_s") / F.sqrt(F.col("_n").cast("double"))
    return g.withColumn("_h", half).select(
        *by, "mean", (F.col("mean") - F.col("_h")).alias("lower"), (F.col("mean") + F.col("_h")).alias("upper")
    )


def record_extent(
    df: DataFrame, fs: dict[str, float] | float, record: str = "record", signal: str = "signal", t: str = "t"
) -> DataFrame:
    """Whole seconds covered by all signals of a record."""
    if isinstance(fs, dict):
        rate = F.element_at(F.create_map(*[F.lit(v) for kv in fs.items() for v in kv]), F.col(signal))
    else:
        rate = F.lit(float(fs))
    n = df.groupBy(record, signal).agg((F.max(t) + 1).alias("_n"))
    return n.groupBy(record).agg(F.min(F.floor(F.col("_n") / rate)).cast("long").alias("extent"))


def total_event_time(intervals: DataFrame, label: str, record: str = "record") -> DataFrame:
    return intervals.where(F.col("label") == label).groupBy(record).agg(F.sum("duration").cast("long").alias("total"))


def event_count(intervals: DataFrame, records: DataFrame, labels: Sequence[str], record: str = "record") -> DataFrame:
    """Events per record and label, zero where there are none."""
    grid = records.select(record).distinct().withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    counted = intervals.groupBy(record, "label").agg(F.count("*").alias("n"))
    return grid.join(counted, [record, "label"], "left").fillna(0, ["n"])
