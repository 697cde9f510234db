"""Seeded augmentation of windows.

Input rows are cells ``(window keys, t, bin, value)``. Draws are hashes of
``seed | operator | window | ...``, so results do not depend on partitioning. A
window is a bounded block (its length times its features), which is what a
grouped-map call receives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions import seeded
from vitalgrid.session import attach, with_stats

KEYS = ("win",)


def _ids(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def jitter(df: DataFrame, seed: int, sigma: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    noise = seeded.normal(seed, "jitter", *_ids(keys), F.col("t"), F.col("bin"), sigma=sigma)
    return df.withColumn("value", F.col("value") + noise)


def scaling(df: DataFrame, seed: int, sigma: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    factor = seeded.normal(seed, "scaling", *_ids(keys), F.col("bin"), mean=1.0, sigma=sigma)
    return df.withColumn("value", F.col("value") * factor)


def inverting(df: DataFrame, seed: int, p: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    up = seeded.uniform(seed, "inverting", *_ids(keys), F.col("bin")) < p
    return df.withColumn("value", F.when(up, F.col("value")).otherwise(-F.col("value")))


def shuffle_features(df: DataFrame, seed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One random permutation of the bins per window."""
    keys = list(keys)
    bins = df.select(*keys, "bin").distinct().withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), *[F.col(k).cast("string") for k in keys], F.col("bin").cast("string")))
    )
    w = Window.partitionBy(*keys)
    placed = bins.withColumn("_to", (F.row_number().over(w.orderBy("_h", "bin")) - 1))
    # The k-th bin in hash order moves to the k-th smallest bin number.
    order = bins.select(*keys, F.col("bin").alias("_dest")).withColumn(
        "_to", F.row_number().over(w.orderBy("_dest")) - 1
    )
    mapping = placed.join(order, [*keys, "_to"]).select(*keys, "bin", "_dest")
    return attach(df, mapping, [*keys, "bin"], "t").withColumn("bin", F.col("_dest").cast("long")).drop("_dest")


def translate_bins(
    df: DataFrame, seed: int, bins: int, window: int = 15, sigma: float = 0.3, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Shift all bins of a window by one random step; uncovered bins take the window mean.

    Cells pushed out on one side are exactly as many as those uncovered on the
    other, so they are moved there instead of building a calendar.
    """
    reach = int(sigma / (1 / window))
    shift = seeded.integer(F.lit(-reach), F.lit(reach), seed, "translate", *_ids(keys))
    out = with_stats(df, keys, "t", _mean=F.avg("value")).withColumn("_s", shift)
    at = F.col("bin") - F.col("_s")
    inside = (at >= 0) & (at < bins)
    return (
        out.withColumn("value", F.when(inside, F.col("value")).otherwise(F.col("_mean")))
        .withColumn("bin", F.pmod(at, F.lit(bins)).cast("long"))
        .drop("_mean", "_s")
    )


def replace_with_noise(
    df: DataFrame, seed: int, sample_prob: float = 0.1, gauss_scale: float = 0.2, keys: Sequence[str] = KEYS
) -> DataFrame:
    """A whole window becomes noise around its mean, with some probability."""
    hit = seeded.uniform(seed, "noise?", *_ids(keys)) < sample_prob
    noise = seeded.normal(seed, "noise", *_ids(keys), F.col("t"), F.col("bin"), mean=F.col("_mean"), sigma=gauss_scale)
    out = with_stats(df, keys, "t", _mean=F.avg("value"))
    return out.withColumn("value", F.when(hit, noise).otherwise(F.col("value"))).drop("_mean")


def segment_noise(
    df: DataFrame, seed: int, sample_prob: float = 0.1, low: float = 0.001, high: float = 0.3,
    gauss_scale: float = 0.01, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """A random stretch of rows (log-uniform length) becomes noise around the window mean."""
    hit = seeded.uniform(seed, "segment?", *_ids(keys)) < sample_prob
    u = seeded.uniform(seed, "segment-length", *_ids(keys))
    share = F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    out = with_stats(df, keys, "t", _mean=F.avg("value"), _rows=F.max("t") + 1)
    out = out.withColumn("_len", F.floor(share * F.col("_rows")))
    start = seeded.integer(F.lit(0), F.col("_rows") - F.col("_len"), seed, "segment-start", *_ids(keys))
    inside = hit & (F.col("t") >= start) & (F.col("t") < start + F.col("_len"))
    noise = seeded.normal(seed, "segment", *_ids(keys), F.col("t"), F.col("bin"), mean=F.col("_mean"), sigma=gauss_scale)
    return out.withColumn("value", F.when(inside, noise).otherwise(F.col("value"))).drop("_mean", "_rows", "_len")


# ---- kernels over one window -------------------------------------------------------------


def _unit(*parts) -> tuple[float, float]:
    """The two hash uniforms of ``seeded``, for use inside a grouped-map call."""
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:8], 16) / 4294967296.0, int(digest[8:16], 16) / 4294967296.0


def _gauss(mean: float, sigma: float, *parts) -> float:
    u, v = _unit(*parts)
    return mean + sigma * math.sqrt(-2.0 * math.log(u + 0.5 / 4294967296.0)) * math.cos(2.0 * math.pi * v)


def _between(low: int, high: int, *parts) -> int:
    return low + math.floor(_unit(*parts)[0] * max(high - low, 0))


@lru_cache(maxsize=8)
def spline_basis(rows: int, knots: int) -> np.ndarray:
    """Natural-order basis of the not-a-knot cubic spline: values at 0..rows-1 per unit knot."""
    n = knots
    x = np.arange(n) * (rows - 1) / (n - 1)
    t = np.arange(rows, dtype=float)
    if n <= 3:
        return np.stack([np.polyval(np.polyfit(x, e, n - 1), t) for e in np.eye(n)], axis=1)
    h = x[1] - x[0]
    a = np.zeros((n, n))
    rhs = np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = (1, 4, 1)
        rhs[i, i - 1 : i + 2] = np.array([1, -2, 1]) * 6 / h**2
    a[0, :3] = (1, -2, 1)
    a[-1, -3:] = (1, -2, 1)
    second = np.linalg.solve(a, rhs)
    k = np.clip((t / h).astype(int), 0, n - 2)
    s = t - x[k]
    eye = np.eye(n)
    left, right = eye[k], eye[k + 1]
    m0, m1 = second[k], second[k + 1]
    s = s[:, None]
    slope = (right - left) / h - h * (2 * m0 + m1) / 6
    return left + slope * s + m0 / 2 * s**2 + (m1 - m0) / (6 * h) * s**3


def _knots(rows: int, fs: int, max_drift: int = 2) -> int:
    return (rows // fs) // max_drift + 2


def _window_map(df: DataFrame, keys: Sequence[str], fn) -> DataFrame:
    """``fn(matrix, ids)`` per window on its dense ``(t, bin)`` matrix."""
    keys = list(keys)
    cols = [*keys, "t", "bin", "value"]
    data = df.select(*keys, "t", "bin", F.col("value").cast("double").alias("value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "bin"], kind="mergesort", ignore_index=True)
        rows = int(pdf["t"].iloc[-1]) + 1
        x = pdf["value"].to_numpy().reshape(rows, -1)
        ids = [pdf[k].iloc[0] for k in keys]
        pdf["value"] = fn(x, ids).ravel()
        return pdf[cols]

    return data.groupBy(*keys).applyInPandas(run, data.schema)


def _curve(x: np.ndarray, ids, seed: int, name: str, sigma: float, fs: int) -> np.ndarray:
    n = _knots(x.shape[0], fs)
    y = np.array([[_gauss(1.0, sigma, seed, name, *ids, b, k) for b in range(x.shape[1])] for k in range(n)])
    return spline_basis(x.shape[0], n) @ y


def random_curve(df: DataFrame, seed: int, sigma: float = 0.1, fs: int = 32, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smooth random curve around 1 for every window and bin."""
    return _window_map(df, keys, lambda x, ids: _curve(x, ids, seed, "curve", sigma, fs))


def mag_warp(df: DataFrame, seed: int, sigma: float = 0.1, fs: int = 32, keys: Sequence[str] = KEYS) -> DataFrame:
    return _window_map(df, keys, lambda x, ids: x * _curve(x, ids, seed, "curve", sigma, fs))


def time_warp(df: DataFrame, seed: int, sigma: float = 0.1, fs: int = 32, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation on a smoothly distorted time axis."""

    def warp(x, ids):
        axis = np.cumsum(_curve(x, ids, seed, "curve", sigma, fs), axis=0)
        axis = axis * ((x.shape[0] - 1) / axis[-1])
        t = np.arange(x.shape[0])
        return np.stack([np.interp(t, axis[:, b], x[:, b]) for b in range(x.shape[1])], axis=1)

    return _window_map(df, keys, warp)


def _mask(df, keys, seed, name, reach, num, zero, axis):
    def run(x, ids):
        x = x.copy()
        size = x.shape[axis]
        for i in range(num):
            width = _between(0, reach, seed, name, "width", *ids, i)
            start = _between(0, size - width, seed, name, "start", *ids, i)
            stop = _between(start, start + width, seed, name, "stop", *ids, i)
            if width > 0 and stop > start:
                part = (slice(None), slice(start, stop)) if axis else (slice(start, stop), slice(None))
                x[part] = 0.0 if zero else x.mean()
        return x

    return _window_map(df, keys, run)


def freq_mask(
    df: DataFrame, seed: int, max_bins: int = 4, num_masks: int = 2, replace_with_zero: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Successive bands of bins take the current window mean (or 0)."""
    return _mask(df, keys, seed, "freq_mask", max_bins, num_masks, replace_with_zero, 1)


def time_mask(
    df: DataFrame, seed: int, max_rows: int = 15, num_masks: int = 16, replace_with_zero: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Successive stretches of rows take the current window mean (or 0)."""
    return _mask(df, keys, seed, "time_mask", max_rows, num_masks, replace_with_zero, 0)
