"""Resampling, framing and pooling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.model import DEFAULT, Layout
from vitalgrid.operators.chunks import floor_div, frame_map
from vitalgrid.session import attach, with_stats


def resample_binary(
    df: DataFrame, fs: float, fs_desired: float, keys: Sequence[str] = ("record", "channel"), t: str = "t"
) -> DataFrame:
    """Nearest-row rate change: keep every k-th row, or repeat each row k times."""
    factor = fs_desired / fs
    if factor == 1:
        return df
    if factor < 1:
        k = int(1 / factor)
        kept = df.where(F.pmod(F.col(t), F.lit(k)) == 0).withColumn(t, floor_div(F.col(t), k))
        # The output has int(n * factor) rows.
        sized = attach(kept, df.groupBy(*keys).agg((F.max(t) + 1).alias("_n")), keys, t)
        return sized.where(F.col(t) < F.floor(F.col("_n") * F.lit(factor))).drop("_n")
    k = int(factor)
    copies = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return df.withColumn("_i", copies).withColumn(t, (F.col(t) * k + F.col("_i")).cast("long")).drop("_i")


def low_pass_taps(down: int, beta: float = 5.0) -> np.ndarray:
    """Kaiser-windowed sinc, cut-off ``1/down``, ``20*down + 1`` taps, unit DC gain."""
    half = 10 * down
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / down) * np.kaiser(2 * half + 1, beta)
    return taps / taps.sum()


def downsample(df: DataFrame, fs: float, fs_out: float, lay: Layout = DEFAULT) -> tuple[DataFrame, float]:
    """Anti-alias decimation by ``fs // fs_out``; returns the table and the new rate."""
    if int(fs) == int(fs_out):
        return df, fs_out
    down = int(fs // fs_out)
    taps = low_pass_taps(down)[::-1].copy()
    out = frame_map(
        df, lay.keys, lay.t, lay.value, len(taps), down, lambda x, j, n: (x @ taps)[:, None],
        offset=-10 * down, need=1, frames_per_chunk=max(1, 131_072 // down),
    )
    return out.select(*lay.keys, F.col("frame").alias(lay.t), F.col("x")[0].alias(lay.value)), fs_out


def _block(fs: float, fs_out: float) -> int:
    if fs % fs_out != 0:
        raise ValueError("fs must be a multiple of fs_out")
    return int(fs // fs_out)


def block_mean(df: DataFrame, fs: float, fs_out: float, lay: Layout = DEFAULT) -> DataFrame:
    """Mean of non-overlapping blocks; an incomplete last block is dropped."""
    k = _block(fs, fs_out)
    if k == 1:
        return df
    return (
        df.groupBy(*lay.keys, floor_div(F.col(lay.t), k).alias("_b"))
        .agg(F.avg(lay.value).alias(lay.value), F.count("*").alias("_n"))
        .where(F.col("_n") == k)
        .select(*lay.keys, F.col("_b").alias(lay.t), lay.value)
    )


def block_max(df: DataFrame, fs: float, fs_out: float, lay: Layout = DEFAULT) -> DataFrame:
    """Every k-th value of the sliding maximum of ``|x|``.

    The frames that survive the stride tile the signal, so each sample belongs
    to exactly one and a plain aggregate replaces the sliding window.
    """
    k = _block(fs, fs_out)
    if k == 1:
        return df
    return (
        df.groupBy(*lay.keys, floor_div(F.col(lay.t) + k // 2, k).alias("_b"))
        .agg(F.max(F.abs(lay.value)).alias(lay.value), F.max(lay.t).alias("_last"))
        .where(F.col("_last") >= F.col("_b") * k)
        .select(*lay.keys, F.col("_b").alias(lay.t), lay.value)
    )


def pool1d(df: DataFrame, kernel_size: int, mode: str = "max", lay: Layout = DEFAULT) -> DataFrame:
    """Block reduction; the last partial block counts as zero-padded."""
    k = kernel_size
    x = F.col(lay.value)
    if mode == "avg":
        reduced = F.sum(x) / F.lit(float(k))
    else:
        reduced = F.when(F.count("*") < k, F.greatest(F.max(x), F.lit(0.0))).otherwise(F.max(x))
    return df.groupBy(*lay.keys, floor_div(F.col(lay.t), k).alias(lay.t)).agg(reduced.alias(lay.value))


def pool2d(
    df: DataFrame, kernel_size: int, stride: int, padding: int, shape: tuple[int, int],
    mode: str = "max", keys: Sequence[str] = ("record",), i: str = "i", j: str = "j", value: str = "value",
) -> DataFrame:
    """Square pooling of an ``i``/``j`` grid, zero-padded, with a stride.

    A cell is copied to the windows that cover it and the windows are aggregated
    (combined map-side before the shuffle).
    """
    k, s, p = kernel_size, stride, padding
    if p >= k:
        raise ValueError("padding must be smaller than the kernel")

    def windows(axis, size):
        last = (size + 2 * p - k) // s
        pos = F.col(axis) + F.lit(p)
        lo = F.greatest(floor_div(pos - k + s, s), F.lit(0).cast("long"))
        hi = F.least(floor_div(pos, s), F.lit(last).cast("long"))
        return F.when(lo <= hi, F.sequence(lo, hi))

    cells = (
        df.withColumn("_i", F.explode(windows(i, shape[0])))
        .withColumn("_j", F.explode(windows(j, shape[1])))
    )
    x = F.col(value)
    if mode == "avg":
        reduced = F.sum(x) / F.lit(float(k * k))
    else:
        reduced = F.when(F.count("*") < k * k, F.greatest(F.max(x), F.lit(0.0))).otherwise(F.max(x))
    return (
        cells.groupBy(*keys, "_i", "_j").agg(reduced.alias(value))
        .withColumnsRenamed({"_i": i, "_j": j})
    )


def frame_index(
    df: DataFrame, window_length: int, overlap: float = 0, lay: Layout = DEFAULT
) -> DataFrame:
    """Sample-to-frame membership: one row per frame and sample it covers."""
    step = round(window_length * (1 - overlap))
    sized = with_stats(df, lay.keys, lay.t, _n=F.max(lay.t) + 1)
    frames = F.floor((F.col("_n") - window_length) / F.lit(step) + 1)
    lo = F.greatest(floor_div(F.col(lay.t) - window_length + step, step), F.lit(0).cast("long"))
    hi = F.least(floor_div(F.col(lay.t), step), (frames - 1).cast("long"))
    return sized.withColumn("frame", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).drop("_n")


def explode_epochs(df: DataFrame, t: str, window: int, ext: int) -> DataFrame:
    """Copy each sample to every extended epoch that covers it; ``_core`` marks its own epoch."""
    own = floor_div(F.col(t), window)
    if ext == 0:
        return df.withColumn("epoch", own).withColumn("_core", F.lit(1))
    lo = F.greatest(floor_div(F.col(t) - ext, window), F.lit(0).cast("long"))
    hi = floor_div(F.col(t) + (ext if ext > 0 else 0), window)
    return df.withColumn("epoch", F.explode(F.sequence(lo, hi))).withColumn(
        "_core", (F.col("epoch") == own).cast("int")
    )


def extended_epochs(df: DataFrame, window: int, ext: int, lay: Layout = DEFAULT) -> DataFrame:
    """Samples of tumbling windows widened by ``ext`` on both sides (in samples)."""
    sized = with_stats(df, lay.keys, lay.t, _n=F.max(lay.t) + 1)
    out = explode_epochs(sized, lay.t, window, ext)
    return out.where(F.col("epoch") < F.floor(F.col("_n") / F.lit(window))).drop("_n", "_core")
