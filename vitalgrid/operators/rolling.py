"""Ordered-frame operators, run per halo chunk so one recording uses many tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.model import CHUNK, DEFAULT, EPS, Layout, odd_window
from vitalgrid.operators.chunks import floor_div, halo_map, over_chunks, previous, time_frame
from vitalgrid.operators.quantiles import group_quantiles
from vitalgrid.session import attach, stage


# A step of a chain: samples it reaches on both sides, its window, and its function of a chunk's values.
Link = tuple[int, int, Callable[[pd.Series], pd.Series]]


def _rolling(df, lay, w, kernel, outputs, chunk, before: Sequence[Link] = ()):
    """Kernel over a centred window of ``w``; chunks are kept several windows long.

    The steps ``before`` run on the same chunk first. Halos add up, so a chain of steps takes one shuffle and one
    pass; the rows near a chunk's border that a step cannot know are those the next one does not ask for.
    """
    h = w // 2 + sum(reach for reach, _, _ in before)
    data = df.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias(lay.value))

    def chained(pdf, wanted):
        for _, _, step in before:
            pdf[lay.value] = step(pdf[lay.value])
        return kernel(pdf, wanted)

    longest = max([w, *(window for _, window, _ in before)])
    return halo_map(data, lay.keys, lay.t, h, h, chained, outputs, max(chunk, 4 * longest))


def _complete(y, w: int):
    """0 where a whole window gave no value (missing samples inside); edges stay missing."""
    h = w // 2
    inner = y.iloc[h : len(y) - h] if len(y) >= w else y.iloc[:0]
    y.loc[inner.index[inner.isna()]] = 0.0
    return y


def median_kernel(fs: float, window_size: float) -> Link:
    """``rolling_median_subtract`` as a step of a chain.

    It reaches two half-windows, so the chunk that holds a recording's edge also holds the nearest full window.
    """
    w = odd_window(fs, window_size)

    def residual(x: pd.Series) -> pd.Series:
        med = _complete(x.rolling(w, center=True).median(), w).bfill().ffill().fillna(x.median())
        return x - med

    return 2 * (w // 2), w, residual


def rolling_median_subtract(
    df: DataFrame, fs: float, window_size: float, lay: Layout = DEFAULT, chunk: int = CHUNK,
    before: Sequence[Link] = (),
) -> DataFrame:
    """``x`` minus its centred median; edges use the first and last full window.

    A recording shorter than one window uses its overall median.
    """
    plain = lambda pdf, wanted: {lay.value: pdf[lay.value].to_numpy()[wanted]}
    return _rolling(df, lay, 1, plain, {lay.value: "double"}, chunk, [*before, median_kernel(fs, window_size)])


def _centred(df, lay, w, chunk, before: Sequence[Link] = (), **probs):
    """(rows with centred quantiles, rows to take statistics of the recording from)."""

    def kernel(pdf, wanted):
        x = pdf[lay.value]
        roll = x.rolling(w, center=True)
        out = {lay.value: x.to_numpy()[wanted]}
        for name, q in probs.items():
            y = roll.median() if q == 0.5 else roll.quantile(q)
            out[name] = _complete(y, w).to_numpy()[wanted]
        return out

    outputs = {lay.value: "double", **{n: "double" for n in probs}}
    got = _rolling(df, lay, w, kernel, outputs, chunk, before)
    # Arrow may deliver missing edge values as NaN; edges are NULL from here on.
    got = got.select(*lay.keys, lay.t, lay.value, *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in probs])
    if not before:
        return got, df
    got = stage(got)
    return got, got


def median_filter(
    df: DataFrame, fs: float, window_size: float, lay: Layout = DEFAULT, chunk: int = CHUNK,
    before: Sequence[Link] = (),
) -> DataFrame:
    """Centred median; edges take the recording's overall median."""
    roll, whole = _centred(df, lay, odd_window(fs, window_size), chunk, before, _med=0.5)
    overall = group_quantiles(whole, lay.keys, lay.value, [0.5], ["_all"])
    out = attach(roll, overall, lay.keys, lay.t)
    return out.select(*lay.keys, lay.t, F.coalesce("_med", "_all").alias(lay.value))


def iqr_normalization_adaptive(
    df: DataFrame, fs: float, iqr_window: float, median_window: float | None = None,
    lay: Layout = DEFAULT, chunk: int = CHUNK, iqr_upper: float = 0.75, iqr_lower: float = 0.25,
    before: Sequence[Link] = (),
) -> DataFrame:
    """Scale by centred rolling quartiles; edges use the recording's quartiles."""
    roll, whole = _centred(df, lay, odd_window(fs, iqr_window), chunk, before, _lo=iqr_lower, _up=iqr_upper)
    overall = group_quantiles(whole, lay.keys, lay.value, [iqr_lower, iqr_upper], ["_glo", "_gup"])
    out = attach(roll, overall, lay.keys, lay.t)
    lo, up = F.coalesce("_lo", "_glo"), F.coalesce("_up", "_gup")
    scaled = (F.col(lay.value) - lo) / (up - lo + F.lit(EPS)) * 2 - 1
    return out.select(*lay.keys, lay.t, scaled.alias(lay.value))


def adaptive_soft(
    df: DataFrame, fs: float, median_window: float, std_window: float,
    lay: Layout = DEFAULT, chunk: int = CHUNK, before: Sequence[Link] = (),
) -> DataFrame:
    """Subtract the centred median, divide by the centred deviation of the residual."""
    w = odd_window(fs, std_window)
    h = w // 2
    roll, whole = _centred(df, lay, odd_window(fs, median_window), chunk, before, _med=0.5)
    overall = group_quantiles(whole, lay.keys, lay.value, [0.5], ["_all"]).join(
        whole.groupBy(*lay.keys).agg(F.stddev_pop(lay.value).alias("_gstd")), list(lay.keys)
    )
    res = attach(roll, overall, lay.keys, lay.t).withColumn(
        "_r", F.col(lay.value) - F.coalesce("_med", "_all")
    )

    res = res.select(*lay.keys, lay.t, F.col("_r").cast("double").alias("_r"), "_gstd")

    def kernel(pdf, wanted):
        r = pdf["_r"].astype(float)
        n = len(r)
        # Rows with a whole frame inside the recording; a sample missing in it leaves no deviation.
        whole = np.zeros(n, dtype=bool)
        whole[h : n - h] = True
        std = np.nan_to_num(r.rolling(w, center=True, min_periods=w).std().to_numpy())
        std = np.where(whole, std, pdf["_gstd"].to_numpy(dtype=float))
        return {lay.value: (r.to_numpy() / (std + 1e-10))[wanted]}

    out = halo_map(res, lay.keys, lay.t, h, h, kernel, {lay.value: "double"}, max(chunk, 4 * w))
    return out.withColumn(lay.value, F.nanvl(lay.value, F.lit(None).cast("double")))


def diff(df: DataFrame, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    def build(d, w):
        step = F.col(lay.value) - F.lag(lay.value).over(w)
        return d.withColumn("_d", F.coalesce(step, F.lit(0.0)))

    return over_chunks(df, lay.keys, lay.t, 1, 0, build, chunk).drop(lay.value).withColumnRenamed("_d", lay.value)


def rolling_autocorr(
    df: DataFrame, fs: float, window: float, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    """Lag-1 autocorrelation of the last ``w`` samples; NULL before the first full window."""
    w = odd_window(fs, window)
    data = df.select(*lay.keys, lay.t, F.col(lay.value).cast("double").alias(lay.value))

    def kernel(pdf, wanted):
        y = pdf[lay.value].to_numpy(dtype=float)
        x = np.concatenate(([np.nan], y[:-1]))
        use = np.isfinite(x) & np.isfinite(y)
        centre = y[np.isfinite(y)].mean() if np.isfinite(y).any() else 0.0
        a, b = np.where(use, x - centre, 0.0), np.where(use, y - centre, 0.0)
        first = np.maximum(np.arange(len(y)) - (w - 2), 0)[wanted]

        def total(v):
            sums = np.concatenate(([0.0], np.cumsum(v, dtype=np.longdouble)))
            return sums[wanted + 1] - sums[first]

        n = total(use.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = total(a * a) - total(a) ** 2 / n, total(b * b) - total(b) ** 2 / n
            c = (total(a * b) - total(a) * total(b) / n) / np.sqrt(va * vb)
        # A frame without spread has no correlation; what is left of it is rounding.
        flat = (va <= 1e-15 * total(a * a)) | (vb <= 1e-15 * total(b * b)) | (n < 2)
        c = np.where(flat | (pdf[lay.t].to_numpy()[wanted] < w - 1), np.nan, c.astype(float))
        return {lay.value: c}

    out = halo_map(data, lay.keys, lay.t, w, 0, kernel, {lay.value: "double"}, max(chunk, 4 * w))
    return out.withColumn(lay.value, F.nanvl(lay.value, F.lit(None).cast("double")))


def lids(
    df: DataFrame, keys: Sequence[str] = ("record",), us: str = "us", enmo: str = "enmo",
    chunk_seconds: int = 86_400, name: str = "lids",
) -> DataFrame:
    """Inactivity index: 10-minute rolling sum of ENMO above .02, inverted, 30-minute mean.

    Both frames are time ranges ``(t - span, t]`` on integer microseconds. Rows are shuffled once, to time chunks
    with a 40-minute halo; inside a chunk each frame is a running sum of what enters and leaves it, so the work
    grows with the rows alone, whatever the sampling rate.
    """
    second = 1_000_000
    above = F.when(F.col(enmo) < 0.02, F.lit(0.0)).otherwise(F.col(enmo) - F.lit(0.02))
    part = [*keys, "_chunk"]

    def build(d, w):
        d = time_frame(d, part, us, 600 * second, "_s", "_total", "_n")
        # What is left of a frame of zeros is rounding.
        total = F.when(F.col("_n") > 0, F.greatest("_total", F.lit(0.0)))
        d = d.withColumn("_u", F.lit(100.0) / (total + F.lit(1.0))).drop("_total", "_n")
        d = time_frame(d, part, us, 1800 * second, "_u", "_total", "_n")
        return d.withColumn(name, F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")))

    out = over_chunks(
        df.withColumn("_s", above), keys, us, 2400 * second, 0, build, chunk_seconds * second
    )
    return out.drop("_s", "_u", "_total", "_n")


def _steps(time_diff: float, interval: float) -> int:
    return int(time_diff / float(interval))


def diff_prev_column(w_spec, value: str, steps: int) -> Column:
    mean = F.avg(value).over(w_spec.rowsBetween(-steps, -1))
    return F.coalesce(F.col(value) - mean, F.lit(0.0))


def diff_next_column(w_spec, value: str, steps: int) -> Column:
    mean = F.avg(value).over(w_spec.rowsBetween(1, steps))
    return F.coalesce(mean - F.col(value), F.lit(0.0))


def diff_prev(
    df: DataFrame, time_diff: float, interval: float = 30, lay: Layout = DEFAULT,
    chunk: int = CHUNK, name: str = "diff",
) -> DataFrame:
    """Value minus the mean of the previous ``time_diff`` seconds of epochs."""
    s = _steps(time_diff, interval)
    return over_chunks(
        df, lay.keys, lay.t, s, 0, lambda d, w: d.withColumn(name, diff_prev_column(w, lay.value, s)), chunk
    )


def diff_next(
    df: DataFrame, time_diff: float, interval: float = 30, lay: Layout = DEFAULT,
    chunk: int = CHUNK, name: str = "diff",
) -> DataFrame:
    """Mean of the next ``time_diff`` seconds of epochs minus the value."""
    s = _steps(time_diff, interval)
    return over_chunks(
        df, lay.keys, lay.t, 0, s, lambda d, w: d.withColumn(name, diff_next_column(w, lay.value, s)), chunk
    )


def weighted_activity(
    df: DataFrame, fs: int, window: int, min_thresh: float = 0.1, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    """Cole-Kripke style weighted activity of tumbling epochs."""
    size = int(fs * window)
    x = F.col(lay.value)
    e = (
        df.groupBy(*lay.keys, floor_div(F.col(lay.t), size).alias("epoch"))
        .agg(F.sum(F.when(x > min_thresh, F.abs(x)).otherwise(F.lit(0.0))).alias("_e"), F.count("*").alias("_n"))
        .where(F.col("_n") == size)
    )

    def build(d, w):
        at = lambda k: F.lag("_e", k).over(w) if k > 0 else F.lead("_e", -k).over(w)
        total = F.col("_e") + 0.2 * (at(1) + at(-1)) + 0.04 * (at(2) + at(-2))
        return d.withColumn("activity", F.coalesce(total, F.lit(0.0)))

    return over_chunks(e, lay.keys, "epoch", 2, 2, build, chunk).drop("_e", "_n")


def max_filter(df: DataFrame, size: int, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Sliding maximum; even sizes reach one further back than ahead."""
    back, ahead = size // 2, size - size // 2 - 1

    def build(d, w):
        return d.withColumn(lay.value, F.max(lay.value).over(w.rowsBetween(-back, ahead)))

    return over_chunks(df, lay.keys, lay.t, back, ahead, build, chunk)


# ---- binary morphology -------------------------------------------------------


def _dilated(d, w, c, m):
    return d.withColumn(c, F.max(c).over(w.rowsBetween(-m, m)))


def _eroded(d, w, c, m):
    frame = w.rowsBetween(-m, m)
    whole = F.count(c).over(frame) == 2 * m + 1
    return d.withColumn(c, F.when(whole, F.min(c).over(frame)).otherwise(F.lit(0)))


def _morph(df, lay, steps, chunk):
    reach = sum(m for _, m in steps)

    def build(d, w):
        d = d.withColumn(lay.value, F.col(lay.value).cast("int"))
        for op, m in steps:
            d = op(d, w, lay.value, m)
        return d

    return over_chunks(df, lay.keys, lay.t, reach, reach, build, chunk)


def dilate(df: DataFrame, m: int, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    return _morph(df, lay, [(_dilated, m)], chunk)


def erode(df: DataFrame, m: int, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Erosion with a zero border."""
    return _morph(df, lay, [(_eroded, m)], chunk)


def close_then_open(
    df: DataFrame, merge_size: int, min_len: int, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    """Merge events closer than ``2*merge_size``, then drop those up to ``2*min_len`` long.

    All four passes share one partitioning and sort. The border is zero, so
    closing takes ``merge_size`` cells from events touching a recording's edge.
    """
    steps = []
    if merge_size > 0:
        steps += [(_dilated, merge_size), (_eroded, merge_size)]
    if min_len > 0:
        steps += [(_eroded, min_len), (_dilated, min_len)]
    return _morph(df, lay, steps, chunk)


def runs(
    df: DataFrame, flag: str, keys: Sequence[str], t: str = "t", chunk: int = CHUNK,
    sums: Sequence[str] = (), tops: Sequence[str] = (),
) -> DataFrame:
    """Maximal runs of ``flag = 1`` as ``[start, stop)``, with optional sums and maxima.

    Runs are found per chunk; only pieces touching a chunk border (at most two
    per chunk) are merged across chunks.
    """
    keys = list(keys)
    carried = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in tops]
    w = Window.partitionBy(*keys, "_chunk").orderBy(t)
    on = F.col(flag) == 1
    begins = on & ~F.coalesce(F.lag(flag).over(w) == 1, F.lit(False))
    pieces = (
        df.withColumn("_chunk", floor_div(F.col(t), chunk))
        .withColumn("_begin", begins.cast("int"))
        .withColumn("_run", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(on)
        .groupBy(*keys, "_chunk", "_run")
        .agg(F.min(t).cast("long").alias("start"), (F.max(t) + 1).cast("long").alias("stop"), *carried)
    )
    touching = (F.col("start") == F.col("_chunk") * chunk) | (F.col("stop") == (F.col("_chunk") + 1) * chunk)
    pieces = pieces.withColumn("_edge", touching)
    kept = [*keys, "start", "stop", *sums, *tops]
    order = Window.partitionBy(*keys).orderBy("start")
    apart = ~F.coalesce(F.lag("stop").over(order) == F.col("start"), F.lit(False))
    merged = (
        pieces.where("_edge")
        .withColumn("_apart", apart.cast("int"))
        .withColumn("_run", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *carried)
    )
    return pieces.where("not _edge").select(*kept).unionByName(merged.select(*kept))


def beat_intervals(
    df: DataFrame, fs: float, average_seconds: float = 0.75, lay: Layout = DEFAULT, chunk: int = CHUNK
) -> DataFrame:
    """Peaks of the stretches above a centred moving average, and the time between them.

    Columns ``beat`` (sample index of the peak) and ``rr`` (seconds since the
    previous peak; NULL for the first).
    """
    h = odd_window(fs, average_seconds) // 2

    def build(d, w):
        mean = F.avg(lay.value).over(w.rowsBetween(-h, h))
        return d.withColumn("_on", (F.col(lay.value) > mean).cast("int"))

    flagged = over_chunks(df.select(*lay.keys, lay.t, lay.value), lay.keys, lay.t, h, h, build, chunk)
    # Highest sample of a run, the earliest one on a tie.
    best = flagged.withColumn("_best", F.struct(F.col(lay.value).alias("v"), (-F.col(lay.t)).alias("nt")))
    beats = runs(best, "_on", lay.keys, lay.t, chunk, tops=["_best"]).select(
        *lay.keys, (-F.col("_best.nt")).cast("long").alias("beat")
    )
    out = previous(beats, lay.keys, floor_div(F.col("beat"), chunk), ["beat"], "beat", "_prev")
    return out.select(*lay.keys, "beat", ((F.col("beat") - F.col("_prev")) / F.lit(float(fs))).alias("rr"))
