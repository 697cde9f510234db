"""Heart-rate-variability features of extended epochs (Task Force 1996 definitions)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.model import DEFAULT, Layout
from vitalgrid.operators.resample import explode_epochs

TIME_NAMES = (
    "mean_nn", "median_nn", "range_nn", "sdnn", "sdsd", "rmssd", "nn50", "pnn50", "nn20", "pnn20",
    "cvsd", "cvnn", "mean_hr", "max_hr", "min_hr", "std_hr",
)
POINCARE_NAMES = ("sd1", "sd2", "ratio_sd2_sd1")
CSI_NAMES = ("csi", "cvi", "modified_csi")


def rr_epochs(df: DataFrame, fs: int, window: int, ext: int, lay: Layout = DEFAULT) -> DataFrame:
    """RR values (> 0.15 s, one per second of signal) of each extended epoch, with differences.

    Epochs without a usable value keep a row of NULLs. An epoch holds at most
    ``window + 2*ext`` samples, so the ordered window below is bounded.
    """
    sampled = df.where(F.pmod(F.col(lay.t), F.lit(fs)) == 0).select(*lay.keys, lay.t, lay.value)
    wide = explode_epochs(sampled, lay.t, window, ext)
    rr = F.when(F.col(lay.value) > 0.15, F.col(lay.value).cast("double"))
    w = Window.partitionBy(*lay.keys, "epoch").orderBy(lay.t)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("_rr", rr).withColumn("_prev", F.last("_rr", ignorenulls=True).over(before))
    return wide.withColumn("_d", F.col("_rr") - F.col("_prev"))


def _clean(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def _aggregates() -> list[Column]:
    hr = F.lit(60.0) / F.col("_rr")
    return [
        F.count("_rr").alias("_n"), F.avg("_rr").alias("mean_nn"), F.median("_rr").alias("median_nn"),
        (F.max("_rr") - F.min("_rr")).alias("range_nn"), F.stddev_samp("_rr").alias("sdnn"),
        F.stddev_pop("_d").alias("sdsd"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
        F.count_if(F.abs("_d") * 1000 > 50).cast("double").alias("nn50"),
        F.count_if(F.abs("_d") * 1000 > 20).cast("double").alias("nn20"),
        F.avg(hr).alias("mean_hr"), F.max(hr).alias("max_hr"), F.min(hr).alias("min_hr"),
        F.stddev_pop(hr).alias("std_hr"), F.var_samp("_d").alias("_vd"), F.var_samp("_rr").alias("_vr"),
        F.sum("_core").alias("_own"),
    ]


def hrv_features(
    df: DataFrame, fs: int, window: int, ext: int, lay: Layout = DEFAULT, entropy: bool = False
) -> DataFrame:
    """Time-domain (16), Poincaré (3) and CSI/CVI (3) values, optionally sample entropy.

    ``window`` and ``ext`` are in samples and multiples of ``fs``.
    """
    by = [*lay.keys, "epoch"]
    aggs = _aggregates()
    if entropy:
        pairs = F.collect_list(F.when(F.col("_rr").isNotNull(), F.struct(lay.t, "_rr")))
        aggs.append(F.transform(F.array_sort(pairs), lambda s: s["_rr"]).alias("_list"))
    g = rr_epochs(df, fs, window, ext, lay).groupBy(*by).agg(*aggs)
    g = g.where(F.col("_own") == window // fs)
    n = F.col("_n").cast("double")
    g = (
        g.withColumn("pnn50", F.when(n > 0, F.lit(100.0) * F.col("nn50") / n))
        .withColumn("pnn20", F.when(n > 0, F.lit(100.0) * F.col("nn20") / n))
        .withColumn("cvsd", F.col("rmssd") / F.col("mean_nn"))
        .withColumn("cvnn", F.col("sdnn") / F.col("mean_nn"))
        .withColumn("sd1", F.sqrt(F.col("_vd") / 2))
        .withColumn("_sq", 2 * F.col("_vr") - F.col("_vd") / 2)
        .withColumn("sd2", F.when(F.col("_sq") >= 0, F.sqrt("_sq")))
        .withColumn("ratio_sd2_sd1", F.when(F.col("sd1") > 0, F.col("sd2") / F.col("sd1")))
        .withColumn("_t", 4 * F.col("sd1"))
        .withColumn("_l", 4 * F.col("sd2"))
        .withColumn("csi", F.when(F.col("_t") > 0, F.col("_l") / F.col("_t")))
        .withColumn("cvi", F.when(F.col("_l") * F.col("_t") > 0, F.log10(F.col("_l") * F.col("_t"))))
        .withColumn("modified_csi", F.when(F.col("_t") > 0, F.col("_l") * F.col("_l") / F.col("_t")))
    )
    names = [*TIME_NAMES, *POINCARE_NAMES, *CSI_NAMES]
    out = [_clean(F.col(c)).alias(c) for c in names]
    if entropy:
        out.append(_clean(sample_entropy_udf("_list")).alias("sampen"))
    return g.select(*by, *out)


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """``-ln(A/B)`` over template pairs closer than ``r`` deviations (Chebyshev)."""
    x = np.asarray(x, dtype=float)
    n = len(x) - m
    if n < 2:
        return float("nan")
    tolerance = r * x.std()
    longer = shorter = 0
    # Row by row over a bounded epoch: no pair matrix is kept.
    for i in range(n - 1):
        near = np.abs(x[i + 1 : n] - x[i]) <= tolerance
        for k in range(1, m):
            near &= np.abs(x[i + 1 + k : n + k] - x[i + k]) <= tolerance
        shorter += int(near.sum())
        longer += int((near & (np.abs(x[i + 1 + m : n + m] - x[i + m]) <= tolerance)).sum())
    if longer == 0 or shorter == 0:
        return float("nan")
    return float(-np.log(longer / shorter))


def sample_entropy_udf(column: str) -> Column:
    @F.pandas_udf("double")
    def entropy(lists: pd.Series) -> pd.Series:
        return lists.map(sample_entropy)

    return entropy(column)


BEAT_NAMES = (
    "bpm", "ibi", "sdnn", "sdsd", "rmssd", "pnn20", "pnn50", "hr_mad", "sd1", "sd2", "s", "sd1_sd2",
)


def beat_measures(beats: DataFrame, fs: int, window: int, keys: Sequence[str] = ("record", "channel")) -> DataFrame:
    """Twelve values per epoch from detected beats (``beat_intervals`` output), ms where a time.

    A beat belongs to the epoch of its peak; differences of successive intervals
    stay inside the epoch. The breathing rate is not computed.
    """
    by = [*keys, "epoch"]
    w = Window.partitionBy(*by).orderBy("beat")
    rr = beats.where(F.col("rr").isNotNull()).select(
        *keys, F.floor(F.col("beat") / F.lit(window)).cast("long").alias("epoch"), "beat",
        (F.col("rr") * 1000).alias("_rr"),
    )
    rr = rr.withColumn("_d", F.col("_rr") - F.lag("_rr").over(w))
    rr = rr.withColumn("_med", F.median("_rr").over(Window.partitionBy(*by)))
    g = rr.groupBy(*by).agg(
        F.avg("_rr").alias("ibi"), F.stddev_pop("_rr").alias("sdnn"), F.stddev_pop("_d").alias("sdsd"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
        F.try_divide(F.count_if(F.abs("_d") > 20), F.count("_d")).alias("pnn20"),
        F.try_divide(F.count_if(F.abs("_d") > 50), F.count("_d")).alias("pnn50"),
        F.median(F.abs(F.col("_rr") - F.col("_med"))).alias("hr_mad"),
        F.var_samp("_d").alias("_vd"), F.var_samp("_rr").alias("_vr"),
    )
    g = (
        g.withColumn("bpm", F.lit(60000.0) / F.col("ibi"))
        .withColumn("sd1", F.sqrt(F.col("_vd") / 2))
        .withColumn("_sq", 2 * F.col("_vr") - F.col("_vd") / 2)
        .withColumn("sd2", F.when(F.col("_sq") >= 0, F.sqrt("_sq")))
        .withColumn("s", F.lit(float(np.pi)) * F.col("sd1") * F.col("sd2"))
        .withColumn("sd1_sd2", F.when(F.col("sd2") > 0, F.col("sd1") / F.col("sd2")))
    )
    return g.select(*by, *[_clean(F.col(c)).alias(c) for c in BEAT_NAMES])
