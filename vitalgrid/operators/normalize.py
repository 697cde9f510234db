"""Per-recording normalisation: group statistics joined back to the samples.

A group is ``(record, channel)`` unless said otherwise. Statistics are partial
aggregates (or exact distributed quantiles), so the samples themselves are not
shuffled when the statistics table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import rows
from vitalgrid.model import CHUNK, DEFAULT, EPS, Layout
from vitalgrid.operators.chunks import floor_div, over_chunks, previous
from vitalgrid.operators.quantiles import group_quantiles, with_quantiles
from vitalgrid.session import attach, with_stats


def _scaled(df: DataFrame, lay: Layout, keys: Sequence[str], expr, **aggs: Column) -> DataFrame:
    out = with_stats(df, keys, lay.t, **aggs)
    return out.withColumn(lay.value, expr(F.col(lay.value))).drop(*aggs)


def zscore(df: DataFrame, lay: Layout = DEFAULT) -> DataFrame:
    x = F.col(lay.value)
    return _scaled(
        df, lay, lay.keys, lambda v: (v - F.col("_m")) / (F.col("_s") + F.lit(EPS)),
        _m=F.avg(x), _s=F.stddev_pop(x),
    )


def complete_zscore(df: DataFrame, lay: Layout = DEFAULT, group: Sequence[str] = ("record",)) -> DataFrame:
    """One mean and deviation over all channels of a record."""
    x = F.col(lay.value)
    return _scaled(
        df, lay, group, lambda v: F.try_divide(v - F.col("_m"), F.col("_s")), _m=F.avg(x), _s=F.stddev_pop(x)
    )


def zscore_axis(df: DataFrame, lay: Layout = DEFAULT) -> DataFrame:
    """Constant channels pass unchanged."""
    x = F.col(lay.value)
    return _scaled(
        df, lay, lay.keys,
        lambda v: F.when(F.col("_lo") == F.col("_hi"), v).otherwise((v - F.col("_m")) / F.col("_s")),
        _m=F.avg(x), _s=F.stddev_pop(x), _lo=F.min(x), _hi=F.max(x),
    )


def zscore_log(df: DataFrame, min_value: float, max_value: float, lay: Layout = DEFAULT) -> DataFrame:
    x = F.col(lay.value)
    y = F.log(rows.clip(x, min_value, max_value) + F.lit(1.0))
    return _scaled(
        df, lay, lay.keys,
        lambda v: F.when(F.col("_lo") == F.col("_hi"), v).otherwise(F.try_divide(y - F.col("_m"), F.col("_s"))),
        _m=F.avg(y), _s=F.stddev_pop(y), _lo=F.min(x), _hi=F.max(x),
    )


def min_max(df: DataFrame, lay: Layout = DEFAULT) -> DataFrame:
    x = F.col(lay.value)
    return _scaled(
        df, lay, lay.keys, lambda v: F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")),
        _lo=F.min(x), _hi=F.max(x),
    )


def set_min(df: DataFrame, new_minimum: float = 0, lay: Layout = DEFAULT) -> DataFrame:
    return _scaled(
        df, lay, lay.keys,
        lambda v: v - F.col("_lo") + F.lit(1e-10) + F.lit(float(new_minimum)), _lo=F.min(lay.value),
    )


def soft(df: DataFrame, perc_low: float, perc_high: float, lay: Layout = DEFAULT) -> DataFrame:
    """Scale so that two percentiles become 0 and 1; zero when they coincide."""
    q = with_quantiles(
        df, lay.keys, lay.t, lay.value, [perc_low / 100, perc_high / 100], ["_lo", "_hi"]
    )
    v = F.col(lay.value)
    scaled = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(
        (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    return q.withColumn(lay.value, scaled).drop("_lo", "_hi")


def iqr_normalization(
    df: DataFrame, iqr_upper: float = 0.75, iqr_lower: float = 0.25, lay: Layout = DEFAULT
) -> DataFrame:
    q = with_quantiles(df, lay.keys, lay.t, lay.value, [iqr_lower, iqr_upper], ["_lo", "_hi"])
    v = F.col(lay.value)
    scaled = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(EPS)) * 2 - 1
    return q.withColumn(lay.value, scaled).drop("_lo", "_hi")


def polarity(df: DataFrame, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Per group: median step within the positive and the negative part of the signal."""
    x = F.col(lay.value)

    def gradient(d, w):
        before, after = F.lag(lay.value).over(w), F.lead(lay.value).over(w)
        central = (after - before) / 2
        return d.withColumn("_g", F.coalesce(central, after - x, x - before))

    sloped = over_chunks(df.select(*lay.keys, lay.t, lay.value), lay.keys, lay.t, 1, 1, gradient, chunk)
    part = F.when(x > 0, "above").when(x < 0, "below")
    moving = sloped.where(F.abs("_g") > 0).withColumn("_part", part).where(F.col("_part").isNotNull())
    by = [*lay.keys, "_part"]
    steps = previous(moving, by, floor_div(F.col(lay.t), chunk), [lay.t], lay.value, "_prev")
    steps = steps.select(*by, F.abs(x - F.col("_prev")).alias("_d")).where("_d is not null")
    medians = group_quantiles(steps, by, "_d", [0.5], ["_med"])
    return medians.groupBy(*lay.keys).agg(
        F.max(F.when(F.col("_part") == "above", F.col("_med"))).alias("above"),
        F.max(F.when(F.col("_part") == "below", F.col("_med"))).alias("below"),
    )


def polarity_correction(df: DataFrame, lay: Layout = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Negate recordings whose negative side moves faster than the positive one."""
    flags = polarity(df, lay, chunk).select(*lay.keys, (F.col("below") > F.col("above")).alias("_flip"))
    out = attach(df, flags, lay.keys, lay.t, how="left")
    v = F.col(lay.value)
    return out.withColumn(lay.value, F.when(F.col("_flip"), -v).otherwise(v)).drop("_flip")


def axis_flip(
    df: DataFrame, keys: Sequence[str] = ("record",), t: str = "t", x: str = "x", y: str = "y", z: str = "z"
) -> DataFrame:
    """Negate x and y of records whose median x-angle is positive."""
    angle = df.withColumn("_a", rows.tilt(F.col(x), F.col(y), F.col(z)))
    out = attach(df, group_quantiles(angle, keys, "_a", [0.5], ["_med"]), keys, t)
    flip = F.col("_med") > 0
    return (
        out.withColumn(x, F.when(flip, -F.col(x)).otherwise(F.col(x)))
        .withColumn(y, F.when(flip, -F.col(y)).otherwise(F.col(y)))
        .drop("_med")
    )


def pca(
    df: DataFrame,
    columns: Sequence[str],
    n_components: int = 1,
    keys: Sequence[str] = ("record",),
    t: str = "t",
) -> DataFrame:
    """Centred projection on the leading principal axes of each record.

    Covariances are one partial aggregate; only the small matrix of each record
    reaches the eigen step. Sign: the largest absolute loading is positive.
    """
    columns = list(columns)
    if len(columns) < 2:
        return df
    c = len(columns)
    moments = df.groupBy(*keys).agg(
        F.array(*[F.avg(a) for a in columns]).alias("_mean"),
        F.array(*[F.covar_pop(a, b) for a in columns for b in columns]).alias("_cov"),
    )

    @F.pandas_udf("array<double>")
    def loadings(cov: pd.Series) -> pd.Series:
        def one(flat):
            values, vectors = np.linalg.eigh(np.asarray(flat, dtype=float).reshape(c, c))
            lead = vectors[:, np.argsort(values)[::-1][:n_components]]
            peak = np.abs(lead).argmax(axis=0)
            return (lead * np.sign(lead[peak, range(lead.shape[1])])).T.ravel()

        return cov.map(one)

    axes = moments.select(*keys, "_mean", loadings("_cov").alias("_axes"))
    out = attach(df, axes, keys, t)
    for k in range(n_components):
        terms = [
            (F.col(a) - F.col("_mean")[i]) * F.col("_axes")[k * c + i] for i, a in enumerate(columns)
        ]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        out = out.withColumn(f"pc{k + 1}", total)
    return out.drop("_mean", "_axes")
