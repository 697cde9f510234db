"""Masked log-loss family as evaluation aggregates.

Every loss is a row expression over ``y_true``, ``y_pred`` and class weights,
followed by one aggregation. A masked mean appends one constant, so a value is
``-(sum + k) / (n + 1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.model import KAPPA
from vitalgrid.operators.intervals import hard_top_k
from vitalgrid.operators.quantiles import group_quantiles
from vitalgrid.session import attach



def _kap() -> Column:
    return F.lit(KAPPA)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, _kap()), F.lit(1.0 - KAPPA))


def _y() -> Column:
    return F.col("y_true")


def _p1() -> Column:
    """Score of true positives, 1 elsewhere."""
    return _clip(F.when(_y() == 1, F.col("y_pred")).otherwise(F.lit(1.0)))


def _p0() -> Column:
    """Score of true negatives, 0 elsewhere."""
    return _clip(F.when(_y() == 0, F.col("y_pred")).otherwise(F.lit(0.0)))


def _log_pos() -> Column:
    return F.log(_p1())


def _log_neg() -> Column:
    return F.log(1 - _p0())


def _unmasked(df: DataFrame) -> DataFrame:
    return df.where(_y() >= -0.5)


def _weighted(df: DataFrame, group: Sequence[str], cls: str, spread: str) -> DataFrame:
    """Class positives, negatives and share as columns.

    The row count is that of the first class, as every class has the same rows
    in a batch.
    """
    group = list(group)
    stats = df.groupBy(*group, cls).agg(F.sum(_y()).alias("_pos"), F.count("*").alias("_rows"))
    first = stats.groupBy(*group).agg(F.min_by("_rows", cls).alias("_base"))
    if group:
        stats = stats.join(first, group)
    else:
        stats = stats.withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k").drop("_k")
    stats = stats.withColumn("_neg", F.col("_base") - F.col("_pos")).withColumn(
        "_pw", _clip(F.col("_pos") / F.col("_base"))
    )
    return attach(df, stats.drop("_rows", "_base"), [*group, cls], spread)


def _masked_mean(total: Column, rows: Column) -> Column:
    return -(total + _kap()) / (rows + 1)


def _mean(df: DataFrame, term: Column, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(_masked_mean(F.sum(term), F.count("*")).alias("value"))


def _hardest(df: DataFrame, term: Column, group, rate, num_samples, spread) -> DataFrame:
    """Sum (_s) and number (_n) of the smallest terms of each group.

    A share of the counted rows is summed below the quantile of that share, which lies within one row of the last
    one kept: no group is ranked in one task, whatever the share's size.
    """
    group = list(group)
    rows = df.withColumn("_loss", term)
    if num_samples is not None:
        top = hard_top_k(rows, "_loss", int(num_samples * rate), group, spread)
        return top.groupBy(*group).agg(F.sum("_loss").alias("_s"), F.count("*").alias("_n"))
    cut = group_quantiles(rows, group, "_loss", [rate], ["_cut"])
    rows = attach(rows, cut, group, spread) if group else rows.crossJoin(F.broadcast(cut))
    below = F.when(F.col("_loss") < F.col("_cut"), F.col("_loss"))
    sums = rows.groupBy(*group).agg(
        F.floor(F.count("_loss") * F.lit(float(rate))).alias("_n"), F.count(below).alias("_less"),
        F.sum(below).alias("_below"), F.max(below).alias("_last"), F.max("_cut").alias("_cut"),
    )
    edge = F.when(F.col("_less") < F.col("_n"), F.col("_cut")).when(F.col("_less") > F.col("_n"), F.col("_last"))
    total = F.coalesce("_below", F.lit(0.0)) + F.coalesce((F.col("_n") - F.col("_less")) * edge, F.lit(0.0))
    return sums.select(*group, total.alias("_s"), "_n")


def _hard(df: DataFrame, term: Column, group, rate, num_samples, spread) -> DataFrame:
    top = _hardest(df, term, group, rate, num_samples, spread)
    return top.select(*group, _masked_mean(F.col("_s"), F.col("_n")).alias("value"))


def _hard_negatives(df: DataFrame, pos: Column, neg: Column, group, rate, num_samples, spread) -> DataFrame:
    rows = df.withColumn("_pos_term", pos).withColumn("_neg_term", neg)
    parts = (
        rows.groupBy(*group).agg(F.sum("_pos_term").alias("_s"), F.count("*").alias("_n"))
        .unionByName(_hardest(rows, F.col("_neg_term"), group, rate, num_samples, spread))
    )
    return parts.groupBy(*group).agg(_masked_mean(F.sum("_s"), F.sum("_n")).alias("value"))


def _share_terms(alpha: float) -> tuple[Column, Column]:
    pw = F.col("_pw")
    nw = 1 - pw
    return F.pow(1 - pw, F.lit(alpha)) * _log_pos(), F.pow(1 - nw, F.lit(alpha)) * _log_neg()


def _effective(beta: float, count: Column) -> Column:
    return F.lit(1 - beta) / (1 - F.pow(F.lit(beta), count))




def _focal_pos(gamma: float) -> Column:
    return F.pow(1 - _p1(), F.lit(float(gamma)))


def _focal_neg(gamma: float) -> Column:
    return F.pow(_p0(), F.lit(float(gamma)))


def cross_entropy(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return _mean(_unmasked(df), _log_pos() + _log_neg(), group)


def weighted(df: DataFrame, alpha: float = 0.5, group: Sequence[str] = (), cls: str = "class", spread: str = "record") -> DataFrame:
    pos, neg = _share_terms(alpha)
    return _mean(_weighted(_unmasked(df), group, cls, spread), pos + neg, group)


def effective_number_cross_entropy(
    df: DataFrame, beta: float = 0.99, group: Sequence[str] = (), cls: str = "class", spread: str = "record"
) -> DataFrame:
    """Weights from effective class counts, normalised over the classes."""
    w = _weighted(_unmasked(df), group, cls, spread)
    smooth = lambda c: F.lit(1 - beta) / (1 - F.pow(F.lit(beta), c) + F.lit(1 - beta))
    w = w.withColumn("_wp", smooth(F.col("_pos"))).withColumn("_wn", smooth(F.col("_neg")))
    # Sum per class, then normalise by the weights of all classes of the group.
    per = w.groupBy(*group, cls).agg(
        F.sum(_log_pos()).alias("_lp"), F.sum(_log_neg()).alias("_ln"), F.count("*").alias("_n"),
        F.max("_wp").alias("_wp"), F.max("_wn").alias("_wn"),
    )
    total = F.sum(F.col("_wp") * F.col("_lp")) / F.sum("_wp") + F.sum(F.col("_wn") * F.col("_ln")) / F.sum("_wn")
    return per.groupBy(*group).agg(_masked_mean(total, F.sum("_n")).alias("value"))


def focal(df: DataFrame, gamma: float = 2.0, group: Sequence[str] = ()) -> DataFrame:
    return _mean(_unmasked(df), _focal_pos(gamma) * _log_pos() + _focal_neg(gamma) * _log_neg(), group)


def focal_weighted(df: DataFrame, alpha: float = 0.5, gamma: float = 2.0, group: Sequence[str] = (),
                   cls: str = "class", spread: str = "record") -> DataFrame:
    pos, neg = _share_terms(alpha)
    return _mean(_weighted(_unmasked(df), group, cls, spread), _focal_pos(gamma) * pos + _focal_neg(gamma) * neg, group)


def effective_number_focal(df: DataFrame, beta: float = 0.99, gamma: float = 2.0, group: Sequence[str] = (),
                           cls: str = "class", spread: str = "record") -> DataFrame:
    pos = _effective(beta, F.col("_pos")) * _focal_pos(gamma) * _log_pos()
    neg = _effective(beta, F.col("_neg")) * _focal_neg(gamma) * _log_neg()
    return _mean(_weighted(_unmasked(df), group, cls, spread), pos + neg, group)


# Hard mining keeps ``rate * num_samples`` rows of each group: the rows of a batch are the caller's to state. None
# stands for all unmasked rows of the group, as counted.


def ohem_cross_entropy(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str], spread: str = "record") -> DataFrame:
    return _hard(_unmasked(df), _log_pos() + _log_neg(), group, rate, num_samples, spread)


def ohem_weighted(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str],
                  alpha: float = 0.5, cls: str = "class", spread: str = "record") -> DataFrame:
    pos, neg = _share_terms(alpha)
    return _hard(_weighted(_unmasked(df), group, cls, spread), pos + neg, group, rate, num_samples, spread)


def ohem_effective(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str],
                   beta: float = 0.99, cls: str = "class", spread: str = "record") -> DataFrame:
    term = _effective(beta, F.col("_pos")) * _log_pos() + _effective(beta, F.col("_neg")) * _log_neg()
    return _hard(_weighted(_unmasked(df), group, cls, spread), term, group, rate, num_samples, spread)


def ohnm_cross_entropy(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str], spread: str = "record") -> DataFrame:
    return _hard_negatives(_unmasked(df), _log_pos(), _log_neg(), group, rate, num_samples, spread)


def ohnm_weighted(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str],
                  alpha: float = 0.5, cls: str = "class", spread: str = "record") -> DataFrame:
    pos, neg = _share_terms(alpha)
    return _hard_negatives(_weighted(_unmasked(df), group, cls, spread), pos, neg, group, rate, num_samples, spread)


def ohnm_effective(df: DataFrame, rate: float, num_samples: int | None, group: Sequence[str],
                   beta: float = 0.99, cls: str = "class", spread: str = "record") -> DataFrame:
    pos, neg = _effective(beta, F.col("_pos")) * _log_pos(), _effective(beta, F.col("_neg")) * _log_neg()
    return _hard_negatives(_weighted(_unmasked(df), group, cls, spread), pos, neg, group, rate, num_samples, spread)


# ---- categorical: one row per (row keys, class) ------------------------------------------------


def _proportions(df: DataFrame, row: Sequence[str]) -> DataFrame:
    """Predictions scaled to sum to 1 over the classes of a row (bounded by the class count)."""
    total = F.sum("y_pred").over(Window.partitionBy(*row))
    return df.withColumn("_q", _clip(F.col("y_pred") / total))


def _class_share(df: DataFrame, group, cls, spread) -> DataFrame:
    stats = df.groupBy(*group, cls).agg(_clip(F.avg(_y())).alias("_pw"))
    return attach(df, stats, [*group, cls], spread)


def _categorical(df, term, group):
    return df.groupBy(*group).agg(F.avg(term).alias("value"))


def _ce() -> Column:
    return -_y() * F.log("_q")


def categorical_cross_entropy(df: DataFrame, row: Sequence[str] = ("record", "epoch"), group: Sequence[str] = ()) -> DataFrame:
    return _categorical(_proportions(df, row), _ce(), group)


def categorical_cross_entropy_weighted(df: DataFrame, alpha: float = 0.5, row: Sequence[str] = ("record", "epoch"),
                                       group: Sequence[str] = (), cls: str = "class") -> DataFrame:
    w = _class_share(_proportions(df, row), group, cls, row[0])
    return _categorical(w, F.pow(1 - F.col("_pw"), F.lit(alpha)) * _ce(), group)


def categorical_focal(df: DataFrame, alpha: float = 0.25, gamma: float = 2.0, row: Sequence[str] = ("record", "epoch"),
                      group: Sequence[str] = ()) -> DataFrame:
    return _categorical(_proportions(df, row), F.lit(alpha) * F.pow(1 - F.col("_q"), F.lit(gamma)) * _ce(), group)


def categorical_focal_weighted(df: DataFrame, alpha: float = 0.5, gamma: float = 2.0, row: Sequence[str] = ("record", "epoch"),
                               group: Sequence[str] = (), cls: str = "class") -> DataFrame:
    w = _class_share(_proportions(df, row), group, cls, row[0])
    term = F.pow(1 - F.col("_pw"), F.lit(alpha)) * F.pow(1 - F.col("_q"), F.lit(gamma)) * _ce()
    return _categorical(w, term, group)


def dice(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    top, bottom = F.sum(_y() * F.col("y_pred")) + _kap(), F.sum(_y() + F.col("y_pred")) + _kap()
    return _unmasked(df).groupBy(*group).agg((1 - F.lit(0.5) * top / (bottom + _kap())).alias("value"))
