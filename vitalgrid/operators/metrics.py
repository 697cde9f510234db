"""Agreement metrics as aggregates over ``predictions`` and event tables.

Epoch metrics start from four conditional counts per group; threshold sweeps
bucket the scores once and accumulate over at most ``num_samples + 1`` buckets,
so a sweep costs one pass whatever the number of thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.model import KAPPA
from vitalgrid.operators.partners import matched_spans
from vitalgrid.session import settle


def _masked(df: DataFrame, mask: bool) -> DataFrame:
    return df.where(F.col("y_true") >= -0.5) if mask else df


def confusion(
    df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, mask: bool = True
) -> DataFrame:
    """tp, tn, fp, fn per group; a positive is strictly above the threshold."""
    pos = (F.col("y_pred") > threshold).cast("double")
    y = F.col("y_true")
    return _masked(df, mask).groupBy(*by).agg(
        F.sum(y * pos).alias("tp"), F.sum((1 - y) * (1 - pos)).alias("tn"),
        F.sum((1 - y) * pos).alias("fp"), F.sum(y * (1 - pos)).alias("fn"),
    )


def confusion_counts(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    c = confusion(df, by, threshold)
    return c.select(*by, *[F.col(n).cast("long").alias(n) for n in ("tp", "tn", "fp", "fn")])


# SQL text of the epoch metrics over the four counts (parsed when a session exists).
KAP = f"{KAPPA!r}D"
ACCURACY = f"(tp + tn) / (tp + tn + fp + fn + {KAP})"
PRECISION = f"tp / (tp + fp + {KAP})"
RECALL = f"tp / (tp + fn + {KAP})"
SPECIFICITY = f"tn / (tn + fp + {KAP})"
BALANCED = f"({RECALL} + {SPECIFICITY}) / 2"
BALANCED_NEW = f"tp / greatest(tp + fn + {KAP}, tp + fp + {KAP})"
MCC = f"(tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + {KAP})"
SEMANTIC_SPECIFICITY = "try_divide(tn, tn + fp)"


def f_beta(beta: float = 1) -> Column:
    b = F.lit(float(beta) ** 2)
    p, r = F.expr(PRECISION), F.expr(RECALL)
    return (1 + b) * p * r / (b * p + r + F.lit(KAPPA))


def kappa_value(guard: bool = True) -> Column:
    """Cohen's kappa of one class; ``guard`` adds the fuzz factor to the totals."""
    tp, tn, fp, fn = (F.col(n) for n in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    g = F.lit(KAPPA if guard else 0.0)
    po = F.try_divide(tp + tn, n + g)
    pe = F.try_divide((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn), n * n + g)
    return (po - pe) / (1 - pe + F.lit(KAPPA))


def _micro(expr: str):
    def metric(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
        return confusion(df, by, threshold).select(*by, F.expr(expr).alias("value"))

    return metric


def _class_mean(expr: str | None):
    def metric(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, cls: str = "class") -> DataFrame:
        c = confusion(df, [*by, cls], threshold).withColumn("_v", F.expr(expr) if expr else kappa_value())
        return c.groupBy(*by).agg(F.avg("_v").alias("value"))

    return metric


binary_accuracy = _micro(ACCURACY)
precision = _micro(PRECISION)
recall = _micro(RECALL)
specificity = _micro(SPECIFICITY)
mcc = _micro(MCC)
balanced_accuracy = _class_mean(BALANCED)
balanced_accuracy_new = _class_mean(BALANCED_NEW)
cohens_kappa = _class_mean(None)


def f1_mean(df: DataFrame, beta: float = 1, by: Sequence[str] = ()) -> DataFrame:
    return confusion(df, by).select(*by, f_beta(beta).alias("value"))


def f1_by_class(df: DataFrame, beta: float = 1, by: Sequence[str] = (), cls: str = "class") -> DataFrame:
    return confusion(df, [*by, cls]).select(*by, cls, f_beta(beta).alias("value"))


# ---- threshold sweeps -------------------------------------------------------------------


def sweep(
    df: DataFrame, lower: float, upper: float, num_samples: int = 100, by: Sequence[str] = (), mask: bool = True
) -> DataFrame:
    """tp, tn, fp, fn at evenly spaced thresholds, from one bucketed pass."""
    by = list(by)
    grid = [float(v) for v in np.linspace(lower, upper, num_samples)]
    step = (upper - lower) / (num_samples - 1)
    points = F.array(*[F.lit(v) for v in grid])
    p = F.col("y_pred")
    # Number of thresholds below the score: closed form, corrected by one if
    # rounding put it on the wrong side of a grid point.
    guess = F.least(F.greatest(F.ceil((p - F.lit(lower)) / F.lit(step)), F.lit(0)), F.lit(num_samples)).cast("int")
    down = (guess > 0) & ~(p > F.element_at(points, F.greatest(guess, F.lit(1))))
    up = (guess < num_samples) & (p > F.element_at(points, F.least(guess + 1, F.lit(num_samples))))
    above = guess - down.cast("int") + up.cast("int")
    y = F.col("y_true")
    counts = (
        _masked(df, mask).groupBy(*by, above.alias("_above"))
        .agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    )
    # Spread each bucket over the thresholds it clears: at most one row per
    # (bucket, threshold), both bounded by num_samples.
    index = F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1)))
    hit = F.col("_above") > F.col("i")
    table = counts.withColumn("i", index).groupBy(*by, "i").agg(
        F.sum(F.when(hit, F.col("_p")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(hit, F.col("_n")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_p")).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~hit, F.col("_n")).otherwise(0.0)).alias("tn"),
    )
    return table.withColumn("threshold", F.element_at(points, F.col("i") + 1))


def cohens_kappa_sweep(df: DataFrame, lower: float = 0.2, upper: float = 0.8, num_samples: int = 100,
                       by: Sequence[str] = (), mask: bool = True, cls: str = "class") -> DataFrame:
    s = sweep(df, lower, upper, num_samples, [*by, cls], mask).withColumn("_v", kappa_value(False))
    return s.groupBy(*by).agg(F.avg("_v").alias("value"))


def _area(df, lower, upper, num_samples, by, mask, height, width):
    s = sweep(df, lower, upper, num_samples, by, mask).withColumn("_h", height).withColumn("_w", width)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("i")
    step = F.col("_h") * (F.lag("_w").over(w) - F.col("_w"))
    return s.withColumn("_a", step).groupBy(*by).agg(F.sum("_a").alias("value"))


def auroc(df: DataFrame, lower: float = 0.01, upper: float = 0.99, num_samples: int = 100,
          by: Sequence[str] = (), mask: bool = True) -> DataFrame:
    return _area(df, lower, upper, num_samples, list(by), mask, F.expr(RECALL), 1 - F.expr(SPECIFICITY))


def auprc(df: DataFrame, lower: float = 0.01, upper: float = 0.99, num_samples: int = 100,
          by: Sequence[str] = (), mask: bool = True) -> DataFrame:
    return _area(df, lower, upper, num_samples, list(by), mask, F.expr(PRECISION), F.expr(RECALL))


def optimized_f1(df: DataFrame, lower: float = 0.2, upper: float = 0.8, num_samples: int = 100, beta: float = 1,
                 by: Sequence[str] = (), mask: bool = True) -> DataFrame:
    """Mean F score over the thresholds."""
    s = sweep(df, lower, upper, num_samples, by, mask).withColumn("_v", f_beta(beta))
    return s.groupBy(*by).agg(F.avg("_v").alias("value"))


def optimized_f12(df: DataFrame, lower: float = 0.2, upper: float = 0.8, num_samples: int = 100, beta: float = 1,
                  by: Sequence[str] = (), mask: bool = True, cls: str = "class") -> DataFrame:
    """The same per class, then averaged over classes."""
    s = sweep(df, lower, upper, num_samples, [*by, cls], mask).withColumn("_v", f_beta(beta))
    return s.groupBy(*by).agg(F.avg("_v").alias("value"))


def multiclass_agreement(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy and Cohen's kappa of two label columns, through the crosstab.

    The crosstab (classes squared) is settled: it is read three times below.
    """
    cells = settle(df.groupBy(true, pred).agg(F.count("*").alias("c")))
    total = cells.agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col(true) == F.col(pred), F.col("c")).otherwise(0)).alias("same")
    )
    sides = (
        cells.select(F.col(true).alias("k"), F.col("c").alias("a"), F.lit(0).alias("b"))
        .unionByName(cells.select(F.col(pred).alias("k"), F.lit(0).alias("a"), F.col("c").alias("b")))
        .groupBy("k").agg((F.sum("a") * F.sum("b")).cast("double").alias("ab"))
        .agg(F.sum("ab").alias("ab"))
    )
    # Two one-row tables meet on a constant key.
    both = total.withColumn("_k", F.lit(1)).join(sides.withColumn("_k", F.lit(1)), "_k")
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return both.select(po.alias("accuracy"), ((po - pe) / (1 - pe)).alias("kappa"))


def one_hot_labels(
    df: DataFrame, classes: Sequence[str], keys: Sequence[str] = ("record", "epoch"), cls: str = "class"
) -> DataFrame:
    """True and predicted class of epochs with exactly one true class (first listed class on a tie).

    One conditional maximum per class keeps the aggregation on plain doubles
    (hash aggregation); the strongest class is picked afterwards.
    """
    side = lambda c: [F.max(F.when(F.col(cls) == k, F.col(c))).alias(f"_{c}{i}") for i, k in enumerate(classes)]
    g = df.where(F.col(cls).isin(list(classes))).groupBy(*keys).agg(
        F.sum("y_true").alias("_s"), *side("y_true"), *side("y_pred")
    )
    names = F.array(*[F.lit(k) for k in classes])

    def strongest(c):
        values = F.array(*[F.col(f"_{c}{i}") for i in range(len(classes))])
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return g.where(F.col("_s") == 1).select(
        *keys, strongest("y_true").alias("true_class"), strongest("y_pred").alias("pred_class")
    )


# ---- binary sequences ----------------------------------------------------------------------


accuracy_semantic = _micro(ACCURACY)
recall_semantic = _micro(RECALL)
precision_semantic = _micro(PRECISION)
specificity_semantic = _micro(SEMANTIC_SPECIFICITY)


# ---- events -----------------------------------------------------------------------------------


def true_positive_events(targets: DataFrame, outputs: DataFrame, min_iou: float = 0.5,
                         keys: Sequence[str] = ("record", "class"), bucket: float = 3600) -> DataFrame:
    hit, _ = matched_spans(targets, outputs, min_iou, keys, bucket)
    return targets.join(hit, [*keys, "start", "stop"], "left_semi")


def false_negative_events(targets: DataFrame, outputs: DataFrame, min_iou: float = 0.5,
                          keys: Sequence[str] = ("record", "class"), bucket: float = 3600) -> DataFrame:
    hit, _ = matched_spans(targets, outputs, min_iou, keys, bucket)
    return targets.join(hit, [*keys, "start", "stop"], "left_anti")


def false_positive_events(targets: DataFrame, outputs: DataFrame, min_iou: float = 0.5,
                          keys: Sequence[str] = ("record", "class"), bucket: float = 3600) -> DataFrame:
    _, hit = matched_spans(targets, outputs, min_iou, keys, bucket)
    return outputs.join(hit, [*keys, "start", "stop"], "left_anti")


def event_counts(targets: DataFrame, outputs: DataFrame, min_iou: float = 0.5,
                 keys: Sequence[str] = ("record", "class"), bucket: float = 3600) -> DataFrame:
    """Per key: targets, outputs, matched targets and matched outputs.

    Spans are counted first, so copies are one row in everything that follows;
    the contributions meet in one aggregation.
    """
    keys = list(keys)
    span = [*keys, "start", "stop"]
    t = targets.groupBy(*span).agg(F.count("*").alias("_n"))
    o = outputs.groupBy(*span).agg(F.count("*").alias("_n"))
    t_hit, o_hit = matched_spans(t, o, min_iou, keys, bucket)

    def tally(df, hits, all_name, hit_name):
        marked = df.join(hits.withColumn("_hit", F.lit(1)), span, "left")
        zero = F.lit(0).cast("long")
        cols = {n: zero for n in ("targets", "outputs", "hit_targets", "hit_outputs")}
        cols[all_name] = F.col("_n")
        cols[hit_name] = F.when(F.col("_hit") == 1, F.col("_n")).otherwise(zero)
        return marked.select(*keys, *[c.alias(n) for n, c in cols.items()])

    parts = tally(t, t_hit, "targets", "hit_targets").unionByName(tally(o, o_hit, "outputs", "hit_outputs"))
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("targets", "outputs", "hit_targets", "hit_outputs")])


# SQL text of the event metrics over the four counts.
EVENT_PRECISION = "CASE WHEN outputs = 0 THEN 1D WHEN targets = 0 THEN 0D ELSE hit_outputs / outputs END"
EVENT_RECALL = "CASE WHEN targets = 0 THEN 1D WHEN outputs = 0 THEN 0D ELSE hit_targets / targets END"
EVENT_F1 = (
    f"coalesce(try_divide(2 * ({EVENT_PRECISION}) * ({EVENT_RECALL}), ({EVENT_PRECISION}) + ({EVENT_RECALL})), 0D)"
)
EVENT_METRICS = {
    "true_positives": "hit_outputs", "false_positives": "outputs - hit_outputs",
    "false_negatives": "targets - hit_targets", "precision": EVENT_PRECISION, "recall": EVENT_RECALL,
    "f1": EVENT_F1, "absolute_error": "abs(targets - outputs)",
}


def event_metric(name: str, targets: DataFrame, outputs: DataFrame, min_iou: float = 0.5,
                 keys: Sequence[str] = ("record", "class"), bucket: float = 3600) -> DataFrame:
    counts = event_counts(targets, outputs, min_iou, keys, bucket)
    return counts.select(*keys, F.expr(EVENT_METRICS[name]).alias("value"))


def batch_mean_f1(df: DataFrame, batch: str, by: Sequence[str] = (), cls: str | None = None, beta: float = 1) -> DataFrame:
    """F score per batch, averaged over batches per data set (and class)."""
    extra = [cls] if cls else []
    per_batch = confusion(df, [*by, *extra, batch]).withColumn("_v", f_beta(beta))
    return per_batch.groupBy(*by, *extra).agg(F.avg("_v").alias("value"))
