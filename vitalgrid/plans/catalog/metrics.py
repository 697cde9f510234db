from pyspark.sql import functions as F

from vitalgrid.operators import metrics as me
from vitalgrid.plans.catalog import query

K = "1e-7"
BUCKET = 14_400


def counts(by, thr="y_pred > 0.5", src="pred WHERE y_true >= -0.5", group=None):
    keys = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}sum(y_true * p)::DOUBLE AS tp, sum((1 - y_true) * (1 - p))::DOUBLE AS tn, sum((1 - y_true) * p)::DOUBLE AS fp, sum(y_true * (1 - p))::DOUBLE AS fn "
            f"FROM (SELECT *, CASE WHEN {thr} THEN 1.0 ELSE 0.0 END AS p FROM {src}) q{tail}")


ALL = {"c": counts("")}
CLS = {"c": counts("class")}
P, R, S = f"(tp / (tp + fp + {K}))", f"(tp / (tp + fn + {K}))", f"(tn / (tn + fp + {K}))"


def fbeta(b):
    return f"({1 + b * b} * {P} * {R} / ({b * b} * {P} + {R} + {K}))"


def kappa(k):
    n = "(tp + tn + fp + fn)"
    pe = f"(((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / ({n} * {n} + {k}))"
    return f"(((tp + tn) / ({n} + {k}) - {pe}) / (1 - {pe} + {K}))"


def _micro(name, sql, fn):
    query(name, "value:d", "pred", f"SELECT {sql} AS value FROM c", ALL)(lambda v: fn(v.predictions))


def _mean(name, sql, fn):
    query(name, "value:d", "pred", f"SELECT avg({sql}) AS value FROM c", CLS)(lambda v: fn(v.predictions))


@query("me1_confusion", "class:s tp:i tn:i fp:i fn:i", "pred", "SELECT * FROM c", CLS)
def _(v):
    return me.confusion_counts(v.predictions, ["class"])


_micro("me2_binary_accuracy", f"(tp + tn) / (tp + tn + fp + fn + {K})", me.binary_accuracy)
_micro("me3_precision", P, me.precision)
_micro("me4_recall", R, me.recall)
_micro("me5_specificity", S, me.specificity)
_micro("me6_f1_mean", fbeta(2), lambda d: me.f1_mean(d, 2))


@query("me7_f1_by_class", "class:s value:d", "pred", f"SELECT class, {fbeta(1)} AS value FROM c", CLS)
def _(v):
    return me.f1_by_class(v.predictions)


_mean("me8_balanced_accuracy", f"({R} + {S}) / 2", me.balanced_accuracy)
_mean("me9_balanced_accuracy_new", f"tp / greatest(tp + fn + {K}, tp + fp + {K})", me.balanced_accuracy_new)
_mean("me10_cohens_kappa", kappa(K), me.cohens_kappa)
_micro("me12_mcc", f"(tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + {K})", me.mcc)


def sweep(lo, hi, by, masked):
    src = "pred" + (" WHERE y_true >= -0.5" if masked else "")
    grid = f"(SELECT i, {lo} + i * ({hi} - {lo}) / 99.0::DOUBLE AS thr FROM range(0, 100) g(i)) t"
    keys = f"{by}, i" if by else "i"
    return {"c": counts(keys, "y_pred > thr", f"(SELECT * FROM {src}) s, {grid}")}


def _sweep(name, sql, lo, hi, by, fn, masked=True):
    query(name, "value:d", "pred", sql, sweep(f"{lo}::DOUBLE", f"{hi}::DOUBLE", by, masked))(lambda v: fn(v.predictions))


def area(height, width):
    return f"SELECT sum(h * (prev - w)) AS value FROM (SELECT {height} AS h, {width} AS w, lag({width}) OVER (ORDER BY i) AS prev FROM c)"


_sweep("me11_cohens_kappa_sweep", f"SELECT avg({kappa('0')}) AS value FROM c", 0.2, 0.8, "class", me.cohens_kappa_sweep)
_sweep("me11_cohens_kappa_sweep_unmasked", f"SELECT avg({kappa('0')}) AS value FROM c", 0.2, 0.8, "class",
       lambda d: me.cohens_kappa_sweep(d, mask=False), False)
_sweep("me13_auroc", area(R, f"(1 - {S})"), 0.01, 0.99, "", me.auroc)
_sweep("me14_auprc", area(P, R), 0.01, 0.99, "", me.auprc)
_sweep("me14_auprc_unmasked", area(P, R), 0.01, 0.99, "", lambda d: me.auprc(d, mask=False), False)
_sweep("me15_optimized_f1", f"SELECT avg({fbeta(1)}) AS value FROM c", 0.2, 0.8, "", me.optimized_f1)
_sweep("me16_optimized_f12", f"SELECT avg({fbeta(1)}) AS value FROM c", 0.2, 0.8, "class", me.optimized_f12)


@query("me17_multiclass_agreement", "accuracy:d kappa:d", "mc", extra={
    "t": "SELECT count(*)::DOUBLE AS n, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) / count(*)::DOUBLE AS po FROM mc",
    "e": "SELECT sum(a.c * b.c)::DOUBLE AS ab FROM (SELECT y_true AS k, count(*) AS c FROM mc GROUP BY 1) a JOIN (SELECT y_pred AS k, count(*) AS c FROM mc GROUP BY 1) b ON a.k = b.k"},
    sql="SELECT po AS accuracy, (po - ab / (n * n)) / (1 - ab / (n * n)) AS kappa FROM t, e")
def _(v):
    return me.multiclass_agreement(v.multiclass)


@query("me17_one_hot_labels", "record:i epoch:i true_class:s pred_class:s", "pred",
       "SELECT record, epoch, CASE WHEN max(CASE WHEN class = 'quality' THEN y_true END) >= max(CASE WHEN class = 'toxic' THEN y_true END) THEN 'quality' ELSE 'toxic' END AS true_class, CASE WHEN max(CASE WHEN class = 'quality' THEN y_pred END) >= max(CASE WHEN class = 'toxic' THEN y_pred END) THEN 'quality' ELSE 'toxic' END AS pred_class FROM pred GROUP BY 1, 2 HAVING sum(y_true) = 1")
def _(v):
    return me.one_hot_labels(v.predictions, ["quality", "toxic"])


_micro("me18_accuracy_semantic", f"(tp + tn) / (tp + tn + fp + fn + {K})", me.accuracy_semantic)
_micro("me19_recall_semantic", R, me.recall_semantic)
_micro("me20_precision_semantic", P, me.precision_semantic)
_micro("me21_specificity_semantic", "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END", me.specificity_semantic)


# ---- events -----------------------------------------------------------------------------

MATCH = {
    "p": "SELECT t.record, t.class, t.id AS t_id, o.id AS o_id, (least(t.stop, o.stop) - greatest(t.start, o.start)) AS i, (t.stop - t.start) + (o.stop - o.start) AS l FROM targets t JOIN outputs o ON t.record = o.record AND t.class = o.class AND t.start < o.stop AND o.start < t.stop",
    "m": "SELECT * FROM p WHERE i / (l - i + 2.220446049250313e-16) >= 0.5",
    "keys": "SELECT record, class FROM targets UNION SELECT record, class FROM outputs",
    "n": """SELECT k.record, k.class, (SELECT count(*) FROM targets t WHERE t.record = k.record AND t.class = k.class) AS t,
  (SELECT count(*) FROM outputs o WHERE o.record = k.record AND o.class = k.class) AS o,
  (SELECT count(DISTINCT t_id) FROM m WHERE m.record = k.record AND m.class = k.class) AS ht,
  (SELECT count(DISTINCT o_id) FROM m WHERE m.record = k.record AND m.class = k.class) AS ho FROM keys k""",
    "pr": "SELECT *, CASE WHEN o = 0 THEN 1 WHEN t = 0 THEN 0 ELSE ho / o::DOUBLE END AS p, CASE WHEN t = 0 THEN 1 WHEN o = 0 THEN 0 ELSE ht / t::DOUBLE END AS r FROM n",
}
EVENT = "record:i class:s id:i start:d stop:d"


@query("me22_true_positive_events", EVENT, "outputs", "SELECT * FROM targets WHERE id IN (SELECT t_id FROM m)", MATCH)
def _(v):
    return me.true_positive_events(v.targets, v.outputs, bucket=BUCKET)


@query("me23_false_negative_events", EVENT, "outputs", "SELECT * FROM targets WHERE id NOT IN (SELECT t_id FROM m)", MATCH)
def _(v):
    return me.false_negative_events(v.targets, v.outputs, bucket=BUCKET)


@query("me24_false_positive_events", EVENT, "outputs", "SELECT record, class, id, start, stop FROM outputs WHERE id NOT IN (SELECT o_id FROM m)", MATCH)
def _(v):
    return me.false_positive_events(v.targets, v.outputs, bucket=BUCKET)


def _event(name, metric, sql):
    query(name, "record:i class:s value:d", "outputs", f"SELECT record, class, {sql} AS value FROM pr", MATCH)(
        lambda v: me.event_metric(metric, v.targets, v.outputs, bucket=BUCKET)
    )


_event("me25_true_positives", "true_positives", "ho")
_event("me26_false_positives", "false_positives", "o - ho")
_event("me27_false_negatives", "false_negatives", "t - ht")
_event("me28_event_precision", "precision", "p")
_event("me29_event_recall", "recall", "r")
_event("me30_event_f1", "f1", "CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END")
_event("me31_count_error", "absolute_error", "abs(t - o)")


@query("me32_batch_mean_f1", "class:s value:d", "pred", extra={
    "c": counts("class, batch", src="(SELECT *, record % 20 AS batch FROM pred WHERE y_true >= -0.5)")},
    sql=f"SELECT class, avg({fbeta(1)}) AS value FROM c GROUP BY 1")
def _(v):
    return me.batch_mean_f1(v.predictions.withColumn("batch", F.pmod("record", F.lit(20))), "batch", cls="class")
