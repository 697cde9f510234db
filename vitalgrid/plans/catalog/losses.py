from pyspark.sql import functions as F

from vitalgrid.operators import losses as ls
from vitalgrid.plans.catalog import query

K = "1e-7"
BASE = {
    "q": f"SELECT *, least(greatest(CASE WHEN y_true = 1 THEN y_pred ELSE 1 END, {K}), 1 - {K}) AS p1, least(greatest(CASE WHEN y_true = 0 THEN y_pred ELSE 0 END, {K}), 1 - {K}) AS p0 FROM pred WHERE y_true >= -0.5",
    "st": "SELECT class, sum(y_true) AS pos, count(*) AS n FROM q GROUP BY 1",
    "base": "SELECT n FROM st ORDER BY class LIMIT 1",
    "w": f"SELECT q.*, pos, (SELECT n FROM base) - pos AS neg, least(greatest(pos / (SELECT n FROM base)::DOUBLE, {K}), 1 - {K}) AS pw FROM q JOIN st USING (class)",
}
CE = "(ln(p1) + ln(1 - p0))"
FOCAL = "((1 - p1) ** 2 * ln(p1) + p0 ** 2 * ln(1 - p0))"
SHARE_POS, SHARE_NEG = "((1 - pw) ** 0.5 * ln(p1))", "(pw ** 0.5 * ln(1 - p0))"
EFF = lambda c: f"((1 - 0.99::DOUBLE) / (1 - pow(0.99, {c})))"
EFF_POS, EFF_NEG = f"({EFF('pos')} * ln(p1))", f"({EFF('neg')} * ln(1 - p0))"
HALF = "(SELECT count(*) // 2 FROM w)"


def mean(term, src="w"):
    return f"SELECT -(sum({term}) + {K}) / (count(*) + 1) AS value FROM {src}"


def hard(term):
    return f"SELECT -(sum(l) + {K}) / (count(*) + 1) AS value FROM (SELECT {term} AS l FROM w ORDER BY 1 LIMIT {HALF})"


def hard_negative(pos, neg):
    return f"SELECT -(sum(l) + {K}) / (count(*) + 1) AS value FROM (SELECT {pos} AS l FROM w UNION ALL SELECT l FROM (SELECT {neg} AS l FROM w ORDER BY 1 LIMIT {HALF}))"


def _loss(name, sql, fn):
    query(name, "value:d", "pred", sql, BASE)(lambda v: fn(v.predictions))


_loss("ls1_cross_entropy", mean(CE), ls.cross_entropy)
_loss("ls2_weighted", mean(f"({SHARE_POS} + {SHARE_NEG})"), ls.weighted)


@query("ls3_effective_number_cross_entropy", "value:d", "pred", extra=BASE | {
    "e": "SELECT class, sum(ln(p1)) AS lp, sum(ln(1 - p0)) AS ln_, count(*) AS n, 0.01 / (1 - pow(0.99, max(pos)) + 0.01) AS wp, 0.01 / (1 - pow(0.99, max(neg)) + 0.01) AS wn FROM w GROUP BY 1"},
    sql=f"SELECT -(sum(wp * lp) / sum(wp) + sum(wn * ln_) / sum(wn) + {K}) / (sum(n) + 1) AS value FROM e")
def _(v):
    return ls.effective_number_cross_entropy(v.predictions)


_loss("ls4_focal", mean(FOCAL), ls.focal)
_loss("ls5_focal_weighted", mean(f"((1 - p1) ** 2 * {SHARE_POS} + p0 ** 2 * {SHARE_NEG})"), ls.focal_weighted)
_loss("ls6_effective_number_focal", mean(f"((1 - p1) ** 2 * {EFF_POS} + p0 ** 2 * {EFF_NEG})"), ls.effective_number_focal)
# The hardest half of all unmasked rows, however many the table has; each query is registered under two names.
for _end in ("", "_half"):
    _loss(f"ls7_ohem_cross_entropy{_end}", hard(CE), lambda d: ls.ohem_cross_entropy(d, 0.5, None, []))
    _loss(f"ls8_ohem_weighted{_end}", hard(f"{SHARE_POS} + {SHARE_NEG}"), lambda d: ls.ohem_weighted(d, 0.5, None, []))
    _loss(f"ls9_ohem_effective{_end}", hard(f"{EFF_POS} + {EFF_NEG}"), lambda d: ls.ohem_effective(d, 0.5, None, []))
    _loss(f"ls10_ohnm_cross_entropy{_end}", hard_negative("ln(p1)", "ln(1 - p0)"), lambda d: ls.ohnm_cross_entropy(d, 0.5, None, []))
    _loss(f"ls11_ohnm_weighted{_end}", hard_negative(SHARE_POS, SHARE_NEG), lambda d: ls.ohnm_weighted(d, 0.5, None, []))
    _loss(f"ls12_ohnm_effective{_end}", hard_negative(EFF_POS, EFF_NEG), lambda d: ls.ohnm_effective(d, 0.5, None, []))


@query("ls7_ohem_by_group", "grp:i value:d", "pred", extra=BASE | {
    "r": f"SELECT record % 3 AS grp, {CE} AS l, row_number() OVER (PARTITION BY record % 3 ORDER BY {CE}) AS rn FROM q"},
    sql=f"SELECT grp, -(sum(l) + {K}) / (count(*) + 1) AS value FROM r WHERE rn <= 50 GROUP BY 1")
def _(v):
    p = v.predictions.withColumn("grp", F.pmod("record", F.lit(3)))
    return ls.ohem_cross_entropy(p, 0.5, 100, ["grp"])


CAT = {
    "h": "SELECT record, epoch, class, CASE WHEN y_true < 0 THEN 0 ELSE y_true END AS y_true, y_pred FROM pred",
    "x": f"SELECT *, least(greatest(y_pred / sum(y_pred) OVER (PARTITION BY record, epoch), {K}), 1 - {K}) AS qq, least(greatest(avg(y_true) OVER (PARTITION BY class), {K}), 1 - {K}) AS pw FROM h",
}


def _cat(name, sql, fn):
    text = f"SELECT avg({sql}) AS value FROM x"
    query(name, "value:d", "pred", text, CAT)(
        lambda v: fn(v.predictions.withColumn("y_true", F.greatest("y_true", F.lit(0.0))))
    )


_cat("ls13_categorical_cross_entropy", "-y_true * ln(qq)", ls.categorical_cross_entropy)
_cat("ls14_categorical_cross_entropy_weighted", "(1 - pw) ** 0.5 * -y_true * ln(qq)", ls.categorical_cross_entropy_weighted)
_cat("ls15_categorical_focal", "0.25 * (1 - qq) ** 2 * -y_true * ln(qq)", ls.categorical_focal)
_cat("ls16_categorical_focal_weighted", "(1 - pw) ** 0.5 * (1 - qq) ** 2 * -y_true * ln(qq)", ls.categorical_focal_weighted)
_loss("ls17_dice", f"SELECT 1 - 0.5 * (sum(y_true * y_pred) + {K}) / (sum(y_true + y_pred) + {K} + {K}) AS value FROM q", ls.dice)
