from pyspark.sql import functions as F

from vitalgrid.model import layout
from vitalgrid.operators import rolling as wf
from vitalgrid.plans.catalog import query

RT = "record:s t:i value:d"
W = "PARTITION BY record ORDER BY t"
SIZED = {"n": "SELECT record, count(*) AS n FROM sig GROUP BY 1"}


def frame(back, ahead):
    return f"({W} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"


@query("wf1_rolling_median_subtract", RT, "sig", extra=SIZED | {
    "m": f"SELECT record, t, value, n, median(value) OVER {frame(15, 15)} AS med FROM sig JOIN n USING (record)"},
    sql="SELECT a.record, a.t, a.value - b.med AS value FROM m a JOIN m b ON a.record = b.record AND b.t = least(greatest(a.t, 15), a.n - 16)")
def _(v):
    return wf.rolling_median_subtract(v.sig, 1, 30)


@query("wf2_median_filter", RT, "sig", extra=SIZED | {
    "m": f"SELECT record, t, value, n, median(value) OVER {frame(15, 15)} AS med, median(value) OVER (PARTITION BY record) AS allmed FROM sig JOIN n USING (record)"},
    sql="SELECT record, t, CASE WHEN t BETWEEN 15 AND n - 16 THEN med ELSE allmed END AS value FROM m")
def _(v):
    return wf.median_filter(v.sig, 1, 30)


@query("wf3_iqr_normalization_adaptive", RT, "sig", extra=SIZED | {
    "m": f"""SELECT record, t, value, n, quantile_cont(value, 0.25) OVER {frame(15, 15)} AS lo, quantile_cont(value, 0.75) OVER {frame(15, 15)} AS up,
  quantile_cont(value, 0.25) OVER (PARTITION BY record) AS glo, quantile_cont(value, 0.75) OVER (PARTITION BY record) AS gup FROM sig JOIN n USING (record)""",
    "e": "SELECT record, t, value, CASE WHEN t BETWEEN 15 AND n - 16 THEN lo ELSE glo END AS lo, CASE WHEN t BETWEEN 15 AND n - 16 THEN up ELSE gup END AS up FROM m"},
    sql="SELECT record, t, (value - lo) / (up - lo + 2.220446049250313e-16) * 2 - 1 AS value FROM e")
def _(v):
    return wf.iqr_normalization_adaptive(v.sig, 1, 30)


@query("wf4_adaptive_soft", RT, "sig", extra=SIZED | {
    "m": f"SELECT record, t, value, n, median(value) OVER {frame(15, 15)} AS med, median(value) OVER (PARTITION BY record) AS allmed, stddev_pop(value) OVER (PARTITION BY record) AS gstd FROM sig JOIN n USING (record)",
    "r": "SELECT record, t, n, gstd, value - CASE WHEN t BETWEEN 15 AND n - 16 THEN med ELSE allmed END AS r FROM m",
    "d": f"SELECT *, stddev_samp(r) OVER {frame(10, 10)} AS sd FROM r"},
    sql="SELECT record, t, r / (CASE WHEN t BETWEEN 10 AND n - 11 THEN sd ELSE gstd END + 1e-10) AS value FROM d")
def _(v):
    return wf.adaptive_soft(v.sig, 1, 30, 20)


@query("wf5_diff", RT, "sig", f"SELECT record, t, coalesce(value - lag(value) OVER ({W}), 0) AS value FROM sig")
def _(v):
    return wf.diff(v.sig)


@query("wf6_rolling_autocorr", RT, "sig", extra={
    "p": f"SELECT *, lag(value) OVER ({W}) AS prev FROM sig"},
    sql=f"SELECT record, t, CASE WHEN t >= 20 THEN corr(value, prev) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS value FROM p")
def _(v):
    return wf.rolling_autocorr(v.sig, 1, 20)


# Micro-time is divided by 60 so that the 10- and 30-minute frames hold several rows.
LIDS = {
    "e": "SELECT record, t, us // 60 AS us, greatest(sqrt(x*x + y*y + z*z) - 1, 0) AS enmo FROM xyz",
    "s": "SELECT *, CASE WHEN enmo < 0.02 THEN 0 ELSE enmo - 0.02 END AS sub FROM e",
    "u": "SELECT *, 100.0 / (sum(sub) OVER (PARTITION BY record ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) + 1) AS u FROM s",
}


@query("wf7_lids", "record:i t:i lids:d", "xyz",
       "SELECT record, t, avg(u) OVER (PARTITION BY record ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS lids FROM u", LIDS)
def _(v):
    from vitalgrid.functions.rows import enmo

    e = v.xyz.select("record", "t", F.floor(F.col("us") / 60).alias("us"), enmo(F.col("x"), F.col("y"), F.col("z")).alias("enmo"))
    return wf.lids(e)


@query("wf8_diff_prev", "record:s t:i diff:d", "sig",
       f"SELECT record, t, coalesce(value - avg(value) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS diff FROM sig")
def _(v):
    return wf.diff_prev(v.sig, 120, 30)


@query("wf9_diff_next", "record:s t:i diff:d", "sig",
       f"SELECT record, t, coalesce(avg(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) - value, 0) AS diff FROM sig")
def _(v):
    return wf.diff_next(v.sig, 120, 30)


@query("wf10_weighted_activity", "record:s epoch:i activity:d", "sig", extra={
    "e": "SELECT record, t // 30 AS epoch, sum(CASE WHEN value > 100 THEN abs(value) ELSE 0 END) AS e FROM sig GROUP BY 1, 2 HAVING count(*) = 30",
    "l": "SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b, lag(e, 2) OVER w AS c, lead(e, 2) OVER w AS d FROM e WINDOW w AS (PARTITION BY record ORDER BY epoch)"},
    sql="SELECT record, epoch, coalesce(e + 0.2 * (a + b) + 0.04 * (c + d), 0) AS activity FROM l")
def _(v):
    return wf.weighted_activity(v.sig, 1, 30, 100)


BITS = {"bits": "SELECT record, t, value, CASE WHEN value > 245 THEN 1 ELSE 0 END AS b FROM sig"}


def dilated(src, m):
    return f"SELECT record, t, max(b) OVER {frame(m, m)} AS b FROM {src}"


def eroded(src, m):
    return f"SELECT record, t, CASE WHEN count(*) OVER {frame(m, m)} = {2 * m + 1} THEN min(b) OVER {frame(m, m)} ELSE 0 END AS b FROM {src}"


def _bits(v):
    return v.sig.select("record", "channel", "t", (F.col("value") > 245).cast("int").alias("b"))


BIT = layout(value="b")


@query("wf11_dilate", "record:s t:i b:i", "sig", dilated("bits", 2), BITS)
def _(v):
    return wf.dilate(_bits(v), 2, BIT)


@query("wf12_erode", "record:s t:i b:i", "sig", eroded("bits", 1), BITS)
def _(v):
    return wf.erode(_bits(v), 1, BIT)


OPENED = BITS | {"c1": dilated("bits", 1), "c2": eroded("c1", 1), "c3": eroded("c2", 2), "c4": dilated("c3", 2)}


@query("wf13_close_then_open", "record:s t:i b:i", "sig", "SELECT * FROM c4", OPENED)
def _(v):
    return wf.close_then_open(_bits(v), 1, 2, BIT)


@query("wf14_max_filter", RT, "sig", f"SELECT record, t, max(value) OVER {frame(4, 3)} AS value FROM sig")
def _(v):
    return wf.max_filter(v.sig, 8)


RUNS = BITS | {
    "f": "SELECT *, t - row_number() OVER (PARTITION BY record, b ORDER BY t) AS island FROM bits",
}


@query("wf15_runs", "record:s start:i stop:i", "sig",
       "SELECT record, min(t) AS start, max(t) + 1 AS stop FROM f WHERE b = 1 GROUP BY record, island", RUNS)
def _(v):
    return wf.runs(_bits(v), "b", ["record", "channel"])


BEATS = {
    "bits": f"SELECT record, t, value, CASE WHEN value > avg(value) OVER {frame(5, 5)} THEN 1 ELSE 0 END AS b FROM sig",
    "f": RUNS["f"],
    "peaks": "SELECT record, arg_max(t, (value, -t)) AS beat FROM f WHERE b = 1 GROUP BY record, island",
}


@query("wf16_beat_intervals", "record:s beat:i rr:d", "sig",
       "SELECT record, beat, (beat - lag(beat) OVER (PARTITION BY record ORDER BY beat)) / 10.0 AS rr FROM peaks", BEATS)
def _(v):
    return wf.beat_intervals(v.sig, 10, 1.0)
