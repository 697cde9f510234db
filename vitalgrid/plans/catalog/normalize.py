from pyspark.sql import functions as F

from vitalgrid.model import layout
from vitalgrid.operators import normalize as nm
from vitalgrid.plans.catalog import query

RT = "record:s t:i value:d"
P = "PARTITION BY record"


def _over(name, sql, fn):
    query(name, RT, "sig", f"SELECT record, t, {sql} AS value FROM sig")(lambda v: fn(v.sig))


_over("nm1_zscore", f"(value - avg(value) OVER ({P})) / (stddev_pop(value) OVER ({P}) + 2.220446049250313e-16)", nm.zscore)
_over("nm3_zscore_axis",
      f"CASE WHEN min(value) OVER ({P}) = max(value) OVER ({P}) THEN value ELSE (value - avg(value) OVER ({P})) / stddev_pop(value) OVER ({P}) END",
      nm.zscore_axis)
_over("nm4_zscore_log",
      f"(ln(least(greatest(value, 10), 300) + 1) - avg(ln(least(greatest(value, 10), 300) + 1)) OVER ({P})) / stddev_pop(ln(least(greatest(value, 10), 300) + 1)) OVER ({P})",
      lambda d: nm.zscore_log(d, 10, 300))
_over("nm5_min_max", f"(value - min(value) OVER ({P})) / (max(value) OVER ({P}) - min(value) OVER ({P}))", nm.min_max)
_over("nm6_set_min", f"value - min(value) OVER ({P}) + 1e-10 + 3", lambda d: nm.set_min(d, 3))
_over("nm7_soft",
      f"CASE WHEN quantile_cont(value, 0.1) OVER ({P}) = quantile_cont(value, 0.9) OVER ({P}) THEN 0 ELSE (value - quantile_cont(value, 0.1) OVER ({P})) / (quantile_cont(value, 0.9) OVER ({P}) - quantile_cont(value, 0.1) OVER ({P})) END",
      lambda d: nm.soft(d, 10, 90))
_over("nm8_iqr_normalization",
      f"(value - quantile_cont(value, 0.25) OVER ({P})) / (quantile_cont(value, 0.75) OVER ({P}) - quantile_cont(value, 0.25) OVER ({P}) + 2.220446049250313e-16) * 2 - 1",
      nm.iqr_normalization)


@query("nm2_complete_zscore", "record:i t:i channel:i value:d", "xyz", extra={
    "long": "SELECT record, t, 0 AS channel, x AS value FROM xyz UNION ALL SELECT record, t, 1, y FROM xyz UNION ALL SELECT record, t, 2, z FROM xyz"},
    sql=f"SELECT record, t, channel, (value - avg(value) OVER ({P})) / stddev_pop(value) OVER ({P}) AS value FROM long")
def _(v):
    long = v.xyz.select("record", "t", F.posexplode(F.array("x", "y", "z")).alias("channel", "value"))
    return nm.complete_zscore(long)


# The signal is centred so that it has both signs.
CENTRED = "SELECT record, t, value - 245.0 AS value FROM sig"
POLARITY = {
    "s": CENTRED,
    "g": """SELECT record, t, value, CASE WHEN prev IS NULL THEN next - value WHEN next IS NULL THEN value - prev ELSE (next - prev) / 2 END AS g
FROM (SELECT *, lag(value) OVER (PARTITION BY record ORDER BY t) AS prev, lead(value) OVER (PARTITION BY record ORDER BY t) AS next FROM s)""",
    "d": "SELECT record, value > 0 AS up, abs(value - lag(value) OVER (PARTITION BY record, value > 0 ORDER BY t)) AS step FROM g WHERE abs(g) > 0 AND value <> 0",
    "m": "SELECT record, median(CASE WHEN up THEN step END) AS above, median(CASE WHEN NOT up THEN step END) AS below FROM d GROUP BY 1",
}


@query("nm9_polarity", "record:s above:d below:d", "sig", "SELECT * FROM m", POLARITY)
def _(v):
    return nm.polarity(v.sig.withColumn("value", F.col("value") - 245.0))


@query("nm9_polarity_correction", RT, "sig",
       "SELECT s.record, t, CASE WHEN below > above THEN -value ELSE value END AS value FROM s JOIN m ON s.record = m.record", POLARITY)
def _(v):
    return nm.polarity_correction(v.sig.withColumn("value", F.col("value") - 245.0))


@query("nm10_axis_flip", "record:i t:i x:d y:d z:d", "xyz", extra={
    "m": "SELECT record, median(degrees(atan2(x, sqrt(y*y + z*z)))) AS med FROM xyz GROUP BY 1"},
    sql="SELECT a.record, t, CASE WHEN med > 0 THEN -x ELSE x END AS x, CASE WHEN med > 0 THEN -y ELSE y END AS y, z FROM xyz a JOIN m ON a.record = m.record")
def _(v):
    return nm.axis_flip(v.xyz)


# Leading axis of a symmetric 3 x 3 matrix in closed form: the largest eigenvalue by the
# trigonometric rule, its axis as the longest cross product of two rows of A - lambda I.
AXES = {
    "m": "SELECT record, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM xyz GROUP BY 1",
    "p": "SELECT *, (a + b + c) / 3 AS q FROM m",
    "r": "SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM p",
    "l": "SELECT *, q + 2 * s * cos(acos(greatest(least(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * s ** 3), 1), -1)) / 3) AS l FROM r",
    "v": """SELECT record, mx, my, mz, unnest([
  {'u': d * f - e * (b - l), 'v': e * d - (a - l) * f, 'w': (a - l) * (b - l) - d * d},
  {'u': d * (c - l) - e * f, 'v': e * e - (a - l) * (c - l), 'w': (a - l) * f - d * e},
  {'u': (b - l) * (c - l) - f * f, 'v': f * e - d * (c - l), 'w': d * f - (b - l) * e}]) AS k FROM l""",
    "n": "SELECT record, mx, my, mz, k.u AS u, k.v AS v, k.w AS w, sqrt(k.u ** 2 + k.v ** 2 + k.w ** 2) AS len FROM v",
    "g": "SELECT record, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, arg_max(u / len, len) AS u, arg_max(v / len, len) AS v, arg_max(w / len, len) AS w FROM n WHERE len > 0 GROUP BY 1",
    "h": "SELECT *, CASE WHEN abs(u) >= abs(v) AND abs(u) >= abs(w) THEN sign(u) WHEN abs(v) >= abs(w) THEN sign(v) ELSE sign(w) END AS sg FROM g",
}


@query("nm11_pca", "record:i t:i pc1:d", "xyz",
       "SELECT i.record, t, sg * (u * (x - mx) + v * (y - my) + w * (z - mz)) AS pc1 FROM xyz i JOIN h ON h.record = i.record", AXES)
def _(v):
    return nm.pca(v.xyz, ["x", "y", "z"])


@query("nm11_pca_variance", "record:i total:d kept:d", "xyz",
       "SELECT record, var_pop(x) + var_pop(y) AS total, (var_pop(x) + var_pop(y)) / 2 + sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2) AS kept FROM xyz GROUP BY 1")
def _(v):
    # Two channels have a closed form: the leading variance is the larger eigenvalue.
    p = nm.pca(v.xyz, ["x", "y"])
    return p.groupBy("record").agg(
        (F.var_pop("x") + F.var_pop("y")).alias("total"), F.var_pop("pc1").alias("kept")
    )
