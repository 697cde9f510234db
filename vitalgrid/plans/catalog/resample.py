from pyspark.sql import functions as F

from vitalgrid.operators import resample as rs
from vitalgrid.plans.catalog import query

RT = "record:s t:i value:d"


@query("rs1_resample_binary_down", RT, "sig",
       "SELECT record, t // 4 AS t, value FROM (SELECT *, count(*) OVER (PARTITION BY record) AS n FROM sig) WHERE t % 4 = 0 AND t // 4 < n // 4")
def _(v):
    return rs.resample_binary(v.sig, 4, 1)


@query("rs2_resample_binary_up", RT, "sig", "SELECT record, t * 3 + i AS t, value FROM sig, range(0, 3) g(i)")
def _(v):
    return rs.resample_binary(v.sig, 1, 3)


TAPS = """SELECT k, CASE WHEN k = 0 THEN 1.0 ELSE sin(pi() * k / 4.0) / (pi() * k / 4.0) END * i0 AS w FROM (
  SELECT k, (SELECT sum(((5.0 * sqrt(greatest(1 - (k / 40.0) ** 2, 0))) / 2) ** (2 * j) / (factorial(j::INTEGER) ** 2)) FROM range(0, 21) g(j)) AS i0 FROM range(-40, 41) h(k))"""


@query("rs3_downsample", RT, "sig", extra={
    "taps": TAPS, "unit": "SELECT k, w / (SELECT sum(w) FROM taps) AS w FROM taps",
    "o": "SELECT record, t // 4 AS j FROM sig WHERE t % 4 = 0"},
    sql="SELECT o.record, o.j AS t, sum(u.w * s.value) AS value FROM o JOIN unit u ON true JOIN sig s ON s.record = o.record AND s.t = o.j * 4 + u.k GROUP BY 1, 2")
def _(v):
    return rs.downsample(v.sig, 4, 1)[0]


@query("rs4_block_mean", RT, "sig", "SELECT record, t // 7 AS t, avg(value) AS value FROM sig GROUP BY 1, 2 HAVING count(*) = 7")
def _(v):
    return rs.block_mean(v.sig, 14, 2)


@query("rs5_block_max", RT, "sig", extra={
    "m": "SELECT record, t, max(abs(value)) OVER (PARTITION BY record ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS value FROM sig"},
    sql="SELECT record, t // 8 AS t, value FROM m WHERE t % 8 = 0")
def _(v):
    return rs.block_max(v.sig, 8, 1)


@query("rs6_pool1d", "record:s t:i hi:d mean:d", "sig",
       "SELECT record, t // 30 AS t, CASE WHEN count(*) < 30 THEN greatest(max(value), 0) ELSE max(value) END AS hi, sum(value) / 30 AS mean FROM sig GROUP BY 1, 2")
def _(v):
    hi = rs.pool1d(v.sig, 30, "max").withColumnRenamed("value", "hi")
    return hi.join(rs.pool1d(v.sig, 30, "avg").withColumnRenamed("value", "mean"), ["record", "channel", "t"])


def _pool(name, mode, reduced):
    # 3 x 3, stride 2, padding 1 on 8 x 8 windows -> 4 x 4.
    sql = f"SELECT win, i AS t, j AS bin, {reduced} AS value FROM cells c, range(0, 4) a(i), range(0, 4) b(j) WHERE c.t BETWEEN i * 2 - 1 AND i * 2 + 1 AND c.bin BETWEEN j * 2 - 1 AND j * 2 + 1 GROUP BY 1, 2, 3"
    query(name, "win:i t:i bin:i value:d", "cells", sql)(
        lambda v: rs.pool2d(v.cells, 3, 2, 1, (8, 8), mode, ["win"], "t", "bin", "value")
    )


_pool("rs7_pool2d_max", "max", "CASE WHEN count(*) < 9 THEN greatest(max(value), 0) ELSE max(value) END")
_pool("rs7_pool2d_avg", "avg", "sum(value) / 9")


@query("rs8_frame_index", "record:s frame:i t:i", "sig",
       "SELECT record, frame, frame * 16 + k AS t FROM (SELECT record, count(*) AS n FROM sig GROUP BY 1), range(0, 100000) f(frame), range(0, 64) g(k) WHERE frame * 16 + 64 <= n")
def _(v):
    return rs.frame_index(v.sig, 64, 0.75)


@query("rs9_extended_epochs", "record:s epoch:i n:i total:d", "sig", extra={
    "r": "SELECT record, count(*) AS n FROM sig GROUP BY 1"},
    sql="SELECT s.record, epoch, count(*) AS n, sum(value) AS total FROM sig s JOIN r ON r.record = s.record JOIN range(0, 10000) e(epoch) ON epoch < r.n // 30 AND s.t >= epoch * 30 - 45 AND s.t < (epoch + 1) * 30 + 45 GROUP BY 1, 2")
def _(v):
    e = rs.extended_epochs(v.sig, 30, 45)
    return e.groupBy("record", "epoch").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
