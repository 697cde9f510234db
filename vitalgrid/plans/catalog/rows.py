from pyspark.sql import functions as F

from vitalgrid.functions import rows
from vitalgrid.operators import windows as wn
from vitalgrid.plans.catalog import query
from vitalgrid.plans.views import WINDOW
from vitalgrid.sources.tables import add_channels
from vitalgrid.operators.spectral import truncate_record

RT = "record:s t:i value:d"


def _value(name, sql, fn):
    query(name, RT, "sig", f"SELECT record, t, {sql} AS value FROM sig")(
        lambda v: v.sig.withColumn("value", fn(F.col("value")))
    )


_value("ex1_divide", "value / 7.0", lambda x: rows.divide(x, 7.0))
_value("ex2_log", "ln(value)", rows.log)
_value("ex3_log_plus_one", "ln(value + 1)", rows.log_plus_one)
_value("ex4_clip", "least(greatest(value, 50), 400)", lambda x: rows.clip(x, 50, 400))
_value("ex5_clip_by_iqr", "least(greatest(value, -20), 20)", rows.clip_by_iqr)
_value("ex7_low_amplitude", "CASE WHEN abs(value) < 100 THEN value ELSE 0 END", lambda x: rows.low_amplitude(x, 100))
_value("ex8_high_amplitude", "CASE WHEN abs(value) > 100 THEN value ELSE 0 END", lambda x: rows.high_amplitude(x, 100))


@query("ex9_enmo", "record:i t:i enmo:d", "xyz",
       "SELECT record, t, greatest(sqrt(x*x + y*y + z*z) - 1, 0) AS enmo FROM xyz")
def _(v):
    return v.xyz.withColumn("enmo", rows.enmo(F.col("x"), F.col("y"), F.col("z")))


@query("ex10_tilt_angles", "record:i t:i angle_x:d angle_y:d angle_z:d", "xyz",
       "SELECT record, t, degrees(atan2(x, sqrt(y*y + z*z))) AS angle_x, degrees(atan2(y, sqrt(x*x + z*z))) AS angle_y, degrees(atan2(z, sqrt(x*x + y*y))) AS angle_z FROM xyz")
def _(v):
    return v.xyz.withColumns(rows.tilt_angles(F.col("x"), F.col("y"), F.col("z")))


@query("ex11_add_channels", "record:i t:i value:d", "xyz", "SELECT record, t, x + y + z AS value FROM xyz")
def _(v):
    channels = F.explode(F.array("x", "y", "z"))
    return add_channels(v.xyz.select("record", "t", channels.alias("value")), ["record", "t"])


@query("ex12_flatten_channels", "win:i t:i feature:i value:d", "cells",
       "SELECT win, t // 2 AS t, bin * 2 + t % 2 AS feature, value FROM cells")
def _(v):
    # Odd and even rows as two channels of one bin axis.
    feature = rows.flat_feature(F.col("bin"), F.pmod("t", F.lit(2)), 2)
    return v.cells.withColumn("feature", feature).withColumn("t", F.floor(F.col("t") / 2))


@query("ex14_truncate_record", RT, "sig", "SELECT record, t, value FROM sig WHERE t < 900 * 0.5")
def _(v):
    return truncate_record(v.sig, 0.5, 900)


@query("ex15_any_event", "record:i win:i y:i", "win iv",
       "SELECT w.record, w.win, CASE WHEN h.record IS NULL THEN 0 ELSE 1 END AS y FROM win w LEFT JOIN (SELECT DISTINCT w.record, w.win FROM win w JOIN iv e ON w.record = e.record AND e.start < w.start + 86400 AND e.start + e.duration > w.start WHERE e.duration > 10 AND e.kind = 'event') h ON h.record = w.record AND h.win = w.win")
def _(v):
    w = wn.window_index(v.extents, WINDOW, 0.25)
    return wn.any_event(w, v.intervals, WINDOW)


EX16_SQL = """SELECT win, t, CASE WHEN max(value) > 0.3 THEN -1 ELSE arg_max(code, (value, -code)) END AS stage FROM (
  SELECT win, t, value, CASE bin % 4 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS code FROM cells) GROUP BY 1, 2"""


@query("ex16_stage_order_eight_bins", "win:i t:i stage:i", "cells", EX16_SQL)
@query("ex16_stage_order", "win:i t:i stage:i", "cells", EX16_SQL)
def _(v):
    # Two bins a class; a cell above the bound masks its row.
    names = F.element_at(F.array(*[F.lit(c) for c in ("wake", "light", "deep", "rem")]), F.pmod("bin", F.lit(4)).cast("int") + 1)
    e = v.cells.withColumns({"class": names, "m": F.col("value") > 0.3})
    return wn.stage_order(e, ["win", "t"], "value", "class", "m")
