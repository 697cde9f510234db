from pyspark.sql import functions as F

from vitalgrid.operators import features as ag
from vitalgrid.operators import hrv, rolling
from vitalgrid.plans.catalog import query
from vitalgrid.plans.views import CLASSES

# Epochs of 60 samples widened by 30; trailing partial epochs dropped.
W, EXT = 60, 30


def epochs(w=W, ext=EXT):
    return {
        "r": "SELECT record, count(*) AS n FROM sig GROUP BY 1",
        "ep": f"SELECT s.record, epoch, t, value AS x, value - lag(value) OVER w AS d1, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d2, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY s.record, epoch) AS len FROM sig s JOIN r ON r.record = s.record JOIN range(0, 100000) e(epoch) ON epoch < r.n // {w} AND s.t >= epoch * {w} - {ext} AND s.t < (epoch + 1) * {w} + {ext} WINDOW w AS (PARTITION BY s.record, epoch ORDER BY t)",
    }


MOBILITY = "sqrt(var_pop(d1) / (var_pop(x) + 1e-9))"
SQL = {
    "energy": "avg(x * x)",
    "heart_rate": "60 / (avg(x) + 1e-9)",
    "rmssd": "sqrt(avg(d1 * d1))",
    "sdsd": "stddev_pop(d1)",
    "sdnn": "stddev_pop(x)",
    "range": "max(x) - min(x)",
    "activity": "var_pop(x)",
    "mobility": MOBILITY,
    "complexity": f"sqrt(sqrt(var_pop(d2) / (var_pop(d1) + 1e-9)) / ({MOBILITY} + 1e-9))",
}


def _feature(name, key, make):
    # Long-valued features are scaled so that six decimals stay significant.
    sql = f"SELECT record, epoch, {SQL[key]} AS {key} FROM ep GROUP BY 1, 2"
    query(name, f"record:s epoch:i {key}:d", "sig", sql, epochs())(
        lambda v: ag.epoch_features(v.sig, W, EXT, {key: make()})
    )


for _name, _key in (("ag1_energy", "energy"), ("ag2_heart_rate", "heart_rate"), ("ag3_rmssd", "rmssd"), ("ag4_sdsd", "sdsd"),
                    ("ag5_sdnn", "sdnn"), ("ag6_range", "range"), ("ag8_activity", "activity"), ("ag9_mobility", "mobility"),
                    ("ag10_complexity", "complexity")):
    _feature(_name, _key, ag.TIME_DOMAIN[_key])


@query("ag7_quantile", "record:s epoch:i q10:d q25:d q75:d q90:d", "sig",
       "SELECT record, epoch, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.9) AS q90 FROM ep GROUP BY 1, 2",
       epochs())
def _(v):
    return ag.epoch_features(v.sig, W, EXT, {f"q{int(q * 100)}": ag.quantile(q) for q in (0.1, 0.25, 0.75, 0.9)})


def spectrum(nfft, fs):
    """Power of each bin of the tapered (and truncated) epoch."""
    return {
        "dft": f"""SELECT record, epoch, b, ln(1 + (sum(x * h * cos(2 * pi() * b * k / {nfft})) ** 2 + sum(x * h * sin(2 * pi() * b * k / {nfft})) ** 2) / ({fs} * {nfft})) AS p
FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * k / (len - 1)) AS h FROM ep WHERE k < {nfft}), range(0, {nfft // 2 + 1}) g(b) GROUP BY 1, 2, 3""",
    }


def band(nfft, fs, low, high):
    return f"sum(CASE WHEN b * {fs}::DOUBLE / {nfft} > {low} AND b * {fs}::DOUBLE / {nfft} <= {high} THEN p ELSE 0 END)"


@query("ag11_band_power", "record:s epoch:i lf:d ratio:d", "sig",
       f"SELECT record, epoch, {band(64, 1, 0.04, 0.15)} AS lf, {band(64, 1, 0.04, 0.15)} / ({band(64, 1, 0.15, 0.4)} + 2.220446049250313e-16) AS ratio FROM dft GROUP BY 1, 2",
       epochs() | spectrum(64, 1))
def _(v):
    return ag.band_power(v.sig, 1, W, EXT, {"lf": (0.04, 0.15), "ratio": (0.04, 0.15, (0.15, 0.4))})


SET_COLS = ("energy", "sdnn", "sdsd", "range", "q10", "q25", "q75", "q90", "vlf", "lf", "hf")


def _set_sql(ext):
    e = epochs(W, ext)
    names = {"ep": f"ep{ext}", "dft": f"dft{ext}"}
    sp = spectrum(64, 1)["dft"].replace("FROM ep WHERE", f"FROM ep{ext} WHERE")
    t = (f"SELECT record, epoch, avg(x * x) AS energy_{ext}, stddev_pop(x) AS sdnn_{ext}, stddev_pop(d1) AS sdsd_{ext}, max(x) - min(x) AS range_{ext}, "
         + ", ".join(f"quantile_cont(x, {q}) AS q{int(q * 100)}_{ext}" for q in (0.1, 0.25, 0.75, 0.9)) + f" FROM ep{ext} GROUP BY 1, 2")
    s = f"SELECT record, epoch, {band(64, 1, 0.0033, 0.04)} AS vlf_{ext}, {band(64, 1, 0.04, 0.15)} AS lf_{ext}, {band(64, 1, 0.15, 0.4)} AS hf_{ext} FROM dft{ext} GROUP BY 1, 2"
    return {names["ep"]: e["ep"], names["dft"]: sp, f"t{ext}": t, f"s{ext}": s}


@query("ag12_signal_feature_set", "record:s epoch:i " + " ".join(f"{c}_{e}:d" for e in (0, 30) for c in SET_COLS), "sig",
       "SELECT * FROM t0 JOIN s0 USING (record, epoch) JOIN t30 USING (record, epoch) JOIN s30 USING (record, epoch)",
       {"r": epochs()["r"]} | _set_sql(0) | _set_sql(30))
def _(v):
    return ag.signal_feature_set(v.sig, 1, W, [0, 30])


def _two(fs, w, ext, nfft, bands, plain):
    e, z = epochs(w * fs, ext * fs), epochs(w * fs, 0)
    return {
        "r": e["r"], "ep": e["ep"], **spectrum(nfft, fs),
        "s": f"SELECT record, epoch, {', '.join(f'{sql} AS {n}' for n, sql in bands.items())} FROM dft GROUP BY 1, 2",
        "z": z["ep"], "p": f"SELECT record, epoch, {', '.join(f'{sql} AS {n}' for n, sql in plain.items())} FROM z GROUP BY 1, 2",
    }


@query("ag13_hrv_spectral_set", "record:s epoch:i vlf:d lf:d hf:d lf_hf:d mean_energy:d hr:d", "sig",
       "SELECT * FROM s JOIN p USING (record, epoch)",
       _two(1, 60, 120, 64, {
           "vlf": band(64, 1, 0.0033, 0.04), "lf": band(64, 1, 0.04, 0.15), "hf": band(64, 1, 0.15, 0.5),
           "lf_hf": f"{band(64, 1, 0.04, 0.15)} / ({band(64, 1, 0.15, 0.5)} + 2.220446049250313e-16)",
       }, {"mean_energy": SQL["energy"], "hr": SQL["heart_rate"]}))
def _(v):
    return ag.hrv_spectral_set(v.sig, 1, 60)


@query("ag14_movement_feature_set", "record:s epoch:i lf:d hf:d mean_energy:d activity:d mobility:d complexity:d", "sig",
       "SELECT * FROM s JOIN p USING (record, epoch)",
       _two(32, 2, 1, 64, {"lf": band(64, 32, 0.04, 0.5), "hf": band(64, 32, 5, 14)},
            {"mean_energy": SQL["energy"], "activity": SQL["activity"], "mobility": SQL["mobility"], "complexity": SQL["complexity"]}))
def _(v):
    return ag.movement_feature_set(v.sig, 32, 2, ext=1)


@query("ag15_sample_rr", "record:s t:i value:d", "sig", "SELECT record, t, value FROM sig WHERE t % 4 = 0")
def _(v):
    return ag.sample_rr(v.sig, 4)


# RR-like series: .5 .. 1.48 s with dropouts below .15.
RR = {
    "rr0": "SELECT record, t, CASE WHEN value < 40 THEN 0.1 ELSE 0.5 + value / 500.0 END AS v FROM sig",
    "r": "SELECT record, count(*) AS n FROM sig GROUP BY 1",
    "rr": "SELECT s.record, epoch, t, v AS rr, v - lag(v) OVER (PARTITION BY s.record, epoch ORDER BY t) AS d FROM rr0 s JOIN r ON r.record = s.record JOIN range(0, 100000) e(epoch) ON epoch < r.n // 120 AND s.t >= epoch * 120 - 40 AND s.t < (epoch + 1) * 120 + 40 WHERE t % 4 = 0 AND v > 0.15",
    "cal": "SELECT record, epoch FROM r, range(0, 100000) e(epoch) WHERE epoch < n // 120",
    "g": """SELECT record, epoch, avg(rr) AS mean_nn, median(rr) AS median_nn, max(rr) - min(rr) AS range_nn, stddev_samp(rr) AS sdnn, stddev_pop(d) AS sdsd, sqrt(avg(d * d)) AS rmssd,
  sum(CASE WHEN abs(d) * 1000 > 50 THEN 1 ELSE 0 END)::DOUBLE AS nn50, sum(CASE WHEN abs(d) * 1000 > 20 THEN 1 ELSE 0 END)::DOUBLE AS nn20, count(*) AS c,
  avg(60 / rr) AS mean_hr, max(60 / rr) AS max_hr, min(60 / rr) AS min_hr, stddev_pop(60 / rr) AS std_hr, var_samp(d) AS vd, var_samp(rr) AS vr FROM rr GROUP BY 1, 2""",
    "h": """SELECT *, 100.0 * nn50 / c AS pnn50, 100.0 * nn20 / c AS pnn20, rmssd / mean_nn AS cvsd, sdnn / mean_nn AS cvnn, sqrt(vd / 2) AS sd1,
  CASE WHEN 2 * vr - vd / 2 >= 0 THEN sqrt(2 * vr - vd / 2) END AS sd2 FROM g""",
}
RR_COLS = "record:s epoch:i " + " ".join(f"{n}:d" for n in hrv.TIME_NAMES)


def _rr(v):
    low = F.col("value") < 40
    return v.sig.withColumn("value", F.when(low, F.lit(0.1)).otherwise(0.5 + F.col("value") / 500.0))


def _zeroed(names):
    return ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)


@query("ag16_hrv_time_domain", RR_COLS, "sig", f"SELECT record, epoch, {_zeroed(hrv.TIME_NAMES)} FROM cal LEFT JOIN h USING (record, epoch)", RR)
def _(v):
    return hrv.hrv_features(_rr(v), 4, 120, 40)


@query("ag17_poincare", "record:s epoch:i sd1:d sd2:d ratio_sd2_sd1:d", "sig",
       "SELECT record, epoch, coalesce(sd1, 0) AS sd1, coalesce(sd2, 0) AS sd2, coalesce(sd2 / sd1, 0) AS ratio_sd2_sd1 FROM cal LEFT JOIN h USING (record, epoch)", RR)
def _(v):
    return hrv.hrv_features(_rr(v), 4, 120, 40)


@query("ag18_csi_cvi", "record:s epoch:i csi:d cvi:d modified_csi:d", "sig",
       "SELECT record, epoch, coalesce(sd2 / sd1, 0) AS csi, coalesce(log10(16 * sd1 * sd2), 0) AS cvi, coalesce(4 * sd2 * sd2 / sd1, 0) AS modified_csi FROM cal LEFT JOIN h USING (record, epoch)", RR)
def _(v):
    return hrv.hrv_features(_rr(v), 4, 120, 40)


@query("ag19_sample_entropy", "record:s epoch:i sampen:d", "sig", extra=RR | {
    "o": "SELECT record, epoch, row_number() OVER w AS i, rr, lead(rr) OVER w AS r1, lead(rr, 2) OVER w AS r2, 0.2 * stddev_pop(rr) OVER (PARTITION BY record, epoch) AS tol FROM rr WINDOW w AS (PARTITION BY record, epoch ORDER BY t)",
    "pairs": "SELECT a.record, a.epoch, count(*) AS b, sum(CASE WHEN abs(a.r2 - b.r2) <= a.tol THEN 1 ELSE 0 END) AS a FROM o a JOIN o b ON a.record = b.record AND a.epoch = b.epoch AND a.i < b.i AND a.r2 IS NOT NULL AND b.r2 IS NOT NULL AND abs(a.rr - b.rr) <= a.tol AND abs(a.r1 - b.r1) <= a.tol GROUP BY 1, 2"},
    sql="SELECT record, epoch, CASE WHEN a > 0 THEN -ln(a::DOUBLE / b) ELSE 0 END AS sampen FROM cal LEFT JOIN pairs USING (record, epoch)")
def _(v):
    return hrv.hrv_features(_rr(v), 4, 120, 40, entropy=True)


def _beats():
    from vitalgrid.plans.catalog.rolling import BEATS

    return BEATS | {
        "ri": "SELECT record, beat, (beat - lag(beat) OVER (PARTITION BY record ORDER BY beat)) / 10.0 * 1000 AS rr FROM peaks",
        "re": "SELECT record, beat // 300 AS epoch, beat, rr, rr - lag(rr) OVER (PARTITION BY record, beat // 300 ORDER BY beat) AS d, median(rr) OVER (PARTITION BY record, beat // 300) AS med FROM ri WHERE rr IS NOT NULL",
        "g": """SELECT record, epoch, avg(rr) AS ibi, stddev_pop(rr) AS sdnn, stddev_pop(d) AS sdsd, sqrt(avg(d * d)) AS rmssd,
  count(*) FILTER (WHERE abs(d) > 20) / nullif(count(d), 0)::DOUBLE AS pnn20, count(*) FILTER (WHERE abs(d) > 50) / nullif(count(d), 0)::DOUBLE AS pnn50,
  median(abs(rr - med)) AS hr_mad, sqrt(var_samp(d) / 2) AS sd1, CASE WHEN 2 * var_samp(rr) - var_samp(d) / 2 >= 0 THEN sqrt(2 * var_samp(rr) - var_samp(d) / 2) END AS sd2 FROM re GROUP BY 1, 2""",
        "k": "SELECT *, 60000 / ibi AS bpm, pi() * sd1 * sd2 AS s, CASE WHEN sd2 > 0 THEN sd1 / sd2 END AS sd1_sd2 FROM g",
    }


@query("ag20_beat_measures", "record:s epoch:i " + " ".join(f"{n}:d" for n in hrv.BEAT_NAMES), "sig",
       f"SELECT record, epoch, {_zeroed(hrv.BEAT_NAMES)} FROM k", _beats())
def _(v):
    return hrv.beat_measures(rolling.beat_intervals(v.sig, 10, 1.0), 10, 300)


DAY = 86_400
STAT = "mean:d std:d range:d mad:d entropy20:d entropy200:d"


def stats(src):
    """Epoch statistics of ``v`` in ``src(k, us, v)`` per key and day."""
    def entropy(bins):
        return f"SELECT k, epoch, -sum(c::DOUBLE / n * ln(c::DOUBLE / n)) AS entropy{bins} FROM (SELECT k, epoch, n, b{bins}, count(*) AS c FROM bx GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"

    def index(bins):
        return f"least(floor((v - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END) / CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END * {bins}), {bins - 1}) AS b{bins}"

    return {
        "bx0": f"SELECT k, us // 86400000000 AS epoch, v, avg(v) OVER w AS m, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY k, us // 86400000000)",
        "bx": f"SELECT *, {index(20)}, {index(200)} FROM bx0",
        "e20": entropy(20), "e200": entropy(200),
        "st": "SELECT k, epoch, avg(v) AS mean, stddev_samp(v) AS std, max(v) - min(v) AS range, avg(abs(v - m)) AS mad FROM bx GROUP BY 1, 2",
        "st6": "SELECT * FROM st JOIN e20 USING (k, epoch) JOIN e200 USING (k, epoch)",
        "days": "SELECT k, unnest(range(a, z + 1)) AS epoch FROM (SELECT k, min(epoch) AS a, max(epoch) AS z FROM st GROUP BY 1)",
        "st12": "SELECT d.k, d.epoch, mean, std, range, mad, entropy20, entropy200, " + ", ".join(
            f"CASE WHEN lag(d.epoch) OVER w IS NULL THEN 0 ELSE mean - avg(mean) OVER (w ROWS BETWEEN {s} PRECEDING AND 1 PRECEDING) END AS prev{s * DAY}, "
            f"CASE WHEN lead(d.epoch) OVER w IS NULL THEN 0 ELSE avg(mean) OVER (w ROWS BETWEEN 1 FOLLOWING AND {s} FOLLOWING) - mean END AS next{s * DAY}"
            for s in (1, 2, 4)
        ) + " FROM days d LEFT JOIN st6 USING (k, epoch) WINDOW w AS (PARTITION BY d.k ORDER BY d.epoch)",
    }


DIFFS = (DAY, 2 * DAY, 4 * DAY)
DIFF_COLS = " ".join(f"prev{s}:d next{s}:d" for s in DIFFS)
ENMO = {"src": "SELECT record AS k, us, greatest(sqrt(x*x + y*y + z*z) - 1, 0) AS v FROM xyz"}


def _enmo(v):
    from vitalgrid.functions.rows import enmo

    return v.xyz.withColumn("v", enmo(F.col("x"), F.col("y"), F.col("z")))


@query("ag21_epoch_stats", f"record:i epoch:i {STAT} {DIFF_COLS}", "xyz", "SELECT k AS record, * EXCLUDE (k) FROM st12", ENMO | stats("src"))
def _(v):
    return ag.epoch_stats(_enmo(v), "v", interval=DAY, diff_seconds=DIFFS)


@query("ag22_epoch_stats_current", f"record:i epoch:i {STAT}", "xyz", "SELECT k AS record, * EXCLUDE (k) FROM st6", ENMO | stats("src"))
def _(v):
    return ag.epoch_stats_current(_enmo(v), "v", interval=DAY)


@query("ag23_mad", "record:i epoch:i mad:d", "xyz", "SELECT k AS record, epoch, mad FROM st", ENMO | stats("src"))
def _(v):
    e = _enmo(v).withColumn("epoch", F.floor(F.col("us") / (DAY * 1_000_000)))
    return ag.mad(e, "v", ["record", "epoch"])


@query("ag24_hist_entropy", "record:i epoch:i entropy:d", "xyz", "SELECT k AS record, epoch, entropy20 AS entropy FROM e20", ENMO | stats("src"))
def _(v):
    e = _enmo(v).withColumn("epoch", F.floor(F.col("us") / (DAY * 1_000_000)))
    return ag.hist_entropy(e, "v", ["record", "epoch"], 20)


SURROGATE = {
    "fl": "SELECT record, median(degrees(atan2(x, sqrt(y*y + z*z)))) AS med FROM xyz GROUP BY 1",
    "f": "SELECT a.record, t, us, CASE WHEN med > 0 THEN -x ELSE x END AS x, CASE WHEN med > 0 THEN -y ELSE y END AS y, z FROM xyz a JOIN fl ON fl.record = a.record",
    "e": "SELECT record, t, us, greatest(sqrt(x*x + y*y + z*z) - 1, 0) AS enmo, degrees(atan2(z, sqrt(x*x + y*y))) AS angle_z FROM f",
    "u": "SELECT *, 100.0 / (sum(CASE WHEN enmo < 0.02 THEN 0 ELSE enmo - 0.02 END) OVER (PARTITION BY record ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) + 1) AS u FROM e",
    "sur": "SELECT record, t, us, enmo, angle_z, avg(u) OVER (PARTITION BY record ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS lids FROM u",
}


@query("ag26_surrogate_signals", "record:i t:i enmo:d angle_z:d lids:d", "xyz", "SELECT * FROM sur", SURROGATE)
def _(v):
    return ag.surrogate_signals(v.xyz)


NAMES = list(ag.STAT_NAMES) + [f"{d}{s}" for s in DIFFS for d in ("prev", "next")]
MOVEMENT_COLS = "record:i epoch:i " + " ".join(f"{s}_{n}:d" for s in ("enmo", "angle_z", "lids") for n in NAMES)
STACKED = SURROGATE | {
    "src": "SELECT record * 4 + 0 AS k, us, enmo AS v FROM sur UNION ALL SELECT record * 4 + 1, us, angle_z FROM sur UNION ALL SELECT record * 4 + 2, us, lids FROM sur",
} | stats("src")


@query("ag25_movement_epoch_features", MOVEMENT_COLS, "xyz",
       "SELECT k // 4 AS record, epoch, " + ", ".join(
           f"max(CASE WHEN k % 4 = {i} THEN {n} END) AS {s}_{n}" for i, s in enumerate(("enmo", "angle_z", "lids")) for n in NAMES
       ) + " FROM st12 GROUP BY 1, 2", STACKED)
def _(v):
    return ag.movement_epoch_features(v.xyz, interval=DAY, diff_seconds=DIFFS)


# The normal quantile and its large-sample expansion give the t quantile to better than 1e-9 here.
Z = "1.959963984540054"
T_QUANTILE = f"({Z} + ({Z}**3 + {Z}) / (4 * d) + (5 * {Z}**5 + 16 * {Z}**3 + 3 * {Z}) / (96 * d**2) + (3 * {Z}**7 + 19 * {Z}**5 + 17 * {Z}**3 - 15 * {Z}) / (384 * d**3))"


@query("ag27_mean_ci", "record:s mean:d lower:d upper:d", "sig", extra={
    "g": "SELECT record, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se, (count(*) - 1)::DOUBLE AS d FROM sig GROUP BY 1"},
    sql=f"SELECT record, m AS mean, m - se * {T_QUANTILE} AS lower, m + se * {T_QUANTILE} AS upper FROM g")
def _(v):
    return ag.mean_ci(v.sig, "value", ["record"])


@query("ag29_total_event_time", "record:i total:i", "iv", "SELECT record, sum(duration) AS total FROM iv WHERE label = 'view' GROUP BY 1")
def _(v):
    return ag.total_event_time(v.intervals, "view")


@query("ag30_event_count", "record:i label:s n:i", "iv extents",
       "SELECT e.record, c.label, count(i.id) AS n FROM extents e CROSS JOIN (SELECT unnest(['click', 'purchase', 'signup', 'view', 'nap']) AS label) c LEFT JOIN iv i ON i.record = e.record AND i.label = c.label GROUP BY 1, 2")
def _(v):
    return ag.event_count(v.intervals, v.extents, [*CLASSES, "nap"])


@query("ud4_user_feature", "record:s epoch:i crossings:d", "sig",
       "SELECT record, epoch, count(*) FILTER (WHERE sign(x - m) <> sign(px - m)) AS crossings FROM (SELECT *, x - d1 AS px, avg(x) OVER (PARTITION BY record, epoch) AS m FROM ep) WHERE d1 IS NOT NULL GROUP BY 1, 2",
       epochs(W, 0))
def _(v):
    # Like the SQL, no row for an epoch without a step.
    return ag.user_feature(v.sig, ag.mean_crossings, W, 0, ["crossings"]).dropna(subset=["crossings"])
