from pyspark.sql import functions as F

from vitalgrid.operators import spectral as sp
from vitalgrid.plans.catalog import query

FX = "record:s frame:i bin:i value:d"


def long(df):
    return df.select("record", "frame", F.posexplode("x").alias("bin", "value"))


# 64-sample frames centred on multiples of 16, zero outside the record.
FRAMES = {
    "r": "SELECT record, count(*) AS n FROM sig GROUP BY 1",
    "ix": "SELECT record, frame, k FROM r, range(0, 100000) f(frame), range(0, 64) g(k) WHERE frame <= n // 16",
    "fr": "SELECT ix.record, frame, k, coalesce(value, 0) AS x FROM ix LEFT JOIN sig ON sig.record = ix.record AND sig.t = frame * 16 - 32 + k",
}
DFT = "SELECT record, frame, b, sum(x * cos(2 * pi() * b * k / 64)) ** 2 + sum(x * sin(2 * pi() * b * k / 64)) ** 2 AS p FROM tp, range(0, 33) g(b) GROUP BY 1, 2, 3"


@query("sp1_psd", FX, "sig", extra=FRAMES | {
    "tp": "SELECT record, frame, k, (x - avg(x) OVER (PARTITION BY record, frame)) * (0.42 - 0.5 * cos(2 * pi() * k / 63) + 0.08 * cos(4 * pi() * k / 63)) AS x FROM fr",
    "u": "SELECT sum((0.42 - 0.5 * cos(2 * pi() * k / 63) + 0.08 * cos(4 * pi() * k / 63)) ** 2) AS u FROM range(0, 64) g(k)",
    "dft": DFT,
    "s": "SELECT record, frame, b - 1 AS i, p / u * CASE WHEN b = 32 THEN 1 ELSE 2 END AS s FROM dft, u WHERE b > 0"},
    sql="SELECT record, frame, o AS bin, ln(max(s) + 2.220446049250313e-16) AS value FROM s JOIN range(0, 11) g(o) ON i BETWEEN o * 3 - 1 AND o * 3 + 1 GROUP BY 1, 2, 3")
def _(v):
    return long(sp.psd(v.sig, 1, 64, 48, 64, 0, 0.5, 3))


@query("sp1_psd_study_settings", FX)
def _(v):
    # 32 Hz, window 320, overlap 256, 512-point spectra pooled to 32 bins.
    return long(sp.psd(v.sig, 32, 320, 256, 512, 0, 6, 3))


# 16-sample frames every 4 samples; their 32-sample neighbourhood; correlation lags cut to 47, of which
# the 16-point spectrum sees the first 16.
AUTOCORR = {
    "r": "SELECT record, count(*) AS n FROM sig GROUP BY 1",
    "ix": "SELECT record, n, frame, k FROM r, range(0, 100000) f(frame), range(0, 32) g(k) WHERE frame <= n // 4",
    "e0": "SELECT ix.record, n, frame, k, coalesce(value, 0) AS x FROM ix LEFT JOIN sig ON sig.record = ix.record AND sig.t = frame * 4 - 16 + k WHERE frame * 4 >= 8 AND frame * 4 + 7 <= n",
    "e": "SELECT record, frame, k, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 2.220446049250313e-16) AS x FROM e0 WINDOW w AS (PARTITION BY record, frame)",
    "f": "SELECT record, frame, k - 8 AS k, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 2.220446049250313e-16) AS x FROM e0 WHERE k >= 8 AND k < 24 WINDOW w AS (PARTITION BY record, frame)",
    "c": "SELECT f.record, f.frame, m, sum(e.x * f.x) * (0.5 - 0.5 * cos(2 * pi() * m / 46)) AS c FROM f JOIN range(0, 16) g(m) ON true JOIN e ON e.record = f.record AND e.frame = f.frame AND e.k = 8 + f.k + (8 + m - 31) GROUP BY 1, 2, 3",
    "d": "SELECT record, frame, b, sum(c * cos(2 * pi() * b * m / 16)) ** 2 + sum(c * sin(2 * pi() * b * m / 16)) ** 2 AS p FROM c, range(1, 4) h(b) GROUP BY 1, 2, 3",
}


@query("sp3_autocorr_psd", FX, "sig", extra=AUTOCORR,
       sql="SELECT ix.record, ix.frame, b - 1 AS bin, CASE WHEN ix.frame * 4 >= 8 AND ix.frame * 4 + 7 <= n THEN ln(p / (32 * 16) + 2.220446049250313e-16) ELSE 0 END AS value FROM (SELECT DISTINCT record, n, frame, b FROM ix, range(1, 4) h(b)) ix LEFT JOIN d USING (record, frame, b)")
def _(v):
    return long(sp.autocorr_psd(v.sig, 32, 16, 12, 0, 6))


@query("sp4_log_filterbank", FX, "sig", extra=FRAMES | {
    "em": "SELECT record, frame, k, (x - 0.97 * coalesce(prev, 0)) * (0.5 - 0.5 * cos(2 * pi() * k / 63)) AS x FROM (SELECT fr.record, frame, k, x, sig.value AS prev FROM fr LEFT JOIN sig ON sig.record = fr.record AND sig.t = frame * 16 - 32 + k - 1)",
    "tp": "SELECT * FROM em",
    "dft": DFT,
    "edge": "SELECT m, floor(65 * 700 * (10 ** (m * 2595 * log10(1 + 16.0 / 700) / 9 / 2595) - 1) / 32) AS e FROM range(0, 10) g(m)",
    "mel": "SELECT a.m, b, CASE WHEN b >= a.e AND b < c.e THEN (b - a.e) / (c.e - a.e) WHEN b >= c.e AND b < d.e THEN (d.e - b) / (d.e - c.e) ELSE 0 END AS w FROM edge a JOIN edge c ON c.m = a.m + 1 JOIN edge d ON d.m = a.m + 2, range(0, 33) g(b)"},
    sql="SELECT record, frame, m AS bin, ln(CASE WHEN sum(w * p / 64) = 0 THEN 2.220446049250313e-16 ELSE sum(w * p / 64) END + 2.220446049250313e-16) AS value FROM dft JOIN mel USING (b) GROUP BY 1, 2, 3")
def _(v):
    return long(sp.log_filterbank(v.sig, 32, 64, 48, 64, 8))


@query("sp5_mfcc", FX, "sig", extra=FRAMES | {
    "tp": "SELECT record, frame, k, (x - 0.97 * coalesce(prev, 0)) * (0.5 - 0.5 * cos(2 * pi() * k / 63)) AS x FROM (SELECT fr.record, frame, k, x, sig.value AS prev FROM fr LEFT JOIN sig ON sig.record = fr.record AND sig.t = frame * 16 - 32 + k - 1)",
    "dft": DFT,
    "edge": "SELECT m, floor(65 * 700 * (10 ** (m * 2595 * log10(1 + 16.0 / 700) / 17 / 2595) - 1) / 32) AS e FROM range(0, 18) g(m)",
    "mel": "SELECT a.m, b, CASE WHEN b >= a.e AND b < c.e THEN (b - a.e) / (c.e - a.e) WHEN b >= c.e AND b < d.e THEN (d.e - b) / (d.e - c.e) ELSE 0 END AS w FROM edge a JOIN edge c ON c.m = a.m + 1 JOIN edge d ON d.m = a.m + 2, range(0, 33) g(b)",
    "fb": "SELECT record, frame, m, ln(CASE WHEN sum(w * p / 64) = 0 THEN 2.220446049250313e-16 ELSE sum(w * p / 64) END) AS e FROM dft JOIN mel USING (b) GROUP BY 1, 2, 3",
    "total": "SELECT record, frame, ln(sum(p / 64)) AS e0 FROM dft GROUP BY 1, 2",
    "dct": "SELECT record, frame, c, sum(e * cos(pi() * c * (m + 0.5) / 16)) * sqrt(2.0 / 16) * (1 + 11 * sin(pi() * c / 22)) AS v FROM fb, range(0, 8) g(c) GROUP BY 1, 2, 3"},
    sql="SELECT record, frame, c AS bin, CASE WHEN c = 0 THEN e0 ELSE v END AS value FROM dct JOIN total USING (record, frame)")
def _(v):
    return long(sp.mfcc(v.sig, 32, 64, 48, 64, 8))


@query("sp6_wavelet", "record:s bin:i energy:d")
def _(v):
    # All 64 scales at full rate; reported as energy per scale.
    return long(sp.wavelet(v.sig)).groupBy("record", "bin").agg(F.avg(F.col("value") ** 2).alias("energy"))


@query("sp7_wavelet_pooled", FX, "sig", extra={
    # Two scales, 2 and 4: direct sums over the support of eight scales.
    "w": """SELECT o.record, o.t, a, sum(s.value * exp(-(((s.t - o.t) / a::DOUBLE) ** 2) / 2) * cos(5 * (s.t - o.t) / a::DOUBLE)) / sqrt(a) AS c
FROM sig o JOIN (SELECT unnest([2, 4]) AS a) sc ON true JOIN sig s ON s.record = o.record AND s.t BETWEEN o.t - 8 * a AND o.t + 8 * a GROUP BY 1, 2, 3""",
    "m": "SELECT record, t, a, max(abs(c)) OVER (PARTITION BY record, a ORDER BY t ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS value FROM w"},
    sql="SELECT record, t // 16 AS frame, CASE a WHEN 4 THEN 0 ELSE 1 END AS bin, value FROM m WHERE t % 16 = 0")
def _(v):
    return long(sp.wavelet_pooled(v.sig, 16, [2, 4]))


def _superlet(freqs, weights):
    """Direct sums for (frequency, order, exponent) terms at 32 Hz and three base cycles."""
    terms = ", ".join(f"({i}, {f}, {o}, {w})" for i, (f, ws) in enumerate(zip(freqs, weights)) for o, w in ws)
    return {
        "terms": f"SELECT col0 AS bin, 1 / (2 * pi() * col1) AS s, 3.0 * col2 AS c, col3 AS pw FROM (VALUES {terms}) v",
        "pts": "SELECT *, 10 * s * c * 32 AS m, CAST(ceil(10 * s * c * 32) AS BIGINT) AS len FROM terms",
        "taps": "SELECT bin, s, c, pw, len, k, ((1 - m) / 2 + k) / 32 / s AS u, 5 / (s * c * (2 * pi()) ** 1.5) * sqrt(1 / 32.0) / (4 * pi()) AS height FROM pts, range(0, 1000) g(k) WHERE k < len",
        "w": "SELECT bin, c, pw, k - (len - 1) // 2 AS lag, height * exp(-0.5 * (5 * u / (2 * pi() * c)) ** 2) * cos(u) AS re, height * exp(-0.5 * (5 * u / (2 * pi() * c)) ** 2) * sin(u) AS im FROM taps",
        "mag": "SELECT o.record, o.t, bin, c, pw, sqrt(sum(re * s.value) ** 2 + sum(im * s.value) ** 2) AS z FROM sig o JOIN w ON true JOIN sig s ON s.record = o.record AND s.t = o.t - lag GROUP BY 1, 2, 3, 4, 5",
    }


SUPERLET = "SELECT record, t AS frame, bin, exp(sum(pw * ln(z))) AS value FROM mag GROUP BY 1, 2, 3"


@query("sp8_superlet", FX, "sig", SUPERLET, _superlet((8, 12), [[(1, 0.5), (2, 0.5)]] * 2))
def _(v):
    return long(sp.superlet(v.sig, 32, [8, 12], 2, c_1=3))


@query("sp9_superlet_adaptive", FX, "sig", SUPERLET,
       _superlet((8, 10, 12), [[(1, 1.0)], [(1, 1 / 1.5), (2, 0.5 / 1.5)], [(1, 0.5), (2, 0.5)]]))
def _(v):
    return long(sp.superlet(v.sig, 32, [8, 10, 12], 2, c_1=3, adaptive=True))


@query("sp10_superlet_frames", FX, "sig", extra=_superlet((8, 12), [[(1, 0.5), (2, 0.5)]] * 2) | {
    "z": "SELECT record, t, bin, exp(sum(pw * ln(z))) AS z FROM mag GROUP BY 1, 2, 3",
    "mx": "SELECT record, t, bin, max(z) OVER (PARTITION BY record, bin ORDER BY t ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS value FROM z"},
    sql="SELECT record, t // 16 AS frame, bin, value FROM mx WHERE t % 16 = 0")
def _(v):
    # Two frequencies of interest: 7.5 + 1/2 and 12 Hz.
    return long(sp.superlet_frames(v.sig, 32, 2, 7.5, 12, 16, order_max=2, c_1=3))


@query("sp10_superlet_frames_ten_orders", "record:s bin:i mean:d")
def _(v):
    x = long(sp.superlet_frames(v.sig, 32, 16, 1, 6, 16))
    return x.groupBy("record", "bin").agg(F.avg("value").alias("mean"))


def _response(b, a):
    """Impulse response of a second-order section by its recursion, and the filtered signal."""
    return {
        "h": f"""/*rec*/ SELECT 0 AS i, {b[0]} AS y, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 UNION ALL
SELECT i + 1, (CASE i + 1 WHEN 1 THEN {b[1]} WHEN 2 THEN {b[2]} ELSE 0.0 END) - {a[0]} * y - {a[1]} * y1, y, y1 FROM h WHERE i < 400""",
        "o": "SELECT s.record, s.t, sum(h.y * p.value) AS value FROM sig s JOIN h ON h.i <= s.t JOIN sig p ON p.record = s.record AND p.t = s.t - h.i GROUP BY 1, 2",
    }


# Bilinear designs with tangents of the cut-offs: 2..8 Hz band (order 1), 4 Hz high pass (order 2) at 32 Hz.
T1, T2, T4 = "tan(pi() * 2 / 32)", "tan(pi() * 8 / 32)", "tan(pi() * 4 / 32)"
_B0 = f"(1 + ({T2} - {T1}) + {T1} * {T2})"
_H0 = f"(1 + sqrt(2) * {T4} + {T4} ** 2)"


@query("sp11_bandpass", "record:s t:i value:d", "sig", "SELECT * FROM o",
       _response((f"(({T2} - {T1}) / {_B0})", "0.0", f"(-({T2} - {T1}) / {_B0})"),
                 (f"(2 * ({T1} * {T2} - 1) / {_B0})", f"((1 - ({T2} - {T1}) + {T1} * {T2}) / {_B0})")))
def _(v):
    return sp.bandpass(v.sig, 32, 2, 8, order=1)


@query("sp12_highpass", "record:s t:i value:d", "sig", "SELECT * FROM o",
       _response((f"(1 / {_H0})", f"(-2 / {_H0})", f"(1 / {_H0})"),
                 (f"(2 * ({T4} ** 2 - 1) / {_H0})", f"((1 - sqrt(2) * {T4} + {T4} ** 2) / {_H0})")))
def _(v):
    return sp.highpass(v.sig, 32, 4, order=2)


@query("sp11_bandpass_order_5", "record:s t:i value:d")
def _(v):
    return sp.bandpass(v.sig, 32, 0.5, 8)


@query("sp12_highpass_order_10", "record:s t:i value:d")
def _(v):
    return sp.highpass(v.sig, 32, 1)


# Two hundred rounds of the dual variable left of each sample (zero at both ends), then the signal it leaves.
TV_ROUND = """SELECT k + 1, record, t, y, CASE WHEN t = 0 THEN 0 ELSE greatest(-1, least(1, f + (x - before) / 4)) END FROM (
  SELECT *, lag(x) OVER (PARTITION BY record ORDER BY t) AS before FROM (
    SELECT *, y + coalesce(lead(f) OVER (PARTITION BY record ORDER BY t), 0) - f AS x FROM tv)) WHERE k < 199"""


@query("sp13_tv_denoise", "record:s t:i value:d", "sig",
       "SELECT record, t, y + coalesce(lead(f) OVER (PARTITION BY record ORDER BY t), 0) - f AS value FROM (SELECT * FROM tv WHERE k = 199)",
       {"tv": "/*rec*/ SELECT 0 AS k, record, t, value AS y, 0.0::DOUBLE AS f FROM sig UNION ALL " + TV_ROUND})
def _(v):
    return sp.tv_denoise(v.sig)
