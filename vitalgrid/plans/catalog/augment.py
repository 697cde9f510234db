from vitalgrid.operators import augment as au
from vitalgrid.plans import oracle
from vitalgrid.plans.catalog import query

CELL = "win:i t:i bin:i value:d"
SEED = 5


def q(text):
    return f"'{text}'"


U, N = oracle.uniform, oracle.normal
S = str(SEED)
MEAN = "avg(value) OVER (PARTITION BY win)"


def _cells(name, sql, fn, extra=None):
    query(name, CELL, "cells", sql, extra)(lambda v: fn(v.cells))


_cells("au1_jitter", f"SELECT win, t, bin, value + 0.1 * {N(S, q('jitter'), 'win', 't', 'bin')} AS value FROM cells", lambda c: au.jitter(c, SEED))
_cells("au2_scaling", f"SELECT win, t, bin, value * (1 + 0.1 * {N(S, q('scaling'), 'win', 'bin')}) AS value FROM cells", lambda c: au.scaling(c, SEED))
_cells("au3_inverting", f"SELECT win, t, bin, CASE WHEN {U(S, q('inverting'), 'win', 'bin')} < 0.5 THEN value ELSE -value END AS value FROM cells",
       lambda c: au.inverting(c, SEED))
_cells("au7_shuffle_features", "SELECT c.win, t, m.dest AS bin, value FROM cells c JOIN m ON m.win = c.win AND m.bin = c.bin",
       lambda c: au.shuffle_features(c, SEED), {
           "m": f"SELECT win, bin, row_number() OVER (PARTITION BY win ORDER BY md5('{S}|shuffle|' || win::VARCHAR || '|' || bin::VARCHAR), bin) - 1 AS dest FROM (SELECT DISTINCT win, bin FROM cells)"})
_cells("au8_translate_bins", f"SELECT b.win, b.t, b.bin, coalesce(c.value, m.mean) AS value FROM s b JOIN m ON m.win = b.win LEFT JOIN cells c ON c.win = b.win AND c.t = b.t AND c.bin = b.bin + b.shift",
       lambda c: au.translate_bins(c, SEED, 8), {
           "s": f"SELECT win, t, bin, -4 + floor({U(S, q('translate'), 'win')} * 8) AS shift FROM cells",
           "m": "SELECT win, avg(value) AS mean FROM cells GROUP BY 1"})


def _masks(name, axis, reach, num):
    """Successive masks as chained statements, each with the mean of the state before it."""
    out = {"v0": "SELECT * FROM cells"}
    for i in range(num):
        width = f"floor({U(S, q(name), q('width'), 'win', str(i))} * {reach})"
        out[f"a{i}"] = f"SELECT *, {width} AS w, avg(value) OVER (PARTITION BY win) AS m FROM v{i}"
        out[f"b{i}"] = f"SELECT *, floor({U(S, q(name), q('start'), 'win', str(i))} * (8 - w)) AS s FROM a{i}"
        stop = f"s + floor({U(S, q(name), q('stop'), 'win', str(i))} * w)"
        out[f"v{i + 1}"] = f"SELECT win, t, bin, CASE WHEN w > 0 AND {axis} >= s AND {axis} < {stop} THEN m ELSE value END AS value FROM b{i}"
    return out


_cells("au9_freq_mask", "SELECT * FROM v2", lambda c: au.freq_mask(c, SEED), _masks("freq_mask", "bin", 4, 2))
_cells("au10_time_mask", "SELECT * FROM v4", lambda c: au.time_mask(c, SEED, max_rows=6, num_masks=4), _masks("time_mask", "t", 6, 4))
_cells("au11_replace_with_noise",
       f"SELECT win, t, bin, CASE WHEN {U(S, q('noise?'), 'win')} < 0.1 THEN {MEAN} + 0.2 * {N(S, q('noise'), 'win', 't', 'bin')} ELSE value END AS value FROM cells",
       lambda c: au.replace_with_noise(c, SEED))
_cells("au12_segment_noise",
       f"SELECT win, t, bin, CASE WHEN {U(S, q('segment?'), 'win')} < 0.5 AND t >= st AND t < st + len THEN mean + 0.01 * {N(S, q('segment'), 'win', 't', 'bin')} ELSE value END AS value FROM b",
       lambda c: au.segment_noise(c, SEED, sample_prob=0.5, low=0.1, high=0.9), {
           "a": f"SELECT *, {MEAN} AS mean, floor(exp(ln(0.1) + {U(S, q('segment-length'), 'win')} * (ln(0.9) - ln(0.1))) * 8) AS len FROM cells",
           "b": f"SELECT *, floor({U(S, q('segment-start'), 'win')} * greatest(8 - len, 0)) AS st FROM a"})

CURVE = {
    "y": f"SELECT DISTINCT win, bin, 1 + 0.1 * {N(S, q('curve'), 'win', 'bin', '0')} AS y0, 1 + 0.1 * {N(S, q('curve'), 'win', 'bin', '1')} AS y1, 1 + 0.1 * {N(S, q('curve'), 'win', 'bin', '2')} AS y2 FROM cells",
    # Parabola through (0, y0), (3.5, y1), (7, y2): the spline through three knots.
    "c": "SELECT x.win, x.t, x.bin, value, y0 * (t - 3.5) * (t - 7) / 24.5 - y1 * t * (t - 7) / 12.25 + y2 * t * (t - 3.5) / 24.5 AS curve FROM cells x JOIN y ON y.win = x.win AND y.bin = x.bin",
}
_cells("au4_random_curve", "SELECT win, t, bin, curve AS value FROM c", lambda c: au.random_curve(c, SEED, fs=4), CURVE)
_cells("au5_mag_warp", "SELECT win, t, bin, value * curve AS value FROM c", lambda c: au.mag_warp(c, SEED, fs=4), CURVE)
_cells("au6_time_warp", """SELECT g.win, g.t, g.bin, CASE WHEN g.t <= f.t0 THEN f.v0 WHEN p.value IS NULL THEN f.v1 ELSE p.value + (g.t - p.axis) / (p.axis2 - p.axis) * (p.value2 - p.value) END AS value
FROM cells g JOIN f ON f.win = g.win AND f.bin = g.bin LEFT JOIN s p ON p.win = g.win AND p.bin = g.bin AND g.t >= p.axis AND g.t < p.axis2""",
       lambda c: au.time_warp(c, SEED, fs=4), CURVE | {
           "k": "SELECT *, sum(curve) OVER (PARTITION BY win, bin ORDER BY t) AS cum, sum(curve) OVER (PARTITION BY win, bin) AS total FROM c",
           "ax": "SELECT *, cum * (7 / total) AS axis FROM k",
           "s": "SELECT *, lead(axis) OVER (PARTITION BY win, bin ORDER BY t) AS axis2, lead(value) OVER (PARTITION BY win, bin ORDER BY t) AS value2 FROM ax",
           "f": "SELECT win, bin, min(axis) AS t0, arg_min(value, t) AS v0, arg_max(value, t) AS v1 FROM ax GROUP BY 1, 2"})
