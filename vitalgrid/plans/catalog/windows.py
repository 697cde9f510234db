from pyspark.sql import functions as F

from vitalgrid.operators import windows as wn
from vitalgrid.plans import oracle
from vitalgrid.plans.catalog import query
from vitalgrid.plans.views import OVERLAP, RESOLUTION, SHARE, WINDOW

WIN = "record:i win:i start:i max_index:i"


def _windows(v):
    return wn.window_index(v.extents, WINDOW, OVERLAP)


@query("sa1_window_index", WIN, "win", "SELECT * FROM win")
def _(v):
    return _windows(v)


def _md5(*parts):
    return "md5(" + "||'|'||".join(parts) + ")"


@query("sa2_split_records", "record:i split:s", "extents", extra={
    "a": f"SELECT record, row_number() OVER (ORDER BY {_md5(chr(39) + '7' + chr(39), chr(39) + 'test' + chr(39), 'record::VARCHAR')}, record) AS p, count(*) OVER () AS n FROM extents",
    "b": f"SELECT record, n, floor(n * 20 / 100.0) AS nt, row_number() OVER (ORDER BY {_md5(chr(39) + '7' + chr(39), chr(39) + 'validation' + chr(39), 'record::VARCHAR')}, record) AS q FROM a WHERE p > floor(n * 20 / 100.0)"},
    sql="SELECT record, 'test' AS split FROM a WHERE p <= floor(n * 20 / 100.0) UNION ALL SELECT record, CASE WHEN q <= floor((n - nt) * 10 / 100.0) THEN 'validation' ELSE 'train' END FROM b")
def _(v):
    return wn.split_records(v.extents, 20, 10, 7)


@query("sa3_batch", WIN + " batch_id:i slot:i", "win", extra={
    "o": "SELECT *, row_number() OVER (ORDER BY md5(record::VARCHAR), record, win) - 1 AS p, count(*) OVER () AS n FROM win"},
    sql="SELECT record, win, start, max_index, p // 7 AS batch_id, p % 7 AS slot FROM o WHERE p // 7 < n // 7")
def _(v):
    return wn.batch(_windows(v), 7)


@query("sa4_event_index", "record:i id:i start:i duration:i max_index:i", "iv",
       "SELECT record, id, start, duration, 2592000 - 86400 AS max_index FROM iv WHERE kind = 'event'")
def _(v):
    return wn.event_index(v.intervals.where("kind = 'event'"), _windows(v))


DRAWS = 5000
U = oracle.uniform


@query("sa5_balanced_sample", "draw:i label:s record:i start:i", "iv", extra={
    "ev": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY start, event_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM iv WHERE label IN ('click', 'view')",
    "d": f"SELECT draw, CASE WHEN u < 0.3 THEN 'click' WHEN u < 0.3::DOUBLE + 0.4::DOUBLE THEN 'view' END AS label FROM (SELECT draw, {U('11', chr(39) + 'class' + chr(39), 'draw')} AS u FROM range(0, {DRAWS}) g(draw))",
    "dn": f"SELECT draw, d.label, CAST(floor({U('11', chr(39) + 'event' + chr(39), 'draw')} * c.n) AS BIGINT) AS pos, {U('11', chr(39) + 'start' + chr(39), 'draw')} AS u FROM d JOIN (SELECT label, max(n) AS n FROM ev GROUP BY 1) c ON c.label = d.label",
    "h": "SELECT draw, dn.label, ev.record, ev.start, ev.duration, u FROM dn JOIN ev ON ev.label = dn.label AND ev.pos = dn.pos",
    "k": "SELECT *, 2505600 AS top, greatest(start - (86400 - duration), 0) AS lo, least(2505600, start) AS hi FROM h"},
    sql="SELECT draw, label, record, CASE WHEN duration >= 86400 OR start = 0 THEN start WHEN start >= top THEN top ELSE lo + floor(u * greatest(hi - lo, 0)) END AS start FROM k")
def _(v):
    e = wn.event_index(v.intervals.where("kind = 'event'"), _windows(v))
    return wn.balanced_sample(e, DRAWS, {"click": 0.3, "view": 0.4}, WINDOW, 11)


@query("sa6_background_sample", "draw:i record:i start:i", "iv extents", extra={
    "grid": "SELECT record, unnest(range(0, 2505600, 600)) AS start FROM extents",
    "ab": "SELECT g.record, g.start, greatest((e.start - g.start) / 600.0::DOUBLE, 0.0) AS a, least((e.start + e.duration - g.start) / 600.0::DOUBLE, 144.0) AS b FROM grid g JOIN iv e ON g.record = e.record AND e.start < g.start + 86400 AND e.start + e.duration > g.start WHERE e.duration > 10",
    "taken": "SELECT DISTINCT record, start FROM ab WHERE b - a > 0.25 AND CASE WHEN a - floor(a) <= 0.75 THEN floor(a) ELSE round_even(a, 0) END < least(CASE WHEN b - floor(b) >= 0.25 THEN floor(b) + 1 ELSE round_even(b, 0) END, 144)",
    "free": "SELECT record, start, row_number() OVER (ORDER BY md5(record::VARCHAR), record, start) - 1 AS pos, count(*) OVER () AS n FROM (SELECT * FROM grid EXCEPT SELECT * FROM taken)",
    "d": f"SELECT draw, CAST(floor({U('11', chr(39) + 'background' + chr(39), 'draw')} * (SELECT max(n) FROM free)) AS BIGINT) AS pos FROM range(0, {DRAWS}) g(draw)"},
    sql="SELECT draw, record, start FROM d JOIN free ON free.pos = d.pos")
def _(v):
    return wn.background_sample(_windows(v), v.intervals, DRAWS, WINDOW, RESOLUTION, 11, SHARE)


@query("sa7_record_windows", WIN, "win", "SELECT * FROM win WHERE record = 7 ORDER BY win")
def _(v):
    return wn.record_windows(_windows(v), 7)
