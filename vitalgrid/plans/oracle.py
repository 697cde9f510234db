"""SQL text for checking queries in an independent engine (DuckDB dialect)."""

from __future__ import annotations

PI = "pi()"


def uniform(*parts: str) -> str:
    """Hash uniform of the key parts (SQL expressions)."""
    key = "||'|'||".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x'||substr(md5({key}),1,8))::BIGINT/4294967296.0)"


def word2(*parts: str) -> str:
    key = "||'|'||".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x'||substr(md5({key}),9,8))::BIGINT/4294967296.0)"


def normal(*parts: str) -> str:
    return f"(sqrt(-2.0*ln({uniform(*parts)}+0.5/4294967296.0))*cos(2.0*pi()*{word2(*parts)}))"


# Views, in dependency order; each query names the ones it uses.
CTES: dict[str, str] = {
    "sig": "SELECT event_type AS record, 0 AS channel, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value FROM events",
    "xyz": "SELECT user_id AS record, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, epoch_us(ts) - 1704067200000000 AS us, sin(value) AS x, cos(value) AS y, value / 250.0 - 1.0 AS z FROM events",
    "iv": "SELECT event_id, event_id AS id, user_id AS record, event_type AS label, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS start, CAST(floor(value * 60) AS BIGINT) AS duration, CASE WHEN event_type = 'error' THEN 'mask' ELSE 'event' END AS kind FROM events",
    "extents": "SELECT DISTINCT user_id AS record, CAST(2592000 AS BIGINT) AS extent FROM events",
    "cells": "SELECT vec_id AS win, i // 8 AS t, i % 8 AS bin, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) g(i)",
    "pred": "SELECT d.doc_id AS record, CAST(0 AS BIGINT) AS epoch, 'quality' AS class, CAST(coalesce(l.quality, -1) AS DOUBLE) AS y_true, "
    + uniform("'p'", "'quality'", "d.doc_id")
    + " AS y_pred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT d.doc_id, CAST(0 AS BIGINT), 'toxic', CAST(coalesce(l.toxic, -1) AS DOUBLE), "
    + uniform("'p'", "'toxic'", "d.doc_id")
    + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "mc": "SELECT vec_id AS epoch, label AS y_true, CASE WHEN "
    + uniform("'k'", "vec_id")
    + " < 0.7 THEN label ELSE CAST(floor("
    + uniform("'c'", "vec_id")
    + " * 10) AS INT) END AS y_pred FROM embeddings",
    "targets": "SELECT record, label AS class, id, CAST(start AS DOUBLE) AS start, CAST(start + duration AS DOUBLE) AS stop FROM iv WHERE kind = 'event'",
    "outputs": "SELECT record, class, id, st AS start, st + floor((stop - start) * ("
    + uniform("'stretch'", "id")
    + " + 0.5)) + 1 AS stop, score FROM (SELECT *, start + floor("
    + uniform("'shift'", "id")
    + " * 7200) AS st, "
    + uniform("'score'", "id")
    + " AS score FROM targets WHERE "
    + uniform("'miss'", "id")
    + " >= 0.2)",
    # W = 86400, overlap .25: 39 regular starts and the tail.
    "win": "SELECT record, CAST(i AS BIGINT) AS win, CAST(CASE WHEN i < n THEN floor(i * 64800.0) ELSE top END AS BIGINT) AS start, top AS max_index FROM (SELECT record, greatest(1, CAST(floor((d - 86400) / 64800.0) + 1 AS BIGINT)) AS n, greatest(0, d - 86400) AS top FROM (SELECT record, extent - extent % 30 AS d FROM extents)), range(0, 100000) g(i) WHERE i <= n",
    "hits": """SELECT record, win, start AS win_start, label, kind,
  CAST(CASE WHEN a - floor(a) <= 0.75 THEN floor(a) ELSE round_even(a, 0) END AS BIGINT) AS first,
  least(CAST(CASE WHEN b - floor(b) >= 0.25 THEN floor(b) + 1 ELSE round_even(b, 0) END AS BIGINT), 144) AS last
FROM (SELECT w.record, w.win, w.start, e.label, e.kind, greatest((e.start - w.start) / 600.0::DOUBLE, 0.0) AS a, least((e.start + e.duration - w.start) / 600.0::DOUBLE, 144.0) AS b
  FROM win w JOIN iv e ON w.record = e.record AND e.start < w.start + 86400 AND e.start + e.duration > w.start WHERE e.duration > 10)
WHERE b - a > 0.25""",
    "labels4": """SELECT w.record, w.win, w.start AS win_start, c.class, g.cell, CASE WHEN m.cell IS NOT NULL THEN -1.0 WHEN h.cell IS NOT NULL THEN 1.0 ELSE 0.0 END AS y_true
FROM win w CROSS JOIN (SELECT unnest(['click', 'purchase', 'signup', 'view']) AS class) c CROSS JOIN range(0, 144) g(cell)
LEFT JOIN (SELECT DISTINCT record, win, label, unnest(range(first, last)) AS cell FROM hits WHERE kind = 'event') h ON h.record = w.record AND h.win = w.win AND h.label = c.class AND h.cell = g.cell
LEFT JOIN (SELECT DISTINCT record, win, unnest(range(first, last)) AS cell FROM hits WHERE kind = 'mask') m ON m.record = w.record AND m.win = w.win AND m.cell = g.cell""",
}

_NEEDS = {
    "targets": ["iv"], "outputs": ["targets"], "win": ["extents"], "hits": ["win", "iv"], "labels4": ["hits"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _NEEDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def columns(spec: str) -> list[tuple[str, str]]:
    """``"record t:i value:d"`` -> (name, kind); kinds: i integer, d double, s text."""
    return [tuple((c.split(":") + ["s"])[:2]) for c in spec.split()]


def statement(spec: str, uses: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Complete statement with typed and rounded output columns."""
    parts = [(n, CTES[n]) for n in _closure(uses.split())] + list((extra or {}).items())
    recursive = "RECURSIVE " if any(q.lstrip().startswith("/*rec*/") for _, q in parts) else ""
    with_ = (f"WITH {recursive}" + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n") if parts else ""
    cols = []
    for name, kind in columns(spec):
        if kind == "i":
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            cols.append(f"round(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}")
        else:
            cols.append(f"CAST({name} AS VARCHAR) AS {name}")
    return f"{with_}SELECT {', '.join(cols)} FROM ({body}) q"
