"""Vector searches and archives against brute force, with nulls, ties, repeats and odd shapes."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import rotated_codes, va_file, vectors, warc

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((6, 20))
    rows = [(k, (centre[k % 6] + 0.4 * rng.standard_normal(20)).tolist()) for k in range(240)]
    rows += [(240 + k, rows[3][1]) for k in range(30)]  # one common vector
    rows += [(300, None), (301, [1.0, None] + [0.0] * 18), (302, [INF] + [0.0] * 19), (303, [NAN] * 20), (304, [0.0] * 20)]
    rows += [(305, rows[0][1][:7]), (306, []), (12, rows[12][1]), (307, [x * 3 for x in rows[5][1]])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vec string, cid int")
    return rows, frame.repartition(5)


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            full = np.array(v + [0.0] * (20 - len(v)))
            if zero or full.any():
                out[i] = full
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_exact_search_equals_brute_force(spark, table, monkeypatch, block):
    monkeypatch.setattr(vectors.query_blocks, "__defaults__", (block,))
    rows, frame = table
    vec = va_file.floored(F.col("embedding"), 1024)
    found = va_file.top_k(frame, F.col("vec_id") % 10 == 0, 7, vec).collect()
    own = {i: np.floor(1024 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q in own:
        if q % 10 == 0:
            scored = sorted((-int(own[q] @ own[c]), c) for c in own if c != q)[:7]
            want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_scores_beyond_doubles_stay_exact():
    a = np.array([[2.0**40 + 1, 3.0], [1e300, 1.0]])
    assert va_file.exact_scores(a, a).tolist() == [(2**40 + 1) ** 2 + 9 if (2**40 + 1) ** 2 + 9 < 2**63 else 2**63 - 1, 2**63 - 1]
    assert va_file.exact_scores(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [2**60 + 1]


def test_rotated_codes_find_the_nearest(spark, table):
    rows, frame = table
    own = usable(rows, False)
    found = rotated_codes.nearest(frame, F.col("vec_id") % 10 == 0, 5).collect()
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    got = {}
    for r in found:
        assert r["score"] == pytest.approx(cosine(own[r["query_id"]], own[r["vec_id"]]), abs=1e-12)
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hit = total = 0
    for q in own:
        if q % 10 == 0:
            best = sorted(((-round(cosine(own[q], own[c]), 12), c) for c in own if c != q))[:5]
            assert sorted(got[q]) == [1, 2, 3, 4, 5]
            hit += len({c for _, c in best} & set(got[q].values()))
            total += 5
    assert hit / total >= 0.9
    assert [got[240][k] for k in (1, 2, 3, 4, 5)] == [3, 241, 242, 243, 244]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((5, 64))
    turn = rotated_codes.rotation(64)
    bits, correction = rotated_codes.encode(x, turn)
    assert bits.shape == (3000, 8)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    near, error = rotated_codes.estimates(bits, correction, unit @ turn)
    true = unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert abs((near - true).mean()) < 0.005 and (np.abs(near - true) > error).mean() < 0.05


def test_few_or_no_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    vec = va_file.floored(F.col("embedding"), 1024)
    none = spark.createDataFrame([], shape)
    assert va_file.top_k(none, F.col("vec_id") % 2 == 0, 3, vec).count() == 0
    assert rotated_codes.nearest(none, F.col("vec_id") % 2 == 0, 3).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], shape)
    assert [tuple(r) for r in va_file.top_k(two, F.col("vec_id") == 0, 3, vec).collect()] == [(0, 1, 1, 4 * 1024 * 1024)]
    assert [r["vec_id"] for r in rotated_codes.nearest(two, F.col("vec_id") == 0, 3).collect()] == [1]


def pages():
    magic = warc.MAGIC
    rows = [
        (i, f"é<p>{i}</p>" * (i % 40) + (magic if i % 3 == 0 else "") + ("x" * 120 + magic * (i % 7) if i % 4 == 0 else ""))
        for i in range(60)
    ]
    inner = "y" * 150 + magic + magic + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + magic + "z" * 2500
    rows += [(100 + i, inner) for i in range(3)]
    rows += [(200, None), (201, ""), (202, "a" * 99), (203, "a" * 99), (None, "q" * 200), (204, "q" * 200), (205, magic)]
    return rows + [(206, "\r\n\r\n"), (300, "w" * 130), (300, "w" * 130)]


@pytest.mark.parametrize("split", ["900", "128m"])
def test_archives_come_back_whole(spark, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = pages()
        table = spark.createDataFrame([(i, h, 1, "v") for i, h in rows], "page_id long, html string, id int, value string")
        found = warc.round_trip(table.repartition(3)).collect()
        assert warc.round_trip(table.limit(0)).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    first = {}
    for i, h in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = []
    for i, h in rows:
        raw, back = (h or "").encode(), h in first and first[h] != i
        digest = hashlib.sha256(raw).hexdigest()
        want.append((i, len(raw), digest, "revisit" if back else "response", first[h] if back else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_payloads_are_kept_on_demand(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, "page_id long, html string"), path)
    found = warc.read_records(spark, path, keep_payload=True).where("type = 'response'").collect()
    texts = {str(i) if i is not None else "": (h or "").encode() for i, h in rows}
    assert all(bytes(r["payload"]) == texts[r["id"]] for r in found) and len(found) > 60
