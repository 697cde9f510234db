"""The pipeline stage by stage against brute force, and every registered query against its SQL or its own rules."""

from __future__ import annotations

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vitalgrid.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not installed")


@pytest.fixture(scope="module")
def stages(spark):
    from vitalgrid.session import stage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL))
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_their_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"
    ]
    for found in stages[1:-1]:
        assert found.schema == stages[0].schema


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before = {r["doc_id"] for r in stages[0].collect()}
    after = {r["doc_id"] for r in stages[1].collect()}
    clean = [i for i in before if labels.get(i) == 0]
    assert after <= before and np.mean([i in after for i in clean]) > 0.97


def test_lines_are_first_occurrences(stages):
    seen, kept = set(), {r["doc_id"]: r["text"].split("\n") for r in stages[2].collect()}
    for r in sorted(stages[1].collect(), key=lambda r: r["doc_id"]):
        for line in kept[r["doc_id"]]:
            if len(line) >= 20:
                assert line not in seen
                seen.add(line)
        assert set(kept[r["doc_id"]]) <= {*r["text"].split("\n"), ""}


def test_one_of_each_near_class(stages):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    rows = {r["doc_id"]: shingles(r["text"]) for r in stages[2].collect()}
    ids, up = sorted(rows), {i: i for i in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i in ids if top(i) == i}


def test_passages_go(stages):
    length = corpus_pipeline.PASSAGE
    texts = {r["doc_id"]: r["text"].encode() for r in stages[3].collect()}
    count = {}
    for raw in texts.values():
        for k in range(len(raw) - length + 1):
            count[raw[k : k + length]] = count.get(raw[k : k + length], 0) + 1
    for r in stages[4].collect():
        raw = texts[r["doc_id"]]
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        least = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        assert least.decode(errors="ignore").replace("�", "") <= r["text"] or len(r["text"].encode()) >= len(least)
        assert len(r["text"].encode()) - len(least) <= 4 * (sum(gone) > 0) * (1 + len(re.findall(b"\1+", bytes(gone))))
        assert r["n_chars"] == len(r["text"])


def test_packing_holds_every_document(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]]))
        assert sum(n for _, n in own) <= corpus_pipeline.SEQUENCE


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in found.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline"}))
def test_queries_return_a_row_for_every_document(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    if "doc_id" in found.columns:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id")
        assert found.select("doc_id").distinct().count() == docs.distinct().count()
    else:
        assert found.count() == 50
