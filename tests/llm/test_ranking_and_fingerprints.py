"""Ranked search, importance resampling and edit-embedding fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import edit_embedding as ee
from vitalgrid.llm import lexical, queries, resampling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    words = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in words if w]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, documents, prose, small, monkeypatch):
    if small:  # many shards and blocks, several blocks of queries, several seeds
        for name, value in {"SHARD_ROWS": 9, "SHARD_CELLS": 900, "BLOCK": 2, "QUERY_TERMS": 5, "SEED": 2}.items():
            monkeypatch.setattr(lexical, name, value)
    rng = random.Random(1)
    items = [(k, prose[rng.randrange(60)][1][: rng.randint(5, 200)] + " Alpha alpha é") for k in range(12)]
    items += [(12, None), (13, ""), (14, "nothing-like-it zzz"), (15, "ONE"), (16, prose[106][1]), (17, "é" * 300)]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = lexical.search(documents, table, 10).collect()
    assert sorted(map(tuple, got), key=str) == ranked([(i, t) for i, t in prose], items, 10)


def test_search_of_one_hot_text(spark):
    docs = spark.createDataFrame([(k, "same words here" if k % 3 else f"other {k} words") for k in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "other")], "item_id long, text string")
    got = sorted(map(tuple, lexical.search(docs, items, 5).collect()))
    assert [(q, r, d) for q, r, d, _ in got if q == 1] == [(1, r, d) for r, d in enumerate((1, 2, 4, 5, 7), 1)]
    assert [d for q, _, d, _ in got if q == 2] == [0, 3, 6, 9, 12]


@pytest.mark.parametrize("empty", ["documents", "items", "both"])
def test_search_of_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty != "items" else [(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([] if empty != "documents" else [(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items, 5).collect() == []


def resampled(docs, target, percent, buckets, longest, least, seed):
    def runs(text):
        w = terms(text)
        return w, [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *runs(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, w, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(fit) // 100
    out = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(fit, 1)] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(out, key=str)


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (2, 100, 0), (3, 37, 5)])
def test_resampling_ranks_are_exact(spark, documents, prose, longest, percent, least):
    target = ["alpha beta gamma", None, "", "rho sigma\ttau Rho", prose[5][1]]
    table = spark.createDataFrame([(t, 3) for t in target], "text string, rank int")
    got = resampling.resample(documents, table, percent, 50, longest, least, "2024:").collect()
    assert sorted(map(tuple, got), key=str) == resampled([(i, t) for i, t in prose], target, percent, 50, longest, least, "2024:")


def test_regular_sampling_splits_ties(spark):
    """Equal scores and repeated rows go to several segments and still get gapless ranks in the order of their ids."""
    rows = [(k // 3, 5, 1, 7 if k < 900 else k % 11) for k in range(1200)]
    frame = spark.createDataFrame(rows, "id long, n_features long, weight long, score long").repartition(7)
    got = sorted((r["rank"], -r["score"], r["id"]) for r in resampling.ranked(frame, len(rows)).collect())
    assert [g[0] for g in got] == list(range(1, 1201)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert [(-s, i) for _, s, i in got] == [(s, i) for i, _, _, s in sorted(rows, key=lambda r: (-r[3], r[0]))]


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(docs, docs, 10).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20), (None, None)], "doc_id long, text string")
    got = {r["id"]: r for r in resampling.resample(some, docs, 100).collect()}
    assert got[1]["rank"] == 1 and got[None]["rank"] is None and got[None]["weight"] == 0


def edited(prose):
    order = sorted(((i, t or "") for i, t in prose), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return order, [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)]


@pytest.mark.parametrize("characters", [ee.CHARACTERS, 500])
def test_fingerprints_of_texts_and_edited_texts(spark, documents, prose, characters, monkeypatch):
    monkeypatch.setattr(ee, "CHARACTERS", characters)
    order, changed = edited(prose)
    prints = [str(f) for f in ee.fingerprints([t for _, t in order])[0]]
    later = [str(f) for f in ee.fingerprints(changed)[0]]
    got = ee.fingerprinted(documents).collect()
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f, g) for (i, t), e, f, g in zip(order, changed, prints, later, strict=True))
    assert sorted((str(r["id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 500 and r["id"] not in (105, 108)]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 > 0.3 > np.mean([r["near_next"] for r in long if r["id"] != 107])


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijklmnop") for _ in range(3000))

    def near(edits):
        t = list(text)
        for _ in range(edits):
            k = rng.randrange(len(t))
            t[k : k + rng.choice((0, 1))] = rng.choice(("", "z", "y"))
        a, b = ee.fingerprints([text, "".join(t)])[0]
        return a.likeness(b)

    few, some, many = (np.mean([near(n) for _ in range(6)]) for n in (3, 60, 1500))
    assert few > 0.85 and few > some > many
    a, b, c = ee.fingerprints(["", "x", ""])[0]
    assert a.likeness(c) == 1 and a.likeness(b) == 0 and str(a) == str(c)


def test_edit_distance_within_a_bound():
    rng = random.Random(9)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(("", "a", "cc"))
        d, most = plain(a, "".join(b)), rng.randint(0, 7)
        assert ee.distance(a, "".join(b), most) == (d if d <= most else None)


def test_near_copies_are_verified(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(150)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(40):  # copies of the first text, a few edits each
        t = list(base[0])
        for _ in range(k % 5):
            t[rng.randrange(len(t))] = "Z"
        rows.append((100 + k, "".join(t)))
    rows += [(7, None), (8, ""), (None, base[3]), (9, base[4] + " more words than the bound allows for this copy of the text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = {r["id"]: r["copy_of"] for r in ee.near_copies(ee.fingerprinted(docs), docs, 10).collect()}
    assert all(got[100 + k] == 0 for k in range(40)) and got[9] == 9
    assert [got[k] for k in (0, 1, 2, 4, 5)] == [0, 1, 2, 4, 5] and got[7] == 7 and got[8] == 8


def test_fingerprints_of_one_row_and_of_none(spark):
    one = ee.fingerprinted(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [(r["id"], r["n_chars"], r["near_next"]) for r in one] == [(5, 6, 1.0)]
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert ee.fingerprinted(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_registered_fingerprints(spark):
    found = queries.QUERIES["op13_edit_embedding"](spark, "/root/testdata/sf0.001").collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    order, changed = edited(docs)
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(order, changed, strict=True)}
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == want
    assert spark.createDataFrame(found).where(F.col("near_edited") < F.col("near_next")).count() < len(found) // 20
