"""Which spans have a partner: champions of cells against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import metrics as me
from vitalgrid.operators import partners

EPS = 2.220446049250313e-16


def frame(spark, a):
    rows = pd.DataFrame({"record": a[0], "class": "x", "start": a[1], "stop": a[2]})
    return spark.createDataFrame(rows)


def expected(a, b, m):
    """Spans of ``a`` with a partner in ``b``, over all pairs."""
    out = set()
    for r, s, e in zip(*a):
        here = b[0] == r
        inter = np.minimum(e, b[2][here]) - np.maximum(s, b[1][here])
        union = (e - s) + (b[2][here] - b[1][here]) - inter
        if e > s and np.any((inter > 0) & (inter / (union + EPS) >= m)):
            out.add((r, s, e))
    return out


def spans(rng, n, whole):
    start = rng.uniform(0, 60, n)
    length = np.exp(rng.uniform(np.log(0.5), np.log(60), n))
    if whole:  # many exact ties with the bound
        start, length = np.floor(start), np.ceil(length)
    return rng.integers(0, 2, n), start, start + length


def rows(df):
    return {tuple(r) for r in df.select("record", "start", "stop").collect()}


@pytest.mark.parametrize("m", [1 / 16, 0.3, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("whole", [False, True])
def test_champions_equal_pairs(spark, m, whole):
    rng = np.random.default_rng(7)
    a, b = spans(rng, 250, whole), spans(rng, 250, whole)
    ta, tb = frame(spark, a), frame(spark, b)
    # No share allowed: every bucket is crowded and cells are halved as far as they are open.
    hit_a, hit_b = partners.matched_spans(ta, tb, m, ["record", "class"], 10, pairs_per_span=0)
    assert rows(hit_a) == expected(a, b, m)
    assert rows(hit_b) == expected(b, a, m)


def test_crowded_beside_calm_buckets(spark):
    rng = np.random.default_rng(8)
    near, far = spans(rng, 300, False), spans(rng, 40, False)
    a = tuple(np.concatenate([x, y]) for x, y in zip(near, (far[0], far[1] + 500 * np.arange(40), far[2] + 500 * np.arange(40))))
    b = (a[0], a[1] + rng.uniform(-3, 3, 340), a[2] + rng.uniform(0, 3, 340))
    hit_a, hit_b = partners.matched_spans(frame(spark, a), frame(spark, b), 0.5, ["record", "class"], 100, pairs_per_span=8)
    assert rows(hit_a) == expected(a, b, 0.5)
    assert rows(hit_b) == expected(b, a, 0.5)


def test_empty_and_pointless_spans(spark):
    none = frame(spark, (np.array([0]), np.array([1.0]), np.array([1.0])))
    some = frame(spark, (np.array([0, 0]), np.array([0.0, 0.0]), np.array([2.0, 2.0])))
    for x, y in ((none, some), (some, none), (some.where("false"), some)):
        assert [h.count() for h in partners.matched_spans(x, y, 0.5, ["record", "class"], 10, pairs_per_span=0)] == [0, 0]
    assert [h.count() for h in partners.matched_spans(some, some, 0.5, ["record", "class"], 10, pairs_per_span=0)] == [1, 1]


def test_a_hundred_thousand_spans_in_one_bucket(spark):
    """All overlap: ten thousand million pairs. Lengths 20 against 44 and 9 never reach one half, those of 22 always do."""
    n = 100_000
    base = spark.range(n).select(F.lit(0).alias("record"), F.lit("x").alias("class"), (F.col("id") / n).alias("at"))
    of = lambda length: base.select("record", "class", (F.col("at") + 100).alias("start"), (F.col("at") + 100 + length).alias("stop"))
    targets = of(20)
    counts = lambda outputs: me.event_counts(targets, outputs, 0.5, bucket=3600).first()
    far = counts(of(44).unionByName(of(9)))
    assert (far.targets, far.outputs, far.hit_targets, far.hit_outputs) == (n, 2 * n, 0, 0)
    close = counts(of(22))
    assert (close.hit_targets, close.hit_outputs) == (n, n)
