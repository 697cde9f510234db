"""Positions, running maxima and previous values where one bucket holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import chunks, intervals as iv, windows as wn
from vitalgrid.session import stage


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "record": np.where(rng.random(n) < 0.9, "hot", "cold"), "at": np.where(rng.random(n) < 0.95, rng.uniform(0, 10, n), rng.uniform(0, 400, n)),
        "id": np.arange(n), "x": rng.normal(size=n),
    })
    return spark.createDataFrame(pdf), pdf.sort_values(["record", "at", "id"], ignore_index=True)


def got(df):
    return df.toPandas().sort_values(["record", "at", "id"], ignore_index=True)


def test_two_levels_split_a_crowded_bucket(monkeypatch, rows):
    df, pdf = rows
    monkeypatch.setattr(chunks, "CROWDED", 100)
    args = ["record"], chunks.floor_div(F.col("at"), 60), ["at", "id"]
    parts, heads = chunks._two_levels(df, *args)
    # 2,600 rows of one record and minute, in parts of which none holds more than a small share.
    assert heads.agg(F.max("_n")).first()[0] < 300
    assert parts.select("_range").distinct().count() > 20
    by = pdf.groupby("record")
    assert got(chunks.ordinal(df, *args, "t"))["t"].tolist() == by.cumcount().tolist()
    want = by["x"].transform(lambda v: v.cummax().shift())
    np.testing.assert_array_equal(got(chunks.running_max(df, *args, "x", "m"))["m"].to_numpy(), want.to_numpy())
    np.testing.assert_array_equal(got(chunks.previous(df, *args, "x", "p"))["p"].to_numpy(), by["x"].shift().to_numpy())


def test_filters_suppression_and_batches_over_crowded_buckets(monkeypatch, spark):
    rng = np.random.default_rng(4)
    n = 600
    start, length = rng.integers(0, 3000, n), rng.integers(1, 40, n)
    events = stage(spark.createDataFrame(pd.DataFrame({
        "record": "a", "class": "x", "id": np.arange(n), "start": start.astype(float), "stop": (start + length).astype(float), "score": rng.random(n),
    })))
    others = stage(spark.createDataFrame(pd.DataFrame({
        "record": "a", "label": rng.choice(["p", "q"], n), "start": rng.integers(0, 3000, n), "duration": rng.integers(1, 20, n),
    })))
    wins = stage(spark.createDataFrame(pd.DataFrame({"record": "a", "win": np.arange(n)})))

    def results():
        return [
            sorted(r.id for r in iv.discard_overlap(events, others, 12.0).collect()),
            sorted(r.id for r in iv.select_overlap(events, others, 5.0).collect()),
            sorted(r.id for r in iv.nms(events, 0.3).collect()),
            sorted((r.win, r.batch_id, r.slot) for r in wn.batch(wins, 16).collect()),
        ]

    simple = results()
    monkeypatch.setattr(chunks, "CROWDED", 20)
    assert results() == simple
    assert all(simple) and len(simple[0]) < n and len(simple[1]) < n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "record string, at double, id long, x double")
    args = ["record"], chunks.floor_div(F.col("at"), 60), ["at", "id"]
    assert chunks.ordinal(none, *args).count() == 0
    assert chunks.running_max(none, *args, "x", "m").count() == 0
