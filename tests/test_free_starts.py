"""Free window starts by interval subtraction against the label grid of every start."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import windows as wn

WINDOW, RESOLUTION = 240, 30


@pytest.mark.parametrize("so", [None, 0.0, 0.1, 0.5])
def test_free_starts_equal_the_grid_of_every_start(spark, so):
    rng = np.random.default_rng(5)
    n = 60
    events = spark.createDataFrame(pd.DataFrame({
        "record": rng.choice(["a", "b", "c"], n), "label": "x", "kind": "event",
        "start": np.round(rng.uniform(0, 14_000, n) * 2) / 2, "duration": rng.choice([5.0, 11.0, 15.0, 30.0, 37.5, 90.0, 500.0], n),
    }))
    # c ends before most of its events, d has none, e has no start at all.
    tops = spark.createDataFrame([("a", 12_001), ("b", 12_000), ("c", 3_000), ("d", 61), ("e", 0)], "record string, max_index long")
    every = tops.where("max_index > 0").select(
        "record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_index") - 1, F.lit(RESOLUTION).cast("long"))).alias("start")
    ).withColumn("win", F.col("start"))
    hit = wn.window_hits(every, events, WINDOW, RESOLUTION, so)
    want = {tuple(r) for r in every.join(hit, ["record", "win"], "left_anti").select("record", "start").collect()}
    runs = wn.free_starts(tops, events, WINDOW, RESOLUTION, so).collect()
    got = [(r.record, RESOLUTION * (r._from + k)) for r in runs for k in range(r._n)]
    assert len(got) == len(set(got)) and set(got) == want
    drawn = wn.background_sample(tops, events, 400, WINDOW, RESOLUTION, 3, so).collect()
    assert len(drawn) == 400 and {(r.record, r.start) for r in drawn} <= want
    none = wn.background_sample(tops.where("record = 'e'"), events, 10, WINDOW, RESOLUTION, 3, so)
    assert none.columns == ["draw", "record", "start"] and none.count() == 0
