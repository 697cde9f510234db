"""Cases of the third round's findings."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vitalgrid.functions import rows, seeded
from vitalgrid.operators import intervals as iv
from vitalgrid.operators import features, metrics, windows as wn
from vitalgrid.plans import spec


def test_logarithms_at_and_below_their_pole(spark):
    x = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, -2.0), (3, 1.0), (4, None), (5, math.nan)], "i int, x double")
    got = {r.i: (r.a, r.b) for r in x.select("i", rows.log(F.col("x")).alias("a"), rows.log_plus_one(F.col("x")).alias("b")).collect()}
    assert got[0] == (-math.inf, 0.0) and math.isnan(got[1][0]) and got[1][1] == -math.inf
    assert math.isnan(got[2][0]) and math.isnan(got[2][1]) and got[3] == (0.0, math.log(2)) and got[4] == (None, None)
    assert math.isnan(got[5][0]) and math.isnan(got[5][1])


def test_samples_of_value_zero_are_told_from_padding(series, spark):
    win = wn.window_index(spark.createDataFrame([("a", 3)], "record string, extent bigint"), 5, 0.5)
    got = wn.window_samples(series(a=[0, 2, 0]), win, 5, 1, sampled="s").where("win = 0").orderBy("pos").collect()
    assert [(r.value, r.s) for r in got] == [(0.0, True), (2.0, True), (0.0, True), (0.0, False), (0.0, False)]


def test_free_starts_follow_the_rounding_of_each_window(spark):
    # Events of exactly the least share of a cell: whether they set one depends on the start that is subtracted.
    events = spark.range(60).selectExpr(
        "id % 3 AS record", "'x' AS label", "'event' AS kind", "id * 40013 + 17 AS start", "bigint(150) AS duration"
    )
    tops = spark.createDataFrame([(r, 2_505_600) for r in range(3)], "record long, max_index long")
    every = tops.select("record", F.explode(F.sequence(F.lit(0), F.col("max_index") - 1, F.lit(600))).alias("start"))
    hit = wn.window_hits(every.withColumn("win", F.col("start")), events, 86_400, 600, 0.25)
    taken = {(r.record, r.win) for r in hit.select("record", "win").distinct().collect()}
    runs = wn.free_starts(tops, events, 86_400, 600, 0.25).collect()
    free = {(r.record, 600 * (r._from + k)) for r in runs for k in range(r._n)}
    assert taken and free == {(r.record, r.start) for r in every.collect()} - taken


def _grid(spark):
    """Windows of two records over several slabs, crowded and empty; events across slabs, masks over some."""
    extents = spark.createDataFrame([("a", 4_000), ("b", 90), ("c", 1_300)], "record string, extent bigint").distinct()
    windows = wn.window_index(extents, 120, 0.25)
    events = spark.range(150).selectExpr(
        "element_at(array('a', 'a', 'c', 'd'), int(id % 4) + 1) AS record", "element_at(array('x', 'y', 'z'), int(id % 3) + 1) AS label",
        "if(id % 7 = 0, 'mask', 'event') AS kind", "id * 97 % 4100 - 20 AS start", "if(id % 50 = 0, 1100, id * 13 % 90) AS duration",
    )
    return windows, events


def test_windows_unfold_in_as_many_tasks_as_a_shuffle_has(spark):
    windows, _ = _grid(spark)
    assert windows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_meet_events_behind_one_shuffle(spark):
    windows, events = _grid(spark)
    words = wn.label_words(windows, events, ["x", "y"], 120, 2, 0.25)
    counts = wn.label_counts(words, ["record", "slab", "win", "win_start", "class"])
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # Extents, their spread, windows, events.
    assert plan.count("Exchange hashpartitioning") <= 4
    hits = wn.window_hits(windows, events, 120, 2, 0.25)
    cells = hits.select("record", "win", "label", "kind", F.explode(F.sequence("first", F.col("last") - 1)).alias("cell")).distinct().collect()
    masked = {(r.record, r.win, r.cell) for r in cells if r.kind == "mask"}
    ones = {(r.record, r.win, r.label, r.cell) for r in cells if r.kind == "event" and (r.record, r.win, r.cell) not in masked}
    want = {}
    for w in windows.collect():
        off = [c for r, i, c in masked if (r, i) == (w.record, w.win)]
        for k in ("x", "y"):
            on = [c for r, i, n, c in ones if (r, i, n) == (w.record, w.win, k)]
            want[w.record, w.win, k] = (len(on), 60 - len(on) - len(off), len(off), sum(on) - sum(off))
    got = {(r.record, r.win, r["class"]): (r.ones, r.zeros, r.masked, r.place) for r in counts.collect()}
    assert got == want and any(v[0] and v[2] for v in want.values())


def test_overlaps_and_any_event_against_every_pair(spark):
    windows, events = _grid(spark)
    e = [r for r in events.collect() if r.duration > 10]
    w = windows.collect()
    meets = lambda a, b: a.record == b.record and b.start < a.start + 120 and b.start + b.duration > a.start
    want = sorted((a.record, a.win, b.start, b.start + b.duration) for a in w for b in e if meets(a, b))
    got = wn.window_overlaps(windows, events, 120).select("record", "win", "_s", "_e").collect()
    assert sorted(map(tuple, got)) == want
    any_ = {(r.record, r.win): r.y for r in wn.any_event(windows, events, 120).collect()}
    assert any_ == {(a.record, a.win): int(any(meets(a, b) and b.kind == "event" for b in e)) for a in w}


def test_stitched_classes_equal_the_stitched_series(spark):
    windows, events = _grid(spark)
    classes = ["x", "y", "z"]
    score = lambda c: seeded.uniform("s", F.col("record"), F.col("win"), c, F.col("cell"))
    got = spec.stitched_classes(windows, events, classes, 120, 2, score, 0.25)
    labels = wn.window_labels(windows, events, classes, 120, 2, 0.25)
    series = spec.epoch_series(labels.withColumn("y_pred", score(F.col("class"))), labels, 2)
    want = metrics.one_hot_labels(series, classes)
    rows_ = lambda df: sorted(map(tuple, df.select("record", "epoch", "true_class", "pred_class").collect()))
    assert rows_(got) == rows_(want) and len(rows_(got)) > 50
    with pytest.raises(ValueError, match="incomplete"):
        spec.stitched_classes(windows.where("record = 'a' AND win <> 5 AND win <> 6"), events, classes, 120, 2, score, 0.25).count()


def test_spans_stitch_as_their_cells(spark, monkeypatch):
    windows, events = _grid(spark)
    hits = wn.window_hits(windows, events, 120, 2, 0.25).withColumnRenamed("label", "class")
    cells = hits.withColumn("y", F.explode(F.sequence("first", F.col("last") - 1))).withColumn("epoch", F.floor(F.col("win_start") / 2) + F.col("y"))
    monkeypatch.setattr(iv, "SLICE", 16)
    rows_ = lambda df: sorted(map(tuple, df.select("record", "class", "epoch", "y").collect()))
    got = iv.stitch_spans(hits, 2, lambda c: c)
    assert rows_(got) == rows_(iv.stitch_windows(cells, win="win", values=["y"]))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_epoch_statistics_unfold_in_as_many_tasks_as_a_shuffle_has(spark):
    df = spark.range(50).selectExpr("id % 2 AS record", "id * 700000 AS us", "double(id * 7 % 11) AS v")
    out = features.epoch_stats_of(df, ["v"], interval=10, diff_seconds=[10])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_features_of_a_dataset_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i)

    feats = spark.range(60).select(
        F.lit("a").alias("record"), F.lit("s").alias("signal"), F.col("id").alias("t"), F.lit(0).alias("feature"),
        value.asNondeterministic()("id").alias("value"),
    )
    data = spec.WindowedDataset(feats, None, ["x"], 30, 1.0, 30, 0.5)
    assert data.signals().where("value > 0").count() > 60 and seen.value == 60


def _crossings(spark, folder, values):
    """ud4_user_feature and its SQL over events with these values in time order; on one thread the SQL sums in time order too."""
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    rows = ", ".join(f"({i}, {'NULL' if v is None else v})" for i, v in enumerate(values))
    duck.execute(
        "CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 7 AS user_id, "
        f"'view' AS event_type, CAST(v AS DOUBLE) AS value, '{{}}' AS props FROM (VALUES {rows}) t(i, v)"
    )
    duck.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    want = duck.execute(entry.oracle_sql()["ud4_user_feature"]).fetchall()
    got = entry.queries()["ud4_user_feature"](spark, str(folder)).collect()
    return sorted(tuple(r) for r in got), sorted(want)


def test_a_sample_at_the_mean_is_on_the_side_that_sql_sees(spark, tmp_path):
    draw = random.Random(20)
    got, want = _crossings(spark, tmp_path, [draw.randint(1, 39) / 100 for _ in range(6_000)])
    assert len(want) == 100 and got == want


def test_missing_samples_cross_no_mean(spark, tmp_path):
    draw = random.Random(6)
    values = [None if i % 60 in (0, 17, 18) else draw.randint(1, 500) / 100 for i in range(300)] + [None] * 60
    values += [4.0 if i % 2 else None for i in range(60)]
    got, want = _crossings(spark, tmp_path, values)
    assert len(want) == 5 and got == want
