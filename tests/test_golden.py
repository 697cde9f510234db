"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import seeded
from vitalgrid.model import layout
from vitalgrid.operators import features, intervals as iv, losses, metrics, normalize, resample, rolling, spectral, windows as wn

BIT = layout(value="value")


def bits(text):
    return [int(c) for c in text]


def shown(values):
    return "".join(str(int(v)) for v in values)


def test_runs(series):
    got = rolling.runs(series(a=bits("0000111100011")), "value", ["record"]).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(4, 8), (11, 13)]


@pytest.mark.parametrize("chunk", [2, 3, 5, 100])
def test_runs_across_chunks(series, chunk):
    got = rolling.runs(series(a=bits("1111110001111101")), "value", ["record"], chunk=chunk).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 6), (9, 14), (15, 16)]


@pytest.mark.parametrize("merge,keep,expected", [
    (1, 0, "0111110000010"), (2, 0, "0011110000000"), (0, 1, "1110000000000"),
])
@pytest.mark.parametrize("chunk", [4, 1000])
def test_morphology(series, ordered, merge, keep, expected, chunk):
    x = series(a=bits("1110010000011"))
    assert shown(ordered(rolling.close_then_open(x, merge, keep, BIT, chunk))) == expected


@pytest.mark.parametrize("chunk", [2, 1000])
def test_median_subtract(series, ordered, chunk):
    assert ordered(rolling.rolling_median_subtract(series(a=[5, 1, 4, 2, 9]), 1, 3, chunk=chunk)) == [1, -3, 2, -2, 5]


def test_median_subtract_short_record(series, ordered):
    assert ordered(rolling.rolling_median_subtract(series(a=[5, 1, 4]), 1, 9)) == [1, -3, 0]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_epoch_differences(series, ordered, chunk):
    x = series(a=[1, 4, 2, 8, 5, 7])
    prev = ordered(rolling.diff_prev(x, 60, 30, chunk=chunk), column="diff")
    nxt = ordered(rolling.diff_next(x, 60, 30, chunk=chunk), column="diff")
    assert prev == [0, 3, -0.5, 5, 0, 0.5]
    assert nxt == [2, 1, 4.5, -2, 2, 0]


def test_weighted_activity(series, ordered):
    got = ordered(rolling.weighted_activity(series(a=[1, 2, 3, 4, 5, 6]), 1, 1), column="activity", t="epoch")
    assert got == pytest.approx([0, 0, 4.44, 5.92, 0, 0])


def test_histogram_entropy(series):
    got = features.hist_entropy(series(a=[0, 1, 2, 3, 10]), "value", ["record"], 5).first().entropy
    assert got == pytest.approx(1.054920, abs=1e-6)


def test_pool_average(series, ordered):
    got = ordered(resample.pool1d(series(a=range(150)), 30, "avg"))
    assert got == [14.5, 44.5, 74.5, 104.5, 134.5]


@pytest.mark.parametrize("extent,window,overlap,starts", [
    (28_815, 3600, 0.25, [*range(0, 24_301, 2700), 25_200]),
    (7200, 3600, 0.5, [0, 1800, 3600, 3600]),
    (1000, 3600, 0.25, [0, 0]),
])
def test_window_index(spark, extent, window, overlap, starts):
    e = spark.createDataFrame([("a", extent)], "record string, extent bigint")
    got = wn.window_index(e, window, overlap).orderBy("win").collect()
    assert [r.start for r in got] == starts


@pytest.mark.parametrize("start,events,expected", [
    (0, [(0, 60), (100, 8), (125, 40), (170, 200)], "1100111111"),
    (0, [(-50, 60), (23, 44)], "1100000000"),
    (30, [(97, 43)], "0011000000"),
])
def test_window_labels(spark, start, events, expected):
    w = spark.createDataFrame([("a", 0, start)], "record string, win int, start bigint")
    # Event times are shifted so that none is negative.
    e = spark.createDataFrame([("a", "x", "event", s + 0, d) for s, d in events], "record string, label string, kind string, start bigint, duration bigint")
    got = wn.window_labels(w, e, ["x"], 300, 30).orderBy("cell").collect()
    assert shown(r.y_true for r in got) == expected


def test_window_masks(spark):
    w = spark.createDataFrame([("a", 0, 0)], "record string, win int, start bigint")
    e = spark.createDataFrame(
        [("a", "x", "event", 0, 90), ("a", "off", "mask", 60, 60)], "record string, label string, kind string, start bigint, duration bigint"
    )
    got = wn.window_labels(w, e, ["x", "y"], 150, 30)
    by = {(r["class"], r.cell): r.y_true for r in got.collect()}
    assert [by["x", c] for c in range(5)] == [1, 1, -1, -1, 0]
    assert [by["y", c] for c in range(5)] == [0, 0, -1, -1, 0]


def test_window_labels_many_words(spark):
    w = spark.createDataFrame([("a", 0, 0)], "record string, win int, start bigint")
    e = spark.createDataFrame([("a", "x", "event", 30, 30 * 70)], "record string, label string, kind string, start bigint, duration bigint")
    got = wn.window_labels(w, e, ["x"], 3000, 30).where("y_true = 1").orderBy("cell").collect()
    assert [r.cell for r in got] == list(range(1, 71))


def test_semantic_grid(spark):
    e = spark.createDataFrame([("a", 0.1, 0.2), ("a", 0.6, 0.8)], "record string, start double, stop double")
    got = iv.semantic_grid(e, e.select("record").distinct(), 10).orderBy("cell").collect()
    assert shown(r.y for r in got) == "0100001100"


def test_inverse_events(spark):
    e = spark.createDataFrame([("a", 2.0, 4.0), ("a", 7.0, 8.0)], "record string, start double, stop double")
    got = iv.inverse_events(e, 10).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 2), (5, 7), (9, 10)]


def _events(spark, rows, cls=None):
    d = [("a", i, float(s), float(e)) for i, (s, e) in enumerate(rows)]
    df = spark.createDataFrame(d, "record string, id long, start double, stop double")
    return df if cls is None else df.withColumn("class", F.lit(cls))


@pytest.mark.parametrize("bucket", [7, 1000])
def test_relative_start(spark, bucket):
    a, b = _events(spark, [(50, 65), (80, 100)]), _events(spark, [(0, 30), (30, 60), (60, 90)])
    got = {(r.a_id, r.b_id): r.relative_start for r in iv.relative_start(a, b, bucket=bucket).collect()}
    assert got == {(0, 1): -20, (0, 2): 10, (1, 2): -20}
    lone = iv.relative_start(_events(spark, [(500, 600)]), b).collect()
    assert [(r.b_id, r.relative_start) for r in lone] == [(None, 1e6)]


def test_iou_and_event_metrics(spark):
    t = _events(spark, [(0, 10), (20, 30), (40, 50)], "x")
    o = _events(spark, [(1, 10), (22, 40), (60, 70)], "x")
    got = {(r.a_id, r.b_id): r.iou for r in iv.interval_iou(t, o, bucket=5).collect()}
    assert got == pytest.approx({(0, 0): 0.9, (1, 1): 0.4})
    value = lambda n, a=t, b=o: metrics.event_metric(n, a, b).first().value
    assert (value("true_positives"), value("false_positives"), value("false_negatives")) == (1, 2, 2)
    assert [value(n) for n in ("precision", "recall", "f1")] == pytest.approx([1 / 3] * 3)
    none = o.where("false")
    assert [value(n, t, none) for n in ("precision", "recall", "f1")] == [1, 0, 0]
    assert [value(n, none, o) for n in ("precision", "recall", "f1")] == [0, 1, 0]


@pytest.fixture
def predictions(spark):
    rows = [("a", 0, "x", 1.0, 0.9), ("b", 0, "x", 0.0, 0.2), ("c", 0, "x", -1.0, 0.5), ("d", 0, "x", 1.0, 0.4), ("e", 0, "x", 0.0, 0.6)]
    return spark.createDataFrame(rows, "record string, epoch long, class string, y_true double, y_pred double")


def test_losses(predictions):
    assert losses.cross_entropy(predictions).first().value == pytest.approx(0.432217, abs=1e-6)
    assert losses.focal(predictions).first().value == pytest.approx(0.133942, abs=1e-6)
    assert losses.ohem_cross_entropy(predictions, 1.0, 2, []).first().value == pytest.approx(0.610861, abs=1e-6)
    assert losses.dice(predictions).first().value == pytest.approx(0.841463, abs=1e-6)


def test_threshold_is_strict(spark):
    p = spark.createDataFrame([("a", "x", 1.0, 0.5)], "record string, class string, y_true double, y_pred double")
    r = metrics.confusion_counts(p).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (0, 0, 0, 1)


def test_psd_frames(series):
    got = spectral.psd(series(a=range(1000)), 32, 320, 256, 512, 0, 6, 3)
    assert got.count() == 16
    assert len(got.first().x) == 32
    assert len(spectral.psd(series(a=range(1000)), 32, 320, 256, 512, 0.1, 2.1, 1).first().x) == 32


def test_hash_uniform(spark):
    got = spark.range(1).select(seeded.uniform(42, 7).alias("u")).first().u
    assert got == 0.46435326454229653


def test_t_quantile():
    # Tabulated two-sided 95 % quantiles.
    for dof, q in ((1, 12.706205), (2, 4.302653), (10, 2.228139), (30, 2.042272), (1000, 1.962339)):
        assert features.t_quantile(0.95, dof) == pytest.approx(q, abs=1e-5)


def test_constant_channel_is_kept(series, ordered):
    assert ordered(normalize.zscore_axis(series(a=[3, 3, 3]))) == [3, 3, 3]
    assert ordered(normalize.soft(series(a=[3, 3, 3]), 5, 95)) == [0, 0, 0]
    assert ordered(normalize.min_max(series(a=[3, 3, 3]))) == [None, None, None]


def test_empty_rr_epoch_is_zero(series):
    from vitalgrid.operators import hrv

    got = hrv.hrv_features(series(a=[0.0] * 10), 1, 10, 0, entropy=True).first().asDict()
    assert all(v == 0 for k, v in got.items() if k not in ("record", "channel", "epoch"))


def test_stage_order(spark):
    rows = [("a", 0, c, y) for c, y in (("wake", 0.1), ("light", 0.5), ("deep", 0.5), ("rem", 0.2))]
    df = spark.createDataFrame(rows, "record string, epoch long, class string, y double")
    assert wn.stage_order(df).first().stage == 0
    assert wn.stage_order(df.withColumn("m", F.lit(True)), mask="m").first().stage == -1


def test_pairs_of_declared_items(spark):
    df = spark.range(5).selectExpr("cast(id as string) item").union(spark.range(3).selectExpr("cast(id as string)"))
    assert iv.pairs(df, "item", list("01234")).count() == 10
    assert [tuple(r) for r in iv.pairs(df, "item", ["3", "9", "1"]).collect()] == [("1", "3")]


def test_assert_finite(series):
    from vitalgrid.sources.tables import assert_finite

    with pytest.raises(Exception, match="non-finite"):
        assert_finite(series(a=[1.0, math.inf]), "value").collect()
