"""Specifications, sources, sinks and streams end to end."""

import json

import pytest
from pyspark.sql import functions as F

from vitalgrid.plans import registry, spec
from vitalgrid.sources import tables
from vitalgrid.streaming import epochs as st

SF = "/root/testdata/sf0.001"


def test_unknown_step_is_refused():
    with pytest.raises(KeyError, match="nope"):
        spec.parse_spec({"a": {"h5_path": "acc", "channel_idx": [0], "preprocessing": [{"type": "nope"}]}})


def test_signals_must_agree():
    one = {"h5_path": "acc", "channel_idx": [0], "fs_post": 0.5}
    with pytest.raises(ValueError, match="fs_post"):
        spec.parse_spec({"a": one, "b": one | {"fs_post": 1.0}})


def test_rate_is_checked(series):
    s = {"a": {"h5_path": "acc", "channel_idx": [0], "fs_post": 2.0, "preprocessing": []}}
    with pytest.raises(ValueError, match="specification says"):
        spec.run_spec(series(a=[1, 2]).withColumn("signal", F.lit("acc")), s, 1.0)


def test_channels_add_or_flatten(spark):
    rows = [("r", "acc", c, t, float(10 * c + t)) for c in range(2) for t in range(3)]
    df = spark.createDataFrame(rows, "record string, signal string, channel int, t long, value double")
    base = {"h5_path": "acc", "channel_idx": [0, 1]}
    added = spec.run_spec(df, {"s": base | {"add": True}}, 1.0).orderBy("t").collect()
    assert [r.value for r in added] == [10, 12, 14]
    flat = spec.run_spec(df, {"s": base}, 1.0).where("t = 1").orderBy("feature").collect()
    assert [(r.feature, r.value) for r in flat] == [(0, 1), (1, 11)]


ARGS = {
    "zscore_log": {"min_value": 0.1, "max_value": 5}, "soft": {"perc_low": 5, "perc_high": 95}, "median": {"window_size": 1},
    "adaptive_soft": {"median_window": 1, "std_window": 1}, "median_filter": {"window_size": 1}, "clip": {"lower": 0, "upper": 1},
    "divide": {"val": 2}, "butter_bandpass_filter": {"lowcut": 1, "highcut": 8, "order": 2}, "butter_highpass_filter": {"highcut": 4, "order": 2},
    "iqr_normalization_adaptive": {"median_window": 1, "iqr_window": 1}, "downsample": {"fs_out": 16}, "absum": {"fs_out": 16},
    "absum2": {"fs_out": 16}, "rolling_autocorr": {"window": 1},
    "cal_psd": {"window": 64, "noverlap": 48, "nfft": 64, "f_min": 0, "f_max": 6},
    "cal_autocorrelation_psd": {"window": 64, "noverlap": 48, "nfft": 64, "f_min": 0, "f_max": 6},
    "logfbank": {"window": 64, "noverlap": 48, "nfft": 64, "numcep": 4, "f_min": 0, "f_max": 6},
    "mfcc": {"window": 64, "noverlap": 48, "nfft": 64, "numcep": 4, "f_min": 0, "f_max": 6},
    "cal_superlet": {"nfft": 4, "f_min": 2, "f_max": 6, "f_sub": 32}, "collect_signal_features": {"window": 2, "window_ext": [0, 1]},
    "acc_manual_feature": {"window": 1}, "FM_features": {"window": 2}, "ACC_features": {"window": 2},
    "collect_aura_features": {"window": 4, "window_ext": [0, 2]}, "collect_hrv_features": {"window": 4, "window_ext": [0]},
    "prep_data_and_compute_features": {"time_interval": 30}, "prep_data_and_compute_surrogate_signals": {}, "pca_feature_reduction": {},
}


@pytest.fixture(scope="module")
def axes(spark):
    return spark.range(3 * 400).selectExpr(
        "'r' as record", "cast(id % 3 as int) as channel", "id div 3 as t", "1 + abs(sin(id * 1.7)) as value"
    ).cache()


@pytest.mark.parametrize("name", sorted(registry.PREPROCESSING))
def test_every_step_runs(axes, name):
    df, fs = registry.PREPROCESSING[name](axes, 32.0, **ARGS.get(name, {}))
    assert fs > 0
    assert df.count() > 0
    assert {"record", "channel"} <= set(df.columns)


def test_registries_are_complete():
    assert len(registry.LOSSES) == 17 and len(registry.METRICS) == 20 and len(registry.AUGMENTATIONS) == 11
    assert set(registry.NORMALIZERS) <= set(registry.PREPROCESSING)


def test_annotation_files(spark, tmp_path):
    for name, rows in (("a", [(0, 30, "wake"), (30, 90, "rem")]), ("b", [(5, 10, "deep")])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"start": s, "end": e, "label": lab} for s, e, lab in rows]))
    got = tables.read_annotations_json(spark, str(tmp_path)).orderBy("file", "start").collect()
    assert [(r.file, r.label, r.start, r.duration) for r in got] == [
        ("a.json", "wake", 0, 30), ("a.json", "rem", 30, 60), ("b.json", "deep", 5, 5)
    ]


def test_broken_intervals_fail(spark):
    df = spark.createDataFrame([(1.5, None)], "start double, duration double")
    with pytest.raises(Exception, match="pair up"):
        tables.read_intervals(df).collect()


def test_cache_is_used_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cache_preprocessed(spark, str(tmp_path), {"a": 1}, compute, "v1").count() == 3
    assert len(calls) == 1
    # Another input under the same specification is computed anew.
    longer = tables.cache_preprocessed(spark, str(tmp_path), {"a": 1}, lambda: spark.range(9), ["part-1", "part-2"])
    assert longer.count() == 9 and len(calls) == 1


def test_filters_reach_the_scan(spark, series, tmp_path):
    path = str(tmp_path / "samples")
    tables.write_samples(series(a=range(10), b=range(10)).withColumn("signal", F.lit("acc")), path)
    df = tables.open_samples(spark, path, signals=["acc"], channels=[0], records=["a"])
    plan = df.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(signal" in plan or "PartitionFilters: [signal" in plan
    assert "EqualTo(record,a)" in plan and "EqualTo(channel,0)" in plan
    assert df.count() == 10


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(1000).selectExpr(
        "'r' as record", "timestamp_micros(id * 7000000) as ts", "cast(id % 13 as double) as value"
    ).write.parquet(str(folder))
    source = spark.read.parquet(str(folder))
    stream = spark.readStream.schema(source.schema).parquet(str(folder))
    st.run_available(st.stream_epoch_stats(stream, delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {r.start: (r.mean, r.std, r.range) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = source.groupBy(F.window("ts", "30 seconds").start.alias("start")).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), (F.max("value") - F.min("value")).alias("r")
    )
    want = {r.start: (r.m, r.s, r.r) for r in batch.collect()}
    assert len(got) > 200 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_windowed_dataset(spark):
    from vitalgrid.plans.catalog.plans import STUDY

    samples = spark.range(32 * 300).selectExpr("'r' as record", "'acc' as signal", "0 as channel", "id as t", "sin(id / 5.0) + id % 7 as value")
    feats = spec.run_spec(samples, STUDY, 32.0)
    events = spark.createDataFrame([("r", "x", "event", 30, 60), ("r", "off", "mask", 200, 40)], "record string, label string, kind string, start long, duration long")
    data = spec.WindowedDataset(feats, events, ["x"], 120, 0.5, 30, 0.5, spec=STUDY)
    win = data.windows()
    assert [r.start for r in win.orderBy("win").collect()] == [0, 60, 120, 180, 180]
    cells = data.signals(win)
    assert cells.count() == 5 * 2 * 60 * 32
    again = data.signals(win, train_seed=1)
    assert again.count() == cells.count()
    labels = {(r.win, r.cell): r.y_true for r in data.labels(win).collect()}
    assert [labels[0, c] for c in range(4)] == [0, 1, 1, 0]
    assert [labels[3, c] for c in range(4)] == [-1, -1, 0, 0]
    assert data.batches(2).count() == 4
