"""The paths taken for large groups give the results of the simple ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid import session
from vitalgrid.model import layout
from vitalgrid.operators import (
    augment, chunks, features, intervals as iv, losses, normalize, quantiles, resample, rolling, spectral, windows as wn,
)
from vitalgrid.plans import registry, spec


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(1)
    return np.round(np.cumsum(rng.normal(size=997)), 2), np.round(rng.exponential(3, size=400), 2)


@pytest.fixture
def samples(series, walk):
    return series(a=walk[0], b=walk[1])


def table(df, keys=("record", "t")):
    return df.toPandas().sort_values(list(keys), ignore_index=True)


def test_narrowed_quantiles(samples, walk):
    probs = [0.0, 0.1, 0.25, 0.5, 0.731, 0.9, 1.0]
    for small, bins in ((5, 4), (1, 16), (50, 8)):
        got = quantiles.group_quantiles(samples, ["record"], "value", probs, small_group=small, bins=bins)
        rows = {r.record: list(r)[1:] for r in got.collect()}
        for name, x in zip("ab", walk):
            assert rows[name] == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)


def test_narrowed_quantiles_heavy_ties(series):
    x = [1.0] * 500 + [2.0] * 3 + [1e9]
    got = quantiles.group_quantiles(series(a=x), ["record"], "value", [0.5, 0.995, 0.999], small_group=2, bins=4).first()
    assert list(got)[1:] == pytest.approx(list(np.quantile(x, [0.5, 0.995, 0.999])))


def test_salted_lookup(samples, monkeypatch):
    plain = table(normalize.zscore(samples))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    pd.testing.assert_frame_equal(plain, table(normalize.zscore(samples))[plain.columns])


ROLLING = {
    "median": lambda d, c: rolling.rolling_median_subtract(d, 1, 30, chunk=c),
    "median_filter": lambda d, c: rolling.median_filter(d, 1, 30, chunk=c),
    "iqr": lambda d, c: rolling.iqr_normalization_adaptive(d, 1, 30, chunk=c),
    "soft": lambda d, c: rolling.adaptive_soft(d, 1, 30, 20, chunk=c),
    "diff": lambda d, c: rolling.diff(d, chunk=c),
    "autocorr": lambda d, c: rolling.rolling_autocorr(d, 1, 20, chunk=c),
    "max": lambda d, c: rolling.max_filter(d, 8, chunk=c),
    "polarity": lambda d, c: normalize.polarity_correction(d, chunk=c),
    "bandpass": lambda d, c: spectral.bandpass(d, 32, 4, 8, order=2, chunk=c),
    "tv": lambda d, c: spectral.tv_denoise(d, iterations=40, chunk=c),
    "beats": lambda d, c: rolling.beat_intervals(d, 10, 1.0, chunk=c).withColumnRenamed("beat", "t"),
}


@pytest.mark.parametrize("name", list(ROLLING))
def test_chunk_size_does_not_matter(samples, name):
    whole, cut = table(ROLLING[name](samples, 100_000)), table(ROLLING[name](samples, 130))
    pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-9, atol=1e-9)


def test_wavelet_chunks(samples):
    f = lambda c: table(spectral.wavelet_pooled(samples, 16, [2, 8], chunk=c), ("record", "frame"))
    a, b = f(100_000), f(256)
    assert np.allclose(np.stack(a.x), np.stack(b.x))


def test_superlet_chunks(samples):
    f = lambda c: table(spectral.superlet(samples, 32, [4, 8], 2, chunk=c, pool=8, stride=4), ("record", "frame"))
    a, b = f(100_000), f(96)
    assert np.allclose(np.stack(a.x), np.stack(b.x))


def test_frames_per_chunk(samples):
    f = lambda n: table(
        chunks.frame_map(samples, ["record"], "t", "value", 20, 5, lambda x, j, n_: x, offset=-10, need=0, frames_per_chunk=n),
        ("record", "frame"),
    )
    a, b = f(10_000), f(7)
    assert list(a.frame) == list(b.frame) and np.array_equal(np.stack(a.x), np.stack(b.x))
    assert (a.record == "a").sum() == 997 // 5 + 1


def test_epoch_map_chunks(samples):
    f = lambda n: table(
        chunks.epoch_map(samples, ["record"], "t", "value", 30, 10, lambda x: [x.sum(), len(x)], ["s", "n"], n), ("record", "epoch")
    )
    pd.testing.assert_frame_equal(f(1000), f(3))
    assert (f(3).record == "a").sum() == 997 // 30


def _epochs_by_hand(rows, window, ext):
    """Extended epochs of one recording of ``{t: value}``, those whose own window is complete."""
    n = max(rows) + 1
    for e in range(n // window):
        if all(t in rows for t in range(e * window, (e + 1) * window)):
            yield e, np.array([rows.get(t, np.nan) for t in range(max(e * window - ext, 0), min((e + 1) * window + ext, n))])


@pytest.mark.parametrize("per", [1, 4, 1000])
def test_epoch_table_against_single_epochs(spark, per):
    """Clipped ends, an extension wider than a chunk, missing values and a gap; two extensions in one pass."""
    rng = np.random.default_rng(5)
    rows = {"a": {t: float(v) for t, v in enumerate(rng.normal(size=211))}, "b": {t: float(v) for t, v in enumerate(rng.normal(size=47))}}
    rows["a"][33] = None
    del rows["a"][95]
    df = spark.createDataFrame([(r, t, v) for r, x in rows.items() for t, v in x.items()], "record string, t long, value double")
    energy = lambda m: np.nanmean(m * m, axis=1)[:, None]
    width = lambda m: np.column_stack([np.full(len(m), m.shape[1]), np.isnan(m).sum(axis=1)])
    got = table(chunks.epoch_table(df, ["record"], "t", "value", 10, [(0, energy, ["e0"]), (25, energy, ["e25"]), (25, width, ["n", "lost"])], per), ("record", "epoch"))
    want = []
    for r, x in rows.items():
        x = {t: np.nan if v is None else v for t, v in x.items()}
        wide = dict(_epochs_by_hand(x, 10, 25))
        for e, own in _epochs_by_hand(x, 10, 0):
            want.append((r, e, np.nanmean(own**2), np.nanmean(wide[e] ** 2), len(wide[e]), np.isnan(wide[e]).sum()))
    assert list(zip(got.record, got.epoch)) == [w[:2] for w in want]
    assert np.allclose(got[["e0", "e25", "n", "lost"]].to_numpy(), [w[2:] for w in want])


def test_signal_features_equal_the_aggregates(samples):
    """The matrix kernels against the plain aggregates of the same epochs."""
    lay = layout(("record",))
    got = table(features.signal_feature_set(samples, 2, 15, [0, 20], lay), ("record", "epoch"))
    for ext in (0, 20):
        want = table(features.epoch_features(samples, 30, 2 * ext, {
            "energy": features.energy(), "sdnn": features.sdnn(), "sdsd": features.sdsd(), "range": features.value_range(),
            "q10": features.quantile(0.1), "q75": features.quantile(0.75),
        }, lay), ("record", "epoch"))
        for c in ("energy", "sdnn", "sdsd", "range", "q10", "q75"):
            assert np.allclose(got[f"{c}_{ext}"], want[c]), c


def test_kernel_chain_equals_single_steps(samples):
    """Median and quartiles in one pass, across chunk borders, at recording edges and on a recording below a window."""
    lay = layout(("record",))
    short = samples.where("t < 9").withColumn("record", F.concat("record", F.lit("-short")))
    both = samples.unionByName(short)
    plain = rolling.iqr_normalization_adaptive(rolling.rolling_median_subtract(both, 10, 2, lay), 10, 3, lay=lay)
    fused = rolling.iqr_normalization_adaptive(both, 10, 3, lay=lay, chunk=130, before=[rolling.median_kernel(10, 2)])
    pd.testing.assert_frame_equal(table(plain), table(fused)[list(plain.columns)], rtol=1e-9, atol=1e-9)
    plain = rolling.median_filter(rolling.rolling_median_subtract(both, 10, 2, lay), 10, 3, lay)
    fused = rolling.median_filter(both, 10, 3, lay, 130, before=[rolling.median_kernel(10, 2)])
    pd.testing.assert_frame_equal(table(plain), table(fused)[list(plain.columns)], rtol=1e-9, atol=1e-9)


def test_specification_adds_channels_of_frames(samples):
    """Spectra of several channels are added bin by bin; a chain of kernels gives what its steps give."""
    two = samples.select("record", F.lit("acc").alias("signal"), F.lit(0).alias("channel"), "t", "value")
    two = two.unionByName(two.withColumn("channel", F.lit(1)).withColumn("value", F.col("value") * 3 + 1))
    steps = [
        {"type": "median", "args": {"window_size": 2}},
        {"type": "iqr_normalization_adaptive", "args": {"median_window": 3, "iqr_window": 3}},
        {"type": "cal_psd", "args": {"window": 40, "noverlap": 20, "nfft": 64, "f_min": 0, "f_max": 5}},
    ]
    got = table(spec.run_spec(two, {"s": {"h5_path": "acc", "channel_idx": [0, 1], "preprocessing": steps, "add": True}}, 10.0), ("record", "t", "feature"))
    df, fs = two.drop("signal"), 10.0
    for step in steps:
        df, fs = registry.PREPROCESSING[step["type"]](df, fs, **step["args"])
    want = table(df.select("record", F.col("frame").alias("t"), F.posexplode("x").alias("feature", "value")).groupBy("record", "t", "feature").agg(F.sum("value").alias("value")), ("record", "t", "feature"))
    assert list(got.t) == list(want.t) and list(got.feature) == list(want.feature)
    assert np.allclose(got.value, want.value)


def test_ordinal_equals_row_number(samples):
    got = chunks.ordinal(samples, ["record"], F.floor(F.col("value") / 3), ["value", "t"], "pos").toPandas()
    for _, g in got.groupby("record"):
        g = g.sort_values(["value", "t"])
        assert list(g.pos) == list(range(len(g)))


def test_previous_and_running_max(samples):
    odd = samples.where("t % 7 in (1, 2)")
    b = F.floor(F.col("t") / 50)
    got = table(chunks.previous(odd, ["record"], b, ["t"], "value", "p"))
    top = table(chunks.running_max(odd, ["record"], b, ["t"], "value", "m"))
    for name in "ab":
        g, h = got[got.record == name], top[top.record == name]
        np.testing.assert_allclose(g.p.to_numpy(), g.value.shift(1).to_numpy())
        np.testing.assert_allclose(h.m.to_numpy(), h.value.cummax().shift(1).to_numpy())


def brute_nms(events, overlap):
    keep, left = [], sorted(events, key=lambda e: (-e[3], e[1], e[2], e[0]))
    while left:
        best, *rest = left
        keep.append(best[0])
        left = []
        for e in rest:
            inter = max(0.0, min(best[2], e[2]) - max(best[1], e[1]))
            if inter / (best[2] - best[1] + e[2] - e[1] - inter) <= overlap:
                left.append(e)
    return sorted(keep)


@pytest.mark.parametrize("local", [0, 3, 10_000])
def test_nms_equals_greedy(spark, local):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 400, 150).astype(float)
    rows = [(i, float(s), float(s + d), float(sc)) for i, (s, d, sc) in enumerate(zip(start, rng.integers(1, 30, 150), np.round(rng.random(150), 1)))]
    df = spark.createDataFrame([("r", "c", *r) for r in rows], "record string, class string, id long, start double, stop double, score double")
    got = sorted(r.id for r in iv.nms(df, 0.4, bucket=25, local_stretch=local).collect())
    assert got == brute_nms(rows, 0.4)


def test_champion_rounds_on_copies(spark):
    """A crowd of equal and nearly equal events collapses to its best members."""
    rng = np.random.default_rng(9)
    rows = [(i, 100.0 + (i % 3), 130.0 + (i % 3), float(rng.random())) for i in range(300)]
    rows += [(1000 + i, float(s), float(s + 2 ** (i % 9)), float(rng.random())) for i, s in enumerate(rng.integers(0, 300, 120))]
    df = spark.createDataFrame([("r", "c", *r) for r in rows], "record string, class string, id long, start double, stop double, score double")
    for t in (0.7, 0.2):
        got = sorted(r.id for r in iv.champion_rounds(df, t, ["record", "class"]).collect())
        assert got == brute_nms(rows, t)
    crowded = iv.nms(df, 0.7, local_bucket=10)
    assert sorted(r.id for r in crowded.collect()) == brute_nms(rows, 0.7)


@pytest.mark.parametrize("threshold", [1, 5, 20])
def test_interval_filters_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(11)
    e = [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 500, 120), rng.integers(0, 40, 120)))]
    k = [(int(s), int(d), "ab"[int(x)]) for s, d, x in zip(rng.integers(0, 500, 25), rng.integers(0, 60, 25), rng.integers(0, 2, 25))]
    events = spark.createDataFrame([("r", *x) for x in e], "record string, id long, start double, stop double")
    masks = spark.createDataFrame([("r", *x) for x in k], "record string, start long, duration long, label string")
    ov = lambda a, m: max(0, min(a[2], m[0] + m[1]) - max(a[1], m[0]))
    got = sorted(r.id for r in iv.discard_overlap(events, masks, threshold, bucket=30).collect())
    assert got == [a[0] for a in e if max(ov(a, m) for m in k) < threshold]
    got = sorted(r.id for r in iv.select_overlap(events, masks, threshold, bucket=30).collect())
    assert got == [a[0] for a in e if all(max(ov(a, m) for m in k if m[2] == lab) > threshold for lab in "ab")]
    other = events.withColumn("record", F.lit("q"))
    assert iv.select_overlap(other, masks, threshold).count() == len(e)


@pytest.mark.parametrize("bucket", [3, 40, 10_000])
def test_overlap_pairs_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    make = lambda n: [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 300, n), rng.integers(0, 60, n)))]
    a, b = make(60), make(70)
    frame = lambda rows: spark.createDataFrame([("r", *x) for x in rows], "record string, id long, start double, stop double")
    got = sorted((r.a_id, r.b_id, r.overlap) for r in iv.overlap_pairs(frame(a), frame(b), bucket=bucket).collect())
    want = sorted(
        (i, j, min(e, f) - max(s, u)) for i, s, e in a for j, u, f in b if e > s and f > u and min(e, f) > max(s, u)
    )
    assert got == want


def test_hard_top_k_by_group(samples):
    got = iv.hard_top_k(samples, "value", 13, ["record"], "t", salts=4).toPandas()
    want = samples.toPandas()
    for name in "ab":
        assert sorted(got[got.record == name].value) == sorted(want[want.record == name].value)[:13]


def test_seeded_rows_ignore_partitioning(spark):
    cells = spark.range(600).selectExpr("id div 60 as win", "(id % 60) div 6 as t", "id % 6 as bin", "cast(id as double) as value")
    for fn in (augment.jitter, augment.scaling, augment.shuffle_features, augment.mag_warp, augment.time_warp, augment.time_mask):
        a = table(fn(cells.repartition(3), 4), ("win", "t", "bin"))
        b = table(fn(cells.repartition(11), 4), ("win", "t", "bin"))
        pd.testing.assert_frame_equal(a, b)


def test_split_sizes_and_order(spark):
    ids = spark.range(103).selectExpr("cast(id as string) record")
    a = {r.record: r.split for r in wn.split_records(ids, 20, 10, 1).collect()}
    b = {r.record: r.split for r in wn.split_records(ids.orderBy(F.desc("record")), 20, 10, 1).collect()}
    assert a == b
    sizes = pd.Series(a).value_counts()
    assert (sizes["test"], sizes["validation"], sizes["train"]) == (20, 8, 75)


def test_stitch_undoes_windows(samples):
    extents = samples.groupBy("record").agg((F.max("t") + 1).alias("extent"))
    win = wn.window_index(extents, 60, 0.5)
    cells = wn.window_samples(samples, win, 60, 1).join(win.select("record", "win", F.col("start").alias("win_start")), ["record", "win"])
    timed = cells.withColumn("epoch", F.col("win_start") + F.col("pos"))
    got = table(iv.stitch_windows(timed, ("record",), win="win", values=["value"]).withColumnRenamed("epoch", "t"))
    want = table(samples.where("t < (case record when 'a' then 990 else 390 end)"))
    np.testing.assert_allclose(got.value, want.value)


def test_short_window_is_padded(series):
    x = series(a=[1, 2, 3])
    win = wn.window_index(x.sparkSession.createDataFrame([("a", 3)], "record string, extent bigint"), 5, 0.5)
    got = wn.window_samples(x, win, 5, 1).where("win = 0").orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 0), (4, 0)]


def test_grouped_loss_equals_global(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), 0, c, float(rng.integers(-1, 2)), float(rng.random())) for i in range(200) for c in "xy"]
    p = spark.createDataFrame(rows, "record string, epoch long, class string, y_true double, y_pred double").withColumn("g", F.lit(1))
    for fn in (losses.weighted, losses.effective_number_focal, losses.effective_number_cross_entropy):
        assert fn(p, group=["g"]).first().value == pytest.approx(fn(p).first().value)
    for fn in (losses.ohem_weighted, losses.ohnm_effective):
        assert fn(p, 0.5, 60, ["g"]).first().value == pytest.approx(fn(p, 0.5, 60, []).first().value)


def test_group_size_is_bounded(samples):
    """A long recording never reaches a kernel whole."""
    seen = lambda pdf, wanted: {"n": np.full(len(wanted), float(len(pdf)))}
    got = chunks.halo_map(samples, ["record"], "t", 7, 5, seen, {"n": "double"}, chunk=64).toPandas()
    assert len(got) == 997 + 400 and got.n.max() == 64 + 7 + 5


def test_one_record_with_a_third_of_the_rows(spark):
    """Results and task sizes on a table where one record dominates."""
    df = spark.range(60_000).selectExpr(
        "case when id < 20000 then 'hot' else concat('r', id % 40) end as record", "0 as channel",
        "case when id < 20000 then id else (id - 20000) div 40 end as t", "cast(id * 7919 % 1009 as double) as value",
    )
    got = rolling.diff(df, chunk=512)
    sizes = got.where("record = 'hot'").groupBy(F.spark_partition_id()).count()
    assert got.count() == 60_000 and sizes.count() > 1
    flags = df.selectExpr("record", "channel", "t", "cast(value > 500 as int) as value")
    pieces = rolling.runs(flags, "value", ["record"], chunk=512).toPandas()
    want = flags.toPandas().sort_values(["record", "t"])
    for name in ("hot", "r3"):
        on = np.concatenate([[0], want[want.record == name].value, [0]])
        edges = np.flatnonzero(np.diff(on)).reshape(-1, 2)
        mine = pieces[pieces.record == name].sort_values("start")[["start", "stop"]].to_numpy()
        assert np.array_equal(mine, edges)


def test_missing_samples_count_as_zero_median(series, ordered):
    x = [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0, 9.0]
    got = ordered(rolling.rolling_median_subtract(series(a=x), 1, 3))
    assert got[1] == 0 and got[2] == 3 and got[4] == 5 and got[6] == 0


def test_rolling_frames_are_linear_and_exact(spark):
    """Running sums equal the frame definition, also where values are missing or constant."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(3000)
    x[500:700] = 1.5
    x[1000] = np.nan
    df = spark.createDataFrame([("a", 0, k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)], "record string, channel int, t long, value double")
    got = rolling.rolling_autocorr(df, 1, 101, chunk=400).orderBy("t").toPandas().value.to_numpy(dtype=float)
    w, s = 101, np.concatenate(([np.nan], x[:-1]))
    for k in (150, 620, 660, 1001, 1050, 2999):
        a, b = s[k - w + 2 : k + 1], x[k - w + 2 : k + 1]
        ok = ~np.isnan(a) & ~np.isnan(b)
        if a[ok].std() == 0 or b[ok].std() == 0:
            assert np.isnan(got[k])
        else:
            assert got[k] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-9)
    assert np.isnan(got[: w - 1]).all()


def test_quantiles_with_infinities_agree_on_both_ways(spark):
    rng = np.random.default_rng(5)
    values = [float("inf")] * 40 + [float("-inf")] * 25 + rng.standard_normal(400).tolist() + [1e308, -1e308, 0.5, 0.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in (1.0, 2.0, 4.0)], "k string, v double")
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    small = {r["k"]: tuple(r)[1:] for r in quantiles.group_quantiles(df, ["k"], "v", probs).collect()}
    for bound in (2, 50):
        large = {r["k"]: tuple(r)[1:] for r in quantiles.group_quantiles(df, ["k"], "v", probs, small_group=bound, bins=8).collect()}
        assert large == small


def test_suppression_ranks_missing_scores_last_on_both_ways(spark):
    rows = [("a", 0, 1, None, 0.0, 10.0), ("a", 0, 2, 0.3, 1.0, 11.0), ("a", 0, 3, float("nan"), 2.0, 12.0), ("a", 0, 4, 0.1, 30.0, 40.0)]
    df = spark.createDataFrame(rows, "record string, class int, id int, score double, start double, stop double")
    keep = [sorted(r["id"] for r in iv.nms(df, 0.5, **kw).collect()) for kw in ({}, {"local_bucket": 0}, {"local_stretch": 0})]
    assert keep == [[2, 4]] * 3


def test_gaps_and_unsampled_records_are_padded(spark):
    samples = spark.createDataFrame([("a", t, 1.0) for t in (0, 1, 5)], "record string, t long, value double")
    win = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "record string, win int, start long")
    got = sorted((r["record"], r["pos"], r["value"]) for r in wn.window_samples(samples, win, 6, 1).collect())
    assert got == [("a", k, float(k in (0, 1, 5))) for k in range(6)] + [("b", k, 0.0) for k in range(6)]


def test_large_window_numbers_do_not_reorder_starts(spark):
    rows = [("a", "x", 3, 0.0, (1 << 20) + 5, 1.0), ("a", "x", 3, 1.0, 0, 2.0)]
    df = spark.createDataFrame(rows, "record string, class string, epoch long, win_start double, win long, y_pred double")
    assert iv.stitch_windows(df, win="win").first().y_pred == 1.0


def test_all_batches_and_the_last_one(spark):
    win = spark.range(25_001).selectExpr("'a' record", "cast(id as int) win")
    assert wn.batch(win, 2).count() == 25_000
    assert wn.batch(win, 2, drop_last=False).count() == 25_001


@pytest.mark.parametrize("rate", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_hard_mining_keeps_a_share_of_all_rows(spark, rate):
    rng = np.random.default_rng(4)
    rows = [(int(r), 0, "c", float(rng.integers(-1, 2)), float(rng.integers(1, 9) / 10), int(r % 3)) for r in range(401)]
    table = spark.createDataFrame(rows, "record long, epoch long, class string, y_true double, y_pred double, g int")
    clip = lambda p: min(max(p, 1e-7), 1 - 1e-7)
    for group in ([], ["g"]):
        every, mined = losses.ohem_cross_entropy(table, rate, None, group), losses.ohnm_cross_entropy(table, rate, None, group)
        for found, negatives in ((every, False), (mined, True)):
            for r in found.collect():
                own = [x for x in rows if x[3] >= 0 and (not group or x[5] == r.g)]
                pos = [np.log(clip(x[4] if x[3] == 1 else 1)) for x in own]
                neg = [np.log(1 - clip(x[4] if x[3] == 0 else 0)) for x in own]
                hard = sorted(neg if negatives else [a + b for a, b in zip(pos, neg, strict=True)])[: int(len(own) * rate)]
                kept = hard + (pos if negatives else [])
                assert r.value == pytest.approx(-(sum(kept) + 1e-7) / (len(kept) + 1), rel=1e-9)


def test_stage_order_reads_all_eight_bins(spark):
    from types import SimpleNamespace

    from vitalgrid.plans.catalog import load

    rows = [(t, 0, b, 0.2 if b == t else 0.1) for t in range(8) for b in range(8)] + [(8, 0, b, 0.4 if b == 7 else 0.1) for b in range(8)]
    cells = spark.createDataFrame(rows, "win long, t long, bin long, value double")
    found = load()["ex16_stage_order_eight_bins"].build(SimpleNamespace(cells=cells)).collect()
    assert {r.win: r.stage for r in found} == dict(enumerate([3, 1, 0, 2, 3, 1, 0, 2, -1]))


def test_lids_frames_of_many_rows(spark):
    """Frames of hundreds of rows, uneven times, ties, missing and unbounded values, several chunks."""
    rng = np.random.default_rng(4)
    us = np.sort(rng.integers(0, 7_000_000_000, 3000))
    us[100:103] = us[100]
    x = np.where(rng.random(3000) < 0.4, 0.0, rng.random(3000))
    x[500:520], x[1400] = np.nan, np.inf
    pdf = pd.DataFrame({"record": "a", "us": us, "enmo": x})
    df = spark.createDataFrame(pdf).withColumn(
        "enmo", F.when(F.col("enmo").isNull() & (F.col("us") % 2 == 1), float("nan")).otherwise(F.col("enmo"))
    )
    got = rolling.lids(df, chunk_seconds=3000).toPandas().sort_values(["us", "enmo"]).reset_index(drop=True)
    value = got["enmo"].to_numpy(float, na_value=np.nan)
    missing = np.isnan(value) & (got["us"].to_numpy() % 2 == 0)
    assert missing.any() and (np.isnan(value) & ~missing).any()
    above = np.where(value < 0.02, 0.0, value - 0.02)

    def frame(v, held, span):
        out = np.full(len(v), np.nan)
        for k, t in enumerate(got["us"]):
            own = (got["us"] > t - span).to_numpy() & (got["us"] <= t).to_numpy() & held
            if own.any():
                out[k] = v[own].sum()
        return out

    u = 100 / (frame(above, ~missing, 600_000_000) + 1)
    held = np.array([(~missing & (got["us"] > t - 600_000_000) & (got["us"] <= t)).any() for t in got["us"]])
    count = frame(np.ones(len(u)), held, 1_800_000_000)
    want = frame(u, held, 1_800_000_000) / count
    assert np.allclose(got["lids"].to_numpy(float, na_value=np.nan), want, equal_nan=True, rtol=1e-9)


def test_stream_statistics_of_one_hot_bin(spark, tmp_path):
    """Several micro-batches, one record with nearly all rows of a bin, a late row, the open bin left out."""
    from vitalgrid.streaming import epochs

    rng = np.random.default_rng(2)
    rows = [("hot", float(s), float(rng.normal())) for s in rng.random(3000) * 120]
    rows += [("cold", float(s), None if s < 3 else 1.0) for s in range(0, 240, 7)] + [("hot", 400.0, 5.0)]
    source = tmp_path / "in"
    for k, part in enumerate((rows, [("hot", 1.0, 99.0), ("hot", 900.0, 1.0)])):
        frame = spark.createDataFrame(part, "record string, s double, value double")
        frame.select("record", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema("record string, ts timestamp, value double").option("recursiveFileLookup", "true")
        epochs.stream_epoch_stats_full(
            stream.parquet(str(source)), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/state", interval="60 seconds",
            delay="100 seconds",
        )
    got = spark.read.parquet(f"{tmp_path}/out").select("record", F.unix_seconds("start").alias("start"), "mean", "std", "range", "mad", "entropy20", "entropy200")
    want = {}
    for r, s, v in rows:
        if v is not None:
            want.setdefault((r, int(s // 60) * 60), []).append(v)
    closed = {k: np.array(v) for k, v in want.items() if k[1] + 60 <= 800}
    got = {(r["record"], r["start"]): r for r in got.collect()}
    assert set(got) == set(closed)
    for k, v in closed.items():
        assert got[k]["mean"] == pytest.approx(v.mean()) and got[k]["mad"] == pytest.approx(np.abs(v - v.mean()).mean())
        assert got[k]["range"] == pytest.approx(v.max() - v.min())
        for b in (20, 200):
            p = np.histogram(v, bins=b)[0] / len(v)
            p = p[p > 0]
            assert got[k][f"entropy{b}"] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-9)


def test_label_counts_on_bits(spark):
    from vitalgrid.operators import windows

    iv = spark.createDataFrame(
        [("a", "x", "event", 0, 30.0, 100.0), ("a", "y", "event", 1, 90.0, 400.0), ("a", "m", "mask", 2, 100.0, 60.0)],
        "record string, label string, kind string, id int, start double, duration double",
    )
    w = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 400.0)], "record string, win long, start double")
    words = windows.label_words(w, iv, ["x", "y"], 500, 7)
    cells = windows.window_labels(w, iv, ["x", "y"], 500, 7)
    by = ["win", "class"]
    want = cells.groupBy(*by).agg(
        F.count_if(F.col("y_true") == 1).alias("ones"), F.count_if(F.col("y_true") == 0).alias("zeros"),
        F.count_if(F.col("y_true") == -1).alias("masked"),
    )
    key = lambda df: sorted(map(tuple, df.select("win", "class", "ones", "zeros", "masked").collect()))
    assert key(windows.label_counts(words, by)) == key(want) and words.agg(F.sum("cells")).first()[0] == 4 * 71
