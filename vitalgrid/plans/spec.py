"""Declarative signal specifications and the three end-to-end plans.

A specification maps a signal name to its source, channels, preprocessing steps
and whether channels are added; ``run_spec`` folds the steps lazily over the
sample table, so Catalyst sees one plan per signal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.rows import flat_feature
from vitalgrid.operators import features, intervals as iv, metrics, windows as wn
from vitalgrid.operators.chunks import floor_div, running_max
from vitalgrid.model import layout
from vitalgrid.plans.registry import (
    AUGMENTATIONS, CHAINED, LINKS, MULTI_PASS_STEPS, NORMALIZERS, PREPROCESSING, ROW_STEPS, WHOLE_WINDOW_NORMALIZERS,
)
from vitalgrid.session import stage
from vitalgrid.sources.tables import read_samples


@dataclass
class SignalSpec:
    name: str
    path: str
    channels: list[int]
    preprocessing: list[dict[str, Any]] = field(default_factory=list)
    add: bool = False
    fs_post: float | None = None
    dimensions: list[int] | None = None
    normalization: dict[str, Any] = field(default_factory=dict)
    transformations: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def parse(cls, name: str, d: dict[str, Any]) -> "SignalSpec":
        return cls(
            name, d["h5_path"], list(d["channel_idx"]), list(d.get("preprocessing", [])), bool(d.get("add", False)),
            d.get("fs_post"), d.get("dimensions"), d.get("batch_normalization") or {}, d.get("transformations") or {},
        )


def parse_spec(spec: dict[str, dict]) -> list[SignalSpec]:
    """Check that names exist and that all signals agree in rate and size."""
    signals = [SignalSpec.parse(n, d) for n, d in spec.items()]
    for s in signals:
        unknown = [p["type"] for p in s.preprocessing if p["type"] not in PREPROCESSING]
        unknown += [n for n in s.transformations if n not in AUGMENTATIONS]
        if unknown:
            raise KeyError(f"{s.name}: unknown steps {unknown}")
    for what in ("fs_post", "dimensions"):
        seen = {str(getattr(s, what)) for s in signals if getattr(s, what) is not None}
        if len(seen) > 1:
            raise ValueError(f"signals disagree in {what}: {sorted(seen)}")
    return signals


def run_signal(samples: DataFrame, spec: SignalSpec, fs: float) -> tuple[DataFrame, float]:
    """Steps of one signal over ``record, signal, channel, t, value`` rows.

    A step that reads its input several times gets it from a written table when
    there is real work behind it; otherwise the work of a chain would grow with
    the product of the passes instead of their sum. A step that only looks at
    neighbouring samples runs inside the next one's pass where that takes it along.

    Returns ``record, signal, t, feature, value`` and the rate after the last step.
    """
    df = read_samples(samples, [spec.path], spec.channels).select("record", "channel", "t", "value")
    heavy, links = False, []
    names = [step["type"] for step in spec.preprocessing]
    for step, name, after in zip(spec.preprocessing, names, [*names[1:], None]):
        args = step.get("args", {})
        if name in LINKS and after in CHAINED:
            links.append(LINKS[name](fs, **args))
            continue
        if heavy and name in MULTI_PASS_STEPS and not links:
            df, heavy = stage(df), False
        df, fs = PREPROCESSING[name](df, fs, **args, **({"before": links} if links else {}))
        heavy, links = heavy or name not in ROW_STEPS, []
    if "x" in df.columns:
        if spec.add:
            df = _added(df, len(spec.channels))
        df = df.select("record", "channel", F.col("frame").alias("t"), F.posexplode("x").alias("bin", "value"))
        if spec.add:
            return df.select("record", F.lit(spec.name).alias("signal"), "t", F.col("bin").cast("long").alias("feature"), "value"), fs
    else:
        df = df.withColumn("bin", F.lit(0))
    if spec.add:
        out = df.groupBy("record", "t", F.col("bin").cast("long").alias("feature")).agg(F.sum("value").alias("value"))
    else:
        order = {c: i for i, c in enumerate(spec.channels)}
        slot = F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), F.col("channel"))
        if len(order) == 1:
            slot = F.lit(0)
        out = df.withColumn("feature", flat_feature(F.col("bin"), slot, len(order)))
    return out.select("record", F.lit(spec.name).alias("signal"), "t", "feature", "value"), fs


def _added(df: DataFrame, channels: int) -> DataFrame:
    """Frames with the bins of all channels added, as arrays; a frame has one row a channel."""
    if channels == 1:
        return df
    of_frame = F.array_sort(F.collect_list(F.struct("channel", "x")))
    plus = lambda a, b: F.coalesce(a + b, a, b)
    total = F.aggregate(
        of_frame, F.array().cast("array<double>"), lambda sums, row: F.zip_with(sums, row["x"], plus)
    )
    return df.groupBy("record", "frame").agg(F.min("channel").alias("channel"), total.alias("x"))


def run_spec(samples: DataFrame, spec: dict[str, dict], fs: dict[str, float] | float) -> DataFrame:
    """All signals of a specification as one feature table."""
    out = None
    for s in parse_spec(spec):
        rate = fs[s.path] if isinstance(fs, dict) else fs
        df, after = run_signal(samples, s, rate)
        if s.fs_post is not None and abs(after - s.fs_post) > 1e-9:
            raise ValueError(f"{s.name}: steps end at {after} Hz, specification says {s.fs_post}")
        out = df if out is None else out.unionByName(df)
    return out


@dataclass
class WindowedDataset:
    """Feature windows with labels: the tables a model would be fed from."""

    features: DataFrame
    intervals: DataFrame
    classes: Sequence[str]
    window: int
    fs: float
    resolution: float
    overlap: float = 0.5
    so: float | None = None
    use_mask: bool = True
    spec: dict[str, dict] = field(default_factory=dict)

    @cached_property
    def stored(self) -> DataFrame:
        """The features, written once: extents and windows of every signal read them several times."""
        return stage(self.features)

    def windows(self) -> DataFrame:
        extents = features.record_extent(self.stored, self.fs)
        return wn.window_index(extents, self.window, self.overlap)

    def signals(self, windows: DataFrame | None = None, train_seed: int | None = None) -> DataFrame:
        """Cells ``record, win, signal, t, bin, value``; augmented when a seed is given."""
        w = self.windows() if windows is None else windows
        cells = wn.window_samples(self.stored, w, self.window, self.fs, features=["signal", "feature"])
        cells = cells.select("record", "win", "signal", F.col("pos").alias("t"), F.col("feature").alias("bin"), "value")
        if not self.spec:
            return cells
        out = None
        for s in parse_spec(self.spec):
            part = cells.where(F.col("signal") == s.name)
            if s.normalization:
                part = self._normalized(part, s)
            if train_seed is not None:
                for name, args in s.transformations.items():
                    part = self._augmented(part, name, args, train_seed, s)
            out = part if out is None else out.unionByName(part)
        return out

    def _normalized(self, part: DataFrame, s: SignalSpec) -> DataFrame:
        """A normaliser applied per window: the window takes the place of the record."""
        keyed = part.select(
            F.struct("record", "win").alias("record"), F.col("bin").cast("int").alias("channel"), "t", "value"
        )
        name, args = s.normalization["type"], dict(s.normalization.get("args", {}))
        if name in WHOLE_WINDOW_NORMALIZERS:
            args["lay"] = layout(("record",))
        out, _ = NORMALIZERS[name](keyed, self.fs, **args)
        return out.select(
            "record.record", "record.win", F.lit(s.name).alias("signal"), "t", F.col("channel").cast("long").alias("bin"), "value"
        )

    def _augmented(self, part: DataFrame, name: str, args: dict, seed: int, s: SignalSpec) -> DataFrame:
        extra = dict(args)
        if name == "image_translation":
            extra.setdefault("bins", (s.dimensions or [1])[0])
        keys = ("record", "win", "signal")
        return AUGMENTATIONS[name](part, seed=seed, keys=keys, **extra).select("record", "win", "signal", "t", "bin", "value")

    def labels(self, windows: DataFrame | None = None) -> DataFrame:
        w = self.windows() if windows is None else windows
        return wn.window_labels(w, self.intervals, self.classes, self.window, self.resolution, self.so, self.use_mask)

    def label_words(self, windows: DataFrame | None = None) -> DataFrame:
        """The labels as bits, for counts."""
        w = self.windows() if windows is None else windows
        return wn.label_words(w, self.intervals, self.classes, self.window, self.resolution, self.so, self.use_mask)

    def batches(self, batch_size: int) -> DataFrame:
        return wn.batch(self.windows(), batch_size)

    def balanced(self, draws: int, probabilities: dict[str, float], seed: int) -> DataFrame:
        w = self.windows()
        events = wn.event_index(self.intervals.where("kind = 'event'"), w)
        return wn.balanced_sample(events, draws, probabilities, self.window, seed)


def detect_events(
    scores: DataFrame, threshold: float, merge_size: int, min_len: int, resolution: float,
    discard: DataFrame | None = None, select: DataFrame | None = None, discard_threshold: float = 1.0,
    select_threshold: float = 0.0, overlap: float = 0.5, bucket: float = 3600,
) -> DataFrame:
    """Window scores -> events: runs, suppression, then discard and select filters.

    ``scores``: ``record, win, win_start, class, cell, score``.
    """
    found = iv.score_runs(scores, threshold, merge_size, min_len, resolution)
    named = found.select(
        "record", "class", "start", "stop", "score",
        F.concat_ws("|", "win", F.col("start").cast("string")).alias("id"),
    )
    kept = iv.nms(named, overlap, ("record", "class"), bucket)
    kept = _unique(kept)
    if discard is not None:
        kept = iv.discard_overlap(kept, discard, discard_threshold, resolution, bucket=bucket)
    if select is not None:
        kept = iv.select_overlap(kept, select, select_threshold, resolution, bucket=bucket)
    return kept


def _unique(events: DataFrame) -> DataFrame:
    """Ids unique per record: classes share the interval filters."""
    return events.withColumn("id", F.concat_ws("|", "class", "id"))


def epoch_series(scores: DataFrame, labels: DataFrame, resolution: float) -> DataFrame:
    """Stitched predictions with targets: ``record, class, epoch, y_true, y_pred``.

    ``scores`` and ``labels`` hold the same windows: ``record, win, win_start,
    class, cell`` plus a value. Both sides go into one aggregation, where the
    earliest window wins, instead of a join followed by one. An epoch that one
    side lacks, or a hole in 0..last, is an error.
    """
    none = F.lit(None).cast("double")
    key = ["record", "win", "win_start", "class", "cell"]
    both = labels.select(*key, "y_true", none.alias("y_pred")).unionByName(
        scores.select(*key, none.alias("y_true"), F.col("y_pred").cast("double"))
    )
    timed = both.withColumn("epoch", F.floor(F.col("win_start") / F.lit(resolution)).cast("long") + F.col("cell"))
    out = iv.stitch_windows(timed, ("record", "class"), "epoch", "win_start", "win", ("y_true", "y_pred"))
    return assert_complete(out, ("record", "class"), "epoch", ("y_true", "y_pred"))


def assert_complete(series: DataFrame, keys, epoch: str, values) -> DataFrame:
    """Fail unless every key has each epoch from 0 to its last one with all values; returns the stored series."""
    series = stage(series)
    bad = series.groupBy(*keys).agg(
        F.min(epoch).alias("_lo"), F.max(epoch).alias("_hi"), F.count_distinct(epoch).alias("_n"),
        *[F.count_if(F.col(v).isNull()).alias(f"_{v}") for v in values],
    ).where(
        " or ".join(["_lo <> 0", "_n <> _hi + 1", *[f"_{v} > 0" for v in values]])
    ).head(1)
    if bad:
        raise ValueError(f"incomplete epoch series: {bad[0].asDict()}")
    return series


def stitched_classes(
    windows: DataFrame, intervals: DataFrame, classes: Sequence[str], window: int, resolution: int,
    score: Callable[[Column], Column], so: float | None = None, record: str = "record",
) -> DataFrame:
    """True and predicted class of the stitched epochs with exactly one true class: ``record, epoch, true_class, pred_class``.

    For scores that are an expression of ``record, win, cell`` and the class ``score`` is called with (a table of scores
    goes through ``epoch_series``). The earliest window of an epoch wins, so windows are cut to the cells that are their
    own before any cell becomes a row: one running maximum over windows. Epochs with one true class are found on the
    label bits; only they are unfolded and scored. A hole in 0..last is an error.
    """
    n = int(window // resolution)
    begin = floor_div(F.col("start"), resolution)
    bounds = windows.select(record, "win", "start", begin.alias("_begin"), (begin + n).alias("_end"))
    seen = stage(running_max(bounds, [record], floor_div(F.col("start"), window * 64), ["start", "win"], "_end", "_seen"))
    covered = F.coalesce("_seen", F.lit(0))
    hole = seen.where((F.col("_begin") > covered) | (F.col("_seen").isNull() & (F.col("_begin") != 0))).head(1)
    if hole:
        raise ValueError(f"incomplete epoch series: {hole[0].asDict()}")
    own = seen.withColumn("own", covered - F.col("_begin")).where(F.col("own") < n)
    bits = wn.label_bits(own, intervals, classes, window, resolution, so, record=record, keep=["own"])
    one = two = F.lit(0).cast("long")
    for i in range(len(classes)):
        e = F.get("events", F.lit(i))
        one, two = one.bitwiseOR(e), two.bitwiseOR(one.bitwiseAND(e))
    single = one.bitwiseAND(F.bitwise_not(two)).bitwiseAND(F.bitwise_not("mask"))
    places = F.sequence(F.greatest(F.col("own") - F.col("word") * wn.WORD, F.lit(0)).cast("int"), (F.col("cells") - 1).cast("int"))
    set_ = lambda bits, k: F.call_function("getbit", bits, k) == 1
    found = bits.withColumn("_single", single).where((F.col("_single") != 0) & (F.col("own") < F.col("word") * wn.WORD + F.col("cells")))
    cells = found.withColumn("_k", F.explode(F.filter(places, lambda k: set_(F.col("_single"), k)))).withColumn(
        "cell", F.col("word") * wn.WORD + F.col("_k")
    )
    names = F.array(*[F.lit(c) for c in classes])
    true = F.coalesce(*[F.when(set_(F.get("events", F.lit(i)), F.col("_k")), F.lit(c)) for i, c in enumerate(classes)])
    scored = cells.withColumn("_scores", F.array(*[score(F.lit(c)) for c in classes]))
    pred = F.element_at(names, F.array_position("_scores", F.array_max("_scores")).cast("int"))
    epoch = floor_div(F.col("win_start"), resolution) + F.col("cell")
    return scored.select(record, epoch.alias("epoch"), true.alias("true_class"), pred.alias("pred_class"))


def agreement(series: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Accuracy and kappa over epochs with exactly one true class."""
    named = metrics.one_hot_labels(series, classes)
    return metrics.multiclass_agreement(named, "true_class", "pred_class")
