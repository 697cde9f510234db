"""Named steps: the vocabulary a declarative signal specification may use.

A step is ``step(df, fs, **args) -> (df, fs)`` on a sample table with columns
``record, channel, t, value`` (or ``frame, x`` after a spectral step).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import rows
from vitalgrid.model import DEFAULT
from vitalgrid.operators import (
    augment, features, hrv, losses, metrics, normalize, resample, rolling, spectral,
)

Step = Callable[..., tuple[DataFrame, float]]


def _expr(fn) -> Step:
    return lambda df, fs, **a: (df.withColumn("value", fn(F.col("value"), **a)), fs)


def _plain(fn) -> Step:
    return lambda df, fs, **a: (fn(df, **a), fs)


def _rated(fn) -> Step:
    return lambda df, fs, **a: (fn(df, fs, **a), fs)


def _frames(fn) -> Step:
    """Frame spectra change the rate to one frame per hop."""

    def step(df, fs, window, noverlap, **a):
        a.pop("plot_flag", None)
        return fn(df, fs, window, noverlap, **a), fs / (window - noverlap)

    return step


def _autocorr(df, fs, window, noverlap, nfft=None, **a):
    return spectral.autocorr_psd(df, fs, window, noverlap, **a), fs / (window - noverlap)


def _cepstral(fn):
    def step(df, fs, window, noverlap, nfft, numcep, f_min=None, f_max=None, **_):
        return fn(df, fs, window, noverlap, nfft, numcep), fs / (window - noverlap)

    return step


def _wavelet(df, fs, sub=16, **_):
    return spectral.wavelet(df), fs


def _wavelet_pooled(df, fs, sub=16, **_):
    return spectral.wavelet_pooled(df, sub), fs / sub


def _superlet(df, fs, nfft, f_min, f_max, f_sub, **_):
    return spectral.superlet_frames(df, int(fs), nfft, f_min, f_max, f_sub), fs / f_sub


def _as_frames(df: DataFrame) -> DataFrame:
    """Epoch features as ``frame, x`` rows."""
    names = [c for c in df.columns if c not in (*DEFAULT.keys, "epoch")]
    return df.select(*DEFAULT.keys, F.col("epoch").alias("frame"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"))


def _collector(fn):
    def step(df, fs, window, window_ext=0, **a):
        return _as_frames(fn(df, int(fs), window, **a)), 1 / window

    return step


def _signal_features(df, fs, window, window_ext):
    return _as_frames(features.signal_feature_set(df, int(fs), window, window_ext)), 1 / window


def _activity(df, fs, window, min_thresh=0.1):
    return _as_frames(rolling.weighted_activity(df, int(fs), window, min_thresh)), 1 / window


def _per_extension(df, fs, window, window_ext, fn):
    keys = [*DEFAULT.keys, "epoch"]
    out = None
    for ext in window_ext:
        part = fn(df, int(fs), window, ext)
        named = part.select(*keys, *[F.col(c).alias(f"{c}_{ext}") for c in part.columns if c not in keys])
        out = named if out is None else out.join(named, keys)
    return _as_frames(out), 1 / window


def _hrv(df, fs, window, window_ext):
    one = lambda d, r, w, e: hrv.hrv_features(d, r, w * r, e * r, entropy=True)
    return _per_extension(df, fs, window, window_ext, one)


def _beats(df, fs, window, window_ext):
    """Beat measures do not widen their epochs: an interval belongs to the epoch of its peak."""
    beats = rolling.beat_intervals(df, fs)
    return _per_extension(df, fs, window, window_ext, lambda d, r, w, e: hrv.beat_measures(beats, r, w * r))


def _wide(df: DataFrame) -> DataFrame:
    """Three-axis wide form of channels 0, 1, 2 (one shuffle)."""
    axes = [F.max(F.when(F.col("channel") == i, F.col("value"))).alias(n) for i, n in enumerate("xyz")]
    return df.groupBy("record", "t").agg(*axes)


def _clocked(df, fs):
    return _wide(df).withColumn("us", F.round(F.col("t") * F.lit(1_000_000.0 / fs)).cast("long"))


def _movement(df, fs, time_interval=30):
    out = features.movement_epoch_features(_clocked(df, fs), interval=time_interval)
    return _as_frames(out.withColumn("channel", F.lit(0))), 1 / time_interval


def _surrogate(df, fs, time_interval=30):
    out = features.surrogate_signals(_clocked(df, fs))
    x = F.array("enmo", "angle_z", "lids")
    return out.select("record", F.lit(0).alias("channel"), F.col("t").alias("frame"), x.alias("x")), fs


def _pca(df, fs, n_components=1):
    channels = [r[0] for r in df.select("channel").distinct().orderBy("channel").collect()]
    names = [f"c{c}" for c in channels]
    cols = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(n) for c, n in zip(channels, names)]
    wide = normalize.pca(df.groupBy("record", "t").agg(*cols), names, n_components)
    x = F.array(*[F.col(f"pc{k + 1}") for k in range(n_components)]) if len(names) > 1 else F.array(names[0])
    return wide.select("record", F.lit(0).alias("channel"), F.col("t").alias("frame"), x.alias("x")), fs


def _downsample(df, fs, fs_out, plot=False):
    return resample.downsample(df, fs, fs_out)


def _absum(df, fs, fs_out, plot=False):
    return resample.block_mean(df, fs, fs_out), fs_out


def _block_max(df, fs, fs_out):
    return resample.block_max(df, fs, fs_out), fs_out


# The step names a specification uses.
PREPROCESSING: dict[str, Step] = {
    "complete_zscore": _plain(normalize.complete_zscore),
    "logfbank": _cepstral(spectral.log_filterbank),
    "mfcc": _cepstral(spectral.mfcc),
    "adaptive_soft": _rated(rolling.adaptive_soft),
    "zscore_log": _plain(normalize.zscore_log),
    "min_max": _plain(normalize.min_max),
    "soft": _plain(normalize.soft),
    "median": _rated(rolling.rolling_median_subtract),
    "clip": _expr(rows.clip),
    "no_normalization": lambda df, fs: (df, fs),
    "median_filter": _rated(rolling.median_filter),
    "divide": _expr(rows.divide),
    "butter_bandpass_filter": _rated(spectral.bandpass),
    "zscore": _plain(normalize.zscore),
    "log": _expr(rows.log),
    "cal_psd": _frames(spectral.psd),
    "cal_autocorrelation_psd": _autocorr,
    "cal_wavelet": _wavelet,
    "cal_wavelet_new": _wavelet_pooled,
    "set_min": _plain(normalize.set_min),
    "collect_signal_features": _signal_features,
    "acc_manual_feature": _activity,
    "FM_features": _collector(features.hrv_spectral_set),
    "ACC_features": _collector(features.movement_feature_set),
    "collect_aura_features": _hrv,
    "collect_hrv_features": _beats,
    "downsample": _downsample,
    "diff": _plain(rolling.diff),
    "butter_highpass_filter": _rated(spectral.highpass),
    "clip_by_iqr": _expr(rows.clip_by_iqr),
    "iqr_normalization": _plain(normalize.iqr_normalization),
    "iqr_normalization_adaptive": _rated(rolling.iqr_normalization_adaptive),
    "ACC_low_amplitude_segmentation": _expr(rows.low_amplitude),
    "ACC_high_amplitude_segmentation": _expr(rows.high_amplitude),
    "log_plus_one": _expr(rows.log_plus_one),
    "change_PPG_direction": _plain(normalize.polarity_correction),
    "cal_superlet": _superlet,
    "prep_data_and_compute_features": _movement,
    "prep_data_and_compute_surrogate_signals": _surrogate,
    "absum": _absum,
    "absum2": _block_max,
    "rolling_autocorr": _rated(rolling.rolling_autocorr),
    "total_variation_filter": _plain(spectral.tv_denoise),
    "pca_feature_reduction": _pca,
}

# Steps that are one pass of row expressions.
ROW_STEPS = frozenset({
    "clip", "divide", "log", "log_plus_one", "clip_by_iqr", "no_normalization",
    "ACC_low_amplitude_segmentation", "ACC_high_amplitude_segmentation",
})
# Steps that read their input more than once (statistics of the whole recording first).
MULTI_PASS_STEPS = frozenset({
    "complete_zscore", "zscore", "zscore_log", "min_max", "soft", "set_min", "iqr_normalization",
    "median_filter", "adaptive_soft", "iqr_normalization_adaptive", "change_PPG_direction",
    "total_variation_filter", "pca_feature_reduction", "collect_signal_features", "FM_features", "ACC_features",
    "collect_aura_features", "collect_hrv_features", "prep_data_and_compute_features",
    "prep_data_and_compute_surrogate_signals",
})

# Steps that only look at neighbouring samples, as links of a chain, and the steps that take such links along.
LINKS: dict[str, Callable[..., rolling.Link]] = {"median": rolling.median_kernel}
CHAINED = frozenset({"median", "median_filter", "adaptive_soft", "iqr_normalization_adaptive"})

# Normalisers that may also run per window.
NORMALIZER_NAMES = (
    "complete_zscore", "adaptive_soft", "zscore_log", "min_max", "soft", "median", "clip", "no_normalization",
    "divide", "butter_bandpass_filter", "butter_highpass_filter", "zscore", "log",
)
NORMALIZERS: dict[str, Step] = {n: PREPROCESSING[n] for n in NORMALIZER_NAMES}
# Of these, the ones whose statistics cover all bins of a window at once.
WHOLE_WINDOW_NORMALIZERS = frozenset({"min_max", "zscore_log", "soft"})

# Augmentation names; each takes (cells, seed, **args).
AUGMENTATIONS: dict[str, Callable[..., DataFrame]] = {
    "Inverting": augment.inverting,
    "Jitter": augment.jitter,
    "Scaling": augment.scaling,
    "MagWarp": augment.mag_warp,
    "TimeWarp": augment.time_warp,
    "image_translation": augment.translate_bins,
    "time_mask": augment.time_mask,
    "freq_mask": augment.freq_mask,
    "shuffle_features": augment.shuffle_features,
    "replace_with_noise": augment.replace_with_noise,
    "time_mask_USleep": augment.segment_noise,
}

# Loss names over a predictions table.
LOSSES: dict[str, Callable[..., DataFrame]] = {
    "cross_entropy_loss": losses.cross_entropy,
    "weighted_loss": losses.weighted,
    "binary_focal_loss": losses.focal,
    "binary_focal_loss_weighted": losses.focal_weighted,
    "effective_number_binary_focal_loss": losses.effective_number_focal,
    "effective_number_cross_entropy_loss": losses.effective_number_cross_entropy,
    "ohem_cross_entropy_loss": losses.ohem_cross_entropy,
    "ohem_cross_entropy_weighted_loss": losses.ohem_weighted,
    "ohem_cross_entropy_efficient_number_loss": losses.ohem_effective,
    "ohnm_cross_entropy_loss": losses.ohnm_cross_entropy,
    "ohnm_cross_entropy_weighted_loss": losses.ohnm_weighted,
    "ohnm_cross_entropy_efficient_number_loss": losses.ohnm_effective,
    "categorical_focal_loss": losses.categorical_focal,
    "categorical_focal_loss_weighted": losses.categorical_focal_weighted,
    "categorical_crossentropy_loss": losses.categorical_cross_entropy,
    "categorical_crossentropy_weighted_loss": losses.categorical_cross_entropy_weighted,
    "DICED_LOSS": losses.dice,
}

# Epoch metric names over a predictions table.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "binary_accuracy": metrics.binary_accuracy,
    "balanced_accuracy": metrics.balanced_accuracy,
    "balanced_accuracy_new": metrics.balanced_accuracy_new,
    "AUCRC": metrics.auprc,
    "AUROC": metrics.auroc,
    "f1_mean": metrics.f1_mean,
    "f1_by_class": metrics.f1_by_class,
    "recall": metrics.recall,
    "precision": metrics.precision,
    "specificity": metrics.specificity,
    "MCC": metrics.mcc,
    "cohens_kappa": metrics.cohens_kappa,
    "cohens_kappa1": metrics.cohens_kappa_sweep,
    "optimized_f1": metrics.optimized_f1,
    "optimized_f12": metrics.optimized_f12,
    "absolute_error": lambda targets, outputs, **a: metrics.event_metric("absolute_error", targets, outputs, **a),
    "accuracy_semantic_input": metrics.accuracy_semantic,
    "precision_semantic_input": metrics.precision_semantic,
    "recall_semantic_input": metrics.recall_semantic,
    "specificity_semantic_input": metrics.specificity_semantic,
}


def event_metric(name: str) -> Callable[..., DataFrame]:
    """Event metric by name over (targets, outputs)."""
    # Event metric names.
    listed = {
        "get_false_negative_events": metrics.false_negative_events,
        "get_false_positive_events": metrics.false_positive_events,
        "get_true_positive_events": metrics.true_positive_events,
    }
    if name in listed:
        return listed[name]
    return lambda targets, outputs, **a: metrics.event_metric(name, targets, outputs, **a)
