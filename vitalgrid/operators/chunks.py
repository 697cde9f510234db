"""Chunked execution: bounded groups whatever the length of a recording.

A recording can hold a large share of all rows, so nothing here partitions by
record alone. Ordered work runs per ``(record, channel, chunk)``, where a chunk
also carries the neighbouring rows (halo) its frames or filters reach into;
halo rows are dropped afterwards, so each input row yields exactly one result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.model import CHUNK
from vitalgrid.session import settle, stage

# Rows of one bucket that a task orders by itself; where a bucket holds more, buckets are split into ranges.
CROWDED = 2_000_000


def floor_div(c: Column, k: int | float) -> Column:
    return F.floor(c / F.lit(k)).cast("long")


def halo(df: DataFrame, t: str, back: int, ahead: int, chunk: int) -> DataFrame:
    """Add ``_chunk``; rows within reach of a neighbouring chunk are repeated for it."""
    if back == 0 and ahead == 0:
        return df.withColumn("_chunk", floor_div(F.col(t), chunk))
    first = F.greatest(floor_div(F.col(t) - ahead, chunk), F.lit(0).cast("long"))
    last = floor_div(F.col(t) + back, chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last)))


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    back: int,
    ahead: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk: int = CHUNK,
) -> DataFrame:
    """Apply ordered window columns per chunk.

    ``build(df, window)`` adds columns over ``window`` (partitioned by key and
    chunk, ordered by ``t``) that look at most ``back`` units of ``t`` behind and
    ``ahead`` in front of a row.
    """
    chunk = max(int(chunk), back + 1, ahead + 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy(t)
    out = build(halo(df, t, back, ahead, chunk), w)
    if back or ahead:
        out = out.where(floor_div(F.col(t), chunk) == F.col("_chunk"))
    return out.drop("_chunk")


def time_frame(
    df: DataFrame, part: Sequence[str], t: str, span: int, value: str, total: str, count: str
) -> DataFrame:
    """Sum and number of ``value`` over the time frame ``(t - span, t]`` inside each partition, in linear time.

    Every row enters at its time and leaves again ``span`` later; the frame is the running sum of what came and
    went, so its cost does not depend on the rows in it. Values without a finite size are counted instead of
    summed, and leave no trace once they are out of the frame. ``total`` is NULL where the frame has no value.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    finite = v.isNotNull() & ~F.isnan(v) & (size < float("inf"))
    events = df.withColumn("_leaves", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_at", F.col(t) + F.col("_leaves") * F.lit(int(span))
    )
    sign = F.lit(1) - 2 * F.col("_leaves")
    w = Window.partitionBy(*part).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda c: F.sum(F.coalesce(c, F.lit(0)) * sign).over(w)
    out = events.withColumns({
        "_sum": running(F.when(finite, v)), "_held": running(v.isNotNull().cast("long")),
        "_odd": running(F.isnan(v).cast("long")), "_high": running((v == float("inf")).cast("long")),
        "_low": running((v == float("-inf")).cast("long")),
    }).where("_leaves = 0")
    nothing, nan = F.col("_held") == 0, (F.col("_odd") > 0) | ((F.col("_high") > 0) & (F.col("_low") > 0))
    found = (
        F.when(nothing, F.lit(None).cast("double")).when(nan, F.lit(float("nan")))
        .when(F.col("_high") > 0, F.lit(float("inf"))).when(F.col("_low") > 0, F.lit(float("-inf"))).otherwise(F.col("_sum"))
    )
    return out.withColumn(total, found).withColumn(count, F.col("_held").cast("long")).drop(
        "_leaves", "_at", "_sum", "_held", "_odd", "_high", "_low"
    )


def _nothing(schema: T.StructType) -> pd.DataFrame:
    """Result of a chunk that only holds neighbours' rows."""
    return pd.DataFrame(columns=schema.names)


def halo_map(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    back: int,
    ahead: int,
    fn: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]],
    outputs: dict[str, str],
    chunk: int = CHUNK,
    stride: int = 1,
) -> DataFrame:
    """Grouped-map kernel per chunk; group memory is ``chunk + back + ahead`` rows.

    ``fn(chunk_rows, wanted)`` receives the chunk sorted by ``t`` and the
    positions whose results are wanted (inside the core, every ``stride``-th
    sample) and returns one array per entry of ``outputs`` (name -> DDL type).
    """
    chunk = max(int(chunk), back + 1, ahead + 1)
    fields = [df.schema[k] for k in keys] + [df.schema[t]]
    schema = T.StructType(
        fields + [T.StructField(n, T._parse_datatype_string(d)) for n, d in outputs.items()]
    )
    names = [*keys, t]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, kind="mergesort", ignore_index=True)
        index = pdf[t].to_numpy()
        core = (index // chunk) == pdf["_chunk"].iloc[0]
        wanted = np.flatnonzero(core & (index % stride == 0))
        if len(wanted) == 0:
            return _nothing(schema)
        out = pdf.loc[wanted, names].copy()
        for name, column in fn(pdf, wanted).items():
            out[name] = list(column) if column.ndim > 1 else column
        return out

    return halo(df, t, back, ahead, chunk).groupBy(*keys, "_chunk").applyInPandas(run, schema)


def frame_map(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    width: int,
    hop: int,
    kernel: Callable[[np.ndarray, np.ndarray, int], np.ndarray],
    offset: int = 0,
    need: int | None = None,
    frames_per_chunk: int = 1024,
    out: str = "x",
) -> DataFrame:
    """Kernel over overlapping frames, many frames per grouped-map call.

    Frame ``j`` covers samples ``[j*hop+offset, j*hop+offset+width)``, zero where
    the recording has none, and exists if ``j*hop + need <= n`` (default: the
    whole frame lies inside the recording). Samples are repeated only where two
    chunks of frames meet, not once per overlapping frame. ``kernel(rows, j, n)``
    maps a ``(frames, width)`` matrix to ``(frames, outputs)``; ``j`` are the
    frame numbers and ``n`` the recording length as far as these frames see it.
    """
    need = offset + width if need is None else need
    per = int(frames_per_chunk)
    pos = F.col(t) - F.lit(offset)
    first = F.greatest(floor_div(pos - F.lit(width) + F.lit(hop), hop), F.lit(0).cast("long"))
    last = floor_div(pos, hop)
    grouped = (
        df.select(*keys, t, F.col(value).cast("double").alias(value))
        .withColumn("_first", floor_div(first, per))
        .withColumn("_last", floor_div(last, per))
        .where(F.col("_last") >= F.col("_first"))
        .withColumn("_chunk", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("frame", T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j0 = int(pdf["_chunk"].iloc[0]) * per
        origin = j0 * hop + offset
        index = pdf[t].to_numpy() - origin
        dense = np.zeros((per - 1) * hop + width)
        dense[index] = pdf[value].to_numpy()
        n_local = origin + int(index.max()) + 1
        count = min(per, (n_local - need) // hop - j0 + 1)
        if count <= 0:
            return _nothing(schema)
        view = np.lib.stride_tricks.sliding_window_view(dense, width)[::hop][:count]
        number = np.arange(j0, j0 + count, dtype=np.int64)
        result = kernel(np.ascontiguousarray(view), number, n_local)
        data = {k: [pdf[k].iloc[0]] * count for k in keys}
        data["frame"] = number
        data[out] = list(result)
        return pd.DataFrame(data)

    return grouped.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def _two_levels(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], **aggregates: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_bucket`` and ``_range``, and the settled table of aggregates per key, bucket and part.

    ``bucket`` must be monotone in ``order``. Buckets are counted; where one is crowded, the rows are dealt to ranges of
    (keys, bucket, order) whose bounds come from a sample, and a bucket's share of a range is a part of its own. The
    ranges are written once, so that every later read and every retried task sees the same bounds.
    """
    by = [*keys, "_bucket", "_range"]
    table = lambda rows: settle(
        rows.groupBy(*by).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in aggregates.items()])
    )
    rows = df.withColumn("_bucket", bucket).withColumn("_range", F.lit(0))
    heads = table(rows)
    most, total = heads.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) > CROWDED:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // CROWDED))
        ranged = rows.drop("_range").repartitionByRange(parts, *keys, "_bucket", *order)
        rows = stage(ranged.withColumn("_range", F.spark_partition_id()))
        heads = table(rows)
    return rows, heads


def _earlier(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy("_bucket", "_range")


def ordinal(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], name: str = "t", weight: str | None = None
) -> DataFrame:
    """0-based dense position inside each key group without sorting a group in one task.

    Rows are numbered per bucket (or part of a crowded one) and shifted by the
    number of rows in earlier ones, which is a prefix sum over the small table
    of counts. With ``weight`` it is the sum of that column over the earlier rows.
    """
    keys = list(keys)
    rows, counts = _two_levels(df, keys, bucket, order, _w=F.sum(weight) if weight else F.count("*"))
    by = [*keys, "_bucket", "_range"]
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before("_w", _earlier(keys))).drop("_n", "_w")
    local = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_rn", before(weight, local) if weight else F.row_number().over(local) - 1)
        .join(offsets, by)
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_bucket", "_range", "_rn", "_before")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the group (NULL for the first).

    Two levels: a prefix maximum over the maxima of buckets (or parts of crowded
    ones), then a window inside each.
    """
    keys = list(keys)
    rows, tops = _two_levels(df, keys, bucket, order, _top=F.max(value))
    by = [*keys, "_bucket", "_range"]
    prior = _earlier(keys).rowsBetween(Window.unboundedPreceding, -1)
    heads = tops.withColumn("_head", F.max("_top").over(prior)).drop("_top", "_n")
    local = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.max(value).over(local))
        .join(heads, by)
        .withColumn(name, F.greatest("_local", "_head"))
        .drop("_bucket", "_range", "_local", "_head")
    )


def previous(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Value of the preceding row of a (possibly sparse) group, two-level like ``ordinal``."""
    keys = list(keys)
    rows, ends = _two_levels(df, keys, bucket, order, _tail=F.max_by(value, F.struct(*order)))
    by = [*keys, "_bucket", "_range"]
    tails = ends.withColumn("_carried", F.lag("_tail").over(_earlier(keys))).drop("_tail", "_n")
    local = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.withColumn("_local", F.lag(value).over(local))
        .withColumn("_rn", F.row_number().over(local))
        .join(tails, by)
        .withColumn(name, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_local")))
        .drop("_bucket", "_range", "_local", "_rn", "_carried")
    )


# Numbers of one matrix of epochs: bounds what a kernel's copies take.
MATRIX = 1 << 20


def epoch_blocks(
    x: np.ndarray, origin: int, n: int, window: int, ext: int, epochs: range
) -> Iterator[np.ndarray]:
    """Epochs ``[eW-ext, (e+1)W+ext)`` as matrices ``(epochs, samples)``, in order.

    ``x`` holds the samples from ``origin`` on. Epochs clipped by an end of the recording ``[0, n)`` come alone,
    the others as strided views without a copy, many at a time.
    """
    length = window + 2 * ext
    per = max(1, MATRIX // length)
    whole = min(max(epochs.start, -(-ext // window)), epochs.stop)
    clipped = max(whole, min(epochs.stop, (n - ext) // window))
    alone = lambda e: x[max(e * window - ext, 0) - origin : min((e + 1) * window + ext, n) - origin][None]
    yield from (alone(e) for e in range(epochs.start, whole))
    for e in range(whole, clipped, per):
        last = min(e + per, clipped)
        part = x[e * window - ext - origin : last * window + ext - origin]
        yield np.lib.stride_tricks.sliding_window_view(part, length)[::window]
    yield from (alone(e) for e in range(clipped, epochs.stop))


def epoch_table(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    window: int,
    parts: Sequence[tuple[int, Callable[[np.ndarray], np.ndarray], Sequence[str]]],
    epochs_per_chunk: int = 256,
) -> DataFrame:
    """Kernels over extended epochs: every part ``(ext, kernel, outputs)`` from one shuffle of the samples.

    ``kernel`` maps a matrix ``(epochs, samples)`` to one ``(epochs, len(outputs))``; a sample that is NULL, NaN or
    absent is NaN there. Epochs that lack a row of their own window (a trailing partial one, a gap) are dropped.
    Samples are repeated only where two chunks of epochs meet, not once per epoch that reaches them.
    """
    per = int(epochs_per_chunk)
    reach = max(ext for ext, _, _ in parts)
    names = [n for _, _, outputs in parts for n in outputs]
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("epoch", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )
    data = df.select(*keys, t, F.col(value).cast("double").alias(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[t].to_numpy()
        origin, n = int(at.min()), int(at.max()) + 1
        first = int(pdf["_chunk"].iloc[0]) * per
        epochs = range(first, max(first, min(first + per, n // window)))
        if len(epochs) == 0:
            return _nothing(schema)
        # Positions before the first sample that this chunk sees are absent.
        origin = min(origin, max(first * window - reach, 0))
        x, there = np.full(n - origin, np.nan), np.zeros(n - origin, bool)
        x[at - origin], there[at - origin] = pdf[value].to_numpy(dtype=float), True
        own = slice(first * window - origin, epochs.stop * window - origin)
        whole = there[own].reshape(len(epochs), window).all(axis=1)
        columns: dict[str, np.ndarray] = {}
        for ext, kernel, outputs in parts:
            blocks = [np.reshape(kernel(m), (len(m), len(outputs))) for m in epoch_blocks(x, origin, n, window, ext, epochs)]
            columns |= dict(zip(outputs, np.concatenate(blocks).astype(float).T, strict=True))
        out = pd.DataFrame({name: columns[name] for name in names})
        out.insert(0, "epoch", np.arange(epochs.start, epochs.stop, dtype=np.int64))
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iloc[0]] * len(out))
        return out[whole]

    return halo(data, t, reach, reach, per * window).groupBy(*keys, "_chunk").applyInPandas(run, schema)


def epoch_map(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    window: int,
    ext: int,
    fn: Callable[[np.ndarray], Sequence[float]],
    outputs: Sequence[str],
    epochs_per_chunk: int = 256,
) -> DataFrame:
    """User function per epoch ``[eW-ext, (e+1)W+ext)`` clipped to the recording, as ``epoch_table`` runs it."""
    each = lambda m: np.array([np.atleast_1d(fn(row)) for row in m], dtype=float)
    return epoch_table(df, keys, t, value, window, [(ext, each, outputs)], epochs_per_chunk)
