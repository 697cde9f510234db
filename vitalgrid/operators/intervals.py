"""Interval joins and interval algebra.

Overlap joins are equi-joins on (record, time bucket): an interval is copied to
the buckets it touches and a pair is emitted only in the bucket where its
overlap begins, so no pair is repeated and no group is paired with itself whole.
Pairs that do not overlap are implicit (overlap 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.model import CHUNK, EPS, layout
from vitalgrid.operators.chunks import floor_div, running_max
from vitalgrid.operators.rolling import close_then_open, runs
from vitalgrid.session import settle, spread, stage


def _bucketed(df: DataFrame, keys, id_, start, stop, bucket, side) -> DataFrame:
    lo, hi = F.col(start), F.col(stop)
    return df.where(hi > lo).select(
        *keys, F.col(id_).alias(f"{side}_id"), lo.alias(f"{side}_start"), hi.alias(f"{side}_stop"),
        F.explode(F.sequence(floor_div(lo, bucket), floor_div(hi, bucket))).alias("_bucket"),
    )


def overlap_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("record",), bucket: float = 3600,
    id_: str = "id", start: str = "start", stop: str = "stop", skip: DataFrame | None = None,
) -> DataFrame:
    """Overlapping pairs with overlap length, IoU and relative start ``b - a``.

    ``bucket`` should be near the usual interval length (same unit as ``start``). Pairs
    whose overlap begins in a bucket of ``skip`` (keys, _bucket) are left out.
    """
    keys = list(keys)
    left = _bucketed(a, keys, id_, start, stop, bucket, "a")
    if skip is not None:
        left = left.join(skip, [*keys, "_bucket"], "left_anti")
    right = _bucketed(b, keys, id_, start, stop, bucket, "b")
    begin = F.greatest("a_start", "b_start")
    inter = F.least("a_stop", "b_stop") - begin
    lengths = (F.col("a_stop") - F.col("a_start")) + (F.col("b_stop") - F.col("b_start"))
    return (
        left.join(right, [*keys, "_bucket"])
        .where((F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop")))
        .where(F.col("_bucket") == floor_div(begin, bucket))
        .withColumn("overlap", inter)
        .withColumn("iou", inter / (lengths - inter + F.lit(EPS)))
        .withColumn("relative_start", F.col("b_start") - F.col("a_start"))
        .drop("_bucket")
    )


def interval_iou(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    return overlap_pairs(a, b, **kw).drop("overlap", "relative_start")


def interval_intersection(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    return overlap_pairs(a, b, **kw).drop("iou", "relative_start")


# Fixed value: relative start of intervals that do not meet.
FAR = 1e6


def relative_start(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("record",), id_: str = "id", **kw) -> DataFrame:
    """Start of every overlapping ``b`` relative to ``a``.

    An ``a`` that meets no ``b`` keeps one row with the sentinel; all other
    missing pairs carry the sentinel implicitly.
    """
    keys = list(keys)
    pairs = overlap_pairs(a, b, keys, id_=id_, **kw).select(
        *keys, "a_id", "b_id", F.col("relative_start").cast("double")
    )
    base = a.select(*keys, F.col(id_).alias("a_id"))
    return base.join(pairs, [*keys, "a_id"], "left").withColumn(
        "relative_start", F.coalesce("relative_start", F.lit(FAR))
    )


def extend_events(intervals: DataFrame, back: float = 0, forward: float = 0) -> DataFrame:
    return intervals.withColumn("start", F.col("start") - F.lit(back)).withColumn(
        "duration", F.col("duration") + F.lit(back + forward)
    )


def event_intervals(intervals: DataFrame, keys: Sequence[str] = ("record", "label")) -> DataFrame:
    """One ``[start, stop]`` row per event, keyed by record and class."""
    return intervals.select(*keys, "start", (F.col("start") + F.col("duration")).alias("stop"))


def _aligned(intervals: DataFrame, resolution: float, keys) -> DataFrame:
    """Interval ends floored to the resolution, in seconds."""
    floored = lambda c: F.floor(c / F.lit(resolution)) * F.lit(resolution)
    start = F.col("start")
    return intervals.select(
        *keys, "label", floored(start).cast("double").alias("start"),
        floored(start + F.col("duration")).cast("double").alias("stop"),
    )


def _reaching(
    events: DataFrame, intervals: DataFrame, keys: Sequence[str], threshold: float, strict: bool, bucket: float
) -> DataFrame:
    """Distinct event spans overlapped by some interval of their key by at least ``threshold``.

    An overlap of ``h`` means ``start_i <= stop_e - h`` and ``stop_i >= start_e + h``
    (both lengths being at least ``h``), so it is enough to know the largest stop
    among the intervals starting early enough: a running maximum over one sorted
    union, with no pairs at all. Copies are collapsed before the sort.
    """
    keys = list(keys)
    span = F.col("stop") - F.col("start")
    long_ = span > threshold if strict else span >= threshold
    spans = events.select(*keys, F.col("start").cast("double"), F.col("stop").cast("double")).where(long_).distinct()
    ask = spans.select(*keys, "start", "stop", (F.col("stop") - threshold).alias("_at"), F.lit(0 if strict else 1).alias("_side"))
    tops = intervals.where(long_).groupBy(*keys, "start").agg(F.max("stop").alias("_top"))
    know = tops.select(*keys, F.col("start").alias("_at"), F.lit(0 if not strict else 1).alias("_side"), "_top")
    both = ask.unionByName(know, allowMissingColumns=True)
    seen = running_max(
        both, keys, floor_div(F.col("_at"), bucket), ["_at", "_side", "start", "stop"], "_top", "_seen"
    ).where(F.col("start").isNotNull())
    need = F.col("start") + threshold
    hit = F.col("_seen") > need if strict else F.col("_seen") >= need
    return seen.where(hit).select(*keys, "start", "stop")


def discard_overlap(
    events: DataFrame, intervals: DataFrame, threshold: float, resolution: float = 1,
    keys: Sequence[str] = ("record",), bucket: float = 3600,
) -> DataFrame:
    """Drop events overlapping any discard interval by ``threshold`` (> 0) seconds or more."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    hit = _reaching(events, _aligned(intervals, resolution, keys), keys, threshold, False, bucket)
    return events.join(hit, [*keys, "start", "stop"], "left_anti")


def select_overlap(
    events: DataFrame, intervals: DataFrame, threshold: float, resolution: float = 1,
    keys: Sequence[str] = ("record",), bucket: float = 3600,
) -> DataFrame:
    """Keep events overlapping an interval of every select label of their record by more than ``threshold`` (>= 0).

    Records without select intervals keep all their events.
    """
    keys = list(keys)
    wanted = _aligned(intervals, resolution, keys)
    labels = wanted.select(*keys, "label").distinct()
    spans = events.select(*keys, "start", "stop").distinct()
    hit = _reaching(spans.join(labels, keys), wanted, [*keys, "label"], threshold, True, bucket)
    # A span fails when some label of its record does not reach it.
    failed = spans.join(labels, keys).join(hit, [*keys, "label", "start", "stop"], "left_anti")
    return events.join(failed.select(*keys, "start", "stop").distinct(), [*keys, "start", "stop"], "left_anti")


def pairs(df: DataFrame, item: str, declared: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of those ``declared`` items (class or channel names) that occur in a key.

    The list is part of a specification, so its size is that of the
    configuration and not of the data; nothing is gathered.
    """
    names = sorted(set(declared))
    keys = list(keys)
    here = df.where(F.col(item).isin(names)).select(*keys, F.col(item).alias("first")).distinct()
    later = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: n > F.col("first"))
    both = here.select(*keys, "first", F.explode(later).alias("second"))
    return both.join(here.withColumnRenamed("first", "second"), [*keys, "second"]).select(*keys, "first", "second")


# ---- grids ---------------------------------------------------------------------------


def cell_span(a: Column, b: Column, size, so: float) -> tuple[Column, Column]:
    """First cell and exclusive last cell of an event given in cell units.

    A border cell counts when at least a share ``so`` of it is covered; ties round
    half to even.
    """
    first = F.when(a - F.floor(a) <= F.lit(1 - so), F.floor(a)).otherwise(F.rint(a)).cast("long")
    last = F.when(b - F.floor(b) >= F.lit(so), F.floor(b) + 1).otherwise(F.rint(b)).cast("long")
    return first, F.least(last, F.lit(size).cast("long"))


def grid_cells(
    events: DataFrame, size: int, so: float = 0.25, keys: Sequence[str] = ("record",),
    start: str = "start", stop: str = "stop",
) -> DataFrame:
    """Cells set by events whose ends are fractions of the output (one row per event and cell)."""
    a, b = F.col(start) * F.lit(size), F.col(stop) * F.lit(size)
    kept = events.where(((b - a) > so) & (F.col(start) < 1) & (F.col(stop) <= 1))
    first, last = cell_span(a, b, size, so)
    return kept.select(*keys, F.explode(F.when(first < last, F.sequence(first, last - 1))).alias("cell"))


def semantic_grid(
    events: DataFrame, records: DataFrame, size: int, so: float = 0.25, keys: Sequence[str] = ("record",),
    start: str = "start", stop: str = "stop",
) -> DataFrame:
    """0/1 grid of ``size`` cells for every record."""
    cells = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    zero = records.select(*keys, F.explode(cells).alias("cell"), F.lit(0).alias("y"))
    one = grid_cells(events, size, so, keys, start, stop).withColumn("y", F.lit(1))
    return zero.unionByName(one).groupBy(*keys, "cell").agg(F.max("y").alias("y"))


def inverse_events(
    events: DataFrame, size: int, keys: Sequence[str] = ("record",), start: str = "start", stop: str = "stop",
    chunk: int = CHUNK,
) -> DataFrame:
    """Cell runs not covered by events; with no required overlap an integer stop fills one extra cell."""
    keys = list(keys)
    scaled = events.join(
        events.groupBy(*keys).agg((F.max(F.greatest(start, stop)) > 1).alias("_cells")), keys
    )
    part = lambda c: F.when(F.col("_cells"), F.col(c) / F.lit(size)).otherwise(F.col(c))
    scaled = scaled.select(*keys, part(start).alias(start), part(stop).alias(stop))
    grid = semantic_grid(scaled, events.select(*keys).distinct(), size, 0.0, keys, start, stop)
    return runs(grid.withColumn("_off", 1 - F.col("y")), "_off", keys, "cell", chunk)


# ---- scores to events --------------------------------------------------------------------


def score_runs(
    scores: DataFrame, threshold: float, merge_size: int, min_len: int, resolution: float,
    keys: Sequence[str] = ("record", "win", "class"), cell: str = "cell", score: str = "score",
    offset: str | None = "win_start", chunk: int = CHUNK,
) -> DataFrame:
    """Threshold, closing and opening, runs, mean raw score per run, absolute seconds."""
    keys = list(keys)
    extra = [offset] if offset else []
    base = scores.select(*keys, *extra, cell, score).withColumn("_on", (F.col(score) > threshold).cast("int"))
    clean = close_then_open(base, merge_size, min_len, layout(keys, cell, "_on"), chunk)
    ones = clean.withColumn("_one", F.lit(1))
    shift = [F.col(offset)] if offset else []
    got = runs(ones, "_on", [*keys, *extra], cell, chunk, sums=[score, "_one"])
    base_time = shift[0] if shift else F.lit(0)
    return got.select(
        *keys, *extra,
        (F.col("start") * F.lit(resolution) + base_time).cast("double").alias("start"),
        (F.col("stop") * F.lit(resolution) + base_time).cast("double").alias("stop"),
        (F.col(score) / F.col("_one")).alias("score"),
    )


def stitch_windows(
    scores: DataFrame, keys: Sequence[str] = ("record", "class"), epoch: str = "epoch",
    start: str = "win_start", win: str | None = None, values: Sequence[str] = ("y_pred",),
) -> DataFrame:
    """One value per epoch from overlapping windows: the earliest window wins.

    Ties between starts go to the smaller window number. NULL values do not take part.
    """
    order = F.col(start) if win is None else F.struct(start, win)
    first = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), order))
    return scores.groupBy(*keys, epoch).agg(*[first(v).alias(v) for v in values])


# Epochs of a group that a task stitches together.
SLICE = 1024


def stitch_spans(
    spans: DataFrame, resolution: int, value: Callable[[Column], Column], keys: Sequence[str] = ("record", "class"),
    epoch: str = "epoch", start: str = "win_start", win: str = "win", name: str = "y",
) -> DataFrame:
    """``stitch_windows`` of the cells ``[first, last)`` of windows, with ``value`` of the cell.

    Spans are shuffled, by slices of epochs, and unfold to cells behind the shuffle, in as many tasks as it has.
    """
    base = floor_div(F.col(start), resolution)
    low, high = base + F.col("first"), base + F.col("last") - 1
    parts = spans.withColumn("_slice", F.explode(F.sequence(floor_div(low, SLICE), floor_div(high, SLICE))))
    inside = F.sequence(F.greatest(low, F.col("_slice") * SLICE), F.least(high, (F.col("_slice") + 1) * SLICE - 1))
    cells = spread(parts, *keys, "_slice").withColumn(epoch, F.explode(inside))
    timed = cells.withColumn(name, value(F.col(epoch) - base))
    return stitch_windows(timed, [*keys, "_slice"], epoch, start, win, [name]).drop("_slice")


def combine_append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append rows; columns missing on one side are NULL."""
    return first.unionByName(second, allowMissingColumns=True)


def combine_overwrite(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``second`` replace those of ``first`` with the same key."""
    kept = first.join(second.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(second, allowMissingColumns=True)


def hard_top_k(
    df: DataFrame, order: str, k: int, group: Sequence[str] = (), spread: str | None = None, salts: int = 64
) -> DataFrame:
    """The ``k`` rows with the smallest ``order`` (the hardest losses).

    Grouped: ranks are first taken inside salted slices of each group, so a hot
    group is cut to ``salts * k`` rows before it meets in one task.
    """
    if not group:
        return df.orderBy(order).limit(k)
    group = list(group)
    salt = F.pmod(F.xxhash64(spread or order), F.lit(salts))
    for by in ([*group, "_salt"], group):
        w = Window.partitionBy(*by).orderBy(order)
        df = df if "_salt" in df.columns else df.withColumn("_salt", salt)
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    return df.drop("_salt")


# ---- non-maximum suppression ------------------------------------------------------------

# Events of one overlapping stretch, or of one time bucket, that a task handles by itself.
LOCAL_STRETCH = 10_000
LOCAL_BUCKET = 200_000


def stretches(
    events: DataFrame, keys: Sequence[str], bucket: float, start: str = "start", stop: str = "stop", id_: str = "id"
) -> DataFrame:
    """Mark connected stretches of overlapping events (``_stretch`` = start of the first one)."""
    order = [start, stop, id_]
    b = floor_div(F.col(start), bucket)
    reached = running_max(events, keys, b, order, stop, "_reach")
    head = F.col("_reach").isNull() | (F.col(start) >= F.col("_reach"))
    heads = reached.withColumn("_opens", F.when(head, F.col(start))).drop("_reach")
    seen = running_max(heads, keys, b, order, "_opens", "_seen")
    return seen.withColumn("_stretch", F.greatest("_opens", "_seen")).drop("_opens", "_seen")


def greedy_keep(start: Sequence[float], stop: Sequence[float], overlap: float) -> list[bool]:
    """Best-first suppression of one small stretch whose rows are listed best first."""
    start, stop = np.asarray(start, float), np.asarray(stop, float)
    keep = np.ones(len(start), dtype=bool)
    for i in range(len(start)):
        if keep[i]:
            inter = np.minimum(stop[i], stop[i + 1 :]) - np.maximum(start[i], start[i + 1 :])
            union = stop[i] - start[i] + stop[i + 1 :] - start[i + 1 :] - inter
            hit = inter > 0
            hit[hit] = inter[hit] / union[hit] > overlap
            keep[i + 1 :] &= ~hit
    return keep.tolist()


def nms(
    events: DataFrame, overlap: float = 0.5, keys: Sequence[str] = ("record", "class"), bucket: float = 3600,
    local_stretch: int = LOCAL_STRETCH, local_bucket: int = LOCAL_BUCKET,
) -> DataFrame:
    """Greedy suppression by score within each key (``id`` must be unique per key).

    Stretches of overlapping events are independent: those of counted size up to
    ``local_stretch`` are solved inside the partition that holds them. Larger
    ones, and tables with a time bucket too crowded to be sorted in one task, go
    through ``champion_rounds``, which gives the same result. The events are
    written once, as they are read several times.
    """
    keys = list(keys)
    events = stage(events)
    crowd = events.groupBy(*keys, floor_div(F.col("start"), bucket)).count().agg(F.max("count")).first()[0]
    if (crowd or 0) > local_bucket:
        return champion_rounds(events, overlap, keys)
    marked = stretches(events, keys, bucket)
    by = [*keys, "_stretch"]
    sizes = marked.groupBy(*by).agg(F.count("*").alias("_size"))
    sized = settle(marked.join(sizes, by))
    small = sized.where(F.col("_size") <= local_stretch)
    large = sized.where(F.col("_size") > local_stretch)
    kept = _local(small, by, overlap, events.schema)
    if large.limit(1).count():
        kept = kept.unionByName(champion_rounds(large.select(*events.columns), overlap, keys))
    return kept


def _local(df: DataFrame, by: list[str], overlap: float, schema) -> DataFrame:
    """Stream sorted stretches through a partition, holding one stretch back at batch ends."""
    names = schema.names

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        up = [True] * len(by)
        pdf = pdf.sort_values([*by, "score", "start", "stop", "id"], ascending=[*up, False, True, True, True])
        changed = np.ones(len(pdf), dtype=bool)
        changed[1:] = False
        for k in by:
            column = pdf[k].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        edges = [*np.flatnonzero(changed).tolist(), len(pdf)]
        start, stop = pdf["start"].astype(float).tolist(), pdf["stop"].astype(float).tolist()
        keep = np.ones(len(pdf), dtype=bool)
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                keep[a:b] = greedy_keep(start[a:b], stop[a:b], overlap)
        return pdf.loc[keep, names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = np.ones(len(held), dtype=bool)
            for k in by:
                same &= (held[k] == held[k].iloc[-1]).to_numpy()
            ready, held = held[~same], held[same].reset_index(drop=True)
            if len(ready):
                yield solve(ready.reset_index(drop=True))
        if held is not None and len(held):
            yield solve(held)

    placed = df.repartition(*by).sortWithinPartitions(*by)
    return placed.mapInPandas(run, schema)


def champion_rounds(events: DataFrame, overlap: float, keys: Sequence[str]) -> DataFrame:
    """The greedy rule in parallel rounds of linear cost.

    Events live in cells of (length class, position on a grid of that length).
    Two events can only conflict when their cells are neighbours: IoU bounds the
    ratio of lengths, and overlap bounds the distance. Each round takes the best
    event of every cell (a partial aggregate, so copies and crowds collapse
    before the shuffle); a champion that beats the champions of all neighbouring
    cells is kept, and the events it suppresses are removed. A row meets at most
    one kept champion per neighbouring cell, so no pairs within a crowd are
    formed. Every round decides at least the best remaining event of each key.
    """
    keys = list(keys)
    spread = 64 if overlap <= 0 else int(np.ceil(np.log2(1 / overlap))) + 1
    length = F.col("stop") - F.col("start")
    level = F.floor(F.log2(length)).cast("long")
    cell = [*keys, "_level", "_slot"]
    grid = lambda at, lv: F.floor(at / F.pow(F.lit(2.0), lv)).cast("long")
    left = settle(
        events.where(length > 0).withColumn("_level", level)
        .withColumn("_slot", grid(F.col("start"), F.col("_level")))
    )
    levels = left.agg(F.min("_level"), F.max("_level")).first()
    out = events.where(length <= 0)

    def neighbours(champions: DataFrame) -> DataFrame:
        """Champions repeated for every cell whose events they may conflict with."""
        near = F.sequence(
            F.greatest(F.col("_level") - spread, F.lit(levels[0])), F.least(F.col("_level") + spread, F.lit(levels[1]))
        )
        c = champions.withColumn("_near", F.explode(near))
        reach = F.pow(F.lit(2.0), F.col("_near") + 1)
        slots = F.sequence(grid(F.col("_best.start") - reach, F.col("_near")), grid(F.col("_best.stop"), F.col("_near")))
        c = c.withColumn("_at", F.explode(slots))
        return c.select(*keys, F.col("_near").alias("_level"), F.col("_at").alias("_slot"), F.col("_best").alias("_by"))

    # Best first: falling score, then start, stop and id; a missing score comes last.
    score = F.when(~F.isnan(F.col("score").cast("double")), F.col("score"))
    best = F.struct(score.isNull().alias("_none"), (-score).alias("_score"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), F.col("id").alias("id"))
    while left.limit(1).count():
        champions = left.groupBy(*cell).agg(F.min(best).alias("_best"))
        beaten = (
            champions.join(neighbours(champions), cell).where(F.col("_by") < F.col("_best")).select(*cell).distinct()
        )
        winners = settle(champions.join(beaten, cell, "left_anti"))
        kept = winners.select(*keys, F.col("_best.id").alias("id"))
        out = out.unionByName(left.join(kept, [*keys, "id"], "left_semi").select(*events.columns))
        # Few winners can stand next to a cell; rows are checked against each.
        inter = F.least(F.col("stop"), F.col("_by.stop")) - F.greatest(F.col("start"), F.col("_by.start"))
        union = length + (F.col("_by.stop") - F.col("_by.start")) - inter
        gone = (F.col("id") == F.col("_by.id")) | (F.greatest(inter, F.lit(0.0)) / union > overlap)
        near = left.select(*cell, "id", "start", "stop").join(neighbours(winners), cell)
        dropped = near.where(gone).select(*keys, "id").distinct()
        left = settle(left.join(dropped, [*keys, "id"], "left_anti"))
    return out
