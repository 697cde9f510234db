"""Window index, window contents, labels and masks, splits, batches and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import seeded
from vitalgrid.operators.chunks import floor_div, ordinal, running_max
from vitalgrid.operators.intervals import cell_span
from vitalgrid.session import attach, settle, spread, stage


def window_index(extents: DataFrame, window: int, overlap: float, record: str = "record") -> DataFrame:
    """Overlapping windows of every record plus a tail window at its end.

    Record length is clipped to 30 s; the tail may repeat the last regular window. Records are spread first: a table
    of extents is small, what comes of it is not.
    """
    step = float(window * (1 - overlap))
    clipped = F.col("extent") - F.pmod(F.col("extent"), F.lit(30))
    count = F.greatest(F.floor((clipped - window) / F.lit(step)) + 1, F.lit(1))
    top = F.greatest(clipped - window, F.lit(0)).cast("long")
    starts = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.floor(i * F.lit(step))),
        F.array(top),
    )
    return spread(extents, record).select(record, top.alias("max_index"), F.posexplode(starts).alias("win", "start")).select(
        record, "win", F.col("start").cast("long"), "max_index"
    )


def record_windows(windows: DataFrame, record_id, record: str = "record") -> DataFrame:
    return windows.where(F.col(record) == record_id).orderBy("win")


def window_samples(
    samples: DataFrame, windows: DataFrame, window: int, fs: float, record: str = "record",
    features: Sequence[str] = (), t: str = "t", value: str = "value", sampled: str | None = None,
) -> DataFrame:
    """Samples of each window at positions ``0..W*fs-1``; a position without a sample is zero.

    ``sampled`` names a boolean column that tells samples (also those of value zero) from padding.

    A sample meets only the windows listed for its time bucket; padding rows are
    generated for the missing positions alone: gaps, ends, and windows of records
    without any sample (for every feature combination there is).
    """
    rows_ = int(window * fs)
    w = windows.withColumn("_a", F.floor(F.col("start") * F.lit(fs)).cast("long"))
    w = w.withColumn("_b", F.floor((F.col("start") + window) * F.lit(fs)).cast("long"))
    spread = w.withColumn(
        "_bucket", F.explode(F.sequence(floor_div(F.col("_a"), rows_), floor_div(F.col("_b") - 1, rows_)))
    )
    s = samples.select(record, *features, t, value).withColumn("_bucket", floor_div(F.col(t), rows_))
    inside = s.join(spread, [record, "_bucket"]).where((F.col(t) >= F.col("_a")) & (F.col(t) < F.col("_b")))
    got = inside.select(
        record, "win", *features, (F.col(t) - F.col("_a")).cast("long").alias("pos"), F.col(value).cast("double").alias(value)
    )
    features = list(features)
    slot = [record, "win", *features]
    own = samples.select(record, *features).distinct()
    every = windows.select(record, "win")
    slots = every.join(own, record)
    bare = every.join(own.select(record).distinct(), record, "left_anti")
    if features:
        # The combinations are those of channel and feature names, a handful.
        names = own.select(*features).distinct().agg(F.collect_list(F.struct(*features)).alias("_f"))
        named = bare.withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k")
        bare = named.select(record, "win", F.explode("_f").alias("_f")).select(record, "win", *[F.col(f"_f.{c}").alias(c) for c in features])
    slots = slots.select(*slot).unionByName(bare.select(*slot))
    filled = got.groupBy(*slot).agg(F.count_distinct("pos").alias("_n"))
    short = slots.join(filled, slot, "left").where(F.coalesce("_n", F.lit(0)) < rows_).select(*slot)
    wanted = short.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows_ - 1).cast("long"))))
    pad = wanted.join(got.select(*slot, "pos"), [*slot, "pos"], "left_anti").withColumn(value, F.lit(0.0))
    if sampled is not None:
        got, pad = got.withColumn(sampled, F.lit(True)), pad.withColumn(sampled, F.lit(False))
    return got.unionByName(pad)


def attach_features(
    df: DataFrame, signals: Sequence[str], keys: Sequence[str] = ("record", "t"), signal: str = "signal", value: str = "value"
) -> DataFrame:
    """One column per signal at every key where all signals are present (one shuffle)."""
    picked = [F.max(F.when(F.col(signal) == s, F.col(value))).alias(str(s)) for s in signals]
    out = df.where(F.col(signal).isin(list(signals))).groupBy(*keys).agg(*picked)
    return out.dropna(subset=[str(s) for s in signals])


# ---- labels ---------------------------------------------------------------------------------


# Windows and events are shuffled once, by record and slab; a slab is so many window lengths of window starts.
SLAB = 8


def _calendar(windows: DataFrame, window: int, record: str, keep: Sequence[str] = ()) -> DataFrame:
    """(record, win, win_start, slab) of every window."""
    start = F.col("start")
    return windows.select(
        record, "win", start.alias("win_start"), floor_div(start, SLAB * window).alias("slab"), *keep
    )


def _events(intervals: DataFrame, window: int, minimum_duration: float, record: str) -> DataFrame:
    """Events (``_s``, ``_e`` in absolute seconds) in each slab with window starts they may meet: above s - W, below e."""
    e = intervals.where(F.col("duration") > minimum_duration).select(
        record, "label", "kind", F.col("start").alias("_s"), (F.col("start") + F.col("duration")).alias("_e")
    )
    first, last = floor_div(F.col("_s") - window, SLAB * window), floor_div(F.col("_e"), SLAB * window)
    return e.withColumn("slab", F.explode(F.sequence(first, last)))


def _meet(w: DataFrame, e: DataFrame, window: int, record: str, how: str = "inner") -> DataFrame:
    """Pairs of windows and events that overlap, each in the slab of its window."""
    e = e.withColumnsRenamed({record: "_record", "slab": "_slab"})
    on = (F.col(record) == F.col("_record")) & (F.col("slab") == F.col("_slab"))
    over = (F.col("_s") < F.col("win_start") + F.lit(window)) & (F.col("_e") > F.col("win_start"))
    return w.join(e, on & over, how).drop("_record", "_slab")


def window_overlaps(
    windows: DataFrame, intervals: DataFrame, window: int, minimum_duration: float = 10, record: str = "record"
) -> DataFrame:
    """Events meeting each window (``_s``, ``_e`` in absolute seconds).

    Both sides are keyed by slab; a window lies in one, so a pair is found once. An event is tried against the windows
    of its slab, a fixed multiple of those it can meet.
    """
    return _meet(_calendar(windows, window, record), _events(intervals, window, minimum_duration, record), window, record)


def window_hits(
    windows: DataFrame, intervals: DataFrame, window: int, resolution: float, so: float | None = None,
    minimum_duration: float = 10, record: str = "record",
) -> DataFrame:
    """Cell spans of each window set by each overlapping event (not yet exploded)."""
    so = 7.5 / resolution if so is None else so
    met = window_overlaps(windows, intervals, window, minimum_duration, record)
    return _spans(met, int(window // resolution), resolution, so).where("_hit").select(
        record, "win", "win_start", "label", "kind", "first", "last"
    )


def _spans(met: DataFrame, n: int, resolution: float, so: float) -> DataFrame:
    """Adds ``first`` and ``last`` (exclusive) cell an event sets in its window, and ``_hit``: whether it sets any."""
    a = F.greatest((F.col("_s") - F.col("win_start")) / F.lit(float(resolution)), F.lit(0.0))
    b = F.least((F.col("_e") - F.col("win_start")) / F.lit(float(resolution)), F.lit(float(n)))
    first, last = cell_span(F.col("_a"), F.col("_b"), n, so)
    spans = met.withColumns({"_a": a, "_b": b}).withColumns({"first": first, "last": last})
    return spans.withColumn("_hit", (F.col("_b") - F.col("_a") > so) & (F.col("first") < F.col("last")))


# Cells packed into one integer while labels are aggregated.
WORD = 32


def label_bits(
    windows: DataFrame, intervals: DataFrame, classes: Sequence[str], window: int, resolution: float,
    so: float | None = None, use_mask: bool = True, minimum_duration: float = 10, record: str = "record",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The label grid as bits, all classes in one row: (record, slab, win, win_start, *keep, word, events, mask, cells).

    ``events`` has a word for each class, in their order; ``keep`` names columns of ``windows`` to carry along. Windows
    and events are shuffled once, by record and slab: windows unfold to words behind their shuffle, meet their events
    there and are aggregated where they are, so neither the words nor the dense grid is shuffled.
    """
    so = 7.5 / resolution if so is None else so
    n = int(window // resolution)
    last = (n - 1) // WORD
    words = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    calendar = spread(_calendar(windows, window, record, keep), record, "slab")
    units = calendar.select("*", F.explode(words).alias("word"))
    wanted = ((F.col("kind") == "event") & F.col("label").isin(list(classes))) | (
        (F.col("kind") == "mask") if use_mask else F.lit(False)
    )
    e = _events(intervals.where(wanted), window, minimum_duration, record).withColumnsRenamed({record: "_record", "slab": "_slab"})
    # A cell of margin: which cells of a word are set is settled below.
    at, reach = F.col("win_start") + F.col("word") * F.lit(WORD * resolution), F.lit(resolution)
    near = (F.col("_s") <= at + F.lit(WORD * resolution) + reach) & (F.col("_e") >= at - reach)
    over = (F.col("_s") < F.col("win_start") + F.lit(window)) & (F.col("_e") > F.col("win_start"))
    on = (F.col(record) == F.col("_record")) & (F.col("slab") == F.col("_slab"))
    met = _spans(units.join(e, on & over & near, "left"), n, resolution, so)
    met = met.withColumn("_lo", F.greatest(F.col("first") - F.col("word") * WORD, F.lit(0)).cast("int"))
    met = met.withColumn("_hi", F.least(F.col("last") - F.col("word") * WORD, F.lit(WORD)).cast("int"))
    met = met.withColumn(
        "_bits", F.when(F.col("_hit") & (F.col("_lo") < F.col("_hi")), F.expr("shiftleft(shiftleft(1L, _hi - _lo) - 1L, _lo)"))
    )
    none = F.lit(0).cast("long")
    of = lambda here: F.bit_or(F.coalesce(F.when(here, F.col("_bits")), none))
    event = [of((F.col("kind") == "event") & (F.col("label") == c)).alias(f"_e{i}") for i, c in enumerate(classes)]
    packed = met.groupBy(record, "slab", "win", "win_start", *keep, "word").agg(*event, of(F.col("kind") == "mask").alias("mask"))
    cells = F.least(F.lit(WORD).cast("long"), F.lit(n) - F.col("word") * WORD)
    return packed.select(
        record, "slab", "win", "win_start", *keep, "word",
        F.array(*[F.col(f"_e{i}") for i in range(len(classes))]).alias("events"), "mask", cells.alias("cells"),
    )


def label_words(
    windows: DataFrame, intervals: DataFrame, classes: Sequence[str], window: int, resolution: float,
    so: float | None = None, use_mask: bool = True, minimum_duration: float = 10, record: str = "record",
) -> DataFrame:
    """The label grid as bits, a row per class: (record, slab, win, win_start, class, word, event, mask, cells).

    Bit k of a word stands for cell ``32 word + k``; ``cells`` is the number of cells of the word. Rows lie by record and
    slab: with both among its keys, a grouping needs no shuffle.
    """
    bits = label_bits(windows, intervals, classes, window, resolution, so, use_mask, minimum_duration, record)
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.get("events", F.lit(i)).alias("event")) for i, c in enumerate(classes)])
    return bits.select(record, "slab", "win", "win_start", "word", "mask", "cells", F.explode(each).alias("_c")).select(
        record, "slab", "win", "win_start", "_c.class", "word", "_c.event", "mask", "cells"
    )


def _places(bits: Column) -> Column:
    """Sum of the places of the set bits of a word: each binary digit of a place is counted over the word."""
    digit = lambda k: sum(1 << p for p in range(WORD) if p >> k & 1)
    return sum(
        (F.bit_count(bits.bitwiseAND(F.lit(digit(k)).cast("long"))) * F.lit(1 << k) for k in range(WORD.bit_length() - 1)),
        F.lit(0).cast("long"),
    )


def label_counts(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of a bit grid per group that are 1, 0 and masked, and the sum of cell number times value; counted on the bits."""
    all_cells = F.expr("shiftleft(1L, cast(cells as int)) - 1L")
    off = F.col("mask").bitwiseAND(all_cells)
    on = F.col("event").bitwiseAND(F.bitwise_not("mask")).bitwiseAND(all_cells)
    masked, ones = F.bit_count(off), F.bit_count(on)
    place = F.col("word") * WORD * (ones - masked) + _places(on) - _places(off)
    return words.groupBy(*by).agg(
        F.sum(ones).alias("ones"), F.sum(F.col("cells") - ones - masked).alias("zeros"), F.sum(masked).alias("masked"),
        F.sum(place).alias("place"),
    )


def window_labels(
    windows: DataFrame, intervals: DataFrame, classes: Sequence[str], window: int, resolution: float,
    so: float | None = None, use_mask: bool = True, minimum_duration: float = 10, record: str = "record",
) -> DataFrame:
    """Full (window, class, cell) grid: 1 where an event of the class covers the cell, 0
    elsewhere, -1 in every class where a mask event covers it.

    The cells are unpacked from the words of ``label_words``, after its shuffle.
    """
    packed = label_words(windows, intervals, classes, window, resolution, so, use_mask, minimum_duration, record)
    cells = packed.withColumn("cell", F.explode(F.sequence(F.col("word") * WORD, F.col("word") * WORD + F.col("cells") - 1)))
    bit = f"cast(cell - word * {WORD} as int)"
    masked, hit = (F.expr(f"shiftright({c}, {bit}) & 1L = 1L") for c in ("mask", "event"))
    y = F.when(masked, F.lit(-1.0)).when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
    return cells.select(record, "win", "win_start", "class", "cell", y.alias("y_true"))


def any_event(
    windows: DataFrame, intervals: DataFrame, window: int, minimum_duration: float = 10, record: str = "record"
) -> DataFrame:
    """1 for windows meeting at least one event longer than the minimum, else 0.

    Windows and events are shuffled once, by record and slab.
    """
    events = _events(intervals.where(F.col("kind") == "event"), window, minimum_duration, record)
    calendar = spread(_calendar(windows, window, record), record, "slab")
    met = _meet(calendar, events, window, record, "left")
    hit = F.max(F.col("_s").isNotNull().cast("int"))
    return met.groupBy(record, "slab", "win", "win_start").agg(hit.alias("y")).select(record, "win", "y")


# Display order of the stages, deepest first.
STAGE_CODES = {"deep": 0, "light": 1, "rem": 2, "wake": 3}


def stage_order(
    epochs: DataFrame, keys: Sequence[str] = ("record", "epoch"), score: str = "y", cls: str = "class",
    mask: str | None = None, codes: dict[str, int] | None = None,
) -> DataFrame:
    """Code of the strongest stage per epoch (first one on a tie), -1 where masked."""
    codes = STAGE_CODES if codes is None else codes
    code = F.element_at(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv]), F.col(cls))
    best = F.max_by("_code", F.struct(F.col(score), -F.col("_code")))
    masked = F.max(F.col(mask).cast("int")) == 1 if mask else F.lit(False)
    return epochs.withColumn("_code", code).groupBy(*keys).agg(
        F.when(masked, F.lit(-1)).otherwise(best).cast("int").alias("stage")
    )


# ---- splits and batches ---------------------------------------------------------------------


def _hash_order(df: DataFrame, order: Column, rest: Sequence[str], name: str) -> DataFrame:
    """Global position by a hash; the first three hex digits are the buckets."""
    hashed = df.withColumn("_h", order)
    return ordinal(hashed, [], F.substring("_h", 1, 3), ["_h", *rest], name).drop("_h")


def split_records(
    records: DataFrame, percent_test: float, percent_validation: float, seed: int, record: str = "record"
) -> DataFrame:
    """Exact-size test, validation and train split, independent of input order."""
    ids = records.select(record).distinct()
    n = ids.count()
    n_test = int(n * percent_test / 100)
    n_valid = int((n - n_test) * percent_validation / 100)
    key = lambda tag: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(record).cast("string")))
    first = _hash_order(ids, key("test"), [record], "_p")
    test = first.where(F.col("_p") < n_test).select(record, F.lit("test").alias("split"))
    rest = _hash_order(first.where(F.col("_p") >= n_test).select(record), key("validation"), [record], "_p")
    split = F.when(F.col("_p") < n_valid, "validation").otherwise("train")
    return test.unionByName(rest.select(record, split.alias("split")))


def batch(
    windows: DataFrame, batch_size: int, max_batches: int | None = None, record: str = "record", drop_last: bool = True
) -> DataFrame:
    """Consecutive windows as ``(batch_id, slot)``.

    Records follow each other by the hash of their id, windows by number. All windows are dealt out unless
    ``max_batches`` asks for fewer; ``drop_last`` leaves out an incomplete last batch.
    """
    pos = _hash_order(windows, F.md5(F.col(record).cast("string")), [record, "win"], "_p")
    n = windows.count()
    full = n // batch_size if drop_last else -(-n // batch_size)
    full = full if max_batches is None else min(full, max_batches)
    return (
        pos.withColumn("batch_id", floor_div(F.col("_p"), batch_size))
        .withColumn("slot", F.pmod(F.col("_p"), F.lit(batch_size)).cast("int"))
        .where(F.col("batch_id") < full)
        .drop("_p")
    )


# ---- sampling --------------------------------------------------------------------------------


def event_index(intervals: DataFrame, windows: DataFrame, record: str = "record") -> DataFrame:
    """Every event with the largest window start of its record."""
    top = windows.groupBy(record).agg(F.max("max_index").alias("max_index"))
    return attach(intervals, top, [record], "start")


def balanced_sample(
    events: DataFrame, draws: int, probabilities: dict[str, float], window: int, seed: int, record: str = "record",
    id_: str = "event_id",
) -> DataFrame:
    """Seeded class-balanced window starts around events.

    ``events`` is ``event_index`` output. A draw picks a class, then one of its
    events by ordinal; draws that fall into the remaining probability are left to
    ``background_sample`` and absent here.
    """
    if sum(probabilities.values()) > 1 + 1e-9:
        raise ValueError("probabilities exceed 1")
    numbered = ordinal(
        events.where(F.col("label").isin(list(probabilities))), ["label"], floor_div(F.col("start"), 86_400),
        ["start", id_], "_pos",
    )
    counts = events.groupBy("label").agg(F.count("*").alias("_count"))
    spark = events.sparkSession
    u, low, label = F.col("_u"), 0.0, F.lit(None).cast("string")
    for name, p in probabilities.items():
        label = F.when((u >= low) & (u < low + p), F.lit(name)).otherwise(label)
        low += p
    d = spark.range(draws).withColumnRenamed("id", "draw")
    d = d.withColumn("_u", seeded.uniform(seed, "class", F.col("draw"))).withColumn("label", label)
    d = attach(d.where(F.col("label").isNotNull()), counts, ["label"], "draw")
    pick = F.floor(seeded.uniform(seed, "event", F.col("draw")) * F.col("_count")).cast("long")
    hit = d.withColumn("_pos", pick).join(numbered, ["label", "_pos"])
    s, dur, top = F.col("start"), F.col("duration"), F.col("max_index")
    low_ = F.greatest(s - (F.lit(window) - dur), F.lit(0))
    uniform_start = seeded.integer(low_, F.least(top, s), seed, "start", F.col("draw"))
    start = F.when((dur >= window) | (s == 0), s).when(s >= top, top).otherwise(uniform_start)
    return hit.select("draw", "label", record, start.cast("long").alias("start"))


# Shares of a cell that are nearer to each other than this may fall on either side of a bound, by rounding.
NEAR = 1e-6


def _taken(events: DataFrame, n: int, resolution: int, so: float, record: str) -> DataFrame:
    """Per event (``_s`` to ``_e``, in seconds) ranges of window starts, in cells, whose grid it sets a cell of.

    Starts lie on the cells, so an event covers the same cells of the calendar in every window and the starts form one
    range. Its ends are settled by the rule of a single window, evaluated next to them. Only where a short event ends
    within rounding of a bound may the rule differ from one window to the next: each of its ``n`` starts is judged then.
    """
    scaled = lambda c: c / F.lit(float(resolution))
    a, b = scaled(F.col("_s")), scaled(F.col("_e"))
    first, last = cell_span(F.col("_a"), F.col("_b"), 1 << 62, so)
    low = F.greatest(F.floor(F.col("_a") + so - n) + 1, first - n + 1)
    high = F.least(F.ceil(F.col("_b") - so) - 1, last - 1)

    def sets(j: Column) -> Column:
        # As in window_hits: seconds are subtracted before they are scaled.
        at = j * F.lit(resolution)
        a, b = F.greatest(scaled(F.col("_s") - at), F.lit(0.0)), F.least(scaled(F.col("_e") - at), F.lit(float(n)))
        one, end = cell_span(a, b, n, so)
        return (F.col("_e") > at) & (F.col("_s") < at + n * resolution) & (b - a > so) & (one < end)

    part = lambda c: F.col(c) - F.floor(c)
    close = lambda c, bound: F.abs(c - F.lit(float(bound))) < NEAR
    length = F.col("_b") - F.col("_a")
    vague = (length < 2) & (close(length, so) | close(part("_a"), 1 - so) | close(part("_b"), so))
    near = lambda c, steps: F.get(F.filter(F.array(*[F.col(c) + k for k in steps]), sets), F.lit(0))
    one = F.array(F.struct(near("_low", (-1, 0, 1)).alias("lo"), near("_high", (1, 0, -1)).alias("hi")))
    every = F.filter(F.sequence(F.floor("_a").cast("long") - n, F.ceil("_b").cast("long")), sets)
    each = F.transform(every, lambda j: F.struct(j.alias("lo"), j.alias("hi")))
    ends = events.withColumns({"_a": a, "_b": b}).withColumn("_low", low).withColumn("_high", high)
    found = ends.select(record, F.explode(F.when(vague, each).otherwise(one)).alias("_r"))
    return found.select(record, F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi")).where(
        (F.col("_lo") <= F.col("_hi")) & (F.col("_hi") >= 0)
    )


def free_starts(
    windows: DataFrame, intervals: DataFrame, window: int, resolution: int, so: float | None = None,
    minimum_duration: float = 10, record: str = "record",
) -> DataFrame:
    """(record, _from, _n): runs of window starts, in multiples of ``resolution``, whose label grid is empty.

    Interval subtraction: every event takes a range of starts, a running maximum joins the ranges, and what lies
    between them is free. Neither the starts nor pairs of starts and events become rows.
    """
    so = 7.5 / resolution if so is None else so
    if so > 0.5:
        raise ValueError("a border cell counts from a half of it at most")
    n = int(window // resolution)
    tops = windows.groupBy(record).agg(F.max("max_index").alias("_top")).where(F.col("_top") > 0)
    size = settle(tops.select(record, (floor_div(F.col("_top") - 1, resolution) + 1).alias("_size")))
    events = intervals.where(F.col("duration") > minimum_duration).select(
        record, F.col("start").alias("_s"), (F.col("start") + F.col("duration")).alias("_e")
    )
    # Of ranges that begin together the longest counts; a last range of each record closes its calendar.
    ranges = _taken(events, n, resolution, so, record).groupBy(record, F.greatest("_lo", F.lit(0)).alias("_lo")).agg(F.max("_hi").alias("_hi"))
    ranges = stage(ranges.unionByName(size.select(record, F.col("_size").alias("_lo"), F.col("_size").alias("_hi"))))
    seen = running_max(ranges, [record], floor_div(F.col("_lo"), max(n, 1) * 64), ["_lo", "_hi"], "_hi", "_seen")
    begin = F.coalesce(F.col("_seen") + 1, F.lit(0)).cast("long")
    # Ranges behind the calendar leave no gap inside it.
    gaps = seen.join(size, record).select(record, begin.alias("_from"), (F.least("_lo", "_size") - begin).alias("_n"))
    return stage(gaps.where(F.col("_n") > 0))


def background_sample(
    windows: DataFrame, intervals: DataFrame, draws: int, window: int, resolution: int, seed: int,
    so: float | None = None, record: str = "record",
) -> DataFrame:
    """Seeded window starts (multiples of ``resolution``) whose label grid is empty.

    A draw is a position among all free starts, records in the order of their hash; it finds its run of starts as the
    last one that begins at or before the position.
    """
    free = free_starts(windows, intervals, window, resolution, so, record=record)
    hashed = free.withColumn("_h", F.md5(F.col(record).cast("string")))
    runs = settle(ordinal(hashed, [], F.substring("_h", 1, 3), ["_h", record, "_from"], "_pos", weight="_n").drop("_h"))
    n = runs.agg(F.sum("_n")).first()[0]
    d = runs.sparkSession.range(draws).withColumnRenamed("id", "draw")
    if not n:
        return d.join(runs, F.lit(False)).select("draw", record, F.col("_from").alias("start"))
    pick = F.floor(seeded.uniform(seed, "background", F.col("draw")) * F.lit(n)).cast("long")
    ask = d.select(pick.alias("_at"), F.lit(1).alias("_side"), "draw")
    know = runs.select(F.col("_pos").alias("_at"), F.lit(0).alias("_side"), F.col("_pos").alias("_begins"))
    both = ask.unionByName(know, allowMissingColumns=True)
    found = running_max(both, [], floor_div(F.col("_at"), max(1, n // 4096)), ["_at", "_side", "draw"], "_begins", "_pos")
    start = (F.col("_from") + F.col("_at") - F.col("_pos")) * F.lit(resolution)
    return found.where(F.col("draw").isNotNull()).join(runs, "_pos").select("draw", record, start.cast("long").alias("start"))
