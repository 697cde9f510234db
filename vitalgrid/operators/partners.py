"""Which spans have a partner: an overlapping span of the other side whose IoU reaches a bound, without forming pairs.

A span ``[s', e')`` of length ``P`` reaches IoU ``m`` with ``[s, e)`` of length ``L`` exactly if four lines allow it:
``s' + m e' <= e + m s``, ``e' + m s' >= s + m e``, ``m P <= L`` and ``P >= m L``. Spans are points (start, length) in
cells as wide as the asking span's length class. Per cell four champions are kept, the furthest inside each line: one
that passes proves a partner, one that fails its own line proves that the cell has none. Only cells near a corner of
the four lines stay open; those are halved, until the points left in open cells are few enough to be looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.model import EPS
from vitalgrid.operators.chunks import floor_div
from vitalgrid.operators.intervals import overlap_pairs
from vitalgrid.session import settle

# A bucket is crowded when its pairs outnumber its spans this many times; open cells are read below the same share.
PAIRS_PER_SPAN = 64
# Below this bound length classes and cells of one span become many, and pairs are formed.
LEAST_IOU = 1 / 16
# Halvings after which open cells are read whatever they hold: their points differ in the last bits only.
HALVINGS = 40


def _reaches(start: Column, stop: Column, a: Column, b: Column, m: float) -> Column:
    """The IoU of two spans by the same arithmetic as ``overlap_pairs``."""
    inter = F.least(stop, b) - F.greatest(start, a)
    union = (stop - start) + (b - a) - inter
    return (inter > 0) & (inter / (union + F.lit(EPS)) >= m)


def _cell(x: Column, width: Column) -> Column:
    return F.floor(x / width).cast("long")


def _points(spans: DataFrame, keys: Sequence[str], m: float) -> DataFrame:
    """One row per span and length class (``_k``) of spans that may ask for it."""
    length = (F.col("stop") - F.col("start")).cast("double")
    low, high = F.floor(F.log2(length * (m * (1 - 1e-9)))), F.floor(F.log2(length * ((1 + 1e-9) / m)))
    return spans.select(
        *keys, F.struct("start", "stop").alias("_p"), F.col("start").cast("double").alias("_s"), length.alias("_len"),
        F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("_k"),
    )


def _celled(points: DataFrame, halvings: int) -> DataFrame:
    width = F.pow(F.lit(2.0), F.col("_k") - halvings)
    return points.withColumn("_i", _cell(F.col("_s"), width)).withColumn("_j", _cell(F.col("_len"), width))


def _champions(points: DataFrame, keys: Sequence[str], halvings: int, m: float) -> DataFrame:
    """Per cell: the number of points and those furthest inside each of the four lines."""
    end = F.col("_s") + F.col("_len")
    return _celled(points, halvings).groupBy(*keys, "_k", "_i", "_j").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_p", F.col("_s") + m * end).alias("_first"), F.max_by("_p", end + m * F.col("_s")).alias("_last"),
        F.min_by("_p", "_len").alias("_short"), F.max_by("_p", "_len").alias("_long"),
    )


def _asking(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    start, stop = F.col("start").cast("double"), F.col("stop").cast("double")
    asks = spans.select(*keys, "start", "stop", start.alias("_a"), stop.alias("_b"), (stop - start).alias("_l"))
    return asks.select(
        "*", F.floor(F.log2("_l")).cast("int").alias("_k"),
        # Rounding of the lines' sums; a cell is only ruled out beyond it.
        ((F.abs("_a") + F.abs("_b")) * 1e-12 + 1e-15).alias("_tol"),
    )


def _strip(m: float) -> tuple[Column, Column]:
    """Lengths that a partner may have."""
    return F.col("_l") * m - F.col("_tol"), F.col("_l") / m + F.col("_tol")


def _reach(j: Column, width: Column, m: float) -> tuple[Column, Column]:
    """Starts that a partner may have whose length lies in row ``j`` of the cells."""
    short, long_ = _strip(m)
    least, most = F.greatest(short, j * width), F.least(long_, (j + 1) * width)
    low = F.col("_a") + (m * F.col("_l") - most) / (1 + m) - F.col("_tol")
    return low, F.col("_a") + (F.col("_l") - m * least) / (1 + m) + F.col("_tol")


def _first_cells(asks: DataFrame, m: float) -> DataFrame:
    """Every cell that meets the four lines' region: about a dozen, however many spans there are."""
    width = F.pow(F.lit(2.0), F.col("_k"))
    short, long_ = _strip(m)
    rows = asks.withColumn("_j", F.explode(F.sequence(F.greatest(_cell(short, width), F.lit(0)), _cell(long_, width))))
    low, high = _reach(F.col("_j"), width, m)
    return rows.withColumn("_i", F.explode(F.sequence(_cell(low, width), _cell(high, width))))


def _halved(cells: DataFrame, halvings: int, m: float) -> DataFrame:
    """The quarters of open cells that still meet the region."""
    width = F.pow(F.lit(2.0), F.col("_k") - halvings)
    quarter = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
    rows = cells.withColumn("_jj", quarter("_j")).withColumn("_ii", quarter("_i")).drop("_i", "_j")
    rows = rows.withColumnsRenamed({"_ii": "_i", "_jj": "_j"})
    short, long_ = _strip(m)
    low, high = _reach(F.col("_j"), width, m)
    inside = (F.col("_j") * width <= long_) & ((F.col("_j") + 1) * width >= short)
    return rows.where(inside & (F.col("_i") * width <= high) & ((F.col("_i") + 1) * width >= low))


def have_partner(
    spans: DataFrame, others: DataFrame, min_iou: float, keys: Sequence[str], pairs_per_span: int = PAIRS_PER_SPAN
) -> DataFrame:
    """The distinct ``spans`` (keys, start, stop) that some span of ``others`` meets with an IoU of ``min_iou`` or more.

    Both sides hold distinct spans of positive length. Rows stay in proportion to the spans however they overlap.
    """
    keys, m = list(keys), float(min_iou)
    span = [*keys, "start", "stop"]
    points = settle(_points(others, keys, m))
    cells = settle(_first_cells(_asking(spans, keys), m))
    few = pairs_per_span * (spans.count() + others.count())
    base = [c for c in cells.columns if c not in ("_i", "_j")]
    ok = lambda p: _reaches(F.col("start"), F.col("stop"), p["start"], p["stop"], m)
    edge = lambda p: (p["start"].cast("double"), p["stop"].cast("double"))
    place = [*keys, "_k", "_i", "_j"]
    hits = None
    for halvings in range(HALVINGS + 1):
        met = cells.join(_champions(points, keys, halvings, m), place)
        champions = [F.col(c) for c in ("_first", "_last", "_short", "_long")]
        (s0, e0), (s1, e1), (s2, e2), (s3, e3) = map(edge, champions)
        none = (
            (s0 + m * e0 > F.col("_b") + m * F.col("_a") + F.col("_tol"))
            | (e1 + m * s1 < F.col("_a") + m * F.col("_b") - F.col("_tol"))
            | (m * (e2 - s2) > F.col("_l") + F.col("_tol")) | (e3 - s3 < m * F.col("_l") - F.col("_tol"))
        )
        proved = F.coalesce(*[F.when(ok(c), F.lit(True)) for c in champions], F.lit(False))
        seen = settle(
            met.withColumn("_hit", proved).withColumn("_open", ~F.col("_hit") & ~none & (F.col("_n") > 1))
            .where("_hit or _open").select(*base, "_i", "_j", "_n", "_hit")
        )
        found = seen.where("_hit").select(*span).distinct()
        hits = settle(found if hits is None else hits.unionByName(found).distinct())
        cells = settle(seen.where("not _hit").join(hits, span, "left_anti").drop("_hit"))
        left = cells.agg(F.sum("_n")).first()[0]
        if not left:
            return hits
        if left <= few or halvings == HALVINGS:
            inside = cells.join(_celled(points, halvings), place).where(ok(F.col("_p")))
            return hits.unionByName(inside.select(*span)).distinct()
        cells = _halved(cells.drop("_n"), halvings + 1, m)
    return hits


def matched_spans(
    targets: DataFrame, outputs: DataFrame, min_iou: float, keys: Sequence[str], bucket: float,
    pairs_per_span: int = PAIRS_PER_SPAN,
) -> tuple[DataFrame, DataFrame]:
    """Distinct target and output spans that have a partner.

    Copies of a span are collapsed first. Pairs are formed only in buckets where they are few; spans that touch a
    crowded bucket are settled by champions against all spans of their key.
    """
    keys = list(keys)
    span = [*keys, "start", "stop"]
    a, b = (df.select(*span).where(F.col("stop") > F.col("start")).distinct() for df in (targets, outputs))
    pairs = lambda skip=None: overlap_pairs(
        *(x.withColumn("id", F.struct("start", "stop")) for x in (a, b)), keys, bucket, skip=skip
    ).where(F.col("iou") >= min_iou)
    side = lambda met, s: met.select(
        *keys, F.col(f"{s}_start").alias("start"), F.col(f"{s}_stop").alias("stop")
    ).distinct()
    if not LEAST_IOU <= min_iou <= 1:
        met = pairs()
        return side(met, "a"), side(met, "b")
    touched = F.explode(F.sequence(floor_div(F.col("start"), bucket), floor_div(F.col("stop"), bucket)))
    bucketed = [x.withColumn("_bucket", touched) for x in (a, b)]
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    counts = bucketed[0].select(*keys, "_bucket", one.alias("_a"), no.alias("_b")).unionByName(
        bucketed[1].select(*keys, "_bucket", no.alias("_a"), one.alias("_b"))
    ).groupBy(*keys, "_bucket").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    # As doubles: the product of two counts may pass a long.
    crowded = settle(
        counts.where(F.col("_a").cast("double") * F.col("_b") > pairs_per_span * (F.col("_a") + F.col("_b")))
        .select(*keys, "_bucket")
    )
    if crowded.isEmpty():
        met = pairs()
        return side(met, "a"), side(met, "b")
    met = pairs(crowded)
    dense = [settle(x.join(crowded, [*keys, "_bucket"], "left_semi").select(*span).distinct()) for x in bucketed]
    near = [x.join(crowded.select(*keys).distinct(), keys, "left_semi") for x in (a, b)]
    by_champions = [
        have_partner(dense[0], near[1], min_iou, keys, pairs_per_span),
        have_partner(dense[1], near[0], min_iou, keys, pairs_per_span),
    ]
    both = [side(met, s).unionByName(x).distinct() for s, x in zip("ab", by_champions, strict=True)]
    return both[0], both[1]
