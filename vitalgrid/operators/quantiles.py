"""Exact group quantiles (linear interpolation) that never gather a large group.

A group whose counted size is small uses the built-in ``percentile``. For the others
the wanted order statistics are found by narrowing: an equal-width histogram
per group (at most ``BINS`` rows each, combined map-side) tells which bin holds
the wanted rank; only that bin is refined in the next pass, until the bins in
question are small enough to be ranked value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.session import attach, settle

# Rows of one group that a single task may rank.
SMALL_GROUP = 1_000_000
BINS = 4096


def _name(i: int) -> str:
    return f"_q{i}"


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    small_group: int | None = None,
    bins: int = BINS,
) -> DataFrame:
    """One row per group with the exact quantiles ``probs`` of ``value``."""
    keys, probs = list(keys), list(probs)
    names = list(names or [_name(i) for i in range(len(probs))])
    small_group = SMALL_GROUP if small_group is None else small_group
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    stats = settle(
        data.groupBy(*keys).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.min(_finite()).alias("_flo"), F.max(_finite()).alias("_fhi"),
        )
    )
    large = stats.where(F.col("_n") > small_group)
    p = F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs]))
    pick = lambda d: d.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]
    )
    if not large.head(1):
        return pick(data)
    if not keys:
        return _narrow(data, large, keys, probs, names, small_group, bins)
    # Each group by its own size; both ways interpolate alike.
    few = data.join(large.select(*keys), keys, "left_anti")
    many = data.join(large.select(*keys), keys, "left_semi")
    return pick(few).unionByName(_narrow(many, large, keys, probs, names, small_group, bins))


def _finite():
    return F.when(F.abs(F.col("_v")) < float("inf"), F.col("_v"))


def _narrow(data, stats, keys, probs, names, small_group, bins):
    # Wanted ranks: floor and floor+1 of q*(n-1) for every q.
    ranks = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.array(
                        F.floor((F.col("_n") - 1) * F.lit(float(q))),
                        F.least(F.floor((F.col("_n") - 1) * F.lit(float(q))) + 1, F.col("_n") - 1),
                    )
                    for q in probs
                ]
            )
        )
    )
    # A cell is the open search range of one rank; `_skip` rows lie below it.
    cells = stats.select(
        *keys, "_lo", "_hi", "_flo", "_fhi", F.lit(0).cast("long").alias("_skip"),
        F.col("_n").alias("_size"), F.explode(ranks).alias("_rank"),
    )
    found = []
    while True:
        cells = settle(cells)
        found.append(
            cells.where(F.col("_lo") == F.col("_hi")).select(
                *keys, "_rank", F.col("_lo").alias("_v")
            )
        )
        open_ = cells.where(F.col("_lo") < F.col("_hi"))
        largest = open_.agg(F.max("_size")).first()[0]
        if largest is None:
            break
        ranges = open_.select(*keys, "_lo", "_hi", "_flo", "_fhi", "_skip").distinct()
        inside = attach(data, ranges, keys, "_v").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if largest <= small_group:
            by = [*keys, "_lo", "_hi"]
            upto = Window.partitionBy(*by).orderBy("_v")
            ranked = (
                inside.groupBy(*by, "_skip", "_v")
                .agg(F.count("*").alias("_c"))
                .withColumn("_end", F.col("_skip") + F.sum("_c").over(upto))
                .withColumn("_beg", F.col("_end") - F.col("_c"))
            )
            found.append(
                open_.select(*keys, "_lo", "_hi", "_rank")
                .join(ranked, by)
                .where((F.col("_rank") >= F.col("_beg")) & (F.col("_rank") < F.col("_end")))
                .select(*keys, "_rank", "_v")
            )
            break
        by = [*keys, "_lo", "_hi", "_skip"]
        # Equal widths between the finite ends (halved: their distance may overflow); infinities and NaN apart.
        width = F.col("_fhi") / 2 - F.col("_flo") / 2
        place = F.floor((F.col("_v") / 2 - F.col("_flo") / 2) / width * F.lit(float(bins)))
        b = (
            F.when(F.isnan(F.col("_v").cast("double")), F.lit(bins + 1))
            .when(F.col("_v") == float("inf"), F.lit(bins)).when(F.col("_v") == float("-inf"), F.lit(-1))
            .when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
        )
        upto = Window.partitionBy(*by).orderBy("_bin")
        histogram = (
            inside.withColumn("_bin", b)
            .groupBy(*by, "_bin")
            .agg(
                F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"),
                F.min(_finite()).alias("_fl"), F.max(_finite()).alias("_fh"),
            )
            .withColumn("_end", F.col("_skip") + F.sum("_c").over(upto))
            .withColumn("_beg", F.col("_end") - F.col("_c"))
        )
        cells = (
            open_.select(*by, "_rank")
            .join(histogram, by)
            .where((F.col("_rank") >= F.col("_beg")) & (F.col("_rank") < F.col("_end")))
            .select(
                *keys, F.col("_l").alias("_lo"), F.col("_h").alias("_hi"),
                F.col("_fl").alias("_flo"), F.col("_fh").alias("_fhi"), F.col("_beg").alias("_skip"), F.col("_c").alias("_size"), "_rank",
            )
        )
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    table = stats.join(
        hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")),
        keys,
    )
    out = []
    for q, n in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        low = F.floor(pos)
        high = F.least(low + 1, F.col("_n") - 1)
        a, b = F.col("_at")[low], F.col("_at")[high]
        # As ``percentile`` does it, so that both ways agree to the last digit.
        between = (low + 1 - pos) * a + (pos - low) * b
        out.append(F.when((pos == low) | (a == b), a.cast("double")).otherwise(between).alias(n))
    return table.select(*keys, *out)


def with_quantiles(df, keys, t, value, probs, names, **kw) -> DataFrame:
    """``group_quantiles`` joined back to every row."""
    return attach(df, group_quantiles(df, keys, value, probs, names, **kw), keys, t)
