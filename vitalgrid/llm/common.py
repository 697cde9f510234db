"""Helpers shared by the training-data operators: ordinals without hot tasks, bounded prefilters, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.session import settle

# Bits of a prefilter bitmap; its broadcast is this many bits whatever the data (8 MB).
FILTER_BITS = 1 << 26
# Bits of one row of bitmap_construct_agg.
_ROW_BITS = 32768


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function over batches, after which its Python worker gives unused memory back: workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows for what is executed inside: tables whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bytes_per_batch(spark: SparkSession, limit: int) -> None:
    """Arrow batches of at most ``limit`` bytes (or one row) in this session from here on; a smaller setting stays.

    Not undone: a lazy result is planned after the function that declares it has returned. Buffers on both sides of a
    Python worker follow the batch and are pooled, so that they stay with an executor for every later stage.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = int(spark.conf.get(name).rstrip("bB"))
    if not 0 < before <= limit:
        spark.conf.set(name, str(limit))


def narrow(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """The two columns an operator works on, as ``id`` and ``text``; columns to carry along go into a struct ``row``.

    Every other column may have any name, because none of them is looked at.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if carry:
        columns.append(F.struct(*carry).alias("row"))
    return df.select(*columns)


def carried(docs: DataFrame) -> list[str]:
    """The carried column's name in a list, or nothing."""
    return [c for c in ("row",) if c in docs.columns]


def ddl(docs: DataFrame, *names: str) -> str:
    """Schema text of some columns, in order."""
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)


def text_key(text: str | Column = "text") -> Column:
    """Second half of a row's key: repeated ids with different texts stay apart."""
    return F.xxhash64(text)


def ordinals(
    df: DataFrame, group: str, order: Sequence[str | Column], name: str, buckets: int, weight: str | None = None
) -> DataFrame:
    """Gapless numbers from 0 within each ``group`` without gathering a group in one task.

    Rows are dealt to hash buckets of their order columns; a row's number is its rank inside (group, bucket)
    plus the rows of the group in earlier buckets. The offsets table has groups x buckets rows at most and is
    aggregated before it is joined. With ``weight`` it is the sum of that column over the rows before a row.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_b").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")
    )
    within = Window.partitionBy(group, "_b").orderBy(*order)
    earlier = F.row_number().over(within) - 1
    if weight:
        earlier = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("_r", earlier)
    joined = ranked.join(starts, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(name, F.col("_s") + F.col("_r")).drop("_b", "_g", "_c", "_s", "_r")


def bitmap_of(keys: DataFrame, key: str | Column) -> DataFrame:
    """A bitmap of fixed size over hashes of ``key``: rows (_row, _bits)."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return keys.select(bit.alias("_h")).groupBy(F.floor(F.col("_h") / _ROW_BITS).cast("int").alias("_row")).agg(
        F.bitmap_construct_agg((F.col("_h") % _ROW_BITS).cast("long")).alias("_bits")
    )


def probably_in(df: DataFrame, key: str | Column, bitmap: DataFrame, name: str = "_maybe") -> DataFrame:
    """Flag rows whose key may be among the bitmap's keys (never misses one).

    The bitmap has FILTER_BITS bits at most, so its broadcast is bounded by a constant; with more keys than
    bits the flag is merely true more often and the exact join behind it does the rest.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    flagged = df.withColumn("_h", bit).withColumn("_hrow", F.floor(F.col("_h") / _ROW_BITS).cast("int"))
    joined = flagged.join(F.broadcast(bitmap), F.col("_hrow") == F.col("_row"), "left")
    inside = F.col("_h") % _ROW_BITS
    octet = F.conv(F.hex(F.expr("substring(_bits, cast(floor(_h % 32768 / 8) as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.when(F.col("_bits").isNull(), F.lit(False)).otherwise(
        F.floor(octet / F.pow(F.lit(2.0), inside % 8)) % 2 == 1
    )
    return joined.withColumn(name, hit).drop("_h", "_hrow", "_row", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (u, v).

    Alternating large-star and small-star rounds over tables; a hub only meets partial aggregates and joins that
    adaptive execution can split. Rounds grow with the logarithm of a component's length.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tidy = lambda e: e.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = settle(tidy(edges.select("u", "v")))
    seen = mark(e)
    while seen[0]:
        around = both(e)
        low = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = around.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("n")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        star = settle(tidy(large))
        low = star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = star.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(F.col("n").alias("u"), F.col("m").alias("v"))
        )
        e = settle(tidy(small))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
