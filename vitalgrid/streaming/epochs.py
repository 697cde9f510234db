"""Streaming surface: causal epoch statistics and window labelling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.operators.features import histogram_bin
from vitalgrid.operators.windows import label_words, window_labels
from vitalgrid.session import attach, exists, listed, remove, settle

# Stored samples lie in folders by the time their bins close, one for each stretch of this many milliseconds.
SLOT_MS = 86_400_000


def ddl_of(df: DataFrame) -> str:
    """The columns of a table as schema text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def stream_epoch_stats(
    stream: DataFrame, keys: Sequence[str] = ("record",), ts: str = "ts", value: str = "value",
    interval: str = "30 seconds", delay: str = "1 minute",
) -> DataFrame:
    """Mean, sample deviation and range per closed bin (append mode).

    Samples later than ``delay`` behind the newest one are dropped.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    g = timed.groupBy(F.window("_ts", interval), *keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range"),
        F.count("*").alias("n"),
    )
    return g.select(*keys, F.col("window.start").alias("start"), "mean", "std", "range", "n")


def _marks(spark: SparkSession, store: str, before: int) -> int | None:
    """The newest watermark (milliseconds) that a batch earlier than ``before`` has left."""
    schema = "batch long, ms long"
    marks = spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{store}/marks") if exists(spark, f"{store}/marks") else None
    return marks.where(F.col("batch") < before).agg(F.max("ms")).first()[0] if marks is not None else None


def _finished(rows: DataFrame, by: Sequence[str], bins: Sequence[int]) -> DataFrame:
    """All six statistics of closed bins: two aggregates, both combined map-side, so a bin may hold any share of the rows."""
    v = F.col("_v")
    first = rows.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        F.count(v).alias("_n"),
    ).where("_n > 0")
    first = settle(first)
    joined = attach(rows.where(v.isNotNull()), first, by, "_v", settled=True)
    places = [F.struct(F.lit(b).alias("bins"), histogram_bin(v, F.col("_lo"), F.col("_hi"), b).alias("bin")) for b in bins]
    # The deviation is counted once, with the first histogram.
    counted = joined.select(*by, F.abs(v - F.col("mean")).alias("_d"), F.explode(F.array(*places)).alias("_p")).groupBy(
        *by, "_p.bins", "_p.bin"
    ).agg(F.count(F.lit(1)).alias("_c"), F.sum("_d").alias("_d"))
    share = F.col("_c") / F.col("_n")
    entropies = [F.sum(F.when(F.col("bins") == b, -share * F.log(share))).alias(f"entropy{b}") for b in bins]
    deviation = (F.sum(F.when(F.col("bins") == bins[0], F.col("_d"))) / F.first("_n")).alias("mad")
    second = attach(counted, first, by, "bin", settled=True).groupBy(*by).agg(deviation, *entropies)
    own = first.select(*by, "mean", "std", (F.col("_hi") - F.col("_lo")).alias("range"))
    return own.join(second, list(by))


def stream_epoch_stats_full(
    stream: DataFrame, store: str, path: str, checkpoint: str, keys: Sequence[str] = ("record",), ts: str = "ts",
    value: str = "value", interval: str = "30 seconds", delay: str = "1 minute", bins: Sequence[int] = (20, 200),
) -> StreamingQuery:
    """The same plus mean absolute deviation and histogram entropies, as Parquet below ``path``.

    Those need two passes over a bin. Every micro-batch appends its samples to ``store``, moves the watermark
    (newest sample minus ``delay``, whole milliseconds) and finishes the bins that it has passed from the stored
    samples; no state row ever holds a list. Samples of bins that are already closed are dropped. Folders carry the
    batch number and are overwritten, so a batch that runs again leaves the same rows; samples of closed bins are
    deleted one batch later. Processes everything that is there and stops.
    """
    keys, by = list(keys), [*keys, "start"]

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _marks(spark, store, number)
        window = F.window(F.col(ts).cast("timestamp"), interval)
        rows = batch.where(F.col(ts).isNotNull()).select(
            *keys, window.alias("_w"), F.col(ts).cast("timestamp").alias("_ts"), F.col(value).cast("double").alias("_v")
        ).select(*keys, "_w.start", "_w.end", "_ts", "_v")
        end = F.unix_millis("end")
        if before is not None:
            rows = rows.where(end > before)
        # Bins that close in the same stretch of time lie in one folder, to be deleted as one.
        slot = F.floor(end / SLOT_MS)
        rows.withColumn("slot", slot).write.mode("overwrite").partitionBy("slot").parquet(f"{store}/rows/batch={number}")
        held = spark.read.schema(f"{ddl_of(rows)}, slot long, batch long").option("basePath", f"{store}/rows").parquet(f"{store}/rows")
        held = held.where(F.col("batch") <= number)
        newest = held.where(F.col("batch") == number).agg(F.max(F.unix_millis(F.col("_ts") - F.expr(f"interval {delay}")))).first()[0]
        now = max((m for m in (before, newest) if m is not None), default=None)
        if now is not None:
            spark.createDataFrame([(number, now)], "batch long, ms long").coalesce(1).write.mode("overwrite").json(
                f"{store}/marks/{number}"
            )
            closed = held.where((end <= now) & (F.col("slot") <= now // SLOT_MS))
            if before is not None:
                closed = closed.where((end > before) & (F.col("slot") >= before // SLOT_MS))
            _finished(closed.select(*by, "_v"), by, bins).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if before is not None:
            for folder in listed(spark, f"{store}/rows/batch=*/slot=*"):
                if int(folder.rsplit("slot=", 1)[1]) < before // SLOT_MS:
                    remove(spark, folder)

    q = (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there into Parquet and stop."""
    q = (
        out.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def stream_label(
    windows: DataFrame, intervals: DataFrame, classes: Sequence[str], window: int, resolution: float,
    checkpoint: str, sink: Callable[[DataFrame, int], None], so: float | None = None, record: str = "record",
    words: bool = False,
) -> StreamingQuery:
    """Label each micro-batch of windows against a static interval table.

    ``labels`` has a row per cell or, with ``words``, the bits of ``windows.label_words``, of which counts need no cells.
    ``sink(labels, batch_id)`` must be idempotent per batch id, as a batch can be
    replayed after a failure.
    """

    def label(batch: DataFrame, batch_id: int) -> None:
        labels = label_words if words else window_labels
        sink(labels(batch, intervals, classes, window, resolution, so, record=record), batch_id)

    q = (
        windows.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q
