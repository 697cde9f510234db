"""Reading and writing the tables of recordings, intervals and predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.model import ANNOTATIONS, INTERVALS, SAMPLES
from vitalgrid.operators.chunks import floor_div, ordinal
from vitalgrid.operators.resample import resample_binary


def read_samples(
    source: DataFrame, signals: Sequence[str] | None = None, channels: Sequence[int] | None = None,
    records: Sequence[str] | None = None,
) -> DataFrame:
    """Chosen signals, channels and records; every filter reaches the scan."""
    for name, wanted in (("signal", signals), ("channel", channels), ("record", records)):
        if wanted is not None:
            source = source.where(F.col(name).isin(list(wanted)))
    return source


def open_samples(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Stored samples; NaN becomes NULL here, so aggregates downstream skip it."""
    df = read_samples(spark.read.schema(SAMPLES).parquet(path), **kw)
    return df.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def select_records(df: DataFrame, records: Sequence | DataFrame, record: str = "record") -> DataFrame:
    """Subset by a list, or by a table of records (semi join)."""
    if isinstance(records, DataFrame):
        return df.join(records.select(record), record, "left_semi")
    return df.where(F.col(record).isin(list(records)))


def read_intervals(source: DataFrame) -> DataFrame:
    """Starts and durations as whole seconds (truncated).

    A row with only one of the two is an error, as starts and durations must pair up.
    """
    broken = F.col("start").isNull() != F.col("duration").isNull()
    start = F.when(broken, F.raise_error(F.lit("start and duration do not pair up"))).otherwise(F.col("start"))
    return source.withColumn("start", start.cast("long")).withColumn("duration", F.col("duration").cast("long"))


def open_intervals(spark: SparkSession, path: str) -> DataFrame:
    return read_intervals(spark.read.schema(INTERVALS).parquet(path))


def read_annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists of ``{start, end[, label]}`` -> start, duration, label and the file they came from."""
    raw = spark.read.schema(ANNOTATIONS).json(path, multiLine=True)
    return raw.select(
        F.col("_metadata.file_name").alias("file"), "label", "start", (F.col("end") - F.col("start")).alias("duration")
    )


def annotations_from_json(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """The same for JSON lists held in a string column."""
    item = F.from_json(column, "array<struct<start: bigint, `end`: bigint, label: string>>")
    rows = df.select(*keys, F.explode(item).alias("_a"))
    return annotations(rows.select(*keys, "_a.label", "_a.start", "_a.end"))


def annotations(source: DataFrame) -> DataFrame:
    """Start/end rows as start/duration rows."""
    return source.withColumn("duration", F.col("end") - F.col("start")).drop("end")


def read_auxiliary(
    series: DataFrame, labels: Sequence[str], fs: float, desired_fs: float | None = None,
    record: str = "record", t: str = "t", label: str = "label", value: str = "value",
) -> DataFrame:
    """One column per label series, at ``desired_fs`` by repeating or striding rows."""
    columns = [F.max(F.when(F.col(label) == v, F.col(value))).alias(str(v)) for v in labels]
    wide = series.where(F.col(label).isin(list(labels))).groupBy(record, t).agg(*columns)
    if desired_fs is None or desired_fs == fs:
        return wide
    return resample_binary(wide, fs, desired_fs, [record], t)


def list_records(samples: DataFrame, record: str = "record") -> DataFrame:
    return samples.select(record).distinct()


def wall_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column as written.

    A zone-less timestamp is read as UTC in every session time zone.
    """
    instant = F.col(ts).cast("timestamp")
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        instant = F.from_utc_timestamp(instant, F.current_timezone())
    return F.unix_micros(instant)


def samples_from_log(
    log: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], bucket_seconds: int = 21_600
) -> DataFrame:
    """Dense sample index ``t`` from time-stamped rows.

    Numbering runs per time bucket, so a busy key is spread over many tasks.
    """
    return ordinal(log, keys, floor_div(wall_micros(log, ts), bucket_seconds * 1_000_000), order, "t")


# ---- sinks -------------------------------------------------------------------------------


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store samples clustered by record; rows of one record are spread over time slices.

    ``repartition`` on (record, slice) keeps files large without sending a long
    recording to one task.
    """
    spread = samples.repartition(F.col("record"), floor_div(F.col("t"), 4_194_304))
    spread.sortWithinPartitions("record", "signal", "channel", "t").write.mode(mode).partitionBy("signal").parquet(path)


def write_intervals(intervals: DataFrame, path: str, mode: str = "overwrite") -> None:
    intervals.write.mode(mode).partitionBy("kind").parquet(path)


# Folders that predictions are dealt to: bounds the files of a store however many records it has.
FOLDERS = 64


def _folder(record: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(record.cast("string")), F.lit(folders)).cast("int")


def write_predictions(
    predictions: DataFrame, path: str, resolution: float, mode: str = "overwrite", folders: int | None = FOLDERS
) -> None:
    """One series per class and record, with its rate ``1/resolution`` as a column.

    Records are dealt to ``folders`` by hash, rows sorted by record inside them, so that a file's statistics tell which
    records it holds; ``folders=None`` gives every record a folder of its own, for stores of few long nights. A long
    record is written by several tasks.
    """
    out = predictions.withColumn("fs", F.lit(1.0 / resolution))
    slices = floor_div(F.col("epoch"), 4_194_304)
    if folders is None:
        out.repartition(F.col("record"), slices).write.mode(mode).partitionBy("record").parquet(path)
        return
    dealt = out.withColumn("folder", _folder(F.col("record"), folders)).repartition(F.col("folder"), slices)
    dealt.sortWithinPartitions("folder", "record", "class", "epoch").write.mode(mode).partitionBy("folder").parquet(path)


def read_predictions(
    spark: SparkSession, path: str, records: Sequence | None = None, folders: int = FOLDERS
) -> DataFrame:
    """Predictions of a store in folders; for some records only their folders and the files that may hold them are read."""
    rows = spark.read.parquet(path)
    if records is not None:
        names = list(records)
        wanted = F.array(*[_folder(F.lit(r), folders) for r in names])
        rows = rows.where(F.array_contains(wanted, F.col("folder")) & F.col("record").isin(names))
    return rows.drop("folder")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_txt(df: DataFrame, path: str, mode: str = "append", sep: str = " ") -> None:
    """Integer rows as separated text."""
    line = F.concat_ws(sep, *[F.col(c).cast("long").cast("string") for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)


def spec_key(spec) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cache_preprocessed(
    spark: SparkSession, root: str, spec, compute: Callable[[], DataFrame], version: str | Sequence[str]
) -> DataFrame:
    """Result of ``compute`` stored under the hash of its specification and its input.

    ``version`` names the input: a version the caller keeps, or the list of its
    files. Another input is another entry. Only a finished write (the table that
    is written after it present) counts as a hit.
    """
    path = f"{root.rstrip('/')}/{spec_key([spec, version])}"
    try:
        spark.read.parquet(f"{path}/done").head(1)
    except AnalysisException:
        compute().write.mode("overwrite").parquet(f"{path}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/data")


# ---- checks ------------------------------------------------------------------------------


def finite_report(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of rows and of values that are NaN or infinite."""
    from vitalgrid.functions.rows import not_finite

    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(not_finite(F.col(value))).alias("bad"))


def assert_finite(df: DataFrame, value: str) -> DataFrame:
    """Fail the job on any NaN or infinity, without a separate pass."""
    from vitalgrid.functions.rows import not_finite

    v = F.col(value)
    checked: Column = F.when(not_finite(v), F.raise_error(F.lit(f"non-finite {value}"))).otherwise(v)
    return df.withColumn(value, checked)


def add_channels(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sum over channels at every key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))
