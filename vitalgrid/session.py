"""Session set-up and the two size-checked building blocks every operator shares.

``settle`` cuts lineage by writing a (small) intermediate to the reliable
checkpoint folder; ``attach`` joins such a table back to the big side, by
broadcast when its measured size allows it and by a shuffle join otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest lookup (estimated bytes) that is broadcast after its rows have been counted.
BROADCAST_BYTES = 16 << 20


def local_session(app: str = "vitalgrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vitalgrid-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Materialise a small intermediate reliably and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Writer options for tables whose rows are large (a megabyte, say): pages and row groups are closed by size after
# every row instead of after the first hundred.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(16 << 20),
}


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write a large intermediate once as Parquet in the shared folder and go on from there.

    For tables that the next step reads several times: columns stay prunable and
    a lost executor costs a re-read, not a recomputation. ``options`` go to the writer.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows to as many tasks as the session shuffles to, for tables whose rows unfold to many.

    Adaptive execution would coalesce such a table by its own size, and one task would unfold and write all of it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _path(spark: SparkSession, path: str):
    """A folder of any file system Spark knows, and that file system."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, system = _path(spark, path)
    return system.exists(own)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern."""
    own, system = _path(spark, pattern)
    return [s.getPath().toString() for s in system.globStatus(own) or []]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    own, system = _path(spark, path)
    system.delete(own, True)


def _row_bytes(schema: T.StructType) -> int:
    """Upper estimate of a row's size; strings and nested values count as 64 bytes."""
    return 16 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) else 64 for f in schema)


def attach(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: str | Column,
    how: str = "inner",
    settled: bool = False,
) -> DataFrame:
    """Join a per-group ``lookup`` back to ``df``.

    The lookup is settled and counted first. Of few bytes: broadcast, so ``df``
    is not shuffled. Larger: one shuffle join with a row per key on the lookup's
    side, where adaptive execution splits the partition of a hot key of ``df``;
    no row of either side is repeated. ``spread`` names what varies inside a group.
    """
    keys = list(keys)
    lookup = lookup if settled else settle(lookup)
    if lookup.count() * _row_bytes(lookup.schema) <= BROADCAST_BYTES:
        return df.join(F.broadcast(lookup), keys, how)
    return df.join(lookup, keys, how)


def with_stats(
    df: DataFrame, keys: Sequence[str], spread: str, **aggregates: Column
) -> DataFrame:
    """Group aggregates (partially combined map-side) as extra columns of ``df``."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return attach(df, stats, keys, spread)
