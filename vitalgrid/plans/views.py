"""Sample, interval, window and prediction tables derived from a table folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import seeded
from vitalgrid.operators.chunks import floor_div
from vitalgrid.sources.tables import samples_from_log, wall_micros

# 2024-01-01 00:00:00 UTC, the origin of the event log, in seconds.
ORIGIN = 1_704_067_200
CLASSES = ("click", "purchase", "signup", "view")
WINDOW, RESOLUTION, OVERLAP, SHARE, EXTENT = 86_400, 600, 0.25, 0.25, 2_592_000


class Views:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def sig(self) -> DataFrame:
        """Five long records, one channel."""
        e = self.events.select(F.col("event_type").alias("record"), "ts", "event_id", "value")
        s = samples_from_log(e, ["record"], "ts", ["ts", "event_id"])
        return s.select("record", F.lit(0).alias("channel"), "t", "value")

    @cached_property
    def xyz(self) -> DataFrame:
        """Many short three-axis records with clock time."""
        e = self.events.select(F.col("user_id").alias("record"), "ts", "event_id", "value")
        s = samples_from_log(e, ["record"], "ts", ["ts", "event_id"], 86_400)
        us = wall_micros(s, "ts") - F.lit(ORIGIN * 1_000_000)
        v = F.col("value")
        return s.select(
            "record", "t", us.alias("us"), F.sin(v).alias("x"), F.cos(v).alias("y"), (v / 250.0 - 1.0).alias("z")
        )

    @cached_property
    def intervals(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "mask").otherwise("event")
        return self.events.select(
            "event_id", F.col("event_id").alias("id"), F.col("user_id").alias("record"), F.col("event_type").alias("label"),
            (floor_div(wall_micros(self.events, "ts"), 1_000_000) - ORIGIN).alias("start"),
            F.floor(F.col("value") * 60).cast("long").alias("duration"), kind.alias("kind"),
        )

    @cached_property
    def extents(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("record")).distinct().withColumn("extent", F.lit(EXTENT).cast("long"))

    @cached_property
    def cells(self) -> DataFrame:
        """Every embedding as an 8 x 8 window."""
        e = self.table("embeddings").select(F.col("vec_id").alias("win"), F.posexplode("embedding").alias("i", "value"))
        return e.select(
            "win", F.floor(F.col("i") / 8).cast("long").alias("t"), F.pmod("i", F.lit(8)).cast("long").alias("bin"),
            F.col("value").cast("double").alias("value"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        d = self.table("documents").select("doc_id").join(self.table("labels"), "doc_id", "left")
        pair = F.explode(
            F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("y")) for c in ("quality", "toxic")])
        )
        rows = d.select(F.col("doc_id").alias("record"), F.lit(0).cast("long").alias("epoch"), pair.alias("_c"))
        return rows.select(
            "record", "epoch", "_c.class", F.coalesce(F.col("_c.y"), F.lit(-1)).cast("double").alias("y_true"),
            seeded.uniform("p", F.col("_c.class"), F.col("record")).alias("y_pred"),
        )

    @cached_property
    def multiclass(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("vec_id").alias("epoch"), F.col("label").alias("y_true"))
        other = F.floor(seeded.uniform("c", F.col("epoch")) * 10).cast("int")
        pred = F.when(seeded.uniform("k", F.col("epoch")) < 0.7, F.col("y_true")).otherwise(other)
        return e.withColumn("y_pred", pred)

    @cached_property
    def targets(self) -> DataFrame:
        return self.intervals.where("kind = 'event'").select(
            "record", F.col("label").alias("class"), "id", F.col("start").cast("double").alias("start"),
            (F.col("start") + F.col("duration")).cast("double").alias("stop"),
        )

    @cached_property
    def outputs(self) -> DataFrame:
        """Detections: shifted and stretched targets, one in five missing, with a score."""
        t = self.targets
        u = lambda tag: seeded.uniform(tag, F.col("id"))
        start = F.col("start") + F.floor(u("shift") * 7200)
        return t.where(u("miss") >= 0.2).select(
            "record", "class", "id", start.alias("start"),
            (start + F.floor((F.col("stop") - F.col("start")) * (u("stretch") + 0.5)) + 1).alias("stop"),
            u("score").alias("score"),
        )
