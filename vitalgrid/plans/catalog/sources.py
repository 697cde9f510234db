import uuid

from pyspark.sql import functions as F

from vitalgrid.operators.features import record_extent
from vitalgrid.plans.catalog import query
from vitalgrid.session import ensure_checkpoint_dir
from vitalgrid.sources import tables


def scratch(spark, name: str) -> str:
    """Fresh folder next to the checkpoints (shared by all executors)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


SIG = "record:s channel:i t:i value:d"


@query("src1_read_samples", SIG, "sig", "SELECT * FROM sig WHERE record IN ('click', 'view') AND channel = 0")
def _(v):
    return tables.read_samples(v.sig, channels=[0], records=["click", "view"])


@query("src2_read_intervals", "event_id:i record:i start:i duration:i", "",
       "SELECT event_id, user_id AS record, trunc(epoch(ts)) - 1704067200 AS start, trunc(value * 60) AS duration FROM events")
def _(v):
    raw = v.events.select(
        "event_id", F.col("user_id").alias("record"),
        (tables.wall_micros(v.events, "ts") / 1_000_000.0 - 1_704_067_200.0).alias("start"),
        (F.col("value") * 60).alias("duration"),
    )
    return tables.read_intervals(raw)


@query("src3_read_annotations_json", "record:i label:s start:i duration:i", "iv",
       "SELECT record, label, start, duration FROM iv")
def _(v):
    # One JSON list per record and day, as annotation files hold them.
    doc = v.intervals.select(
        "record", F.floor(F.col("start") / 86_400).alias("day"),
        F.struct("start", (F.col("start") + F.col("duration")).alias("end"), "label").alias("a"),
    )
    docs = doc.groupBy("record", "day").agg(F.to_json(F.collect_list("a")).alias("json"))
    return tables.annotations_from_json(docs, "json", ["record"])


@query("src4_read_auxiliary", "record:i t:i click:d view:d", "iv", extra={
    "series": "SELECT record, start // 21600 AS t, label, max(duration) AS value FROM iv GROUP BY 1, 2, 3",
    "wide": "SELECT record, t, max(CASE WHEN label = 'click' THEN value END) AS click, max(CASE WHEN label = 'view' THEN value END) AS view FROM series WHERE label IN ('click', 'view') GROUP BY 1, 2",
}, sql="SELECT record, t * 3 + i AS t, click, view FROM wide, range(0, 3) g(i)")
def _(v):
    series = v.intervals.groupBy("record", F.floor(F.col("start") / 21_600).cast("long").alias("t"), "label").agg(
        F.max("duration").alias("value")
    )
    return tables.read_auxiliary(series, ["click", "view"], 1 / 21_600, 3 / 21_600)


@query("src5_list_records", "record:i", "", "SELECT DISTINCT user_id AS record FROM events")
def _(v):
    return tables.list_records(v.events.select(F.col("user_id").alias("record")))


@query("snk1_write_predictions", "record:i epoch:i class:s y_true:d y_pred:d fs:d", "pred",
       "SELECT *, 1.0 / 30 AS fs FROM pred")
def _(v):
    path = scratch(v.spark, "predictions")
    tables.write_predictions(v.predictions, path, 30)
    return tables.read_predictions(v.spark, path)


@query("snk2_write_csv", "record:s t:i value:d", "sig", "SELECT record, t, value FROM sig")
def _(v):
    path = scratch(v.spark, "csv")
    half = v.sig.select("record", "t", "value")
    tables.write_csv(half.where("t % 2 = 0"), path)
    tables.write_csv(half.where("t % 2 = 1"), path)
    return v.spark.read.schema("record string, t bigint, value double").option("header", True).csv(path)


@query("snk2_write_txt", "line:s", "iv", "SELECT concat_ws(' ', record, start, duration) AS line FROM iv")
def _(v):
    path = scratch(v.spark, "txt")
    tables.write_txt(v.intervals.select("record", "start", "duration"), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("snk3_write_samples", SIG, "sig", "SELECT * FROM sig")
def _(v):
    path = scratch(v.spark, "samples")
    tables.write_samples(v.sig.withColumn("signal", F.lit("acc")), path)
    return tables.open_samples(v.spark, path, signals=["acc"])


@query("snk4_cache_preprocessed", "record:s t:i value:d", "sig", "SELECT record, t, value / 2 AS value FROM sig")
def _(v):
    root = scratch(v.spark, "cache")
    spec = {"divide": 2, "source": v.folder}
    make = lambda: v.sig.select("record", "t", (F.col("value") / 2).alias("value"))
    tables.cache_preprocessed(v.spark, root, spec, make, v.folder)
    return tables.cache_preprocessed(v.spark, root, spec, make, v.folder)


@query("ex13_assert_finite", "record:s rows:i bad:i", "sig",
       "SELECT record, count(*) AS rows, sum(CASE WHEN isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS bad FROM sig GROUP BY 1")
def _(v):
    return tables.finite_report(tables.assert_finite(v.sig, "value"), "value", ["record"])


@query("ex17_select_records", SIG, "sig", "SELECT * FROM sig WHERE record IN (SELECT event_type FROM events WHERE value > 490)")
def _(v):
    busy = v.events.where("value > 490").select(F.col("event_type").alias("record"))
    return tables.select_records(v.sig, busy)


@query("ag28_record_extent", "record:s extent:i", "sig",
       "SELECT record, floor(count(*) / 0.5) AS extent FROM sig GROUP BY 1")
def _(v):
    return record_extent(v.sig.withColumn("signal", F.lit("acc")), {"acc": 0.5})
