"""Web archives written by Spark and read back by boundary-chain verification.

An archive is the plain concatenation of records, so a task that starts in the middle of a file cannot know where
records begin: the magic may as well stand inside a payload. Every place of the magic is therefore a candidate that
names its successor (its own end by its length field). Inside a block of the file the chains are followed at once;
between blocks pointers are doubled from the start of the file on. What is reached is a record, all else is payload.

Defined results: a null payload is empty; payloads of at least ``least`` bytes that are equal are stored once, with the
smallest id (rows that share it are all responses), and the rest revisit it; shorter ones are always responses. A null
id is written without a number and read back as null; it comes before every other. An empty table gives an archive without
records. Other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm.common import bitmap_of, probably_in
from vitalgrid.session import ensure_checkpoint_dir, settle, stage

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> None:
    """One record per row, in as many files as the table has partitions; nothing but ids and digests is shuffled."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn(
        "bytes", F.octet_length("payload")
    )
    again = rows.where(F.col("bytes") >= least).groupBy("digest").agg(
        F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("many")
    )
    again = stage(again.where("many > 1").select(F.col("digest").alias("rd"), F.col("first.id").alias("rid")))
    light = probably_in(rows.select("id", "digest"), "digest", stage(bitmap_of(again, "rd")))
    light = light.where("_maybe").join(again, F.col("digest") == F.col("rd"))
    revisits = stage(light.where(~F.col("id").eqNullSafe(F.col("rid"))).select(
        F.col("id").alias("vi"), F.col("digest").alias("vd"), "rid"
    ).distinct())
    flagged = probably_in(rows, "digest", stage(bitmap_of(revisits, "vd")))
    back = flagged.where("_maybe").join(
        revisits, F.col("id").eqNullSafe(F.col("vi")) & (F.col("digest") == F.col("vd")), "left"
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    revisit = F.col("vd").isNotNull()
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")),
        F.lit("WARC-Record-ID: "), urn("id"), F.lit(f"WARC-Date: {DATE}\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("rid"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit(BREAK),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    same = flagged.where(~F.col("_maybe")).withColumn("vd", F.lit(None).cast("string")).withColumn("rid", F.col("id"))
    columns = ["id", "payload", "digest", "bytes", "vd", "rid"]
    out = back.select(*columns).union(same.select(*columns)).select(record.alias("value"))
    # The blank lines that end a record are the text writer's separator.
    out.write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str, keep_payload: bool) -> DataFrame:
    """What lies between two places of the magic, with its block of the file and its fields if it looks like a record."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("n"),
    )
    head = F.substring_index("value", BREAK, 1)
    fields = raw.withColumn("head", head).withColumn("bytes", F.octet_length("value").cast("long"))
    one = lambda name, pattern: F.regexp_extract("head", f"(?:^|\r\n){name}: *{pattern}", 1)
    length = one("Content-Length", r"(\d{1,18})\s*(?:\r\n|$)")
    fields = fields.withColumn("length", F.when((length != "") & (F.octet_length("head") < F.col("bytes")), length.try_cast("long")))
    start = F.octet_length("head") + len(BREAK)
    fields = fields.withColumn("body", start.cast("long"))
    whole = F.col("length").isNotNull() & (F.col("bytes") == F.col("body") + F.col("length") + len(BREAK))
    payload = F.expr("substring(cast(value as binary), cast(body + 1 as int), cast(length as int))")
    return fields.select(
        "file", "block", "file_size", "n", "bytes", "length", "body", F.coalesce(whole, F.lit(False)).alias("whole"),
        one("WARC-Type", r"(\w+)").alias("type"), one("WARC-Record-ID", r"<urn:page:([^>]*)>").alias("id"),
        one("WARC-Refers-To", r"<urn:page:([^>]*)>").alias("refers"),
        one("WARC-Payload-Digest", r"sha256:(\w+)").alias("claimed"), one("X-Payload-Length", r"(\d{1,18})").try_cast("long").alias("full"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
        (F.col("value") if keep_payload else F.lit(None).cast("string")).alias("value"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, the place in the file where a piece's magic begins (the first piece lies before any magic)."""
    span = F.col("bytes") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("file", "block").agg(F.sum(span).alias("size"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("file", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
    rows = pieces.withColumn("_in", F.coalesce(F.sum(span).over(inside), F.lit(0)))
    return rows.join(begin, ["file", "block"]).withColumn("at", F.col("begin") + F.col("_in") - len(MAGIC)).drop("_in", "begin")


def _exits(candidates: DataFrame) -> DataFrame:
    """(file, at, out): where the chain from a candidate leaves its block (nowhere, if it breaks inside)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        last = pdf["at"].iloc[-1]
        out: dict[int, int] = {}
        for at, after in zip(pdf["at"].to_numpy()[::-1], pdf["next"].to_numpy()[::-1], strict=True):
            out[at] = after if after > last else out.get(after, -1)
        return pd.DataFrame({"file": pdf["file"], "at": pdf["at"], "out": [out[a] for a in pdf["at"]]})

    return candidates.select("file", "block", "at", "next").groupBy("file", "block").applyInPandas(
        run, "file string, at long, out long"
    )


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain that starts at the beginning of each file."""
    jump = stage(_exits(candidates))
    blocks = candidates.groupBy("file").agg(F.count_distinct("block").alias("b")).agg(F.max("b")).first()[0] or 0
    found = jump.where("at = 0").select("file", "at")
    step = 1
    while step < blocks + 1:
        after = found.join(jump, ["file", "at"]).select("file", F.col("out").alias("at"))
        found = settle(found.union(after).where("at >= 0").distinct())
        far = jump.select("file", F.col("at").alias("out"), F.col("out").alias("far"))
        step *= 2
        if step < blocks + 1:
            jump = settle(jump.join(far, ["file", "out"]).select("file", "at", F.col("far").alias("out")))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        good = set(pdf.loc[pdf["entry"], "at"])
        for at, after in zip(pdf["at"].to_numpy(), pdf["next"].to_numpy(), strict=True):
            if at in good:
                good.add(after)
        own = pdf[pdf["at"].isin(good)]
        return own[["file", "at"]]

    marked = candidates.select("file", "block", "at", "next").join(found.withColumn("entry", F.lit(True)), ["file", "at"], "left")
    marked = marked.withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(follow, "file string, at long")


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """(file, at, id, type, refers, claimed, full, length, digest[, payload]) of every true record.

    ``digest`` is computed from the bytes read; ids are strings.
    """
    placed = stage(_placed(stage(_pieces(spark, path, keep_payload))))
    end = F.col("at") + len(MAGIC) + F.col("body") + F.col("length") + len(BREAK)
    candidates = placed.where("length is not null and at >= 0").withColumn("next", end)
    candidates = candidates.where(F.col("next") <= F.col("file_size"))
    good = stage(_reached(candidates))
    records = placed.join(good.withColumn("record", F.lit(True)), ["file", "at"], "left")
    full = records.where(F.col("record"))
    broken = stage(full.where("not whole").select("file", F.col("at").alias("owner")))
    if not broken.head(1):
        payload = _body(F.col("value"), F.col("body"), F.col("length"))
        return full.select(*_FIELDS, *([payload.alias("payload")] if keep_payload else []))
    # A payload that holds the magic is in several pieces, which belong to the last record that began before them. Only
    # files with such a payload are read again, with their texts; blocks may be cut elsewhere this time.
    files = broken.select("file").distinct()
    texts = stage(_placed(_pieces(spark, path, True).join(files, "file", "left_semi")).select("file", "block", "at", "value"))
    marks = texts.where("at >= 0").join(good.withColumn("own", F.col("at")), ["file", "at"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = marks.groupBy("file", "block").agg(F.max("own").alias("top")).withColumn("carry", F.max("top").over(before))
    last = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("owner", F.max("own").over(last)).join(tops.select("file", "block", "carry"), ["file", "block"])
    owned = owned.withColumn("owner", F.coalesce("owner", "carry")).join(broken, ["file", "owner"], "left_semi")
    joined = owned.groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "value"))), lambda p: p["value"]), MAGIC).alias("text")
    ).select("file", F.col("owner").alias("at"), "text")
    full = full.join(joined, ["file", "at"], "left")
    payload = _body(F.coalesce("text", "value"), F.col("body"), F.col("length"))
    digest = F.when(F.col("text").isNotNull(), F.sha2(payload, 256)).otherwise(F.col("digest"))
    return full.withColumn("digest", digest).select(*_FIELDS, *([payload.alias("payload")] if keep_payload else []))


_FIELDS = ("file", "at", "id", "type", "refers", "claimed", "full", "length", "digest")


def _body(text: Column, body: Column, length: Column) -> Column:
    return F.substring(text.cast("binary"), (body + 1).cast("int"), length.cast("int"))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write the pages as archives into the shared folder and read all records back."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, payload_col, least)
    found = read_records(spark, path)
    id_type = pages.schema[id_col].dataType.simpleString()
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return found.select(
        number("id").alias("id"), F.col("full").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("claimed")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers").alias("refers_to"),
    )
