"""Longest-processing-time sharding: groups of equal texts, largest first, each to the least loaded shard.

Which shard is least loaded depends only on the sizes placed so far, and groups of one size are alike. So the heap
runs over size classes with counts instead of groups, and a whole class is dealt out at once. Sizes below FINE are
classes of their own; above it a class spans 1/FINE of its octave, which bounds the number of classes by FINE per
octave, and the exact loads that the large groups made are counted before the small ones fill them up.

Defined results: the size of a row is its text's UTF-8 bytes plus one (null: no bytes); null and empty texts form one
group; repeated rows and ids are rows like any others; an empty table has no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import narrow, ordinals
from vitalgrid.session import stage

FINE = 4096


def deal(loads: list[int], classes: list[tuple[int, int]]) -> list[list[int]]:
    """Groups of each (size, count) class, sizes falling, that each shard gets; ``loads`` grows along.

    The result is that of giving each group in turn to the least loaded shard (ties to the lower number).
    """
    out = []
    for size, count in classes:
        got = [0] * len(loads)
        if count > 4 * len(loads):
            # What stays two groups under the final level is certain; the heap settles the rest.
            low, high = min(loads), max(loads) + size * count
            while low < high:
                level = (low + high + 1) // 2
                if sum(max(0, (level - x) // size) for x in loads) <= count:
                    low = level
                else:
                    high = level - 1
            got = [max(0, (low - x) // size - 2) for x in loads]
        heap = [(x + g * size, k) for k, (x, g) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, k = heap[0]
            got[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        for k, g in enumerate(got):
            loads[k] += g * size
        out.append(got)
    return out


def assign(
    df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row: equal texts in one shard, shards near equal in bytes."""
    spark = df.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = narrow(df, id_col, text_col)
    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stage(
        docs.select(
            "id", (F.length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
            F.unhex(F.sha2(whole, 256)).alias("grp"),
        )
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    # log2 rounds at powers of two; classes need only be alike for equal sizes and fall with the size.
    octave = F.greatest(F.floor(F.log2(F.col("bytes") / FINE)), F.lit(0))
    step = F.pow(F.lit(2.0), octave)
    kind = F.when(F.col("bytes") < FINE, F.col("bytes")).otherwise(
        (octave + 1) * (4 * FINE) + F.floor(F.col("bytes") / step)
    ).cast("long")
    numbered = stage(ordinals(groups.withColumn("kind", kind), "kind", ["grp"], "ord", buckets))
    # At most FINE rows for the small sizes and FINE per octave above them.
    sizes = numbered.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("top")).collect()
    loads = [0] * shards
    bounds = []

    def dealt(classes: list) -> None:
        for row, got in zip(classes, deal(loads, [(r["top"], r["n"]) for r in classes]), strict=True):
            ends, total = [], 0
            for g in got:
                total += g
                ends.append(total)
            bounds.append((row["kind"], ends))

    def placed(kinds: DataFrame) -> DataFrame:
        table = spark.createDataFrame(bounds, "k long, ends array<long>")
        # One row per class: bounded by FINE per octave of sizes.
        return kinds.join(F.broadcast(table), F.col("kind") == F.col("k")).select(
            "grp", "bytes", F.expr("size(filter(ends, e -> e <= ord))").alias("shard")
        )

    ordered = sorted(sizes, key=lambda r: -r["top"])
    large = [r for r in ordered if r["kind"] >= FINE]
    dealt(large)
    if large:
        exact = placed(numbered.where(F.col("kind") >= FINE)).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        loads[:] = [0] * shards
        for r in exact:
            loads[r["shard"]] = r["b"]
    dealt([r for r in ordered if r["kind"] < FINE])
    home = placed(numbered).select(F.col("grp").alias("g"), "shard")
    found = rows.join(home, F.col("grp") == F.col("g")).select("id", "size", "text_crc32", "shard")
    return ordinals(found, "shard", ["id", "size", "text_crc32"], "slot", 16 * buckets)
