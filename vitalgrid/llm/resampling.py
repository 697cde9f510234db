"""Target-distribution importance resampling with exact global ranks.

Features (runs of words) are hashed to buckets. Counts per bucket of all documents and of all target texts give each
bucket a gain, a document's weight is the floored mean of the gains over its array of buckets, and hash noise of the
extreme-value kind turns drawing without replacement into taking the highest scores. Ranks come from parallel sorting
by regular sampling: every task sorts its run and gives every so-manieth key; sorted, those keys give regular
splitters; the segments between splitters are exchanged and merged locally, and the counts of the segments before a
segment turn a place in it into an exact rank.

Defined results: words as in ``terms``; null, empty and wordless texts have no feature, weight 0, and are not drawn
unless ``least_words`` is 0. Repeated rows are documents of their own with ranks of their own; equal scores go by
ascending id (null last), features and weight. A null id has the noise of an empty one. Tables without rows give no
row; a target without words makes every gain depend on the documents alone. Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm import terms
from vitalgrid.llm.common import narrow
from vitalgrid.session import stage

# Sampled keys for each segment of the exchange, about.
SAMPLES = 64
# Segments of the exchange at most: their bounds are collected.
SEGMENTS = 1 << 11
_NAMES = "id long, n_words long, n_features long, buckets binary"
# From the first place to the last.
_KEY = ("down", "absent", "id", "n_features", "weight", "place")
_KEY_SCHEMA = "down long, absent int, id long, n_features long, weight long, place long"


def _hashed(piece: terms.Piece, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``longest`` words, row after row."""
    words = piece.terms.to_pylist()
    raw = [w.encode() for w in words]
    single = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
    rows, found = [piece.row], [single[piece.code]]
    for size in range(2, longest + 1):
        if len(piece.row) < size:
            break
        whole = np.flatnonzero(piece.row[size - 1 :] == piece.row[: len(piece.row) - size + 1])
        runs = (b" ".join(raw[c] for c in piece.code[k : k + size]) for k in whole)
        rows.append(piece.row[whole])
        found.append(np.fromiter((zlib.crc32(r) for r in runs), np.int64, len(whole)) % buckets)
    row, bucket = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def _features(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in terms.pieces(batch.column(1)):
            row, bucket = _hashed(piece, longest, buckets)
            sizes = np.bincount(row, minlength=piece.rows)
            bounds = np.concatenate(([0], np.cumsum(4 * sizes))).astype(np.int32)
            data = pa.py_buffer(bucket.astype("<i4").tobytes())
            yield pa.record_batch([
                batch.column(0).slice(piece.first, piece.rows).cast(pa.int64()),
                pa.array(np.bincount(piece.row, minlength=piece.rows)), pa.array(sizes),
                pa.Array.from_buffers(pa.binary(), piece.rows, [None, pa.py_buffer(bounds), data]),
            ], names=["id", "n_words", "n_features", "buckets"])


def features(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets) of ``id`` and ``text``: the buckets of all features of a text in one array."""
    return docs.select("id", "text").mapInArrow(lambda b: _features(b, longest, buckets), _NAMES)


def _totals(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for octets in batch.column(0):
            total += np.bincount(np.frombuffer(octets.as_py(), "<i4"), minlength=buckets)
    yield pa.record_batch([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all features of a table; a task gives one row per bucket at most."""
    partial = found.select("buckets").mapInArrow(lambda b: _totals(b, buckets), "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, an array of ``buckets`` numbers: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toLocalIterator():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.array([gain[np.frombuffer(b.as_py(), "<i4")].sum() for b in batch.column(3)], np.int64)
        weight = total // np.maximum(batch.column(2).to_numpy(), 1)
        columns = [*batch.columns[:3], pa.array(weight)]
        yield pa.record_batch(columns, names=["id", "n_words", "n_features", "weight"])


def noise(id_col: str | Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u between 0 and 1 from the digest of seed and id."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296)))


def _regular(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Every ``step``-th row of a sorted run, from half a step on."""
    before = 0
    for batch in batches:
        places = np.arange((step // 2 - before) % step, batch.num_rows, step)
        before += batch.num_rows
        yield batch.take(pa.array(places))


def _deal(batches: Iterator[pa.RecordBatch], splitters: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Each row's segment: how many splitters are not behind its key."""
    for batch in batches:
        keys = zip(*[batch.column(k).fill_null(0).to_pylist() for k in range(len(_KEY))], strict=True)
        segment = pa.array([bisect_right(splitters, key) for key in keys], pa.int32())
        yield pa.record_batch([*batch.columns, segment], names=[*_KEY, "score", "segment"])


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """Exact ranks from 1 by falling ``score``, then id, features and weight, of (id, n_features, weight, score).

    ``count`` is the number of rows. What reaches the driver is bounded: the sample (a fixed number of keys for each
    segment, and one for each run at most) and the segments' counts.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("down", -F.col("score")).withColumn("absent", F.col("id").isNull().cast("int"))
    # Written: a task that runs again must not number its rows anew once splitters depend on the numbers.
    held = stage(numbered.withColumn("place", F.monotonically_increasing_id()).select(*_KEY, "score"))
    runs = held.sortWithinPartitions(*_KEY)
    segments = min(SEGMENTS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, count // (SAMPLES * segments))
    sample = runs.select(*_KEY).mapInArrow(lambda b: _regular(b, step), _KEY_SCHEMA).fillna(0, ["id"]).collect()
    keys = sorted(map(tuple, sample))
    splitters = [keys[k * len(keys) // segments] for k in range(1, segments)] if keys else []
    dealt = runs.mapInArrow(lambda b: _deal(b, splitters), f"{_KEY_SCHEMA}, score long, segment int")
    counts = dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()
    start, starts = 0, []
    for segment, n in sorted(map(tuple, counts)):
        starts.append((segment, start))
        start += n
    offsets = spark.createDataFrame(starts, "segment int, start long")
    merged = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("segment").orderBy(*_KEY)))
    placed = merged.join(F.broadcast(offsets), "segment")
    return placed.select("id", "n_features", "weight", "score", (F.col("start") + F.col("inside")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int, buckets: int = 10000, longest: int = 2, least_words: int = 20,
    seed: str = "2024:", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every document's (id, n_features, weight, score, rank): drawn ones have ranks from 1, the others null."""
    found = stage(features(narrow(docs, id_col, text_col), longest, buckets))
    wanted = features(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text_col).alias("text")), longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    weighed = found.mapInArrow(lambda b: _weights(b, gain), "id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise("id", seed)))
    fit = scored.where(F.col("n_words") >= least_words)
    count = fit.count()
    drawn = ranked(fit.drop("n_words"), count).withColumn(
        "rank", F.when(F.col("rank") <= percent * count // 100, F.col("rank"))
    )
    rest = scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)
