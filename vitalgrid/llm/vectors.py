"""What the vector searches share: usable vectors, classes of equal vectors, query blocks and the final ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.session import stage

# Queries that are held in a task at a time; more queries take more passes over the index.
QUERY_BLOCK = 1024


def usable(df: DataFrame, id_col: str, vec: Column) -> DataFrame:
    """(id, vec as array<double>) of rows whose vector is there and has finite components only."""
    rows = df.select(F.col(id_col).alias("id"), vec.cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return rows.where(F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, ids, vec): each distinct vector once with its ``keep`` smallest distinct ids.

    More ids of one vector can't be among the first ``keep`` - 1 results, so a vector that very many rows have
    is no larger than any other: every batch sends its ``keep`` smallest at most.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                found.setdefault(tuple(x + 0.0 for x in v), []).append(i)
            ids = [sorted(set(own), key=lambda i: (i is not None, i))[:keep] for own in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(batch.column("id").type)), pa.array([list(v) for v in found], pa.list_(pa.float64()))],
                ["ids", "vec"],
            )

    part = rows.mapInArrow(few, f"ids array<{id_type}>, vec array<double>")
    met = part.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    return stage(met.select(F.monotonically_increasing_id().alias("cid"), "ids", "vec"))


def width(found: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as filled with zeros."""
    return found.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a list column, filled with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims)
    out = np.zeros((len(lens), dims))
    own = np.repeat(np.arange(len(lens)), lens)
    out[own, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def query_blocks(queries: DataFrame, dims: int, size: int = QUERY_BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of about ``size`` queries at a time: the only rows that ever reach the driver."""
    blocks = -(-queries.count() // size)
    dealt = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))
    for b in range(blocks):
        rows = dealt.where(F.col("_b") == b).collect()
        out = np.zeros((len(rows), dims))
        for k, r in enumerate(rows):
            out[k, : len(r["vec"])] = r["vec"][:dims]
        if rows:
            yield [r["id"] for r in rows], out


def ranked(found: DataFrame, ids: list, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the first ``k`` from rows (q, score, ids): q numbers the block's queries."""
    spark = found.sparkSession
    vec_type = found.schema["ids"].dataType.elementType
    names = spark.createDataFrame(
        list(enumerate(ids)), f"q int, query_id {vec_type.simpleString()}"
    )
    rows = found.select("q", "score", F.explode("ids").alias("vec_id")).join(F.broadcast(names), "q")  # one block of names
    rows = rows.where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def id_order(ids: list) -> np.ndarray:
    """Numbers that sort as the ids do (null first)."""
    try:
        return np.array(ids, np.int64)
    except (TypeError, ValueError, OverflowError):
        place = {x: k for k, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
        return np.array([place[x] for x in ids], np.int64)


class Best:
    """Running best classes of each query of a block over the batches of a task; scores stay of the kind given."""

    def __init__(self, queries: int, keep: int, least: float | int = -np.inf) -> None:
        self.keep = keep
        #: The score that a further vector must reach, per query.
        self.bar = np.full(queries, least)
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def take(self, q: np.ndarray, score: np.ndarray, ids: list[list]) -> None:
        """Offer pairs of a query and a class with the class's ids, smallest first."""
        low = id_order([own[0] for own in ids])
        # Whole numbers fall without overflow as their complements.
        falling = ~score if score.dtype.kind == "i" else -score
        order = np.lexsort((low, falling, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        for k in order[place < self.keep]:
            first = ids[k][0]
            self.rows[q[k]].append((-score[k].item(), first is not None, first, ids[k]))
        for k in np.unique(q):
            own = sorted(self.rows[k], key=lambda x: x[:3])[: self.keep]
            self.rows[k] = own
            if len(own) == self.keep:
                self.bar[k] = -own[-1][0]

    def out(self) -> tuple[list[int], list, list[list]]:
        """(query, score, ids) of all that is held."""
        held = [(k, -x[0], x[3]) for k, own in enumerate(self.rows) for x in own]
        return [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]
