"""Exact top-k by inner product over a vector-approximation file.

Every dimension is cut into cells of near equal shares of the values, with widening cells towards its least and largest
value, and a vector is approximated by its cell numbers, one byte each. A scan of the cells bounds every score from both sides; only vectors whose upper bound reaches
the k-th best lower bound of all are candidates, and their exact vectors are read in order of the bound until the
k-th result is certain.

Defined results: components are integers held as doubles, the score is their integer inner product (exact; beyond the
range of a long it stays at the end of that range). Vectors that are null or hold a null or non-finite component take no part;
shorter vectors count as filled with zeros; equal vectors are scored once and all their ids compete, equal rows counting
once; fewer candidates than asked for give fewer rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from vitalgrid.llm import vectors
from vitalgrid.llm.common import bitmap_of, probably_in
from vitalgrid.session import stage

CELLS = 256
# Cells on each side of the inner ones, for what lies beyond all but half a hundredth of the values.
OUTER = 32
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def floored(vec: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down, as a double; what is not finite stays so, and large doubles are whole."""
    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vec, one)


def grid(found: DataFrame, dims: int) -> np.ndarray:
    """(dims, CELLS + 1) borders of the cells of every dimension.

    Inner cells hold near equal shares of the values; on both sides cells that widen geometrically lead to the least
    and the largest value, so a few extreme values widen no other value's cell by much. One aggregate with a fixed
    number of quantiles per dimension.
    """
    inner = CELLS - 2 * OUTER
    shares = [0.0, *np.linspace(0.005, 0.995, inner + 1).tolist(), 1.0]
    values = found.select(F.posexplode("vec").alias("d", "x"))
    rows = values.groupBy("d").agg(
        F.percentile_approx("x", shares, 20 * CELLS).alias("at"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.count(F.lit(1)).alias("n"),
    ).collect()  # one row per dimension
    total = found.count()
    out = np.zeros((dims, CELLS + 1))
    for r in rows:
        # Shorter vectors count as filled with zeros, so zero is a value of their dimensions too.
        zero = [0.0] if r["n"] < total else []
        low, high = min([r["low"], *zero]), max([r["high"], *zero])
        middle = np.sort(np.array(r["at"][1:-1]))
        width = max((middle[-1] - middle[0]) / inner, abs(middle).max() * 1e-9, 1e-300)
        out[r["d"]] = np.concatenate((
            (middle[0] - _widening(middle[0] - low, width))[::-1], middle, middle[-1] + _widening(high - middle[-1], width)
        ))
        out[r["d"], 0], out[r["d"], -1] = low, high
    return np.maximum.accumulate(out, axis=1)


def _widening(reach: float, first: float) -> np.ndarray:
    """OUTER distances up to ``reach``, the first about ``first`` and each a fixed multiple of the one before."""
    if reach <= first:
        return np.linspace(0, max(reach, 0), OUTER + 1)[1:]
    return np.exp(np.linspace(np.log(first), np.log(reach), OUTER))


def approximate(found: DataFrame, borders: np.ndarray) -> DataFrame:
    """(cid, cells): the approximation file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column("vec"), len(borders))
            cells = np.zeros(rows.shape, np.uint8)
            for d, own in enumerate(borders):
                cells[:, d] = np.clip(np.searchsorted(own, rows[:, d], side="right") - 1, 0, CELLS - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array([c.tobytes() for c in cells], pa.binary())], ["cid", "cells"]
            )

    return found.select("cid", "vec").mapInArrow(run, "cid long, cells binary")


def _bounds(cells: DataFrame, queries: np.ndarray, borders: np.ndarray, keep: int) -> DataFrame:
    """(q, cid, lb, ub) of classes that the bounds of their task can't rule out."""
    dims = len(borders)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    length = np.sqrt((queries**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), keep), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            q, cid, lb, ub = (np.concatenate(x) for x in zip(*held, strict=True))
            use = ub >= best[q, 0]
            return pa.RecordBatch.from_arrays(
                [pa.array(q[use].astype(np.int32)), pa.array(cid[use]), pa.array(lb[use]), pa.array(ub[use])],
                ["q", "cid", "lb", "ub"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, dims)
                low, high = borders[np.arange(dims), raw], borders[np.arange(dims), raw + np.intp(1)]
                # Rounding of the sums is far below this share of the largest sum a vector of the cell can have.
                slack = 1e-12 * np.outer(length, np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=1))) + 1e-6
                lb = up @ low.T + down @ high.T - slack
                ub = up @ high.T + down @ low.T + slack
                best = np.sort(np.concatenate([best, lb], axis=1), axis=1)[:, -keep:]
                q, x = np.nonzero(ub >= best[:, :1])
                held.append((q, part.column("cid").to_numpy()[x], lb[q, x], ub[q, x]))
                size += len(q)
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return cells.mapInArrow(run, "q int, cid long, lb double, ub double")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row integer inner products of integral doubles, as longs."""
    if not len(a):
        return np.zeros(0, np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(p, r, strict=True)) for p, r in zip(a, b, strict=True)]
    return np.array([min(_MOST, max(_LEAST, s)) for s in sums], np.int64)


def _read(pairs: DataFrame, queries: np.ndarray, keep: int) -> DataFrame:
    """(q, score, ids): exact scores in falling order of the upper bound, while it can still matter."""
    dims = queries.shape[1]
    id_type = pairs.schema["ids"].dataType
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vectors.Best(len(queries), keep, _LEAST)
        for batch in batches:
            q, ub = batch.column("q").to_numpy(), batch.column("ub").to_numpy()
            use = np.flatnonzero(ub >= best.bar[q])  # what lies below is certain not to enter
            if len(use):
                rows = vectors.matrix(batch.column("vec"), dims)
                ids = batch.column("ids").to_pylist()
                best.take(q[use], exact_scores(queries[q[use]], rows[use]), [ids[k] for k in use])
        q, score, ids = best.out()
        if q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, arrow_type)], ["q", "score", "ids"]
            )

    return pairs.select("q", "ub", "vec", "ids").mapInArrow(run, f"q int, score long, ids {id_type.simpleString()}")


def _block(found: DataFrame, cells: DataFrame, queries: np.ndarray, borders: np.ndarray, keep: int) -> DataFrame:
    bounds = stage(_bounds(cells, queries, borders, keep))
    first = Window.partitionBy("q").orderBy(F.desc("lb"))
    top = bounds.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep)
    bar = top.groupBy("q").agg(F.min("lb").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") == keep)
    # One row per query of the block.
    sure = bounds.join(F.broadcast(bar.select("q", "bar")), "q", "left").where("bar is null or ub >= bar")
    sure = stage(sure.select("q", "cid", "ub"))
    near = probably_in(found, "cid", stage(bitmap_of(sure, "cid"))).where("_maybe").drop("_maybe")
    pairs = sure.join(near, "cid").sortWithinPartitions(F.desc("ub"))
    return _read(pairs, queries, keep)


def top_k(df: DataFrame, is_query: Column, k: int, vec: Column, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest scores for each query row, itself left out.

    ``vec`` gives the components as whole numbers in doubles.
    """
    found = vectors.classes(vectors.usable(df, id_col, vec), k + 1)
    dims = vectors.width(found)
    borders = grid(found, dims)
    cells = stage(approximate(found, borders))
    queries = vectors.usable(df.where(is_query), id_col, vec).distinct()
    out = None
    for ids, block in vectors.query_blocks(queries, dims):
        part = vectors.ranked(_block(found, cells, block, borders, k + 1), ids, k)
        out = part if out is None else out.union(part)
    if out is None:
        out = vectors.ranked(_read(found.select(F.lit(0).alias("q"), F.lit(0.0).alias("ub"), "vec", "ids").limit(0), np.zeros((1, dims)), k + 1), [], k)
    return out
