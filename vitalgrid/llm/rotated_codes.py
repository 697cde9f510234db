"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is turned by one fixed random rotation and keeps the signs, packed into bits, and one correction
scalar, the inner product of the turned vector with its own sign vector. From those the inner product with a query is
estimated without bias, with an error that exceeds its bound rarely. A vector is read exactly only if the upper
bound of its cosine reaches the best lower bounds or the exact results found so far.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; shorter vectors count
as filled with zeros; equal vectors are scored once and all their ids compete, equal rows counting once; fewer candidates
than asked for give fewer rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vitalgrid.llm import vectors
from vitalgrid.session import stage

# Width of the error bounds in standard deviations.
SIGMAS = 2.2
SEED = 11


def rotation(dims: int) -> np.ndarray:
    """A random rotation of ``dims`` rounded up to whole bytes of bits."""
    size = max(8, -(-dims // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: no square vanishes or overflows."""
    power = np.frexp(np.abs(rows).max(axis=1, initial=0))[1]
    # In two halves, because the power itself may be beyond the range of a double.
    return np.ldexp(np.ldexp(rows, -(power // 2)[:, None]), -(power - power // 2)[:, None])


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction) of non-zero vectors."""
    size = turn.shape[0]
    rows = scaled(rows)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    turned = unit @ turn[: rows.shape[1]]
    bits = turned > 0
    return np.packbits(bits, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(size)


def estimates(bits: np.ndarray, correction: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) estimates of the cosine, and the error bound of each vector."""
    size = turned.shape[1]
    signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
    product = turned.astype(np.float32) @ signs.T / np.float32(np.sqrt(size))
    error = SIGMAS * np.sqrt(np.maximum(1 - correction**2, 0) / correction**2 / max(1, size - 1))
    return product / correction.astype(np.float32), error.astype(np.float32) + np.float32(1e-5)


def index(found: DataFrame, dims: int) -> DataFrame:
    """Adds ``bits`` and ``correction`` to the classes of vectors."""
    turn = rotation(dims)
    id_type = found.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, correction = encode(vectors.matrix(batch.column("vec"), dims), turn)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("vec"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(correction)],
                ["ids", "vec", "bits", "correction"],
            )

    shape = f"ids {id_type}, vec array<double>, bits binary, correction double"
    return found.select("ids", "vec").mapInArrow(run, shape)


def _search(coded: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(q, score, ids): every task's best classes for each query of a block."""
    dims = queries.shape[1]
    queries = scaled(queries)
    length = np.sqrt((queries**2).sum(axis=1))
    turned = (queries / length[:, None]) @ rotation(dims)[:dims]
    id_type = coded.schema["ids"].dataType.simpleString()
    keep = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vectors.Best(len(queries), keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                near, error = estimates(raw, part.column("correction").to_numpy(), turned)
                low = near - error
                bar = best.bar
                if part.num_rows >= keep:
                    bar = np.maximum(bar, np.partition(low, -keep, axis=1)[:, -keep])
                q, x = np.nonzero(near + error >= bar[:, None])
                if not len(q):
                    continue
                rows = scaled(vectors.matrix(part.column("vec"), dims))
                norm = np.sqrt((rows**2).sum(axis=1))
                score = np.concatenate(
                    [
                        np.einsum("ij,ij->i", queries[q[a : a + 65536]], rows[x[a : a + 65536]])
                        for a in range(0, len(q), 65536)
                    ]
                ) / (length[q] * norm[x])
                use = score >= best.bar[q]
                ids = part.column("ids").to_pylist()
                best.take(q[use], score[use], [ids[j] for j in x[use]])
        q, score, ids = best.out()
        if q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(score, pa.float64()), pa.array(ids, coded_type)], ["q", "score", "ids"]
            )

    coded_type = to_arrow_type(coded.schema["ids"].dataType)
    return coded.mapInArrow(run, f"q int, score double, ids {id_type}")


def nearest(
    df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each query row by cosine, itself left out."""
    rows = vectors.usable(df, id_col, F.col(vec_col)).where(F.exists("vec", lambda x: x != 0))
    found = vectors.classes(rows, k + 1)
    dims = vectors.width(found)
    queries = vectors.usable(df.where(is_query), id_col, F.col(vec_col)).where(F.exists("vec", lambda x: x != 0))
    coded = stage(index(found, dims))
    out = None
    for ids, block in vectors.query_blocks(queries.distinct(), dims):
        part = vectors.ranked(_search(coded, block, k), ids, k)
        out = part if out is None else out.union(part)
    return out if out is not None else vectors.ranked(_search(coded, np.zeros((0, dims)), k), [], k)
