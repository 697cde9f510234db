"""Ranked lexical search over posting lists cut into geometric blocks.

Documents are indexed in shards of bounded size. Within a shard every term's posting list is clustered by the
similarity of its documents into blocks; each block stores the coordinatewise maximum of its documents' term scores, rounded
up to eight bits. The inner product of a query with that summary bounds the score of every document of the block, so
a block is left out only if its bound is below the k-th best score known; every other block is scored exactly. A first
pass over a share of the shards gives each query the score that the pass over all shards starts from.

Defined results: terms as in ``terms``; texts without terms (null, empty, separators only) are no documents and, as
queries, have no result. Repeated documents are documents of their own; equal scores go by ascending id, a null id
last. Rows of the queries with equal id and terms count once; the same id with other terms is a query of its own.
An empty table of either kind gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm import terms
from vitalgrid.llm.common import narrow, released, rows_per_batch
from vitalgrid.session import BROADCAST_BYTES, LARGE_ROWS, settle, stage

# Documents of a block, about (a shorter list has none); documents of a shard, and its documents x terms, at most.
BLOCK = 48
SHARD_ROWS = 512
SHARD_CELLS = 1 << 22
# Distinct terms of the queries that are searched for together, about.
QUERY_TERMS = 8192
# One shard in so many is searched first, for the scores to start from.
SEED = 16
# Summaries drop so many low bits (upwards): a term's score in a document is below 1,000,000.
SHIFT = 12
# Bits of the prefilter of terms that some query holds (8 MB, whatever the queries).
FILTER_BITS = 1 << 26
_DIMENSIONS = 32
_FORWARD = "id long, n long, terms array<string>, tfs array<long>"
_INDEX = (
    "seed boolean, ids array<long>, terms array<string>, rows binary, coords binary, scores binary, docs binary, "
    "ends binary, blocks binary, lists binary, sums binary, sum_coords binary, sum_scores binary"
)


def _counts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and the distinct terms that pass the prefilter with their counts."""
    for batch in batches:
        for piece in terms.pieces(batch.column(1)):
            size = len(piece.terms)
            keep = np.ones(size, bool)
            if wanted is not None:
                bit = np.fromiter((zlib.crc32(t.encode()) for t in piece.terms.to_pylist()), np.int64, size) % FILTER_BITS
                keep = (wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            inside = keep[piece.code]
            key, times = np.unique(piece.row[inside] * max(size, 1) + piece.code[inside], return_counts=True)
            bounds = np.searchsorted(key, np.arange(piece.rows + 1) * max(size, 1)).astype(np.int32)
            found = piece.terms.take(pa.array(key % max(size, 1)))
            yield pa.record_batch([
                batch.column(0).slice(piece.first, piece.rows).cast(pa.int64()),
                pa.array(np.bincount(piece.row, minlength=piece.rows)),
                pa.ListArray.from_arrays(bounds, found.cast(pa.string())),
                pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
            ], names=["id", "n", "terms", "tfs"])


def forward(docs: DataFrame, query_terms: DataFrame | None = None) -> DataFrame:
    """(id, n, terms, tfs) of documents with at least one term, as a written table.

    ``query_terms`` (term) leaves out terms that no query holds, up to collisions in a bitmap of fixed size; ``n``
    counts all terms.
    """
    wanted = None
    if query_terms is not None:
        octets = query_terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)).alias("b")).groupBy(
            F.shiftright("b", 3).alias("at")
        ).agg(F.bit_or(F.expr("shiftleft(1, cast(b % 8 as int))")).alias("bits"))
        wanted = np.zeros(FILTER_BITS // 8, np.uint8)  # the rows below are one for each of its bytes at most
        for part in octets.toArrow().to_batches():
            wanted[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return stage(docs.select("id", "text").mapInArrow(released(lambda b: _counts(b, wanted)), _FORWARD).where("n > 0"))


def _narrow(width: int) -> type:
    """The smallest kind of number that counts the terms of a shard."""
    return np.uint16 if width <= 1 << 16 else np.int32


def _block_up(ids: pa.Array, n: np.ndarray, own: pa.ListArray, tfs: pa.ListArray, documents: int, all_terms: int) -> list:
    """Rows of the index: documents by row, posting lists by block, summaries by block."""
    coded = own.flatten().dictionary_encode()
    width, coords = len(coded.dictionary), coded.indices.to_numpy()
    if len(ids) > 1 and len(ids) * width > SHARD_CELLS:
        half, out = len(ids) // 2, []
        for a, size in ((0, half), (half, len(ids) - half)):
            part = [x.slice(a, size) for x in (ids, own, tfs)]
            out += _block_up(part[0], n[a : a + size], part[1], part[2], documents, all_terms)
        return out
    sizes = pc.list_value_length(own).to_numpy()
    rows, of, tf = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(len(ids)), sizes), tfs.flatten().to_numpy()
    scores = (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // all_terms)[of])
    dense = np.zeros((len(ids), width), np.uint8)
    dense[of, coords] = (scores + (1 << SHIFT) - 1) >> SHIFT
    held = np.bincount(coords, minlength=width)
    axes = np.random.default_rng(11).standard_normal((width, _DIMENSIONS), np.float32)
    place = dense.astype(np.float32) @ (axes * np.log1p(len(ids) / np.maximum(held, 1)).astype(np.float32)[:, None])
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
    docs, ends = of[np.argsort(coords, kind="stable")], np.concatenate(([0], np.cumsum(held)))
    blocks, lists, where, most = [], np.zeros(width + 1, np.int64), [], []
    for t in range(width):
        a, b = ends[t], ends[t + 1]
        if b - a >= BLOCK:
            members, k = docs[a:b], -(-(b - a) // BLOCK)
            nearest = np.argmax(place[members] @ place[members[np.arange(k) * (b - a) // k]].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            docs[a:b], nearest = members[order], nearest[order]
            cuts = a + np.concatenate(([0], np.flatnonzero(np.diff(nearest)) + 1, [b - a]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                top = dense[docs[x:y]].max(axis=0)
                where.append(np.flatnonzero(top))
                most.append(top[where[-1]])
                blocks.append((x, y))
        lists[t + 1] = len(blocks)
    sums = np.cumsum([0, *[len(w) for w in where]])
    flat = lambda x, kind: (np.concatenate(x) if x else np.zeros(0)).astype(kind).tobytes()
    return [(
        zlib.crc32(repr(ids.slice(0, 8).to_pylist()).encode()) % SEED == 0, ids.to_pylist(), coded.dictionary.to_pylist(),
        rows.astype(np.int64).tobytes(), coords.astype(_narrow(width)).tobytes(), scores.astype(np.int32).tobytes(),
        docs.astype(np.int32).tobytes(), ends.astype(np.int64).tobytes(), flat([np.array(blocks).ravel()], np.int32),
        lists.tobytes(), sums.astype(np.int64).tobytes(), flat(where, _narrow(width)), flat(most, np.uint8),
    )]


def _shards(batches: Iterator[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("seed", pa.bool_()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
        *[(c.split()[0], pa.binary()) for c in _INDEX.split(", ")[3:]],
    ])
    waiting, held = [], 0

    def out(all_rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n, own, tfs = (c.combine_chunks() for c in all_rows.columns)
        for row in _block_up(ids, n.to_numpy(), own, tfs, documents, all_terms):
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for first in range(0, batch.num_rows, SHARD_ROWS):
            waiting.append(batch.slice(first, SHARD_ROWS))
            held += waiting[-1].num_rows
            if held >= SHARD_ROWS:
                table = pa.Table.from_batches(waiting)
                yield from out(table.slice(0, SHARD_ROWS))
                waiting, held = table.slice(SHARD_ROWS).to_batches(), held - SHARD_ROWS
    if held:
        yield from out(pa.Table.from_batches(waiting))


def index(found: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """Shards of blocked posting lists of a forward table, written; nothing is shuffled."""
    held = found.where(F.size("terms") > 0).select("id", "n", "terms", "tfs")
    return stage(held.mapInArrow(released(lambda b: _shards(b, documents, all_terms)), _INDEX), **LARGE_ROWS)


class _Shard:
    """A row of the index, its arrays by name."""

    def __init__(self, row: dict) -> None:
        kinds = {"sum_scores": np.uint8} | dict.fromkeys(("rows", "ends", "lists", "sums"), np.int64)
        kinds |= dict.fromkeys(("coords", "sum_coords"), _narrow(len(row["terms"])))
        self.ids, self.number = row["ids"], {t: k for k, t in enumerate(row["terms"])}
        for column in _INDEX.split(", ")[3:]:
            name = column.split()[0]
            setattr(self, name, np.frombuffer(row[name], kinds.get(name, np.int32)))
        self.order = np.argsort(np.argsort([(1 << 63) - 1 if i is None else i for i in self.ids], kind="stable"))
        self.peak = np.zeros(len(self.number), np.int64)
        np.maximum.at(self.peak, self.coords, self.scores)

    @staticmethod
    def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of several half-open ranges after one another."""
        sizes = ends - starts
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def _totals(self, rows: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` over the given rows of a ragged array, values laid out row after row."""
        sums = np.concatenate(([0], np.cumsum(values)))
        ends = np.cumsum(bounds[rows + 1] - bounds[rows])
        return sums[ends] - sums[ends - (bounds[rows + 1] - bounds[rows])]

    def _members(self, own: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
        """Documents of some lists, without the blocks that their summaries rule out; short lists have no blocks."""
        short = own[self.lists[own] == self.lists[own + 1]]
        blocks = self._ranges(self.lists[own], self.lists[own + 1])
        at = self._ranges(self.sums[blocks], self.sums[blocks + 1])
        bound = self._totals(blocks, self.sums, weight[self.sum_coords[at]] * self.sum_scores[at]) << SHIFT
        blocks = blocks[bound >= least]
        spans = self._ranges(self.blocks[2 * blocks], self.blocks[2 * blocks + 1])
        return self.docs[np.concatenate((self._ranges(self.ends[short], self.ends[short + 1]), spans))]

    def best(self, query: list[str], weights: list[int], k: int, least: int) -> list[tuple[int | None, int]]:
        """The k best documents that score ``least`` or more.

        Lists come by falling bound; once all that are left add up to less than the k-th score, no new document in
        them can reach it.
        """
        known = [(self.number[t], w) for t, w in zip(query, weights, strict=True) if t in self.number]
        if not known:
            return []
        weight = np.zeros(len(self.number), np.int64)
        own, value = (np.array(c, np.int64) for c in zip(*known, strict=True))
        weight[own] = value
        falling = np.argsort(-value * self.peak[own], kind="stable")
        own = own[falling]
        left = np.cumsum((weight[own] * self.peak[own])[::-1])[::-1]
        seen, step, first = np.zeros(len(self.ids), bool), 4, 0
        docs, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(least, 1)
        while first < len(own) and left[first] >= least:
            fresh = self._members(own[first : first + step], weight, least)
            fresh = np.unique(fresh[~seen[fresh]]).astype(np.int64)
            seen[fresh] = True
            at = self._ranges(self.rows[fresh], self.rows[fresh + 1])
            exact = self._totals(fresh, self.rows, weight[self.coords[at]] * self.scores[at])
            docs, score = np.concatenate((docs, fresh)), np.concatenate((score, exact))
            top = np.lexsort((self.order[docs], -score))[:k]
            docs, score = docs[top], score[top]
            if len(docs) == k:
                least = max(least, int(score[-1]))
            first, step = first + step, step * 2
        return [(self.ids[d], int(s)) for d, s in zip(docs, score, strict=True) if s >= least]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number in range(batch.num_rows):
            row, out = batch.slice(number, 1).to_pylist()[0], ([], [], [])
            shard = _Shard(row)
            for item in row["items"]:
                for doc, score in shard.best(item["terms"], item["weights"], k, item["least"] or 0):
                    for column, value in zip(out, (item["item"], doc, score), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["item", "id", "score"])


def _hits(shards: DataFrame, items: DataFrame, blocks: int, k: int) -> DataFrame:
    """Every shard against every block of queries; the blocks are sent along only if their bytes were counted to be few."""
    packed = settle(items.groupBy("block").agg(F.collect_list(F.struct("item", "terms", "weights", "least")).alias("items")))
    size = items.agg(F.sum(F.size("terms") * 40 + 64)).first()[0] or 0
    dealt = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    packed = F.broadcast(packed) if size <= BROADCAST_BYTES else packed
    columns = [*[f.split()[0] for f in _INDEX.split(", ")], "items"]
    joined = dealt.join(packed, "block").select(*columns)
    found = joined.mapInArrow(released(lambda b: _search(b, k)), "item long, id long, score long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search(
    documents: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
    query_col: str = "item_id", query_text_col: str = "text",
) -> DataFrame:
    """(query, rank, id, score): the k best documents for every query.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score adds, over the query's terms with repeats,
    the weight times (10^9 tf) div (1000 tf + 8 m), where m = 25 + (75 n N) div L.
    """
    spark = documents.sparkSession
    asked = narrow(queries, query_col, query_text_col).distinct()
    asked = settle(asked.mapInArrow(released(lambda b: _counts(b, None)), _FORWARD).where("n > 0"))
    # A number for every query: ids may repeat with another text.
    key = F.xxhash64("id", F.col("terms"), F.col("tfs"))
    asked = asked.withColumn("item", key).dropDuplicates(["item"])
    words = asked.select("item", "id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "item", "id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")
    )
    words = settle(words)
    distinct = settle(words.select("term").distinct())
    found = forward(narrow(documents, id_col, text_col), distinct)
    total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total[0]:
        return spark.createDataFrame([], "query long, rank int, id long, score long")
    shards = index(found, total[0], total[1])
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total[0] + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = words.join(held, "term").select(
        "item", "id", F.struct("term", (weight * F.col("times")).alias("weight")).alias("t")
    )
    blocks = max(1, -(-distinct.count() // QUERY_TERMS))
    items = settle(
        weighed.groupBy("item").agg(F.first("id").alias("query"), F.collect_list("t").alias("t")).select(
            "item", "query", F.pmod("item", F.lit(blocks)).cast("int").alias("block"),
            F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"),
        )
    )
    with rows_per_batch(spark, 4):
        first = _hits(shards.where("seed"), items.withColumn("least", F.lit(0).cast("long")), blocks, k)
        least = settle(first.where(F.col("rank") == k).select("item", F.col("score").alias("least")))
        best = stage(_hits(shards, items.join(least, "item", "left"), blocks, k))
    return best.join(items.select("item", "query"), "item").select("query", "rank", "id", "score")
