"""Repeated passages by a logarithmic family of sparse suffix arrays.

A suffix is sampled where the rolling hash of a short gram is the (leftmost) least of a window, so any two equal
strings of ``length`` bytes sample the same suffix at the same place inside them: a sparse array finds every match the
full one would, with one entry per 80 bytes or so. A level of the family is a table of such suffixes sorted by key
(hash of the gram) and context (hash of all bytes of the windows that chose it). A new batch is sorted into a level of
its own, merge-scanned against the levels there are, and levels of equal rank are merged, so that an entry is rewritten
a logarithmic number of times. Keys seen twice are settled exactly on the bytes: the windows of each distinct context
are compared with those of the other contexts of its key.

Defined results: a null text is empty; texts shorter than ``length`` keep every byte; equal rows are separate texts
that repeat each other; matches never cross texts. Input columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import hashing
from vitalgrid.llm.common import bitmap_of, carried, ddl, narrow, probably_in, released, text_key
from vitalgrid.session import stage

GRAM = 32
BATCHES = 3
# Distinct contexts of one key that are compared in one task; keys with more are dealt out by window instead.
CROWD = 2000
_PLACE = np.uint64((1 << 24) - 1)


def _pieces(bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, places where rows begin and the last ends); a very long row comes in overlapping pieces."""
    for first, last in hashing.groups_of_rows(bounds):
        low, high = int(bounds[first]), int(bounds[last])
        if high - low <= 2 * hashing.BLOCK:
            yield first, bounds[first : last + 1]
            continue
        for at in range(low, max(low + 1, high - length + 1), hashing.BLOCK):
            yield first, np.array([at, min(high, at + hashing.BLOCK + length - 1)])


def sample_suffixes(data: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, context, start, windows) of the sampled suffixes of rows that lie one behind another in ``data``.

    ``start`` is the first of the consecutive windows of ``length`` bytes that chose the suffix.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    sums = hashing.prefix(data)
    grams = hashing.mix((sums[gram:] - sums[:-gram]) * hashing.powers(n, inverse=True)[: n - gram + 1])
    value = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    valid = np.ones(count, bool)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        valid[max(a, b - length + 1) : b] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    chosen = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    starts = at[first]
    many = np.diff(np.append(first, len(at)))
    context = hashing.windows(sums, starts, many + (length - 1))
    return grams[chosen[first]], context, starts, many


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, th, key, ctx, start, many) per sampled suffix of every text."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = hashing.utf8(batch.column("text"))
            for first, rows in _pieces(bounds, length):
                key, ctx, start, many = sample_suffixes(data[rows[0] : rows[-1]], rows - rows[0], length, gram)
                if not len(start):
                    continue
                own = np.searchsorted(rows - rows[0], start, side="right") - 1
                take = pa.array(first + own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("th").take(take),
                        pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)),
                        pa.array(start + rows[0] - bounds[first + own]), pa.array(many.astype(np.int64)),
                    ],
                    ["id", "th", "key", "ctx", "start", "many"],
                )

    return docs.mapInArrow(released(run), f"id {id_type}, th long, key long, ctx long, start long, many long")


class SuffixFamily:
    """Levels of sorted sparse suffix arrays that grow batch by batch."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch (key, ctx per suffix); returns the keys that it repeats within itself or from a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.union(b).groupBy("key", "ctx").agg(F.sum("cnt").alias("cnt"))
            self.levels.append((rank + 1, stage(merged.sortWithinPartitions("key", "ctx"))))
        run = stage(
            entries.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("cnt")).sortWithinPartitions("key", "ctx")
        )
        seen = run.select("key", "cnt", F.lit(1).alias("new"))
        for _, level in self.levels:
            seen = seen.union(level.select("key", "cnt", F.lit(0)))
        hits = stage(
            seen.groupBy("key").agg(F.sum("cnt").alias("all"), F.max("new").alias("new"))
            .where("new = 1 and `all` > 1").select("key")
        )
        self.levels.append((0, run))
        self.hits.append(hits)
        return hits

    def repeated(self) -> tuple[DataFrame, DataFrame]:
        """(suffixes of repeated keys with their counts, bitmap of those keys)."""
        keys = self.hits[0]
        for more in self.hits[1:]:
            keys = keys.union(more)
        bitmap = stage(bitmap_of(keys, "key"))
        every = self.levels[0][1]
        for _, level in self.levels[1:]:
            every = every.union(level)
        near = probably_in(every, "key", bitmap).where("_maybe").drop("_maybe")
        known = near.groupBy("key", "ctx").agg(F.sum("cnt").alias("cnt"))
        per_key = known.groupBy("key").agg(
            F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("variants"),
            F.sum((F.col("cnt") == 1).cast("long")).alias("singles"),
        ).where("total > 1")
        return stage(known.join(per_key, "key").drop("total")), bitmap


def _window_hashes(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, window hash, row of the window) over blocks of byte strings."""
    data, bounds = hashing.utf8(column)
    for first, last in hashing.groups_of_rows(bounds):
        rows = bounds[first : last + 1] - bounds[first]
        many = np.diff(rows) - (length - 1)
        own = np.repeat(np.arange(last - first), many)
        starts = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + rows[own]
        yield first, hashing.windows(hashing.prefix(data[bounds[first] : bounds[last]]), starts, length), own


def _runs(hit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of hit windows inside each row."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    cut = (np.diff(at) > 1) | (np.diff(own[at]) > 0)
    return at[np.concatenate(([True], cut))], at[np.concatenate((cut, [True]))]


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Marks (id, th, s, e) of windows that several contexts of one key hold; contexts of a key come together."""
    id_type = rows.schema["id"].dataType.simpleString()

    def settle_keys(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        hashes, owners = [], []
        for first, h, own in _window_hashes(table.column("bytes"), length):
            hashes.append(h)
            owners.append(own + first)
        h, own = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        a, b = _runs(hit, own)
        base = np.searchsorted(own, own[a])
        take = pa.array(own[a])
        start = table.column("start").to_numpy()[own[a]]
        return pa.RecordBatch.from_arrays(
            [
                table.column("id").combine_chunks().take(take), table.column("th").combine_chunks().take(take),
                pa.array(start + a - base), pa.array(start + b - base + length),
            ],
            ["id", "th", "s", "e"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                held.append(batch.slice(0, cut))
            if cut or (held and held[-1].column("key")[-1].as_py() != keys[-1]):
                yield settle_keys(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settle_keys(pa.Table.from_batches(held))

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(released(run), f"id {id_type}, th long, s long, e long")


def _compare_crowd(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """The same for keys of very many contexts: windows are dealt out by their hash, packed in blocks."""
    id_type = rows.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, own in _window_hashes(batch.column("bytes"), length):
                part = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                place = np.arange(len(own)) - np.searchsorted(own, own)
                start = batch.column("start").to_numpy()[own + first] + place
                own = own + first
                for p in range(parts):
                    pick = order[cuts[p] : cuts[p + 1]]
                    if len(pick):
                        take = pa.array(own[pick])
                        ends = pa.array([0, len(pick)], pa.int32())
                        values = (
                            pa.array(h[pick].view(np.int64)), batch.column("id").take(take),
                            batch.column("th").take(take), pa.array(start[pick]),
                        )
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p], pa.int32()), *(pa.ListArray.from_arrays(ends, v) for v in values)],
                            ["part", "h", "ids", "ths", "at"],
                        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        flat = {c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]) for c in ("h", "ids", "ths", "at")}
        h = flat["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found = np.flatnonzero(hit)
        text = flat["ths"].to_numpy()[found].view(np.uint64) % np.uint64(parts)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            take = pa.array(found[order[cuts[p] : cuts[p + 1]]])
            if len(take):
                ends = pa.array([0, len(take)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), *(pa.ListArray.from_arrays(ends, flat[c].take(take)) for c in _TEXT)],
                    ["part", *_TEXT],
                )

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        flat = {c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]) for c in _TEXT}
        at, th = flat["at"].to_numpy(), flat["ths"].to_numpy()
        own = flat["ids"].dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.lexsort((at, own, th))
        at, th, own = at[order], th[order], own[order]
        cut = (np.diff(th) != 0) | (np.diff(own) != 0) | (np.diff(at) > length)
        first = np.flatnonzero(np.concatenate(([True], cut)))
        last = np.append(first[1:] - 1, len(at) - 1)
        yield pa.RecordBatch.from_arrays(
            [flat["ids"].take(pa.array(order[first])), pa.array(th[first]), pa.array(at[first]), pa.array(at[last] + length)],
            ["id", "th", "s", "e"],
        )

    packed = f"ids array<{id_type}>, ths array<long>, at array<long>"
    blocks = rows.mapInArrow(released(deal), f"part int, h array<long>, {packed}")
    # Repeated windows go back to their texts and leave as runs.
    hits = blocks.repartition(parts, "part").mapInArrow(released(meet), f"part int, {packed}")
    return hits.repartition(parts, "part").mapInArrow(released(join_runs), f"id {id_type}, th long, s long, e long")


_TEXT = ("ids", "ths", "at")


def repeated_marks(docs: DataFrame, length: int, gram: int, batches: int) -> DataFrame:
    """(id, th, s, e): byte ranges covered by strings of ``length`` bytes that start in several places."""
    id_type = docs.schema["id"].dataType.simpleString()
    family = SuffixFamily()
    for k in range(batches):
        own = docs.where(F.pmod(F.xxhash64("id", "th"), F.lit(batches)) == k)
        family.add(suffixes(own, length, gram).select("key", "ctx"))
    known, bitmap = family.repeated()
    entries = probably_in(suffixes(docs, length, gram), "key", bitmap).where("_maybe").drop("_maybe")
    found = stage(entries.join(known, ["key", "ctx"]))
    marks = found.where("cnt > 1").select("id", "th", F.col("start").alias("s"), (F.col("start") + F.col("many") + (length - 1)).alias("e"))

    # Contexts that differ: one text of each, with the bytes of its windows.
    need = found.where("singles > 0 and variants > 1").groupBy("key", "ctx").agg(
        F.min(F.struct("id", "th", "start", "many")).alias("o"), F.first("variants").alias("variants")
    )
    per_text = stage(
        need.groupBy(F.col("o.id").alias("nid"), F.col("o.th").alias("nth"))
        .agg(F.collect_list(F.struct("o.start", "o.many", "key", "variants")).alias("wanted"))
    )
    near = probably_in(docs, "th", bitmap_of(per_text, "nth")).where("_maybe")
    texts = near.join(per_text, F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = hashing.utf8(batch.column("text"))
            wanted = batch.column("wanted")
            flat, lens = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
            field = lambda name: flat.field(name).to_numpy()
            own = np.repeat(np.arange(batch.num_rows), lens)
            begin = bounds[own] + field("start")
            end = begin + field("many") + length - 1
            raw = data.tobytes()
            for at in range(0, len(own), 4096):
                take = pa.array(own[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("th").take(take),
                        pa.array(field("start")[at : at + 4096]), pa.array(field("key")[at : at + 4096]),
                        pa.array(field("variants")[at : at + 4096]),
                        pa.array([raw[a:b] for a, b in zip(begin[at : at + 4096], end[at : at + 4096], strict=True)], pa.binary()),
                    ],
                    ["id", "th", "start", "key", "variants", "bytes"],
                )

    edges = stage(
        texts.select("id", "th", "text", "wanted")
        .mapInArrow(released(cut), f"id {id_type}, th long, start long, key long, variants long, bytes binary")
    )
    few = _compare(edges.where(F.col("variants") <= CROWD), length)
    marks = marks.union(few)
    crowd = edges.where(F.col("variants") > CROWD)
    size = crowd.agg(F.sum(F.length("bytes") - (length - 1))).first()[0]
    if size:
        marks = marks.union(_compare_crowd(crowd, length, max(16, -(-size // 500_000))))
    return marks


def strip_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    gram: int = GRAM,
    batches: int = BATCHES,
    whole_characters: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, th, carried row, n_bytes, spans, kept) per row: maximal removed byte runs and the bytes that stay.

    With ``whole_characters`` a run gives back bytes of characters it covers only in part, so ``kept`` is UTF-8.
    """
    docs = narrow(df, id_col, text_col, carry).withColumn("th", text_key())
    own_columns = ["id", "th", *carried(docs)]
    marks = repeated_marks(docs.select("id", "th", "text"), length, gram, batches)
    per_text = stage(
        marks.groupBy(F.col("id").alias("mid"), F.col("th").alias("mth"))
        .agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    )
    flagged = probably_in(docs, "th", stage(bitmap_of(per_text, "mth")))
    shape = f"{ddl(docs, *own_columns)}, n_bytes long, spans array<struct<s:long,e:long>>, kept binary"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = hashing.utf8(batch.column("text"))
            marks = batch.column("marks")
            spans, kept = [], []
            for k in range(batch.num_rows):
                own = data[bounds[k] : bounds[k + 1]]
                if not marks[k].is_valid:
                    spans.append([])
                    kept.append(own.tobytes())
                    continue
                part = marks[k].values
                s, e = part.field("s").to_numpy(), part.field("e").to_numpy()
                step = np.zeros(len(own) + 1, np.int32)
                np.add.at(step, s, 1)
                np.add.at(step, e, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                if whole_characters:
                    inside = (own & 0xC0) == 0x80
                    for row in edge:
                        while row[0] < row[1] and inside[row[0]]:
                            row[0] += 1
                        while row[1] > row[0] and row[1] < len(own) and inside[row[1]]:
                            row[1] -= 1
                    gone[:] = False
                    for a, b in edge:
                        gone[a:b] = True
                    edge = edge[edge[:, 0] < edge[:, 1]]
                spans.append([{"s": int(a), "e": int(b)} for a, b in edge])
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in own_columns), pa.array(np.diff(bounds)),
                    pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                [*own_columns, "n_bytes", "spans", "kept"],
            )

    changed = flagged.where("_maybe").join(
        per_text, F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")), "left"
    ).select(*own_columns, "text", "marks").mapInArrow(released(strip), shape)
    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    same = flagged.where(~F.col("_maybe")).select(
        *own_columns, F.length(whole).cast("long").alias("n_bytes"),
        F.from_json(F.lit("[]"), "array<struct<s:long,e:long>>").alias("spans"), whole.alias("kept"),
    )
    return changed.union(same)
