"""Packing token pieces into sequences by patterns of few lengths.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches the driver. Patterns of a few
length classes that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative
least squares and rounded down, and what remains is packed best-fit in decreasing length, into the space the patterns
left first. The result is again a list of patterns with repeat counts; pieces find their place by their number within
their length, so no sequence is ever gathered anywhere.

Defined results: a null or empty text is one piece that holds the end id alone; rows that repeat are packed once each;
an empty table packs into nothing. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.bpe import encoder
from vitalgrid.llm.common import narrow, ordinals, released
from vitalgrid.session import stage

# Length classes per sequence, and documents in an enumerated pattern.
CLASSES = 64
DOCUMENTS = 4
# Lengths up to this many classes are kept out of the patterns: they fill the space that rounding up leaves.
FILLERS = 2
# Parts of the histogram that the patterns are fitted to; the plan with the fewest sequences is kept.
SHARES = (0.95, 0.85, 0.7, 0.5, 0.3)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set (one column enters per round)."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        enter = int(np.argmax(slope))
        if slope[enter] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        inside[enter] = True
        while True:
            columns = np.flatnonzero(inside)
            fit = np.zeros_like(x)
            fit[columns] = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            low = columns[fit[columns] <= 0]
            if not len(low):
                x = fit
                break
            step = np.min(x[low] / np.maximum(x[low] - fit[low], 1e-300))
            x = x + step * (fit - x)
            drop = inside & (x <= 1e-12)
            drop[low[np.argmin(x[low])]] = True
            x[drop] = 0
            inside &= ~drop
        if not inside[enter] and not inside.any():
            break
    return x


def exact_patterns(classes: int, documents: int, least: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``documents`` classes from ``least`` on that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < documents:
            for c in range(min(left, head[-1] if head else left), least - 1, -1):
                extend((*head, c), left - c)

    extend((), classes)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, repeats) that hold every piece of the histogram {length: count}."""
    plans = (_plan(histogram, capacity, share) for share in SHARES)
    return min(plans, key=lambda p: sum(many for _, many in p))


def _plan(histogram: dict[int, int], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    unit = -(-capacity // CLASSES)
    of_class = -(-np.arange(capacity + 1) // unit)
    target = np.bincount(of_class, weights=left, minlength=CLASSES + 1)[: CLASSES + 1]
    target[: FILLERS + 1] = 0
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    if target.any():
        patterns = exact_patterns(CLASSES, DOCUMENTS, FILLERS + 1)
        table = np.zeros((CLASSES + 1, len(patterns)))
        for k, p in enumerate(patterns):
            np.add.at(table[:, k], list(p), 1)
        scale = target.max()
        repeats = np.floor(nnls(table, target / scale) * scale * share + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k]:
                _realise(patterns[k], int(repeats[k]), left, unit, capacity, open_)
    _best_fit(left, capacity, open_)
    for classes in open_.values():
        done += classes
    return done


def _realise(pattern, repeats: int, left: np.ndarray, unit: int, capacity: int, open_: dict) -> None:
    """Take lengths of each class, longest first, and open the sequences they make."""
    need = defaultdict(int)
    for c in pattern:
        need[c] += 1
    for c, times in need.items():
        repeats = min(repeats, int(left[(c - 1) * unit + 1 : c * unit + 1].sum()) // times)
    if not repeats:
        return
    runs = []
    for c in pattern[:-1]:
        own, missing = [], repeats
        for length in range(min(c * unit, capacity), (c - 1) * unit, -1):
            take = min(missing, int(left[length]))
            if take:
                own.append([length, take])
                left[length] -= take
                missing -= take
            if not missing:
                break
        runs.append(own)
    places = [0] * len(runs)
    while repeats:
        lengths = tuple(r[i][0] for r, i in zip(runs, places, strict=True))
        take = min([repeats, *(r[i][1] for r, i in zip(runs, places, strict=True))])
        # The last length is the one that fills the space best.
        space, least = capacity - sum(lengths), (pattern[-1] - 1) * unit + 1
        fits = np.flatnonzero(left[least : space + 1])
        if len(fits):
            last = least + int(fits[-1])
            take = min(take, int(left[last]))
            left[last] -= take
            open_[space - last].append(((*lengths, last), take))
        else:
            open_[space].append((lengths, take))
        repeats -= take
        for k, (r, i) in enumerate(zip(runs, places, strict=True)):
            r[i][1] -= take
            places[k] += r[i][1] == 0


def _best_fit(left: np.ndarray, capacity: int, open_: dict) -> None:
    """Best fit in decreasing length over counts: equal sequences and equal lengths move together."""
    room = np.zeros(capacity + 1, np.int64)
    for space, classes in open_.items():
        room[space] = len(classes)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                space = length + int(fits[0])
                lengths, many = open_[space].pop()
                room[space] -= 1
                take = min(many, count)
                if many > take:
                    open_[space].append((lengths, many - take))
                    room[space] += 1
                open_[space - length].append(((*lengths, length), take))
                room[space - length] += 1
                count -= take
                continue
            each = capacity // length
            bins, rest = divmod(count, each)
            for copies, many in ((each, bins), (rest, 1)):
                if copies and many:
                    space = capacity - copies * length
                    open_[space].append(((length,) * copies, many))
                    room[space] += 1
            count = 0
        left[length] = 0


def pieces(
    df: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str, forget: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text's ids with ``end_id`` behind them, cut at ``size``.

    With ``forget`` a worker drops the words it remembers after every task: less memory for what follows, more time here.
    """
    docs = narrow(df, id_col, text_col)
    id_type = docs.schema["id"].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, stream=False)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for k, text in enumerate(batch.column("text")):
                ids = own.encode(text.as_py() or "") + tail
                for p in range(-(-len(ids) // (4 * size))):
                    part = ids[4 * p * size : 4 * (p + 1) * size]
                    rows.append(k)
                    for column, value in zip(out, (p, p * size, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in out[1:]),
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
        if forget:
            own.forget()

    return docs.mapInArrow(released(run), f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def place(pieces_: DataFrame, size: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to staged rows with a ``length`` of 1 to ``size``."""
    spark = pieces_.sparkSession
    counts = pieces_.groupBy("length").count().collect()  # one row per length: at most ``size`` rows
    froms, bases, offsets = defaultdict(list), defaultdict(list), defaultdict(list)
    used, base = defaultdict(int), 0
    for lengths, repeats in plan({r["length"]: r["count"] for r in counts}, size):
        at = 0
        for length in lengths:
            froms[length].append(used[length])
            bases[length].append(base)
            offsets[length].append(at)
            used[length] += repeats
            at += length
        base += repeats
    table = spark.createDataFrame(
        [(k, froms[k], bases[k], offsets[k]) for k in froms],
        "len long, froms array<long>, bases array<long>, offsets array<long>",
    )
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["id", "piece", "ids_crc32"]
    numbered = ordinals(pieces_, "length", keys, "_ord", buckets)
    # One row per length, so the broadcast is bounded by ``size`` and the number of patterns.
    found = numbered.join(F.broadcast(table), F.col("length") == F.col("len"))
    slot = F.expr("size(filter(froms, f -> f <= _ord)) - 1")
    found = found.withColumn("_slot", slot)
    return found.select(
        "id", "piece", "start", "length", "ids_crc32",
        F.expr("bases[_slot] + _ord - froms[_slot]").alias("sequence_id"), F.expr("offsets[_slot]").alias("offset"),
    )


def pack(
    df: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    forget: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every text's ids placed in sequences of ``size``."""
    return place(stage(pieces(df, path, size, end_id, id_col, text_col, forget)), size)
