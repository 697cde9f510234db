"""Document fingerprints by randomised edit embedding.

All texts take the same random walk: a pointer starts at the first character, every step reads the character under it,
and a bit shared by all texts for this step and character says whether it moves on. Texts that differ by an insertion
or deletion soon read the same characters in the same steps again, so edit distance becomes Hamming distance between
the characters read. A fingerprint holds the characters of the steps with the least shared priorities (SYMBOLS of
them, whatever the length); the share on which two fingerprints agree estimates their likeness, and keys of a few
steps each (bands) find candidates whose edit distance is then verified.

Defined results: a null text is empty; empty texts have a fingerprint without characters, are like each other (1) and
unlike all others (0). Equal texts have equal fingerprints. Documents are ordered by falling id, a null id last, equal
ids by the hash of their text; the one after the last is the first, so a single document follows itself. An empty
table gives no row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import hashing
from vitalgrid.llm.common import components, narrow, released
from vitalgrid.session import settle, stage

# Sampled steps of a fingerprint.
SYMBOLS = 128
# Steps between two looks at which texts have come to their end; lengths of walks are multiples of it.
STRIDE = 64
# Steps after which the shared bits repeat.
PERIOD = 8192
# Characters walked over at a time, about (one document at least).
CHARACTERS = 1 << 23
# Ranges of ids for each partition of the exchange, and ranges at most.
RANGES, MOST_RANGES = 4, 1 << 12
# Bands of a scale, sampled steps of a band; a text has the bands of its two largest scales (powers of two of steps).
BANDS, BAND_STEPS = 24, 8
SCALES = 34


@cache
def _bits(walk: int) -> np.ndarray:
    """(step, symbol) -> whether the pointer moves on; symbol 0 is the end, where it stays."""
    bits = np.random.default_rng(101 + walk).integers(0, 2, (PERIOD, 256)).astype(np.intp)
    bits[:, 0] = 0
    return bits


class _Steps:
    """Steps that belong to the sample of some walk length, in order, with their priorities."""

    def __init__(self) -> None:
        self.known, self.heap = 0, []
        self.step, self.priority = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def up_to(self, length: int) -> None:
        while self.known < length:
            at = np.arange(self.known, self.known + (1 << 16), dtype=np.uint64)
            priority = hashing.mix(at + np.uint64(0x51ED270B9F3C2A17))
            near = range(len(at))
            if len(self.heap) == SYMBOLS:
                near = np.flatnonzero(priority < np.uint64(-self.heap[0])).tolist()
            steps, values = [], []
            for k in near:
                value = int(priority[k])
                if len(self.heap) < SYMBOLS:
                    heapq.heappush(self.heap, -value)
                elif value < -self.heap[0]:
                    heapq.heapreplace(self.heap, -value)
                else:
                    continue
                steps.append(self.known + k)
                values.append(value)
            self.step = np.concatenate((self.step, np.array(steps, np.int64)))
            self.priority = np.concatenate((self.priority, np.array(values, np.uint64)))
            self.known += len(at)

    def sample(self, length: int) -> np.ndarray:
        """Which of the recorded steps make the sample of a walk of this length."""
        n = int(np.searchsorted(self.step, length))
        return np.sort(np.argpartition(self.priority[:n], SYMBOLS - 1)[:SYMBOLS]) if n > SYMBOLS else np.arange(n)


_steps = _Steps()


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One byte (1 to 255) for each character, a 0 behind each text; where each text begins."""
    data = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = (1 + hashing.mix(data.astype(np.uint64) + np.uint64(1)) % np.uint64(255)).astype(np.uint8)
    symbols[ends] = 0
    return symbols, np.concatenate(([0], ends[:-1] + 1)).astype(np.intp)


def walks(texts: list[str], walk: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each text's walk, symbols read at the wanted steps): all texts go step by step together."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros((0, len(wanted)), np.uint8)
    flat, place = _symbols(texts)
    bits, live = _bits(walk), np.arange(len(texts))
    lengths, read = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(wanted)), np.uint8)
    step, look = 0, wanted.tolist() + [-1]
    at = 0
    while len(live):
        for step in range(step, step + STRIDE):
            symbol = flat[place]
            if step == look[at]:
                read[live, at] = symbol
                at += 1
            place += bits[step % PERIOD][symbol]
        step += 1
        lengths[live] += STRIDE
        on = flat[place] != 0
        if not on.all():
            live, place = live[on], place[on]
    lengths[[not t for t in texts]] = 0
    return lengths, read


class Fingerprint:
    """What a text's walk read at the sampled steps."""

    def __init__(self, length: int, symbols: np.ndarray) -> None:
        self.length, self.symbols = length, symbols

    def __str__(self) -> str:
        return f"{self.length:x}:{self.symbols.tobytes().hex()}"

    def likeness(self, other: Fingerprint) -> float:
        """Share of the longer one's sampled steps on which both read the same; steps behind both ends do not count."""
        short, long = sorted((self, other), key=lambda f: f.length)
        if not long.length:
            return 1.0
        steps = _steps.step[_steps.sample(long.length)]
        read = np.zeros(len(steps), np.uint8)
        own = _steps.step[_steps.sample(short.length)]
        inside = steps < short.length
        read[inside] = short.symbols[np.searchsorted(own, steps[inside])]
        count = int(((read != 0) | (long.symbols != 0)).sum())
        return float((read == long.symbols)[long.symbols != 0].sum() / count)


@cache
def _band_steps(scale: int) -> np.ndarray:
    """Steps of all bands of a scale, below two to its power."""
    return np.random.default_rng(977 + scale).integers(0, 1 << scale, BANDS * BAND_STEPS)


def fingerprints(texts: list[str], banded: int = 0) -> tuple[list[Fingerprint], list[np.ndarray]]:
    """One fingerprint per text, and the band keys of the first ``banded`` texts; all from one walk."""
    most = 3 * max((len(t) for t in texts), default=0) + (1 << 16)
    _steps.up_to(most)
    recorded = _steps.step[_steps.step < most]
    scales = range(6, min(SCALES, most.bit_length()))
    banding = [_band_steps(s) for s in scales] if banded else []
    wanted = np.unique(np.concatenate([recorded, *banding]))
    lengths, read = walks(texts, 0, wanted)
    own = np.searchsorted(wanted, recorded)
    prints = [Fingerprint(int(n), row[own[_steps.sample(int(n))]]) for n, row in zip(lengths, read, strict=True)]
    keys: list[list[np.ndarray]] = [[] for _ in range(banded)]
    top = np.frexp(lengths[:banded].astype(np.float64))[1] - 1
    for scale, steps in zip(scales, banding, strict=False):
        rows = np.flatnonzero((top == scale) | (top == scale + 1))
        symbols = read[rows][:, np.searchsorted(wanted, steps)].reshape(len(rows), BANDS, BAND_STEPS).astype(np.uint64)
        key = np.broadcast_to(hashing.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(scale << 8)), (len(rows), BANDS))
        for k in range(BAND_STEPS):
            key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, :, k])
        for row, found in zip(rows, key.astype(np.int64), strict=True):
            keys[row].append(found)
    return prints, [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_RESULT = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, digest binary, bands array<long>"
)
_Row = tuple[int, bool, int | None, str]


def _compare(rows: list[_Row]) -> pa.RecordBatch:
    """Results of all rows whose next row in the same range is there."""
    pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[1]]
    texts, edited = [a[3] for a, _ in pairs], [_edited(a[3], b[3]) for a, b in pairs]
    apart = [k for k, (_, b) in enumerate(pairs) if k + 1 == len(pairs) or b is not pairs[k + 1][0]]
    prints, bands = fingerprints([*texts, *edited, *[pairs[k][1][3] for k in apart]], len(texts))
    own, changed = prints[: len(texts)], prints[len(texts) : 2 * len(texts)]
    following = own[1:] + own[:1]
    for k, found in zip(apart, prints[2 * len(texts) :], strict=True):
        following[k] = found
    raw = lambda t: t.encode("utf-8", "surrogatepass")
    columns = [
        [a[2] for a, _ in pairs], [len(t) for t in texts], [hashlib.sha256(raw(e)).hexdigest() for e in edited],
        [str(f) for f in own], [str(f) for f in changed],
        [a.likeness(b) for a, b in zip(own, changed, strict=True)],
        [a.likeness(b) for a, b in zip(own, following, strict=True)],
        [hashlib.sha256(raw(t)).digest() for t in texts], bands,
    ]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.binary(), pa.list_(pa.int64())]
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")]
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of ranges in order; a piece of a range hands its last row to the next piece."""
    rows, size = [], 0
    for batch in batches:
        for segment, tail, i, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            rows.append((segment, tail, i, text or ""))
            size += len(rows[-1][3])
            if size >= CHARACTERS and len(rows) > 1:
                yield _compare(rows)
                rows = rows[-1:]
                size = len(rows[0][3])
    if len(rows) > 1:
        yield _compare(rows)


def in_order(docs: DataFrame) -> DataFrame:
    """(segment, id, text) by falling id within ranges of ids; behind a range's last row stands the row that follows.

    One shuffle of the texts. What reaches the driver is bounded: bounds of the ranges and their first keys.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(MOST_RANGES, RANGES * parts)
    least = F.lit(-(1 << 63)).cast("long")
    keyed = docs.select(F.coalesce("id", least).alias("key"), F.xxhash64("text").alias("hash"), "id", "text")
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("key", shares, 10 * ranges)).first()[0] or [])) if shares else []
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    segment = F.size(F.filter(bounds, lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    dealt = keyed.withColumn("segment", segment)
    firsts = dealt.groupBy("segment").agg(F.max(F.struct("key", "hash")).alias("top")).orderBy("segment").collect()
    follows = [(r["top"]["key"], r["top"]["hash"], firsts[(k + 1) % len(firsts)]["segment"]) for k, r in enumerate(firsts)]
    tails = spark.createDataFrame(follows, "key long, hash long, to int")
    joined = dealt.join(F.broadcast(tails), ["key", "hash"], "left")
    own = F.struct(F.col("segment"), F.lit(False).alias("tail"))
    also = F.struct(F.col("to").alias("segment"), F.lit(True).alias("tail"))
    copies = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))
    placed = joined.select("key", "hash", "id", "text", F.explode(copies).alias("at")).select(
        F.col("at.segment").alias("segment"), F.col("at.tail").alias("tail"), "key", "hash", "id", "text"
    )
    dealt = placed.repartition(parts, "segment")
    return dealt.sortWithinPartitions("segment", "tail", F.desc("key"), F.desc("hash")).select("segment", "tail", "id", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (its last half replaced by as much of the next document's
    beginning), both likenesses, the digest of the text and its band keys."""
    return in_order(narrow(docs, id_col, text_col)).mapInArrow(released(_stream), _RESULT)


def distance(a: str, b: str, most: int) -> int | None:
    """Edit distance (insert, delete, replace) if at most ``most``: furthest places per diagonal, edit by edit."""

    def run(i: int, j: int) -> int:
        """Where equal characters from i and j on end in ``a``."""
        step = 32
        while i + step <= len(a) and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, step * 2
        while step:
            if i + step <= len(a) and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
            step //= 2
        return i

    if abs(len(a) - len(b)) > most:
        return None
    goal, far = len(b) - len(a), {0: run(0, 0)}
    for edits in range(most + 1):
        if far.get(goal, -1) >= len(a):
            return edits
        reach = {}
        for d in range(-edits - 1, edits + 2):
            start = max(far.get(d - 1, -1), far.get(d, -2) + 1, far.get(d + 1, -2) + 1)
            start = min(start, len(a), len(b) - d)
            if start >= 0 and start + d >= 0:
                reach[d] = run(start, start + d)
        far = reach
    return None


def _verify(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, a, b = (batch.column(k).to_pylist() for k in range(4))
        near = [k for k in range(batch.num_rows) if distance(a[k] or "", b[k] or "", edits) is not None]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).take(pa.array(near, pa.int64()))


def near_copies(found: DataFrame, docs: DataFrame, edits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``found`` with copy_of: the smallest id that texts of at most ``edits`` edits from one to the next lead to.

    Each distinct text is compared with the first text of every band it is in, so the pairs of a band grow with its
    texts, however many there are; two texts that only meet behind different first texts are not linked.
    """
    classes = stage(
        found.where(F.size("bands") > 0).groupBy("digest").agg(
            F.min("id").alias("first"), F.first("n_chars").alias("n"), F.first("bands").alias("bands")
        )
    )
    crowd = classes.select(F.explode("bands").alias("band"), "digest", "n")
    lead = crowd.groupBy("band").agg(F.min(F.struct("digest", "n")).alias("lead"), F.count(F.lit(1)).alias("texts"))
    held = crowd.join(lead.where("texts > 1"), "band").where(F.col("digest") != F.col("lead.digest"))
    pairs = held.where(F.abs(F.col("n") - F.col("lead.n")) <= edits).select(
        F.col("digest").alias("u"), F.col("lead.digest").alias("v")
    )
    pairs = settle(pairs.distinct())
    wanted = pairs.select(F.col("u").alias("digest")).union(pairs.select("v")).distinct()
    texts = narrow(docs, id_col, text_col).select(
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"), "text"
    ).join(wanted, "digest", "left_semi")
    texts = stage(texts.groupBy("digest").agg(F.first("text").alias("text")))
    left, right = (texts.select(F.col("digest").alias(k), F.col("text").alias(t)) for k, t in (("u", "a"), ("v", "b")))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    root = components(settle(both.mapInArrow(released(lambda b: _verify(b, edits)), "u binary, v binary")))
    joined = classes.select("digest", "first").join(root, F.col("digest") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "digest").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("first").alias("copy_of"))
    grouped = joined.join(least, "root").select("digest", "copy_of")
    return found.join(grouped, "digest", "left").withColumn("copy_of", F.coalesce("copy_of", F.col("id")))
