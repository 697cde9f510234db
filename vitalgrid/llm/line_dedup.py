"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are one edit apart if they share a variant: the same string after one character is deleted from both at the
same place (a substitution), or one line itself and the other with a character deleted (an insertion). Variants go
round as hashed keys. Emitting every deletion of every line would be as large as the corpus times a line, so two
exact filters come first: one edit lies in one of the pieces of the longer line, so near lines agree on all that is
outside it. Lines that share no half with another line emit nothing, and the rest delete only inside the piece of
an eighth that they share the surroundings of. Per variant only the earliest line meets the others (lines that share a
place of substitution are all one edit apart, lines around an inserted character have one centre), and each meeting
is verified on the texts.

Defined results: lines are parts between line feeds; the earliest line (least id, then place) of equal lines stays,
unless a still earlier one is within one edit. Lines shorter than ``min_chars`` are not compared up to an edit. Equal
lines are found from ``exact_chars`` characters (``min_chars`` where it is not given); lines that are shorter still, and
below ``min_chars`` lines of nothing but blanks, always stay. A null text stays null and has no lines; rows that repeat
with id and text count as one document and keep the same lines. A null id comes before every other. Other columns of
the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import hashing
from vitalgrid.llm.common import bitmap_of, carried, narrow, probably_in, released, text_key
from vitalgrid.session import stage

# Shorter lines are never near duplicates: one edit changes too much of them.
MIN_CHARS = 20
PIECES = 8
# A line has to hold something else to be repeated rather than part of the layout.
NOT_BLANK = r"[^ \t\x0B\f\r]"


def _outside(pieces: int) -> Column:
    """An array of (t, j, key): hashes of what surrounds piece j if the longer line of a pair has t characters."""
    items = []
    for more in (0, 1):
        for j in range(pieces):
            head = f"cast(floor((n + {more}) * {j} / {pieces}) as int)"
            tail = f"cast(n + {more} - floor((n + {more}) * {j + 1} / {pieces}) as int)"
            items.append(
                f"named_struct('t', n + {more}, 'j', {j}, 'key', xxhash64(n + {more}, {j}, substring(line, 1, {head}), "
                f"substring(line, n - {tail} + 1, {tail})))"
            )
    return F.expr(f"array({', '.join(items)})")


def _keys_outside(pieces: int) -> Column:
    return F.transform(_outside(pieces), lambda o: o["key"])


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one distinct line has (lh numbers lines)."""
    seen = rows.groupBy(key).agg(F.min("lh").alias("a"), F.max("lh").alias("b"))
    return stage(seen.where("a <> b").select(F.col(key).alias("skey")))


def _among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys``: a bounded bitmap first, the exact join for what passes it."""
    near = probably_in(rows, key, stage(bitmap_of(keys, "skey"))).where("_maybe").drop("_maybe")
    return near.join(keys, F.col(key) == F.col("skey"), "left_semi")


def _neighbourhood(middle: str, key: int, alone: bool) -> np.ndarray:
    """Keys of a piece's variants: itself, or each deletion with and without its place.

    Variants are hashed from prefix sums, so a piece of any length takes memory in proportion to its length.
    """
    data = np.frombuffer(middle.encode(), np.uint8)
    sums = hashing.prefix(data)
    own = np.array([key], np.int64).view(np.uint64)
    tag = np.uint64(0xD6E8FEB86659FD93)
    if alone:
        return hashing.mix(hashing.mix(sums[-1:] + np.uint64(len(data)) * tag) + own)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.diff(np.append(start, len(data)))
    rest = (sums[-1] - sums[start + wide]) * hashing.powers(8, inverse=True)[wide]
    cut = hashing.mix(sums[start] + rest + (len(data) - wide).astype(np.uint64) * tag) + own
    placed = hashing.mix(cut + (np.arange(len(start), dtype=np.uint64) + np.uint64(1)) * tag)
    return np.concatenate([np.unique(hashing.mix(cut)), placed])


def _variants(rows: DataFrame) -> DataFrame:
    """(vk, lh, centre): keys of the deletion neighbourhood of each row's piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            lens = [len(h) for h, _, _ in held]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h for h, _, _ in held]).view(np.int64)),
                    pa.array(np.repeat([lh for _, lh, _ in held], lens)),
                    pa.array(np.repeat(np.array([c for _, _, c in held], np.int32), lens)),
                ],
                ["vk", "lh", "centre"],
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("line", "n", "t", "j", "key", "lh"))
            for row in zip(*columns, strict=True):
                line, n, t, j, key, lh = (x.as_py() for x in row)
                a, b = t * j // PIECES, t * (j + 1) // PIECES
                held.append((_neighbourhood(line[a : b - (t - n)], key, n < t), lh, int(n < t)))
                size += len(held[-1][0])
                if size > 200_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select("line", "n", "t", "j", "key", "lh").mapInArrow(released(run), "vk long, lh long, centre int")


def one_edit(a: str, b: str) -> bool:
    """Whether one character inserted, deleted or replaced turns one string into the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [one_edit(x.as_py(), y.as_py()) for x, y in zip(batch.column("lx"), batch.column("ly"), strict=True)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["x", "y"])

    return pairs.select("x", "y", "lx", "ly").mapInArrow(released(run), "x long, y long")


def near_lines(lines: DataFrame) -> DataFrame:
    """(lh) of distinct lines that have an earlier line within one edit.

    ``lines``: h (digest), lh (its first 64 bits as a number), line, n (characters), place (struct that orders lines).
    """
    halves = lines.select("lh", F.explode(_keys_outside(2)).alias("key"))
    keys = _shared(halves, "key")
    bitmap = stage(bitmap_of(keys, "skey"))
    dealt = lines.withColumn("key", F.explode(_keys_outside(2)))
    near = probably_in(dealt, "key", bitmap).where("_maybe").drop("_maybe")
    near = near.join(keys, F.col("key") == F.col("skey"), "left_semi")
    some = stage(near.groupBy("lh").agg(F.min(F.struct("place", "line", "n")).alias("f")).select(
        "lh", "f.place", "f.line", "f.n"
    ))
    pieces = some.withColumn("o", F.explode(_outside(PIECES))).select("lh", "line", "n", "o.t", "o.j", "o.key")
    close = stage(_among(pieces, "key", _shared(pieces.select("lh", "key"), "key")))
    # A line's own first place decides which of a variant's lines is the earliest.
    members = stage(_among(_variants(close), "vk", _shared(_variants(close), "vk")))
    place = some.select(F.col("lh").alias("pl"), "place")
    placed = stage(members.join(place, F.col("lh") == F.col("pl")).drop("pl"))
    # The line around which a character is inserted is the centre of its variant; else it is the earliest line.
    lead = placed.groupBy("vk").agg(F.min(F.struct(-F.col("centre"), "place", "lh")).alias("lead"))
    pairs = placed.join(lead, "vk").where(F.col("lh") != F.col("lead.lh")).select(
        F.col("lh").alias("x"), F.col("lead.lh").alias("y")
    ).distinct()
    text = some.select(F.col("lh").alias("tl"), "line")
    pairs = pairs.join(text, F.col("x") == F.col("tl")).drop("tl").withColumnRenamed("line", "lx")
    pairs = pairs.join(text, F.col("y") == F.col("tl")).drop("tl").withColumnRenamed("line", "ly")
    sure = _verified(pairs)
    px = place.select(F.col("pl").alias("x"), F.col("place").alias("px"))
    py = place.select(F.col("pl").alias("y"), F.col("place").alias("py"))
    both = sure.join(px, "x").join(py, "y")
    return stage(both.select(F.when(F.col("px") > F.col("py"), F.col("x")).otherwise(F.col("y")).alias("lh")).distinct())


def drop_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near: bool = True,
    carry: Sequence[str] = (), exact_chars: int | None = None,
) -> DataFrame:
    """(id, th, text, n_lines, n_removed, carried row): the text without lines that an earlier one (nearly) equals."""
    least = min_chars if exact_chars is None else exact_chars
    docs = narrow(df, id_col, text_col, carry).withColumn("th", text_key())
    own = ["id", "th", *carried(docs)]
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(
        (F.char_length("line") >= least) & ((F.char_length("line") >= min_chars) | F.col("line").rlike(NOT_BLANK))
    )
    lines = lines.select(
        F.struct("id", "pos", "th").alias("place"), "line", F.char_length("line").alias("n"), F.md5("line").alias("h")
    ).withColumn("lh", F.conv(F.substring("h", 1, 15), 16, 10).cast("long"))
    firsts = lines.groupBy("lh", "h").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("many"))
    again = stage(firsts.where("many > 1").select("lh", "h", "first"))
    close = near_lines(lines.where(F.col("n") >= min_chars)) if near else again.select("lh").limit(0)
    keys = stage(
        again.select("lh", "h", "first", F.lit(False).alias("gone"))
        .unionByName(close.select("lh", F.lit(True).alias("gone")), allowMissingColumns=True)
    )
    bitmap = stage(bitmap_of(keys, "lh"))
    maybe = probably_in(lines.select("place", "h", "lh"), "lh", bitmap).where("_maybe")
    rule = keys.select(F.col("lh").alias("kl"), F.col("h").alias("kh"), "first", "gone")
    out = maybe.join(rule, F.col("lh") == F.col("kl")).where(
        F.col("gone") | ((F.col("h") == F.col("kh")) & (F.col("place") != F.col("first")))
    )
    per_text = stage(
        out.groupBy(F.col("place.id").alias("mid"), F.col("place.th").alias("mth"))
        .agg(F.collect_set("place.pos").alias("removed"))
    )
    flagged = probably_in(docs, "th", stage(bitmap_of(per_text, "mth")))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long")
    changed = flagged.where("_maybe").join(
        per_text, F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")), "left"
    )
    # Positions that stay as a set difference, lines bound once: linear where most of very many lines go.
    stay = F.array_except(F.sequence(F.lit(0), (n_lines - 1).cast("int")), F.col("removed"))
    kept = F.transform(
        F.array(F.split("text", "\n")),
        lambda parts: F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"),
    )[0]
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    changed = changed.select(
        *own, kept.alias("text"), n_lines.alias("n_lines"),
        F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )
    same = flagged.where(~F.col("_maybe")).select(
        *own, "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")
    )
    return changed.union(same)
