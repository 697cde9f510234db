"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so half
the hash evaluations fill the bands. Documents that share a band are candidates; every link is confirmed on the
whole shingle sets.

Defined results: words are runs of bytes other than ASCII white space with A-Z lowered; a document of fewer words
than a shingle has the whole sequence as its one shingle; null, empty and blank texts have no shingle and are linked
with nothing. Rows repeat as they are: equal rows are members of one class. A null id counts as an id of its own,
smaller than every other. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import hashing
from vitalgrid.llm.common import bitmap_of, components, narrow, ordinals, probably_in, released, text_key
from vitalgrid.session import settle, stage

# 100 permutations give 200 values: 40 bands of 5. A pair at similarity .8 misses all bands once in 8 million.
PERMUTATIONS = 100
ROWS = 5
# Bytes of text in a block where colliding classes are compared with each other (a text counts as LEAST_BYTES or more).
BLOCK_BYTES = 1 << 21
LEAST_BYTES = 1 << 12
_SIGNED = np.int64


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 1 << 63, n, dtype=np.uint64
    )


def band_keys(sets: list[np.ndarray], permutations: int, rows: int) -> np.ndarray:
    """(documents, bands) of 64-bit band keys from minima and maxima; every set must have a member."""
    a, b = _coefficients(permutations)
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    values = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        moved = flat * a[k] + b[k]
        values[:, 2 * k] = np.minimum.reduceat(moved, at)
        values[:, 2 * k + 1] = np.maximum.reduceat(moved, at)
    bands = 2 * permutations // rows
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sets), bands))
    for r in range(rows):
        keys = hashing.mix(keys * np.uint64(0xD6E8FEB86659FD93) + values[:, r : bands * rows : rows])
    return keys


def signatures(docs: DataFrame, shingle: int, permutations: int, rows: int) -> DataFrame:
    """(id, th, n, cls, bands) per document; cls names the shingle set, empty sets have null cls and bands."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = hashing.utf8(batch.column("text"))
            for first, last in hashing.groups_of_rows(bounds):
                sets = hashing.shingle_sets(data, bounds[first : last + 1], shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                cls: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    keys = band_keys([sets[k] for k in full], permutations, rows).view(_SIGNED)
                    for k, own in zip(full, keys, strict=True):
                        cls[k], bands[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), own
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first), batch.column("th").slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["id", "th", "n", "cls", "bands"],
                )

    keyed = docs.withColumn("th", text_key())
    return keyed.mapInArrow(released(run), f"id {id_type}, th long, n long, cls binary, bands array<long>")


def _confirm(pairs: DataFrame, shingle: int) -> DataFrame:
    """(u, v, inter, total): sizes of intersection and union of the whole sets of (u, ut) and (v, vt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            inter, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            heads = batch.column("u").to_pylist()
            change = np.array([k for k in range(n) if not k or heads[k] != heads[k - 1]], np.int64)
            left = batch.column("ut").take(pa.array(change))
            data, bounds = hashing.utf8(left)
            mine = hashing.shingle_sets(data, bounds, shingle)
            owner = np.searchsorted(change, np.arange(n), side="right") - 1
            data, bounds = hashing.utf8(batch.column("vt"))
            for first, last in hashing.groups_of_rows(bounds):
                for k, s in enumerate(hashing.shingle_sets(data, bounds[first : last + 1], shingle), first):
                    own = mine[owner[k]]
                    found = np.searchsorted(own, s)
                    found[found == len(own)] = 0
                    inter[k] = np.count_nonzero(own[found] == s)
                    total[k] = len(own) + len(s) - inter[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(inter), pa.array(total)], ["u", "v", "inter", "total"]
            )

    return pairs.select("u", "v", "ut", "vt").mapInArrow(released(run), "u binary, v binary, inter long, total long")


def _links(table: pa.Table, shingle: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join different classes of one pair of blocks, a spanning set of them."""
    cls, root = table.column("cls").to_pylist(), table.column("root").to_pylist()
    side = table.column("side").to_numpy()
    data, bounds = hashing.utf8(table.column("text"))
    sets = hashing.shingle_sets(data, bounds, shingle)
    sizes = np.array([len(s) for s in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    holders, first = owner[order], np.concatenate(([0], np.cumsum(often)))
    ends = np.cumsum(sizes)
    up = {r: r for r in root}

    def top(r: bytes) -> bytes:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out = []
    for k in range(len(sets)):
        own = place[ends[k] - sizes[k] : ends[k]]
        own = own[often[own] > 1]
        many = often[own]
        at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        inter = np.bincount(holders[at], minlength=len(sets))
        close = 100 * inter >= percent * (sizes + sizes[k] - inter)
        close[: k + 1] = False
        if side.any():
            close &= side != side[k]
        for j in np.flatnonzero(close):
            a, b = top(root[k]), top(root[j])
            if a != b:
                up[a] = b
                out.append((cls[k], cls[j]))
    return out


def _within_groups(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): links between different roots among classes that collide, directly or over others.

    A group is cut into blocks of about BLOCK_BYTES of text and every pair of its blocks is one unit of work, so neither
    a task nor a row ever holds a whole group or many long texts, and only links that join something are written.
    """
    edges = rest.where("low <> cls").select(F.col("low").alias("u"), F.col("cls").alias("v"))
    groups = components(edges)
    groups = groups.union(groups.select("root", "root")).distinct()
    members = rest.select("cls", "root").distinct().join(
        groups.select(F.col("node").alias("gn"), F.col("root").alias("grp")), F.col("cls") == F.col("gn")
    ).drop("gn")
    buckets = max(8, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    length = texts.select(F.col("cls").alias("tc"), F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES)).cast("long").alias("w"))
    members = members.join(length, F.col("cls") == F.col("tc")).drop("tc")
    numbered = ordinals(members, "grp", ["cls"], "_o", buckets, weight="w").drop("w")
    numbered = stage(numbered.withColumn("b", F.floor(F.col("_o") / BLOCK_BYTES)))
    many = numbered.groupBy("grp").agg((F.max("b") + 1).alias("blocks"))
    dealt = numbered.join(many, "grp").join(texts, "cls").withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)")))
    units = dealt.select(
        F.xxhash64("grp", F.least("b", "o"), F.greatest("b", "o")).alias("unit"),
        (F.col("b") > F.col("o")).cast("int").alias("side"), "cls", "root", "text",
    ).repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle_unit() -> pa.RecordBatch:
            links = _links(pa.Table.from_batches(held).combine_chunks(), shingle, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"]
            )

        for batch in batches:
            unit = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[-1].column("unit")[0].as_py() != unit[a]:
                    yield settle_unit()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield settle_unit()

    return units.mapInArrow(released(run), "u binary, v binary")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, th, n_shingles, component_id, kept) per row: classes of documents linked at ``percent`` or more.

    Links are 100 * |intersection| >= percent * |union| on whole sets. Equal sets are one class before any pair is
    formed. In each bucket of a band the class that shares most buckets meets every other class; what collides and is
    still in different classes then is compared block by block. ``th`` is a hash of the text that keeps repeated ids apart.
    """
    docs = narrow(df, id_col, text_col)
    sig = stage(signatures(docs, shingle, permutations, rows))
    classes = stage(
        sig.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct("id", "th", "n", "bands")).alias("rep"))
    )
    banded = classes.select(F.explode("rep.bands").alias("bk"), "cls", F.col("rep.n").alias("n"))
    crowded = banded.groupBy("bk").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = stage(banded.join(crowded, "bk"))
    # The class that shares most buckets with others is the likeliest centre of its group.
    degree = shared.groupBy("cls").agg(F.sum("many").alias("degree")).withColumnRenamed("cls", "dcls")
    buckets = stage(shared.join(degree, F.col("cls") == F.col("dcls")).drop("dcls"))

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes alone allow a link, each once."""
        return pairs.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v").distinct()

    involved = buckets.select("cls").distinct()
    reps = classes.join(involved, "cls").select("cls", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    reps = settle(reps)
    maybe = probably_in(docs.withColumn("th", text_key()), "th", bitmap_of(reps, "rth")).where("_maybe")
    texts = stage(
        maybe.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
        .select("cls", "text").dropDuplicates(["cls"])
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        right = texts.select(F.col("cls").alias("v"), F.col("text").alias("vt"))
        left = texts.select(F.col("cls").alias("u"), F.col("text").alias("ut"))
        return stage(_confirm(pairs.join(right, "v").join(left, "u"), shingle))

    def star(rows: DataFrame) -> DataFrame:
        """The centre of every bucket with each other member of the bucket."""
        centre = rows.groupBy("bk").agg(F.max(F.struct("degree", "cls", "n", "root")).alias("c"))
        return rows.join(centre, "bk").where((F.col("cls") != F.col("c.cls"))).select(
            F.col("c.cls").alias("u"), F.col("cls").alias("v"), F.col("c.n").alias("nu"), F.col("n").alias("nv"),
            F.col("c.root").alias("ru"), F.col("root").alias("rv"),
        )

    def linked(tested: DataFrame) -> DataFrame:
        return tested.where(100 * F.col("inter") >= percent * F.col("total")).select("u", "v")

    tested = confirmed(sized(star(buckets.withColumn("root", F.col("cls")))))
    joined = components(linked(tested))
    # Buckets whose members are still in different classes: what collides there is compared block by block.
    near = joined.select(F.col("node").alias("jn"), "root")
    member = buckets.select("bk", "cls").join(near, F.col("cls") == F.col("jn"), "left").select(
        "bk", "cls", F.coalesce("root", "cls").alias("root")
    )
    mixed = member.groupBy("bk").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("cls").alias("low"))
    rest = stage(member.join(mixed.where("r0 <> r1").select("bk", "low"), "bk").select("low", "cls", "root").distinct())
    found = stage(_within_groups(rest, texts, shingle, percent))
    if found.head(1):
        joined = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))

    roots = classes.select("cls", F.col("rep.id").alias("rid")).join(
        joined.select(F.col("node").alias("cls"), "root"), "cls", "left"
    ).withColumn("root", F.coalesce("root", "cls"))
    least = roots.groupBy("root").agg(F.min("rid").alias("component_id"))
    labels = roots.join(least, "root").select(F.col("cls").alias("lcls"), "component_id")
    out = sig.drop("bands").join(labels, F.col("cls") == F.col("lcls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of every class the document with the smallest id stays.

    Of rows that repeat with id and text one stays. Only rows that may go are shuffled.
    """
    found = near_duplicates(df, id_col, text_col, shingle, percent)
    fate = found.groupBy("id", "th").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("many"))
    fate = stage(fate.where("many > 1 or not kept").select(F.col("id").alias("_fi"), F.col("th").alias("_ft"), "kept"))
    fate = fate.withColumnRenamed("kept", "_fk")
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    docs = docs.withColumn("_th", text_key(F.col("row")[text_col]))
    flagged = probably_in(docs, "_th", stage(bitmap_of(fate, "_ft")))
    same = (F.col("_th") == F.col("_ft")) & F.col("row")[id_col].eqNullSafe(F.col("_fi"))
    doubtful = flagged.where("_maybe").join(fate, same, "left").where("coalesce(_fk, true)")
    once = doubtful.where("_fk is not null").dropDuplicates(["_fi", "_ft"]).select("row.*")
    return once.union(doubtful.where("_fk is null").select("row.*")).union(flagged.where(~F.col("_maybe")).select("row.*"))
