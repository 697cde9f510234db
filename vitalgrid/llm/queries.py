"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import (
    bpe,
    edit_embedding,
    lexical,
    line_dedup,
    minmax,
    patterns,
    resampling,
    rotated_codes,
    shards,
    suffix_family,
    toxicity,
    va_file,
    warc,
)

# Every tokenizing query reads this public vocabulary file where it is installed.
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best integer inner products of every hundredth vector against all others."""
    vec = va_file.floored(F.col("embedding"), 1024)
    return va_file.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, vec)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by cosine of every fiftieth vector against all others."""
    return rotated_codes.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes, equal texts together."""
    found = shards.assign(_table(spark, sf_dir, "documents"), 16)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles at similarity .8."""
    found = minmax.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of 4096 tokens."""
    found = patterns.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 4096, 1)
    return found.withColumnRenamed("id", "doc_id")


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again, as digests."""
    path = public_tokenizers.path(TOKENIZER)
    found = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return bpe.with_counts(found).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that an earlier line equals, from 20 characters up to one edit."""
    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), exact_chars=1)
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5")
    )


OP8_SQL = r"""
WITH parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT line, min((doc_id, pos)) AS first FROM parts
    WHERE length(line) >= 20 OR regexp_matches(line, '[^ \t\x0B\f\r]') GROUP BY line),
longs AS (SELECT line, first, length(line) AS n FROM firsts WHERE length(line) >= 20),
ends AS (SELECT line, first, n, left(line, 10) AS e FROM longs
    UNION ALL SELECT line, first, n, '>' || right(line, 10) FROM longs),
pairs AS (SELECT DISTINCT a.line AS x, b.line AS y, a.n AS nx, b.n AS ny FROM ends a JOIN ends b
    ON a.e = b.e AND b.first < a.first AND abs(a.n - b.n) <= 1),
close AS (SELECT DISTINCT x FROM pairs WHERE len(list_filter(range(greatest(nx, ny)),
    lambda i: left(x, i::BIGINT) = left(y, i::BIGINT) AND
    substr(x, (i + 1 + (nx >= ny)::INT)::BIGINT) = substr(y, (i + 1 + (ny >= nx)::INT)::BIGINT))) > 0),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text, count(*) AS n FROM parts p
    LEFT JOIN firsts f ON f.line = p.line LEFT JOIN close c ON c.x = p.line
    WHERE f.line IS NULL OR (f.first = (p.doc_id, p.pos) AND c.x IS NULL) GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
    (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0))::BIGINT AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op9_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a web archive record and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def op10_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes of passages of 200 bytes that stand in several places."""
    found = suffix_family.strip_repeats(_table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["e"] - x["s"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of all for every benchmark item."""
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
held AS (SELECT r, doc_id, len(words)::HUGEINT AS n, words FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::HUGEINT AS big_n, sum(n)::HUGEINT AS big_l FROM held),
asked AS (SELECT item_id, term, count(*)::HUGEINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*)::HUGEINT AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM held)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w
    FROM tf, total GROUP BY term, big_n),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))
    ::BIGINT AS score FROM asked JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of twenty words or more, drawn towards the benchmark's words."""
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = resampling.resample(docs, target, percent=10, buckets=10000, longest=1, least_words=20, seed="2024:")
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE octet(b, k, c) AS (SELECT b::UINTEGER, 0, b::UINTEGER FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END
    FROM octet WHERE k < 8),
rule AS (SELECT list(c ORDER BY b) AS r FROM octet WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
listed AS (SELECT side, id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM texts),
used AS (SELECT side, r, word, count(*) AS times FROM (SELECT side, r, unnest(words) AS word FROM listed) GROUP BY ALL),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(octet_length(encode(word))),
    lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::UINTEGER)),
    lambda a, x: xor(a >> 8, r[(xor(a, x) & 255) + 1])), 4294967295::UINTEGER) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM used), rule),
counted AS (SELECT bucket, coalesce(sum(times) FILTER (side = 'd'), 0) AS s, coalesce(sum(times) FILTER (side = 'b'), 0) AS t
    FROM used JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weighed AS (SELECT r, sum(times * gain)::BIGINT AS total FROM used JOIN hashed USING (word) JOIN gain USING (bucket)
    WHERE side = 'd' GROUP BY r),
scored AS (SELECT id, len(words)::BIGINT AS n, coalesce(floor(total / len(words))::BIGINT, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM listed LEFT JOIN weighed USING (r) WHERE side = 'd'),
fit AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY weight + noise DESC, id) AS place,
    count(*) FILTER (n >= 20) OVER () AS fit FROM scored)
SELECT id AS doc_id, n AS n_features, weight, weight + noise AS score,
    CASE WHEN n >= 20 AND place <= 10 * fit // 100 THEN place END::BIGINT AS rank FROM fit
"""


def op13_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, their likenesses, and the keys of the bands it is found by."""
    return edit_embedding.fingerprinted(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "bands",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_va_file": op1_va_file,
    "op2_lpt_sharding": op2_lpt_sharding,
    "op3_minmax_near_dedup": op3_minmax_near_dedup,
    "op4_rotated_codes": op4_rotated_codes,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_streaming_bpe": op7_streaming_bpe,
    "op8_line_neighbourhood": op8_line_neighbourhood,
    "op8_line_neighbourhood_every_line": op8_line_neighbourhood,
    "op9_warc_chain": op9_warc_chain,
    "op10_suffix_family": op10_suffix_family,
    "op11_geometric_blocks": op11_geometric_blocks,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_edit_embedding": op13_edit_embedding,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_va_file": OP1_SQL, "op8_line_neighbourhood": OP8_SQL,
    "op8_line_neighbourhood_every_line": OP8_SQL, "op9_warc_chain": OP9_SQL,
    "op11_geometric_blocks": OP11_SQL, "op12_importance_resampling": OP12_SQL,
}
