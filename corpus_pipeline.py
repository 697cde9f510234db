"""A corpus from raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import line_dedup, minmax, patterns, suffix_family, toxicity
from vitalgrid.llm.common import bytes_per_batch
from vitalgrid.session import stage

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
# Bytes from which a repeated passage is cut out everywhere but where it is part of no other text.
PASSAGE = 200
# Bytes of rows that go to a Python worker at a time: all stages share the executors' memory.
BATCH = 4 << 20


def _documents(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """Carried rows with a new text; the character count follows the text."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labelled ones, does not reject."""
    bytes_per_batch(spark, BATCH)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=docs.columns).where("score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals, long ones up to one edit."""
    bytes_per_batch(spark, BATCH)
    found = line_dedup.drop_repeated_lines(docs, carry=[c for c in docs.columns if c != "text"], exact_chars=1)
    return _documents(found, docs.columns, F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class on five-word shingles at similarity .8."""
    bytes_per_batch(spark, BATCH)
    return minmax.keep_one(docs, shingle=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in several places, cut between characters."""
    bytes_per_batch(spark, BATCH)
    others = [c for c in docs.columns if c != "text"]
    found = suffix_family.strip_repeats(docs, length=PASSAGE, whole_characters=True, carry=others)
    return _documents(found, docs.columns, F.col("kept").cast("string"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids with its place in a sequence."""
    bytes_per_batch(spark, BATCH)
    packed = patterns.pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE, 1, forget=True)
    return packed.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_passages),
    ("best_fit_packing", pack),
]

# Learned scores and tokenizer ids have no SQL form; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's rows go through a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
