"""From raw documents to token ids: toxic documents out, equal texts once, near copies once, sources
mixed to their weights, texts encoded.

``run`` writes every stage's documents to the shared folder and reads them again for the next.
Stages are functions of (spark, docs, sf_dir); all but the last return the columns of documents.

NULL texts count as empty in every stage; an empty text is scored, and all empty texts are equal. Rows
that repeat a doc_id with its text are equal too, so one of them stays. Rows without a doc_id are kept
like others and draw the same number in the mix. An empty table of documents gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.llm import bpe, exact_dedup, mixing, simhash, toxicity
from quillstone.plans.registry import Query
from quillstone.session import stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.3; the model learns from the given labels of raw documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels).select(*COLUMNS)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by three-word fingerprints that differ in two bits at most, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it drew, so that a source weighs the square root of its size."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its ids, their number, and whether they decode to the text."""
    coded = bpe.round_trip(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("_sha")).alias("lossless")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_equal),
    ("simhash_dedup", drop_near),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the first stage's trees; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
