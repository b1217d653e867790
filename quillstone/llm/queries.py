"""The registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Query
from ..session import new_folder
from . import bpe, chat, exact_dedup, lexical, licences, mixing, neighbours, runs, simhash, token_files, toxicity, warc, winnowing


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents mixed so that each source weighs the square root of its size."""
    return mixing.mix(_table(spark, folder, "documents")).withColumnRenamed("_copy", "copy")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of each document."""
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its fingerprint and the group of near copies it belongs to."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph of the documents that is a licence notice."""
    return licences.scan(_table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's place and ids, read back from the shard files."""
    documents, path = _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    index = token_files.write_tokens(documents, path, new_folder(spark, "tokens"), end_id=1)
    return token_files.read_tokens(index).select(
        F.col("_key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(_table(spark, folder, "documents").select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's fingerprint, as ``position:hash`` in order, beside those of its edit and of the next document."""
    pairs = winnowing.edited_pairs(_table(spark, folder, "documents"))

    def written(marks):
        return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["pos"], F.hex(m["hash"]))), " ")

    own = F.col("fingerprint.hash")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("fingerprint").alias("fingerprint"),
        written("edited_fingerprint").alias("edited_fingerprint"),
        winnowing.likeness(own, F.col("edited_fingerprint.hash")).alias("near_edited"),
        winnowing.likeness(own, F.col("next_fingerprint.hash")).alias("near_next"),
    )


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """What each conversation's training examples hold, and one conversation of nothing but control strings."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.summary(chat.expand(rows.unionByName(hostile)))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's record, read back from the archives."""
    index = warc.write_archives(_table(spark, folder, "pages"), new_folder(spark, "warc"))
    return warc.read_archives(index).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the equal document that stays."""
    return exact_dedup.find_duplicates(_table(spark, folder, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every tenth document, by a hash of its id, repeating some words from a place on."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    worded = docs.select("doc_id", "text", draw.alias("h"), F.when(draw % 10 == 0, F.split("text", r"[\x20\x09-\x0D]+")).alias("split"))
    worded = worded.withColumn("words", F.filter("split", lambda w: w != ""))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    placed = worded.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, start).alias("a"), F.when(n > 0, period).alias("p"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.floor((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    left = F.slice("words", F.col("a") + 1, (F.col("n") - F.col("a")) % F.col("p"))
    edited = F.concat_ws(" ", F.concat(F.slice("words", F.lit(1), F.col("a")), again, left))
    return placed.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's periodic runs of words, its longest one, and the words that no run repeats."""
    found = runs.find_runs(planted_periods(_table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth one."""
    vectors = _table(spark, folder, "embeddings")
    found = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("_key").alias("vec_id"), "score")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_source_mix": Query(op1_source_mix, mixing.ORACLE),
    "op2_toxicity": Query(op2_toxicity),
    "op3_simhash_dedup": Query(op3_simhash_dedup),
    "op4_licence_scan": Query(op4_licence_scan),
    "op5_token_files": Query(op5_token_files),
    "op6_bpe": Query(op6_bpe),
    "op7_winnowing": Query(op7_winnowing),
    "op8_chat": Query(op8_chat, chat.ORACLE),
    "op9_warc": Query(op9_warc),
    "op10_exact_dedup": Query(
        op10_exact_dedup,
        """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(text) AS text_sha256 FROM t WINDOW same AS (PARTITION BY text)""",
    ),
    "op11_periodic_runs": Query(op11_periodic_runs),
    "op12_nearest_vectors": Query(op12_nearest_vectors),
    "op13_ranked_search": Query(op13_ranked_search, lexical.ORACLE),
}
