"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in two bits or
fewer, at least one segment is free of errors, and the next segment has at most two, so the Golay
keys of its two versions share an index. A lookup key is thus an exact segment with one index of
its neighbour: at most 18 keys per distinct fingerprint, and every link shares one.

Fingerprints under a shared key are joined and verified bit by bit. Where many fingerprints share
a key, as in a large family of near copies, pairs would grow with the square. Those are linked
exactly in another way, with no pairs: each fingerprint is filed under itself and its 64 one-bit
neighbours, and what is filed under the same word, 65 fingerprints at most, differs in two bits
or fewer. Any two fingerprints with two different bits share such a word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import release, scratch, stage_table
from . import golay
from .components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_DIFFERENT = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, number of bits
PAIRED_UP_TO = 50  # fingerprints under one key that are still verified pair by pair


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes; A-Z is lower-cased, ASCII white space separates words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends.tolist()]
        ends = (ends[words - 1 :] - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text's bits are counted in slices
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


@pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


@pandas_udf(T.ArrayType(T.LongType()))
def _lookup_keys(prints: pd.Series) -> pd.Series:
    values = prints.to_numpy().view(np.uint64)
    parts = [((values >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    columns = []
    for i, exact in enumerate(parts):
        near = golay.keys(parts[(i + 1) % len(parts)])
        name = (i << 40 | exact << golay.DATA)[:, None] | near
        columns.append(np.where(near < 0, -1, name))
    table = np.concatenate(columns, axis=1)
    return pd.Series([row[row >= 0] for row in table])


def links(prints: DataFrame, paired_up_to: int = PAIRED_UP_TO) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a > b, from (print): whoever is linked by a chain of
    differences of two bits or fewer is linked by a chain of these pairs, all of them such links."""
    with scratch(prints.sparkSession) as table:
        keyed = table(prints.select("print", F.explode(_lookup_keys("print")).alias("key")))
        sizes = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = table(keyed.join(sizes, "key"))
        few = shared.filter(F.col("n") <= paired_up_to).drop("n")
        pairs = few.select("key", F.col("print").alias("a")).join(few.select("key", F.col("print").alias("b")), "key").filter("a > b")
        near = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DIFFERENT).select("a", "b")
        many = shared.filter(F.col("n") > paired_up_to).select("print").distinct()
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        filed = many.select("print", F.explode(F.concat(F.array("print"), flips)).alias("word"))
        # 65 fingerprints at most are filed under a word.
        together = filed.groupBy("word").agg(F.collect_set("print").alias("prints")).filter(F.size("prints") > 1)
        stars = together.select(F.array_min("prints").alias("b"), F.explode("prints").alias("a")).filter("a <> b").select("a", "b")
        return stage_table(near.union(stars).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", paired_up_to: int = PAIRED_UP_TO) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id, the smallest key that can be
    reached over links of two different bits or fewer, its own included.

    NULL and empty texts have fingerprint zero and are linked like any other. A text of fewer than
    three words is one shingle. Repeated rows come back as often as they are given. A NULL key is
    no smallest key: a group of such rows only has component NULL. Other columns are not looked at.
    """
    with scratch(docs.sparkSession) as table:
        printed = stage_table(docs.select(F.col(key).alias("_key"), _fingerprints(text).alias("print")))
        classes = table(printed.groupBy("print").agg(F.min("_key").alias("first")))
        found = links(classes.select("print"), paired_up_to)
        grouped = components(found)
        release(found)
        linked = classes.join(grouped, classes["print"] == grouped["node"], "left")
        whole = linked.select("print", "first", F.coalesce("component", "print").alias("component"))
        # Only linked classes take another class's key.
        named = whole.groupBy("component").agg(F.min("first").alias("component_id"))
        ids = stage_table(whole.join(named, "component").select("print", "component_id"))
        release(grouped)
    return printed.join(ids, "print").select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is their group's component_id; of rows that repeat a key, one.

    Rows without a key belong to nobody's group and stay.
    """
    return keep_first(docs, near_duplicates(docs, text, key), key)


def keep_first(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """As above, by the key and component_id of ``found``."""
    lost = stage_table(found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_key")).distinct())
    stay = docs.join(lost, docs[key] == lost["_key"], "left_anti")
    again = stage_table(docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key")))
    if again.isEmpty():
        return stay
    once = stay.join(again, stay[key] == again["_key"], "left_semi").dropDuplicates([key])
    return stay.join(again, stay[key] == again["_key"], "left_anti").unionByName(once)
