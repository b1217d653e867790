"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Sorting the blocks gives each distinct
block an integer name. Then the names of adjacent blocks are paired, and sorting the pairs names
them in turn; after log2(blocks) rounds every text has one name. Names are given by comparing
contents, so two texts share one if and only if they are equal: a hash only decides where a
block is sorted to, never whether two blocks are the same.

A sort is dealt out by (hash, row, place), so a block that a third of all rows share is spread
over many tasks. A value that lies across the border of two tasks gets a name in each; these
border values, one or two per task, are then brought to one name.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch, stage_table

BLOCK_BYTES = 4096
HOT_SHARE = 1_000  # of all rows, a group that holds one part in so many is joined by a broadcast
_LOCAL = 1 << 40  # names per sort partition

_ROW = "_row long, _place long, _blocks long"


def _named_runs(key: str):
    """Number the runs of equal keys in a sorted partition; repeat the border keys in marker rows."""

    def number(batches):
        first_name = TaskContext.get().partitionId() * _LOCAL
        name, last_key, last_hash, first_hash = first_name - 1, None, None, None
        head, tail = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, hashes = batch.column(key), batch.column("_hash")
            before = pa.concat_arrays([pa.array([last_key], keys.type), keys.slice(0, batch.num_rows - 1)])
            new = pc.fill_null(pc.not_equal(keys, before), True).to_numpy(zero_copy_only=False)
            names = name + new.cumsum()
            hash_numbers = hashes.to_numpy()
            if first_hash is None:
                first_hash = hash_numbers[0]
            starts = new.nonzero()[0]
            for i in starts[hash_numbers[starts] == first_hash]:
                head.append((int(names[i]), keys[i].as_py()))
            if hash_numbers[-1] != last_hash:
                tail = []
            for i in starts[hash_numbers[starts] == hash_numbers[-1]]:
                tail.append((int(names[i]), keys[i].as_py()))
            name, last_key, last_hash = int(names[-1]), keys[-1].as_py(), hash_numbers[-1]
            carried = [batch.column(c) for c in ("_row", "_place", "_blocks", "_carry")]
            yield _rows(pa.array(names), pa.nulls(batch.num_rows, keys.type), *carried)
        borders = dict(head + tail)
        if borders:
            nothing = pa.nulls(len(borders), pa.int64())
            yield _rows(
                pa.array(list(borders), pa.int64()),
                pa.array(list(borders.values()), keys.type),
                nothing, nothing, nothing, pa.nulls(len(borders), batch.column("_carry").type),
            )

    return number


def _rows(name, border, row, place, blocks, carry):
    return pa.RecordBatch.from_arrays([name, border, row, place, blocks, carry], ["_name", "_border", "_row", "_place", "_blocks", "_carry"])


def _named(df: DataFrame, table) -> DataFrame:
    """Give equal binary ``_key`` values one integer ``_name``; other columns: _row, _place, _blocks, _carry."""
    dealt = df.withColumn("_hash", F.xxhash64("_key")).repartitionByRange("_hash", "_row", "_place")
    ordered = dealt.sortWithinPartitions("_hash", "_key").select("_hash", "_key", "_row", "_place", "_blocks", "_carry")
    carry = df.schema["_carry"].dataType.simpleString()
    runs = table(ordered.mapInArrow(_named_runs("_key"), f"_name long, _border binary, {_ROW}, _carry {carry}"))
    # At most a few rows per sort partition: the keys at its two borders.
    borders = runs.filter(F.col("_border").isNotNull()).select("_name", "_border")
    shared = borders.groupBy("_border").agg(F.min("_name").alias("_one"), F.collect_list("_name").alias("_names"))
    renamed = table(shared.filter(F.size("_names") > 1).select("_one", F.explode("_names").alias("_name")))
    named = runs.filter(F.col("_border").isNull()).drop("_border").join(F.broadcast(renamed), "_name", "left")
    return named.select("_row", "_place", "_blocks", "_carry", F.coalesce("_one", "_name").alias("_name"))


def text_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One collision-free identity (_level, _name) for each row of (_row, _text binary, _carry).

    Equal texts, and only they, get the same identity. The result is a staged table of
    (_row, _carry, _level, _name).
    """
    with scratch(texts.sparkSession) as table:
        size = F.octet_length("_text")
        places = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / block_bytes), F.lit(0)).cast("int"))
        cut = texts.select("_row", "_carry", "_text", F.posexplode(places).alias("_place", "_n")).select(
            "_row",
            F.col("_place").cast("long").alias("_place"),
            F.greatest(F.ceil(size / block_bytes), F.lit(1)).cast("long").alias("_blocks"),
            F.when(F.col("_place") == 0, F.col("_carry")).alias("_carry"),
            F.substring("_text", F.col("_n") * block_bytes + 1, F.lit(block_bytes)).alias("_key"),
        )
        names, level, done = _named(cut, table), 0, []
        while True:
            names = table(names)
            done.append(names.filter("_blocks = 1").select("_row", "_carry", F.lit(level).alias("_level"), "_name"))
            if names.filter("_blocks > 1").isEmpty():
                break
            pairs = names.filter("_blocks > 1").groupBy("_row", (F.col("_place").bitwiseAND(F.lit(-2)) / 2).cast("long").alias("_half"))
            even = F.col("_place") % 2 == 0
            pairs = pairs.agg(
                F.max(F.when(even, F.col("_name"))).alias("_left"),
                F.max(F.when(~even, F.col("_name"))).alias("_right"),
                F.max("_carry").alias("_carry"),
                F.max(F.ceil(F.col("_blocks") / 2)).cast("long").alias("_blocks"),
            )
            # A missing right name is -1, which no block has, so a text never equals one that is longer.
            key = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in (F.col("_left"), F.coalesce("_right", F.lit(-1)))])
            names, level = _named(pairs.select("_row", F.col("_half").alias("_place"), "_blocks", "_carry", key.alias("_key")), table), level + 1
        whole = done[0]
        for part in done[1:]:
            whole = whole.unionByName(part)
        return stage_table(whole)


def find_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group equal texts; of each group the row with the largest key stays.

    One row per row of ``docs``: the key, keep_id (key of the row that stays), group_size, kept,
    text_sha256 (lowercase hex of the UTF-8 text). A NULL text counts as empty. Texts are compared
    as they are. Other columns are not looked at. Rows that repeat key and text form one group of
    which exactly one row is kept; a NULL key is smaller than any other. An empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        content.alias("_text"),
        F.struct(F.col(key).alias("key"), F.sha2(content, 256).alias("sha")).alias("_carry"),
    )
    named = text_names(texts, block_bytes)
    mine = F.struct(F.col("_carry.key").alias("key"), F.col("_row").alias("row"))
    groups = stage_table(named.groupBy("_level", "_name").agg(F.max(mine).alias("_keep"), F.count(F.lit(1)).alias("group_size")))
    # Groups of a thousandth of all rows or more, a thousand at most, go to the rows; the other rows go to their groups.
    large = F.col("group_size") * HOT_SHARE >= named.count()
    hot = F.broadcast(groups.filter(large))
    rest = named.join(hot.select("_level", "_name"), ["_level", "_name"], "left_anti")
    grouped = named.join(hot, ["_level", "_name"]).unionByName(rest.join(groups.filter(~large), ["_level", "_name"]))
    return grouped.select(
        F.col("_carry.key").alias(key),
        F.col("_keep.key").alias("keep_id"),
        "group_size",
        (F.col("_keep.row") == F.col("_row")).alias("kept"),
        F.col("_carry.sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``find_duplicates``.

    The rows to drop are looked up by key. Rows that repeat both key and text are told apart
    by nothing, so one of them is taken.
    """
    found = find_duplicates(docs, text, key, block_bytes)
    lost = stage_table(found.filter(~F.col("kept")).select(F.col(key).alias("_key"), "keep_id", "text_sha256").distinct())
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn("_exact_dedup_sha", sha)
    gone = marked[key].eqNullSafe(lost["_key"]) & (marked["_exact_dedup_sha"] == lost["text_sha256"])
    other = ~lost["keep_id"].eqNullSafe(lost["_key"])
    stay = marked.join(lost.filter(other), gone, "left_anti")
    # Repeated rows of a key that stays itself: rare, taken once each.
    again = lost.filter(~other)
    if again.isEmpty():
        return stay.drop("_exact_dedup_sha")
    rest = stay.join(again, stay[key].eqNullSafe(again["_key"]) & (stay["_exact_dedup_sha"] == again["text_sha256"]), "left_anti")
    once = stay.join(again, stay[key].eqNullSafe(again["_key"]) & (stay["_exact_dedup_sha"] == again["text_sha256"]), "left_semi")
    return rest.unionByName(once.dropDuplicates(["_exact_dedup_sha", key])).drop("_exact_dedup_sha")
