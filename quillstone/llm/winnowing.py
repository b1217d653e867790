"""Document fingerprints by winnowing, with DataFrame functions only.

A text is cut into pieces, lower-cased: a run of up to 24 characters that are not white space is one
piece, a word as a rule; a longer run, and what is written in a script without spaces, goes character by
character. So how a passage is cut does not depend on what stands before or after its runs.
Every ``k`` pieces in a row are hashed, and of every ``w`` hashes in a row the smallest is kept,
the rightmost of equals, with its position. So two texts that share w + k - 1 pieces in a row share
at least one hash, wherever they stand, and nothing shorter than k pieces is ever matched.

The smallest of a window is found on 31 bits of the hash with the position below them, in one
number, so that ties go to the right; what is kept is the whole hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table

#: Code points of scripts that put no spaces between words: Thai to Tibetan, Burmese, Khmer, Kana and Han.
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
PIECE = rf"(?<!\S)[^\s{UNSPACED}]{{1,24}}(?!\S)|\S"
K, W = 5, 8
ROWS_PER_BLOCK = 2_000
MOST_BLOCKS = 1_000_000
INTERVALS = 256
_LOW = 0x7FFFFFFF


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``: an array of (pos, hash) in order of position.

    A text of fewer than k pieces is one gram; one without pieces, empty or NULL, has no hash.
    Column names that start with _w_ are used in between.
    """
    kept = df.columns
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(PIECE), 0)
    hashed = df.withColumn("_w_hashes", F.transform(pieces, lambda p: F.xxhash64(p)))
    whole = F.array(F.aggregate("_w_hashes", F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))
    rolled = F.transform(F.sequence(F.lit(0), F.size("_w_hashes") - k), lambda i: F.xxhash64(*[F.get("_w_hashes", i + j) for j in range(k)]))
    grams = F.when(F.size("_w_hashes") >= k, rolled).when(F.size("_w_hashes") > 0, whole).otherwise(F.array().cast("array<long>"))
    grammed = hashed.select(*kept, grams.alias("_w_grams"))
    ranked = F.transform("_w_grams", lambda g, i: g.bitwiseAND(F.lit(_LOW << 32)).bitwiseOR(F.lit(_LOW) - i))
    keyed = grammed.withColumn("_w_ranks", ranked)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w_ranks") - w, F.lit(0)))
    smallest = F.transform(starts, lambda i: F.least(*[F.get("_w_ranks", i + j) for j in range(w)]))
    chosen = F.when(F.size("_w_ranks") > 0, F.array_distinct(smallest)).otherwise(F.array().cast("array<long>"))
    picked = keyed.select(*kept, "_w_grams", chosen.alias("_w_chosen"))

    def place(key: Column) -> Column:
        return (F.lit(_LOW) - key.bitwiseAND(F.lit(_LOW))).cast("int")

    marks = F.transform("_w_chosen", lambda c: F.struct(place(c).alias("pos"), F.get("_w_grams", place(c)).alias("hash")))
    return picked.select(*kept, marks.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays of them; 1 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, Window]:
    """``docs`` dealt into blocks of neighbouring keys, and the window by which a row's next row
    (descending keys; after the last the first) is reached with ``lead``.

    The first rows of the next block are added to each block as guests (``_guest``), to be dropped
    after the lead. Keys are integers; NULL keys come last, and equal keys are ordered by a hash of
    ``columns``. The keys are cut at ``INTERVALS`` quantiles, so an outlying key makes no large block, and
    evenly in between.
    """
    spread = [i / INTERVALS for i in range(INTERVALS + 1)]
    n, edges = docs.agg(F.count(F.lit(1)), F.percentile_approx(F.col(key).cast("long"), spread, 20 * INTERVALS)).first()
    edges = sorted(set(edges or [0]))
    each = max(1, min(n // ROWS_PER_BLOCK, MOST_BLOCKS) // INTERVALS)
    value = F.coalesce(F.col(key).cast("long"), F.lit(edges[0]))
    # The last edge at or below the key, and the share of the way to the next one.
    number = F.greatest(F.size(F.filter(F.lit(edges), lambda e: e <= value)) - 1, F.lit(0))
    exact = lambda c: c.cast("decimal(20,0)")
    low, high = F.get(F.lit(edges), number), F.coalesce(exact(F.get(F.lit(edges), number + 1)), exact(F.lit(edges[-1])) + 1)
    share = (exact(value) - exact(low)).cast("double") / (exact(high) - exact(low)).cast("double")
    part = F.greatest(F.lit(0), F.least(F.floor(share * each), F.lit(each - 1))).cast("long")
    # The last key's block is where NULL keys go too.
    block = -(number.cast("long") * each + part)
    rows = docs.withColumn("_block", block).withColumn("_tie", F.xxhash64(*columns))
    # One row per block.
    heads = rows.groupBy("_block").agg(F.max(key).alias("_head"))
    order = Window.orderBy("_block")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stage_table(heads.select("_block", "_head", F.coalesce(F.lag("_block").over(order), F.max("_block").over(everything)).alias("_before")))
    heads = heads.withColumnRenamed("_block", "_own")
    first = rows.join(F.broadcast(heads), (rows["_block"] == heads["_own"]) & rows[key].eqNullSafe(heads["_head"]))
    guests = first.select(*docs.columns, F.col("_before").alias("_block"), "_tie", F.lit(True).alias("_guest"))
    both = rows.select(*docs.columns, "_block", "_tie", F.lit(False).alias("_guest")).unionByName(guests)
    return both, Window.partitionBy("_block").orderBy("_guest", F.col(key).desc_nulls_last(), "_tie")


def edited_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """Each text and its edit, whose last floor(n/2) code points are the first ones of the next document
    by descending key (after the last: the first): key, n_chars, edited, fingerprint, edited_fingerprint
    and next_fingerprint (arrays of pos and hash). A NULL text counts as empty; a single document
    is its own next one; repeated rows are rows of their own. Other columns are not looked at.
    """
    plain = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blocks, order = with_next(plain, "_key", ["_text"])
    # Fingerprints come after the exchange by block, so only texts are moved.
    with_text = blocks.withColumn("_next", F.lead("_text").over(order))
    own = with_fingerprint(with_text, "_text", "fingerprint", k, w)
    led = own.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("_guest"))
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), F.length("_text") - half), F.substr("_next", F.lit(1), half))
    made = led.select("_key", F.length("_text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    return with_fingerprint(made, "edited", "edited_fingerprint", k, w).withColumnRenamed("_key", key)
