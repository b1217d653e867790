"""Mixing sources to target weights by Poisson replication.

A source's rate is how often one of its documents should appear on average. Each document draws
its own number of copies: a hash of seed and key gives a uniform number, and the inverse of the
Poisson distribution with the source's rate turns it into a count. So the mix is the same in every
run and on every cluster, and needs no coordination between rows. Rates above ``PART`` are split
into equal parts with a draw each, as the sum of Poisson counts is one of their summed rate; that
keeps the table of a distribution short and its numbers far from underflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import stage_table

SEED = 42
PART = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: its first 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source: str = "source", size: str | None = None, temperature: float = 2.0) -> DataFrame:
    """One row per source: its mean repetition rate, in ``parts`` equal parts, and the distribution of one part.

    ``weights`` has the columns source and weight; weights are shares among the sources that occur, and
    sources without a weight get none of the mix.
    Without it a source weighs its size to the power 1 / temperature. ``size`` names the column a
    source is measured by (NULL counts as 0); without it, by documents. ``total`` is the size of
    the mix, by default that of ``docs``. A NULL source is a source of its own.
    """
    amount = F.coalesce(F.col(size).cast("double"), F.lit(0.0)) if size else F.lit(1.0)
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(amount).alias("_size"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow("_size", F.lit(1 / temperature)))
    else:
        given = weights.select(F.col("source").alias("_given"), F.col("weight").cast("double").alias("_weight"))
        weighed = sizes.join(given, sizes["_source"].eqNullSafe(given["_given"]), "left").drop("_given").fillna(0.0, ["_weight"])
    sums = weighed.agg(F.sum("_weight").alias("_weights"), F.sum("_size").alias("_sizes"))
    wanted = F.lit(float(total)) if total is not None else F.col("_sizes")
    # A one-row aggregate on the other side.
    rates = weighed.join(F.broadcast(sums)).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("_weight") * wanted, F.col("_weights") * F.col("_size")), F.lit(0.0))
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("_parts")
    # Beyond this count the rest of the distribution is smaller than the steps of a draw.
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))

    def step(made: Column, k: Column) -> Column:
        p = made["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(made["upto"], F.element_at(made["upto"], -1) + p).alias("upto"))

    return rates.withColumn("_parts", parts).select(
        "_source", "rate", "_parts", F.aggregate(F.sequence(F.lit(1), last), start, step)["upto"].alias("_upto")
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source: str = "source", key: str = "doc_id", size: str | None = None, temperature: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix: every row of ``docs`` as often as it drew, with ``_copy`` (from 0), shuffled globally.

    Every copy goes to a partition chosen by the hash of its own random number ``_order`` and is
    sorted by it there, so each partition is a random sample of the whole mix in random order. See
    ``source_rates`` for the weights. Rows with equal keys draw equal numbers, so repeated rows are
    repeated together; so are rows without a key. A column named ``_copy`` gives way to the
    number of the copy. An empty table gives no rows.
    """
    # A row per source; written, so that Spark joins it by its true size.
    rates = stage_table(source_rates(docs, weights, total, source, size, temperature))
    kept = [quoted(c) for c in docs.columns if c != "_copy"]
    wrapped = docs.select(F.struct(*kept).alias("_row"), quoted(key).alias("_key"), quoted(source).alias("_of"))
    drawn = wrapped.join(rates, wrapped["_of"].eqNullSafe(rates["_source"]))

    def count(u: Column) -> Column:
        return F.size(F.filter("_upto", lambda upto: upto <= u))

    more = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + count(uniform(F.lit(f"{seed}:draw"), F.col("_key"), part))
    )
    copies = F.when(F.col("_parts") == 1, count(uniform(F.lit(f"{seed}:draw"), F.col("_key"), F.lit(1)))).otherwise(more)
    placed = drawn.withColumn("_copies", copies).filter("_copies > 0")
    out = placed.select("_row", "_key", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), F.col("_key"), F.col("_copy"))
    dealt = out.select("_row", "_key", "_copy", order.alias("_order")).repartition("_order")
    return dealt.sortWithinPartitions("_order", "_key", "_copy").select("_row.*", "_copy")


ORACLE = """
WITH sizes AS (SELECT source, count(*)::DOUBLE AS size FROM documents GROUP BY 1),
rates AS (SELECT source, sqrt(size) * sum(size) OVER () / (sum(sqrt(size)) OVER () * size) AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / 64.0), 1)::INTEGER AS parts, rate / greatest(ceil(rate / 64.0), 1) AS mean FROM rates),
steps AS (SELECT source, parts, mean, unnest(generate_series(0, ceil(mean + 12 * sqrt(mean) + 24)::INTEGER)) AS k FROM parts),
shares AS (SELECT source, parts, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM steps),
upto AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM shares),
draws AS (SELECT d.doc_id, d.source, p.part, ('0x' || substr(md5('42:draw:' || d.doc_id || ':' || p.part), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT source, unnest(generate_series(1, parts)) AS part FROM parts) p ON p.source IS NOT DISTINCT FROM d.source),
copies AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, part, count(*) AS n FROM draws w JOIN upto t ON t.source IS NOT DISTINCT FROM w.source AND t.upto <= w.u
  GROUP BY 1, 2) GROUP BY 1)
SELECT d.*, unnest(generate_series(0, c.n::BIGINT - 1))::INTEGER AS copy FROM documents d JOIN copies c USING (doc_id)"""
