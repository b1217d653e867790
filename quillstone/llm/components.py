"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import release, stage_table


def _digest(edges: DataFrame) -> tuple:
    name = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(name), F.sum(F.pmod(name, F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Alternating star contraction: each round points the larger neighbours of a node at the smallest
    one around it, then each node and its smaller neighbours at the smallest of them, until nothing
    changes, after about log(n) squared rounds at worst. A hub's edges are only aggregated with a
    pre-combining minimum and joined back, which adaptive execution can split. Each round's edges
    are a staged table; the result is one too.
    """
    now = stage_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stage_table(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stage_table(after.distinct())
        changed = _digest(after) != _digest(now)
        release(now, large)
        now = after
        if not changed:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    result = stage_table(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
    release(now)
    return result
