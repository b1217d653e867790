"""Isolation forest.

A bounded sample of rows is enough to grow the trees; they are grown in parallel tasks and are
small (at most 511 nodes each). Scoring runs over all rows in Arrow batches. The cut is the exact
quantile of all scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, quoted
from ..functions.quantiles import exact_quantiles
from ..session import spread_out, stage_table
from ..sources.files import stable_sample

TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.1
SEED = 42
TREE = "tree int, node int, feature int, cut double, depth double"
# Bounds of the score ranges.
SCORE_RANGES = (("Very Low (< -0.5)", None, -0.5), ("Low (-0.5 to -0.2)", -0.5, -0.2), ("Medium (-0.2 to 0)", -0.2, 0.0), ("High (0 to 0.2)", 0.0, 0.2), ("Very High (> 0.2)", 0.2, None))


def _mean_path(rows: int) -> float:
    """Mean path length of an unsuccessful search among that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def _grow(sample: np.ndarray, draw: np.random.RandomState, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree in the layout of a full binary tree: children of node i are 2i + 1 and 2i + 2.

    A leaf above the last level sends every value to its left child, down to the last level,
    so that scoring takes the same number of steps for all rows.
    """
    nodes = 2 ** (limit + 1) - 1
    feature, cut, depth = np.zeros(nodes, dtype="int32"), np.full(nodes, np.inf), np.zeros(nodes)
    waiting = [(0, sample, 0)]
    while waiting:
        node, rows, level = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(varied):
            last = node
            while 2 * last + 1 < nodes:
                last = 2 * last + 1
            depth[last] = level + _mean_path(len(rows))
            continue
        feature[node] = draw.choice(varied)
        cut[node] = draw.uniform(low[feature[node]], high[feature[node]])
        below = rows[:, feature[node]] <= cut[node]
        waiting += [(2 * node + 1, rows[below], level + 1), (2 * node + 2, rows[~below], level + 1)]
    return feature, cut, depth


def isolation_scores(df: DataFrame, features: Sequence[str], keys: Sequence[str], contamination: float = CONTAMINATION) -> DataFrame:
    """Keys and features with a ``score`` (below 0 is anomalous) and an ``anomaly`` flag, staged."""
    spark = df.sparkSession
    named = [k for k in keys if k not in features]
    made = df.select(
        *[quoted(k) for k in named],
        *[F.coalesce(as_double(quoted(c), df.schema[c].dataType), F.lit(0.0)).alias(c) for c in features],
        F.xxhash64(*[quoted(k) for k in keys]).alias("_key"),
    )
    numbers = spread_out(stage_table(made))
    # At most TREES * TREE_ROWS rows reach the driver.
    drawn = stable_sample(numbers, ["_key", *features], TREES * TREE_ROWS, SEED)
    sample = drawn.select(*[quoted(c) for c in features]).toPandas().to_numpy(dtype="float64")
    plain = numbers.drop("_key")
    if not len(sample):
        return plain.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("anomaly"))
    size = min(TREE_ROWS, len(sample))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                draw = np.random.RandomState(SEED + int(tree))
                rows = sample[draw.choice(len(sample), size, replace=False)]
                feature, cut, depth = _grow(rows, draw, limit)
                yield pd.DataFrame(
                    {"tree": int(tree), "node": np.arange(len(cut)), "feature": feature, "cut": cut, "depth": depth}
                ).astype({"tree": "int32", "node": "int32"})

    # At most TREES * 511 nodes.
    grown = spark.range(TREES).mapInPandas(grow, TREE).toPandas().sort_values(["tree", "node"])
    forest = [tuple(g[c].to_numpy() for c in ("feature", "cut", "depth")) for _, g in grown.groupby("tree", sort=True)]
    scale = max(_mean_path(size), 1e-12)

    @F.pandas_udf("double")
    def normality(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype="float64") for c in columns]).ravel()
        starts = np.arange(len(columns[0])) * len(columns)
        total = np.zeros(len(starts))
        for feature, cut, depth in forest:
            at = np.zeros(len(starts), dtype="int64")
            for _ in range(limit):
                at = 2 * at + 1 + (rows[starts + feature[at]] > cut[at])
            total += depth[at]
        return pd.Series(-np.power(2.0, -total / (len(forest) * scale)))

    raw = stage_table(plain.withColumn("_normality", normality(*[quoted(c) for c in features])))
    cut = exact_quantiles(raw, {"_normality": [contamination]})["_normality"][0]
    score = F.col("_normality") - F.lit(cut)
    return raw.select(*[quoted(c) for c in (*named, *features)], score.alias("score"), (score < 0).alias("anomaly"))


def anomaly_report(scores: DataFrame, features: Sequence[str]) -> DataFrame:
    """Counts, rate, mean and deviation of each feature by class, and score ranges, from one aggregate."""
    odd, score = F.col("anomaly"), F.col("score")
    measured = {"rows": F.count(F.lit(1)), "anomalies": F.count(F.when(odd, 1))}
    for i, c in enumerate(features):
        for tag, where in (("normal", ~odd), ("anomaly", odd)):
            value = F.when(where, quoted(c))
            measured[f"{tag}_mean{i}"] = F.avg(value)
            measured[f"{tag}_std{i}"] = F.stddev_samp(value)
    for i, (_, low, high) in enumerate(SCORE_RANGES):
        test = F.lit(True)
        test = test & (score >= low) if low is not None else test
        test = test & (score < high) if high is not None else test
        measured[f"range{i}"] = F.count(F.when(test, 1))

    def cell(section: str, key: str, value) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))

    cells = [
        cell("total", "anomalies", F.col("anomalies")),
        cell("total", "normal", F.col("rows") - F.col("anomalies")),
        cell("total", "anomaly_rate", F.try_divide("anomalies", "rows")),
    ]
    for i, c in enumerate(features):
        cells += [cell(c, f"{t}_{s}", F.coalesce(f"{t}_{s}{i}", F.lit(0.0))) for t in ("normal", "anomaly") for s in ("mean", "std")]
    cells += [cell("range", name, F.col(f"range{i}")) for i, (name, _, _) in enumerate(SCORE_RANGES)]
    return scores.agg(*[v.alias(k) for k, v in measured.items()]).select(F.inline(F.array(*cells)))
