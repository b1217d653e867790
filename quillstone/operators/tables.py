"""Small table operators that the jobs and their users combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, bucket_number, quoted
from ..functions.grouping import value_counts
from ..functions.quantiles import exact_quantiles

# Upper bounds of the revenue ranges and their labels.
REVENUE_EDGES = (100.0, 500.0, 1000.0)
REVENUE_LABELS = ("0-100", "100-500", "500-1000", "1000+")


def of_kind(df: DataFrame, keep) -> DataFrame:
    """Only the columns whose type passes ``keep``."""
    return df.select(*[quoted(f.name) for f in df.schema if keep(f.dataType)])


def counted(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, NULL left out."""
    value = quoted(column)
    return df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def keep_top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent. The list has at most k rows."""
    top = counted(df, column).orderBy(F.desc("n"), "value").limit(k).select(F.col("value").alias("_top"))
    return df.join(F.broadcast(top), quoted(column) == F.col("_top"), "left_semi")


def updated(df: DataFrame, column: str, changes: Sequence[tuple[Column, object]]) -> DataFrame:
    """Conditional updates in turn: a later one that holds wins over an earlier one.

    A new value is a column, or a function of the value that the updates before it left.
    """
    value = quoted(column)
    for condition, new in changes:
        value = F.when(condition, new(value) if callable(new) else new).otherwise(value)
    return df.withColumn(column, value)


def pooled_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of several columns counted as one list."""
    return value_counts(df, columns).groupBy("value").agg(F.sum("n").alias("n"))


def pair_table(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """How often each pair of values occurs; the sparse form of a matrix."""
    a, b = quoted(rows), quoted(columns)
    held = df.filter(a.isNotNull() & b.isNotNull())
    return held.groupBy(a.alias(rows), b.alias(columns)).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Dense matrix with a column for each of the known values; empty cells are 0.

    A table of very many columns is slow to plan; ``pair_table`` is the same counts as rows.
    """
    pairs = pair_table(df, rows, columns)
    return pairs.groupBy(quoted(rows)).pivot(columns, list(values)).agg(F.sum("n")).na.fill(0)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line, r, r², slope error and number of complete pairs, in one aggregate."""
    a, b = as_double(quoted(x), df.schema[x].dataType), as_double(quoted(y), df.schema[y].dataType)
    row = df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.corr(a, b).alias("r"),
        F.regr_r2(b, a).alias("r_squared"),
        F.regr_count(b, a).alias("points"),
        F.regr_sxx(b, a).alias("_sxx"),
        F.regr_syy(b, a).alias("_syy"),
    )
    rest = (1 - F.col("r_squared")) * F.col("_syy")
    error = F.sqrt(F.try_divide(F.try_divide(rest, F.col("points") - 2), F.col("_sxx")))
    return row.select("slope", "intercept", "r", "r_squared", "points", error.alias("slope_error"))


def _bins(labels: Sequence[str], counts: DataFrame) -> DataFrame:
    """Every label with its count, 0 where nothing fell in. Both sides are as short as the list."""
    spark = counts.sparkSession
    listed = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(v).alias("label")) for i, v in enumerate(labels)]))
    )
    return listed.join(F.broadcast(counts), "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fixed_histogram(
    df: DataFrame, column: str, edges: Sequence[float] = REVENUE_EDGES, labels: Sequence[str] = REVENUE_LABELS, low: float | None = 0.0
) -> DataFrame:
    """Counts between fixed edges; a value on an edge belongs to the bin below it."""
    value = as_double(quoted(column), df.schema[column].dataType)
    held = df.select(value.alias("value")).filter(F.col("value").isNotNull())
    if low is not None:
        held = held.filter(F.col("value") >= low)
    counts = held.groupBy(bucket_number(F.col("value"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return _bins(labels, counts)


def equal_width_histogram(df: DataFrame, column: str, bins: int = 5, compat: bool = False) -> DataFrame:
    """Counts in equal steps from the smallest to the largest value.

    The largest value belongs to the last bin; with ``compat`` every bin is half-open, so it
    falls outside of all of them.
    """
    value = as_double(quoted(column), df.schema[column].dataType)
    held = df.select(value.alias("value")).filter(F.col("value").isNotNull())
    low, high = held.agg(F.min("value"), F.max("value")).first()
    labels = [str(i + 1) for i in range(bins)]
    if low is None:
        return _bins(labels, held.limit(0).select(F.lit(0).alias("bin"), F.lit(0).alias("n")))
    width = (high - low) / bins
    # The bounds are computed once, so neighbouring bins share exactly the same number.
    starts = [low + i * width for i in range(bins)] + [low + bins * width]
    number = F.lit(0)
    for start in starts[:bins]:
        number = number + F.when(F.col("value") >= F.lit(start), 1).otherwise(0)
    numbered = held.withColumn("bin", number)
    if compat:
        numbered = numbered.filter(F.col("value") < F.lit(starts[bins]))
    counts = numbered.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return _bins(labels, counts)


def quantile_buckets(df: DataFrame, column: str, quantiles: Sequence[float] = (0.2, 0.4, 0.6, 0.8), name: str = "bucket") -> DataFrame:
    """Bucket by quantile edges: right-closed, equal values share a bucket."""
    edges = exact_quantiles(df, {column: quantiles})[column]
    value = as_double(quoted(column), df.schema[column].dataType)
    if edges[0] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, bucket_number(value, edges))


def quantile_table(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(column, quantile, value) rows of exact quantiles."""
    found = exact_quantiles(df, {c: quantiles for c in columns})
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(float(q)).alias("quantile"), F.lit(v).cast("double").alias("value"))
        for c in columns
        for q, v in zip(quantiles, found[c])
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))
