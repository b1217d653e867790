"""Profiling and data-quality jobs over any table.

Every statistic that merges is computed for all columns together: one scan, one small row per
partition. Means and quantiles come first, as plain numbers, because moments are taken around
the mean and outlier fences around the quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, clip, is_missing, quoted, time_of
from ..functions.grouping import numeric_columns, text_columns, top_per, value_counts
from ..functions.ordering import rolling_std, row_index
from ..functions.quantiles import exact_quantiles
from ..session import scratch

MERGED = 32  # tasks' sums that one task adds up


def _number(df: DataFrame, name: str) -> Column:
    return as_double(quoted(name), df.schema[name].dataType)


def _tall(row: DataFrame, names: Sequence[str], fields: Mapping[str, str | Column], label: str = "column") -> DataFrame:
    """One wide row to one row per name. ``fields`` maps an output field to a column prefix."""
    cells = []
    for i, name in enumerate(names):
        values = [F.lit(name).alias(label)]
        for field, source in fields.items():
            values.append((F.col(f"{source}{i}") if isinstance(source, str) else source).alias(field))
        cells.append(F.struct(*values))
    return row.select(F.inline(F.array(*cells)))


def _rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``m0``, ``m1``, … missing cells per column."""
    counts = [
        F.count(F.when(is_missing(quoted(f.name), f.dataType), 1)).alias(f"m{i}") for i, f in enumerate(df.schema)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def _all_missing(df: DataFrame) -> Column:
    total = F.lit(0).cast("long")
    for i in range(len(df.columns)):
        total = total + F.col(f"m{i}")
    return total


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``duplicates``, the rows that repeat an earlier one. Copies combine before the shuffle."""
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _quality_row(df: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicates in one row, from two aggregates."""
    zero = F.lit(None).cast("long")
    left = missing_counts(df).select("rows", _all_missing(df).alias("missing"), zero.alias("duplicates"))
    right = duplicate_rows(df).select(zero.alias("rows"), zero.alias("missing"), "duplicates")
    both = left.unionByName(right).agg(*[F.max(c).alias(c) for c in ("rows", "missing", "duplicates")])
    cells = F.col("rows") * len(df.columns)
    return both.select(
        "*",
        cells.alias("cells"),
        F.coalesce(F.try_divide("missing", cells), F.lit(0.0)).alias("missing_share"),
        F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)).alias("duplicate_share"),
    )


def quality_business(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicates and a score of 100 minus both percentages."""
    score = F.greatest(F.lit(0.0), 100 - F.col("missing_share") * 100 - F.col("duplicate_share") * 100)
    return _quality_row(df).select(
        F.col("rows").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.col("missing").alias("missing_values"),
        F.col("duplicates").alias("duplicate_rows"),
        F.round(score, 2).alias("quality_score"),
    )


def quality_healthcare(df: DataFrame, found: Mapping[str, Sequence[str]]) -> DataFrame:
    """Business quality plus the number of columns per clinical role and penalties for gaps."""
    missing, duplicate = F.col("missing_share") * 100, F.col("duplicate_share") * 100
    fixed = (15 if not found.get("patient") else 0) + (10 if not found.get("vital") and not found.get("lab") else 0)
    penalty = F.when(missing > 20, 10).otherwise(0) + F.when(duplicate > 10, 5).otherwise(0) + fixed
    score = F.greatest(F.lit(0.0), 100 - missing - duplicate - penalty)
    roles = ("date", "patient", "vital", "lab", "diagnosis", "treatment", "cost")
    return _quality_row(df).select(
        F.col("rows").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.col("missing").alias("missing_values"),
        F.round(missing, 2).alias("missing_percentage"),
        F.col("duplicates").alias("duplicate_rows"),
        F.round(duplicate, 2).alias("duplicate_percentage"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("long").alias("text_columns"),
        *[F.lit(len(found.get(r, ()))).cast("long").alias(f"{r}_columns") for r in roles],
        F.round(score, 2).alias("quality_score"),
    )


def data_quality(df: DataFrame) -> DataFrame:
    """Completeness in per cent, missing and total cells, duplicates."""
    complete = F.coalesce(F.try_divide(F.col("cells") - F.col("missing"), F.col("cells")) * 100, F.lit(0.0))
    return _quality_row(df).select(
        F.round(complete, 2).alias("completeness"),
        F.col("missing").alias("missing_values"),
        F.col("cells").alias("total_cells"),
        F.col("duplicates").alias("duplicate_rows"),
        F.round(complete, 2).alias("data_quality_score"),
    )


def completeness(df: DataFrame) -> float:
    """Share of filled cells in per cent, rounded to 2 decimals."""
    row = missing_counts(df).first()
    cells = row[0] * len(df.columns)
    return round((cells - sum(row[1:])) / cells * 100, 2) if cells else 0.0


# ---- numeric columns -------------------------------------------------------------------------



def _moments(n: Column, sums: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Second to fourth central moment sums from power sums of values shifted near their mean."""
    s1, s2, s3, s4 = sums
    d = F.try_divide(s1, n)
    second = F.greatest(F.lit(0.0), s2 - n * d * d)
    third = s3 - 3 * d * s2 + 2 * n * d * d * d
    fourth = s4 - 4 * d * s3 + 6 * d * d * s2 - 3 * n * d * d * d * d
    return second, third, fourth


def numeric_summary(
    df: DataFrame, names: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75), outliers: bool = False
) -> DataFrame:
    """One row per column: count, mean, deviation, extremes, quantiles, moments, missing, outliers.

    Moments are sums of powers of values shifted by the mean, which a first scan finds. Both scans and
    the search of the quantiles take all columns together.
    """
    plain = df.select(*[_number(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    size = len(names)

    def first(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.full(size, len(rows)), (~np.isnan(rows)).sum(axis=0), np.nansum(rows, axis=0)])

    counts = _added_up(plain, (3, size), first) if names else np.zeros((3, 0))
    rows, sizes = int(counts[0].max(initial=0)), [int(n) for n in counts[1]]
    means = [float(total / n) if n else None for total, n in zip(counts[2], counts[1])]
    # The extremes are the first and the last quantile.
    ranked = exact_quantiles(df, {n: (0.0, *quantiles, 1.0) for n in names}, sizes=sizes)
    found = {n: values[1:-1] for n, values in ranked.items()}
    fences = np.full((2, size), np.nan)
    for i, name in enumerate(names):
        if outliers and found[name][0] is not None:
            fence = 1.5 * (found[name][2] - found[name][0])
            fences[:, i] = found[name][0] - fence, found[name][2] + fence
    center = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])

    def powers(rows: np.ndarray) -> np.ndarray:
        moved = np.where(np.isnan(rows), 0.0, rows - center)
        square = moved * moved
        beyond = (rows < fences[0]) | (rows > fences[1])
        return np.stack([v.sum(axis=0) for v in (moved, square, square * moved, square * square, beyond)])

    sums = _added_up(plain, (5, size), powers) if names else np.zeros((5, 0))
    fields = ["n", "lo", "hi", "s1", "s2", "s3", "s4", "out"]
    known = []
    for i, name in enumerate(names):
        moments = [float(v) for v in sums[:4, i]] if sizes[i] else [None] * 4
        known.append((name, means[i], sizes[i], ranked[name][0], ranked[name][-1], *moments, int(sums[4, i]), *found[name], rows))
    labels = [f"q{int(round(q * 100))}" for q in quantiles]
    kinds = {"n": "long", "out": "long"}
    schema = ["column string", "mean double", *[f"{f} {kinds.get(f, 'double')}" for f in fields], *[f"{q} double" for q in labels]]
    # One short row per column; all of it is already known here.
    tall = df.sparkSession.createDataFrame(known, ", ".join([*schema, "rows long"]))
    n = F.col("n").cast("double")
    second, third, fourth = _moments(n, [F.col(f"s{k}") for k in (1, 2, 3, 4)])
    spread = F.when(second > 0, second)
    variance = F.when(n > 1, second / (n - 1))
    return tall.select(
        "column",
        "n",
        "mean",
        F.sqrt(variance).alias("std"),
        "lo",
        "hi",
        variance.alias("var"),
        (F.sqrt(n) * third / F.pow(spread, F.lit(1.5))).alias("skew"),
        (n * fourth / (spread * spread) - 3).alias("kurt"),
        F.col("out").alias("outliers"),
        "rows",
        *labels,
        (F.col("rows") - F.col("n")).alias("missing"),
    )


def profile_file(df: DataFrame) -> DataFrame:
    """Per column: type, missing cells and, for numbers, count, mean, deviation, extremes, quartiles."""
    numbers = numeric_columns(df)
    row = missing_counts(df)
    base = _tall(
        row,
        df.columns,
        {"missing": "m", "total_rows": F.col("rows"), "total_columns": F.lit(len(df.columns)).cast("long")},
    )
    types = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    base = base.withColumn("data_type", types[F.col("column")])
    fields = ("n", "mean", "std", "lo", "q25", "q50", "q75", "hi")
    if not numbers:
        return base.select("*", *[F.lit(None).cast("double").alias(f) for f in fields])
    stats = numeric_summary(df, numbers).select("column", *fields)
    # Both sides have one row per column of the table.
    joined = base.join(F.broadcast(stats), "column", "left")
    return _rounded(joined, [f for f in fields if f != "n"])


def eda_overview(df: DataFrame, shown: int | None = None) -> DataFrame:
    """Shape, columns per type, missing cells (columns that have any), column names (the first ``shown``)."""
    kinds: dict[str, int] = {}
    for field in df.schema:
        kinds[field.dataType.simpleString()] = kinds.get(field.dataType.simpleString(), 0) + 1
    known = [("shape", "total_columns", len(df.columns))]
    known += [("type", kind, n) for kind, n in sorted(kinds.items())]
    known += [("count", "numeric_columns", len(numeric_columns(df))), ("count", "categorical_columns", len(text_columns(df)))]
    known += [("name", name, i + 1) for i, name in enumerate(df.columns[:shown])]
    cells = [_cell(s, k, F.lit(v).cast("long")) for s, k, v in known]
    cells.append(_cell("shape", "total_rows", F.col("rows")))
    cells += [_cell("missing", name, F.col(f"m{i}")) for i, name in enumerate(df.columns)]
    tall = missing_counts(df).select(F.inline(F.array(*cells)))
    return tall.filter((F.col("section") != "missing") | (F.col("value") > 0))


def _cell(section: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.alias("value"))


def eda_missing(df: DataFrame) -> DataFrame:
    """Per column: missing and filled cells, percentage, type."""
    tall = _tall(missing_counts(df), df.columns, {"missing": "m", "total": F.col("rows")})
    types = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return tall.select(
        "column",
        "missing",
        F.round(F.try_divide("missing", "total") * 100, 2).alias("missing_percentage"),
        types[F.col("column")].alias("data_type"),
        "total",
        (F.col("total") - F.col("missing")).alias("filled"),
    )


def eda_missing_total(df: DataFrame) -> DataFrame:
    row = missing_counts(df)
    total = _all_missing(df)
    touched = F.lit(0).cast("long")
    for i in range(len(df.columns)):
        touched = touched + F.when(F.col(f"m{i}") > 0, 1).otherwise(0)
    return row.select(
        F.col("rows").alias("total_rows"),
        total.alias("total_missing"),
        touched.alias("columns_with_missing"),
        F.round(F.try_divide(total, F.col("rows") * len(df.columns)) * 100, 2).alias("missing_percentage"),
    )


def eda_distribution(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mean, median, deviation, extremes, population skewness and kurtosis of numeric columns."""
    stats = numeric_summary(df, numeric_columns(df)[:limit], (0.5,)).filter(F.col("n") > 0)
    out = stats.select(
        "column",
        "mean",
        F.col("q50").alias("median"),
        "std",
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        F.col("skew").alias("skewness"),
        F.col("kurt").alias("kurtosis"),
        F.col("n").alias("count"),
    )
    return _rounded(out, ["mean", "median", "std", "min", "max", "skewness", "kurtosis"])


def eda_box(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Quartiles, extremes and values beyond 1.5 interquartile ranges."""
    stats = numeric_summary(df, numeric_columns(df)[:limit], outliers=True).filter(F.col("n") > 0)
    out = stats.select(
        "column",
        F.col("q25").alias("q1"),
        F.col("q50").alias("median"),
        F.col("q75").alias("q3"),
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        (F.col("q75") - F.col("q25")).alias("iqr"),
        "outliers",
        F.round(F.try_divide("outliers", "n") * 100, 2).alias("outlier_percentage"),
    )
    return _rounded(out, ["q1", "median", "q3", "min", "max", "iqr"])


def statistical_summary(df: DataFrame) -> DataFrame:
    """All numeric columns with variance, variation, bias-adjusted skewness and kurtosis, outliers."""
    stats = numeric_summary(df, numeric_columns(df), outliers=True).filter(F.col("n") > 0)
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6))
    out = stats.select(
        "column",
        F.col("n").alias("count"),
        "mean",
        "std",
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        F.col("q50").alias("median"),
        "q25",
        "q75",
        (F.col("q75") - F.col("q25")).alias("iqr"),
        (F.col("hi") - F.col("lo")).alias("range"),
        F.col("var").alias("variance"),
        F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)).alias("variation"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
        "missing",
        F.round(F.try_divide("missing", "rows") * 100, 4).alias("missing_percentage"),
        "outliers",
    )
    # The variance has the square of the unit, so it is rounded to fewer digits.
    fine = ["mean", "std", "min", "max", "median", "q25", "q75", "iqr", "range", "variation", "skewness", "kurtosis"]
    return _rounded(_rounded(out, fine), ["variance"], 2)


def statistical_totals(df: DataFrame) -> DataFrame:
    """Records, columns by kind, missing cells, duplicates, columns per type."""
    kinds: dict[str, int] = {}
    for field in df.schema:
        kinds[field.dataType.simpleString()] = kinds.get(field.dataType.simpleString(), 0) + 1
    cells = [
        _cell("total", "records", F.col("rows")),
        _cell("total", "columns", F.lit(len(df.columns)).cast("long")),
        _cell("total", "numeric_columns", F.lit(len(numeric_columns(df))).cast("long")),
        _cell("total", "categorical_columns", F.lit(len(text_columns(df))).cast("long")),
        _cell("total", "missing_values", F.col("missing")),
        _cell("total", "duplicate_rows", F.col("duplicates")),
        *[_cell("type", kind, F.lit(n).cast("long")) for kind, n in sorted(kinds.items())],
    ]
    return _quality_row(df).select(F.inline(F.array(*cells)))


# ---- text columns ----------------------------------------------------------------------------


def _categories(df: DataFrame, names: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Per column totals and the k most frequent values, from one frequency table."""
    counts = value_counts(df, names)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"))
    top = top_per(counts, ["column"], [F.desc("n"), F.asc("value")], k)
    return totals, top


def eda_categorical(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Per text column: distinct values, filled cells, the most frequent value."""
    totals, top = _categories(df, text_columns(df)[:limit], 1)
    best = top.select("column", F.col("value").alias("most_frequent"), F.col("n").alias("most_frequent_count"))
    # One row per text column on both sides.
    return totals.join(F.broadcast(best), "column").select(
        "column",
        "distinct_values",
        "total",
        "most_frequent",
        "most_frequent_count",
        F.round(F.col("most_frequent_count") / F.col("total") * 100, 2).alias("most_frequent_percentage"),
    )


def eda_categorical_top(df: DataFrame, limit: int | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of each text column."""
    counts = value_counts(df, text_columns(df)[:limit])
    return top_per(counts, ["column"], [F.desc("n"), F.asc("value")], k).select("column", "rank", "value", "n")


# ---- pairs of columns ------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A column of numbers each, NaN for NULL."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)


def _added_up(plain: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` over all batches of rows; one scan, whatever the number of columns.

    A task adds up its own batches, and tasks' sums are added up ``MERGED`` at a time until one is left.
    """

    def own(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    def merged(batches):
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    with scratch(plain.sparkSession) as table:
        sums = table(plain.mapInArrow(own, "sums binary"))
        n = sums.count()
        while n > MERGED:
            n = -(-n // MERGED)
            sums = table(sums.repartition(n).mapInArrow(merged, "sums binary"))
        parts = [np.frombuffer(r["sums"]).reshape(shape) for r in sums.collect()]  # MERGED at most
    return np.sum(parts, axis=0) if parts else np.zeros(shape)


def pair_statistics(df: DataFrame, pairs: Sequence[tuple[str, str]], full: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlation; with ``full`` also counts, means and deviations.

    Two scans for any number of columns: one for their means, and one that adds up products of values
    shifted by them, as products of matrices. With a gap anywhere, products with the matrix of what is
    there give the same sums over each pair's complete rows.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {n: i for i, n in enumerate(names)}
    plain = df.select(*[_number(df, n).alias(f"v{i}") for i, n in enumerate(names)])

    def first(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.full(rows.shape[1], len(rows)), (~np.isnan(rows)).sum(axis=0), np.nansum(rows, axis=0)])

    size = len(names)
    counts = _added_up(plain, (3, size), first) if names else np.zeros((3, 0))
    rows, there = int(counts[0].max(initial=0)), counts[1]
    center = np.divide(counts[2], there, out=np.zeros(size), where=there > 0)
    center[~np.isfinite(center)] = 0
    complete = bool((there == rows).all())

    def products(rows: np.ndarray) -> np.ndarray:
        held = ~np.isnan(rows)
        moved = np.where(held, rows - center, 0.0)
        if complete:
            return np.stack([moved.T @ moved, np.diag(moved.sum(axis=0))])
        mask = held.astype(np.float64)
        return np.stack([moved.T @ moved, moved.T @ mask, (moved * moved).T @ mask, mask.T @ mask])

    sums = _added_up(plain, (2 if complete else 4, size, size), products) if names else np.zeros((2, 0, 0))
    if complete:
        sums = np.stack([sums[0], np.repeat(np.diag(sums[1])[:, None], size, 1), np.repeat(np.diag(sums[0])[:, None], size, 1), np.full((size, size), rows)])
    known = []
    for x, y in pairs:
        a, b = place[x], place[y]
        n, sx, sy, sxx, syy, sxy = (float(v) for v in (sums[3, a, b], sums[1, a, b], sums[1, b, a], sums[2, a, b], sums[2, b, a], sums[0, a, b]))
        # The mean over all of a column's rows is known already.
        mx, my = (float(center[i]) + (s / n if n < there[i] else 0.0) for i, s in ((a, sx), (b, sy))) if n else (None, None)
        known.append((x, y, int(n), mx, my, *((sx, sy, sxx, syy, sxy) if n else (None,) * 5)))
    schema = "x string, y string, points long, x_mean double, y_mean double, sx double, sy double, sxx double, syy double, sxy double"
    # One short row per pair; all of it is already known here.
    tall = df.sparkSession.createDataFrame(known, schema)
    n = F.col("points").cast("double")
    dx, dy = F.try_divide(F.col("sx"), n), F.try_divide(F.col("sy"), n)
    vx, vy = F.col("sxx") - n * dx * dx, F.col("syy") - n * dy * dy
    r = F.when((vx > 0) & (vy > 0), (F.col("sxy") - n * dx * dy) / (F.sqrt(vx) * F.sqrt(vy)))
    out = ["x", "y", clip(r, -1.0, 1.0).alias("correlation")]
    if full:
        out += ["points", "x_mean", "y_mean"]
        out += [F.sqrt(F.try_divide(v, n - 1)).alias(f"{k}_std") for k, v in (("x", vx), ("y", vy))]
    return tall.select(*out)


def eda_correlation(df: DataFrame) -> DataFrame:
    """Full correlation matrix in long form; pairs above 0.7 are labelled once, in column order."""
    names = numeric_columns(df)
    pairs = list(combinations(names, 2)) + [(n, n) for n in names]
    upper = pair_statistics(df, pairs)
    same, value = F.col("x") == F.col("y"), F.col("correlation")
    strength = F.when(~same & (F.abs(value) > 0.8), "strong").when(~same & (F.abs(value) > 0.7), "moderate")
    labelled = upper.withColumn("strength", strength)
    mirrored = upper.filter(~same).select(
        F.col("y").alias("x"), F.col("x").alias("y"), "correlation", F.lit(None).cast("string").alias("strength")
    )
    return _rounded(labelled.unionByName(mirrored), ["correlation"])


def eda_scatter(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Correlation, r², means and deviations for pairs of numeric columns (more than 10 points); ``limit`` takes the first columns only."""
    pairs = list(combinations(numeric_columns(df)[:limit], 2))
    stats = pair_statistics(df, pairs, full=True).filter((F.col("points") > 10) & F.col("correlation").isNotNull())
    out = stats.withColumn("r_squared", F.col("correlation") * F.col("correlation"))
    return _rounded(out, ["correlation", "r_squared", "x_mean", "y_mean", "x_std", "y_std"])


def correlation_bands(df: DataFrame) -> DataFrame:
    """All pairs with strength (0.7, 0.5) and direction."""
    pairs = pair_statistics(df, list(combinations(numeric_columns(df), 2)))
    size = F.abs("correlation")
    return pairs.select(
        "x",
        "y",
        F.round("correlation", 4).alias("correlation"),
        F.round(size, 4).alias("abs_correlation"),
        F.when(size > 0.7, "strong").when(size > 0.5, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
    )


def correlation_summary(df: DataFrame) -> DataFrame:
    pairs = pair_statistics(df, list(combinations(numeric_columns(df), 2)))
    size = F.abs("correlation")
    row = pairs.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count(F.when(size > 0.7, 1)).alias("strong_count"),
        F.count(F.when((size > 0.5) & (size <= 0.7), 1)).alias("moderate_count"),
        F.count(F.when(size <= 0.5, 1)).alias("weak_count"),
        F.avg("correlation").alias("average_correlation"),
        F.max("correlation").alias("max_correlation"),
        F.min("correlation").alias("min_correlation"),
    )
    return _rounded(row, ["average_correlation", "max_correlation", "min_correlation"])


# ---- time ------------------------------------------------------------------------------------


def eda_timeseries(
    df: DataFrame, dates: Sequence[str], numbers: Sequence[str], ties: Sequence[str] = (), unique: bool = False
) -> DataFrame:
    """Trend of each (date, number) pair against its row position in date order.

    All series are stacked and sorted once; the position inside a series is the global
    position minus the position of the series' first row. ``ties`` order rows of equal date.
    """
    cells = []
    for date in dates:
        moment = time_of(df, date)
        for number in numbers:
            cells.append(
                F.struct(
                    F.lit(f"{date} - {number}").alias("series"), moment.alias("moment"), _number(df, number).alias("value")
                )
            )
    stacked = df.select(F.inline(F.array(*cells)), *[quoted(t).alias(f"_tie{i}") for i, t in enumerate(ties)])
    stacked = stacked.filter(F.col("moment").isNotNull() & F.col("value").isNotNull())
    order = ["series", "moment", *[f"_tie{i}" for i in range(len(ties))]]
    placed = row_index(stacked, order, "place", unique=unique).select("series", "moment", "value", "place")
    firsts = placed.groupBy("series").agg(F.min("place").alias("_first"))
    # One row per series.
    rows = placed.join(F.broadcast(firsts), "series").withColumn("place", F.col("place") - F.col("_first")).drop("_first")
    rolled = rolling_std(rows, "value", "place", ["series"])
    x, y = F.col("place").cast("double"), F.col("value")
    stats = rolled.groupBy("series").agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r_squared"),
        F.count(F.lit(1)).alias("points"),
        F.min("moment").alias("start"),
        F.max("moment").alias("end"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg("rolling_std").alias("rolling"),
    )
    slope, std, mean = F.col("slope"), F.col("std"), F.col("mean")
    seasonal = F.when(F.col("points") <= 12, "insufficient_data").when(F.col("rolling") > std * 0.1, "detected")
    out = stats.filter(F.col("points") > 10).select(
        "series",
        F.when(slope > 0.01, "increasing").when(slope < -0.01, "decreasing").otherwise("stable").alias("trend"),
        "slope",
        "r_squared",
        "points",
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_date"),
        F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end_date"),
        "mean",
        "std",
        "min",
        "max",
        seasonal.otherwise("not_detected").alias("seasonality"),
        F.when(F.abs(slope) > 0.1, "strong").when(F.abs(slope) > 0.01, "weak").otherwise("stable").alias("strength"),
        F.when(std > mean * 0.5, "high").when(std > mean * 0.2, "medium").otherwise("low").alias("volatility"),
    )
    return _rounded(_rounded(out, ["mean", "std", "min", "max"]), ["slope", "r_squared"], 8)


def slope_p_value(r_squared: float, points: int) -> float:
    """Two-sided p-value of a regression slope, from r² and the number of points."""
    freedom = points - 2
    if freedom <= 0 or r_squared is None:
        return float("nan")
    if r_squared >= 1:
        return 0.0
    t_squared = r_squared * freedom / (1 - r_squared)
    return _beta_tail(freedom / 2.0, 0.5, freedom / (freedom + t_squared))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x >= (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * value / a


def with_p_values(trends: DataFrame) -> DataFrame:
    """Add ``p_value`` to the trend rows (a handful), computed on the driver from r² and n."""
    rows = trends.select("series", "r_squared", "points").collect()
    if not rows:
        return trends.withColumn("p_value", F.lit(None).cast("double"))
    pairs = [x for r in rows for x in (F.lit(r["series"]), F.lit(slope_p_value(r["r_squared"], r["points"])))]
    return trends.withColumn("p_value", F.create_map(*pairs)[F.col("series")])


def record_trend(df: DataFrame, date: str) -> dict[str, DataFrame]:
    """Record counts by month, year and quarter, and a one-row summary of growth and extremes."""
    moment = time_of(df, date)
    days = df.select(F.to_date(moment).alias("day")).filter(F.col("day").isNotNull())
    # Monthly counts are the only shuffle of base rows; the rest is derived from that small table.
    months = days.groupBy(F.trunc("day", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last")
    )
    monthly = months.select(
        F.date_format("month", "yyyy-MM").alias("month"), F.date_format("month", "MMM yyyy").alias("label"), "n"
    )
    yearly = months.groupBy(F.year("month").alias("year")).agg(F.sum("n").alias("n"))
    quarterly = months.groupBy(F.concat(F.lit("Q"), F.quarter("month").cast("string")).alias("quarter")).agg(
        F.sum("n").alias("n")
    )
    growth = F.when(
        F.col("first_year") < F.col("last_year"),
        F.coalesce(F.try_divide(F.col("last_n") - F.col("first_n"), F.col("first_n")) * 100, F.lit(0.0)),
    ).otherwise(F.lit(0.0))
    from_years = yearly.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min_by("n", "year").alias("first_n"),
        F.max_by("n", "year").alias("last_n"),
    ).select(growth.alias("growth"))
    early = -F.unix_date("month")
    from_months = months.agg(
        F.when(F.count(F.lit(1)) > 1, F.coalesce(F.try_divide(F.stddev_pop("n"), F.avg("n")) * 100, F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("volatility"),
        F.max_by(F.date_format("month", "MMM yyyy"), F.struct(F.col("n"), early)).alias("peak_period"),
        F.max_by(F.date_format("month", "MMM yyyy"), F.struct(-F.col("n"), early)).alias("low_period"),
        F.sum("n").alias("total_data_points"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_day"),
    )
    number = F.substring("quarter", 2, 1).cast("int")
    from_quarters = quarterly.agg(
        F.when(F.count(F.lit(1)) == 4, F.max_by("quarter", F.struct(F.col("n"), -number))).alias("peak_quarter"),
        F.when(F.count(F.lit(1)) == 4, F.max_by("quarter", F.struct(-F.col("n"), -number))).alias("low_quarter"),
    )
    summary = _one_row(from_years, from_months, from_quarters).select(
        F.round("growth", 2).alias("growth_rate"),
        F.when(F.col("growth") > 5, "strongly_increasing")
        .when(F.col("growth") > 0, "increasing")
        .when(F.col("growth") < -5, "strongly_decreasing")
        .when(F.col("growth") < 0, "decreasing")
        .otherwise("stable")
        .alias("trend_direction"),
        F.round("volatility", 2).alias("volatility"),
        "peak_period",
        "low_period",
        "total_data_points",
        "first_day",
        "last_day",
        "peak_quarter",
        "low_quarter",
    )
    return {"month": monthly, "year": yearly, "quarter": quarterly, "summary": summary}


def _one_row(*rows: DataFrame) -> DataFrame:
    """Put one-row results side by side."""
    names = [f for r in rows for f in r.schema]
    stacked = None
    for r in rows:
        wide = r.select(*[F.col(f.name) if f.name in r.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names])
        stacked = wide if stacked is None else stacked.unionByName(wide)
    return stacked.agg(*[F.max(f.name).alias(f.name) for f in names])
