"""Feature jobs: business metrics, dates, codes, clinical scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, is_missing, is_numeric, quoted, row_mean, row_sum, scaled, time_of
from ..functions.grouping import SKETCH_MARGIN, dictionary, distinct_sizes, estimated_sizes, numeric_columns, sizes_of, text_columns, with_codes, with_group_value
from ..functions.roles import categorical_columns, read_dates, transform_date_columns
from .sales import ASSUMED_MARGIN, Roles

# How many distinct values a column may have to be encoded.
ENCODE_MORE_THAN, ENCODE_LESS_THAN = 1, 100
ENCODE_SHARE = 0.5


def business_metrics(df: DataFrame, roles: Roles) -> DataFrame:
    """Total_Revenue, Profit and Customer_Value (the customer's revenue sum on each row).

    Without a price, a Total_Revenue column that is there already is used.
    """
    out = df
    if "price" in roles:
        price = quoted(roles["price"])
        revenue = price * quoted(roles["quantity"]) if "quantity" in roles else price
        out = out.withColumn("Total_Revenue", revenue)
    if "Total_Revenue" in out.columns and ("price" in roles or "Profit" not in out.columns):
        out = out.withColumn("Profit", F.col("Total_Revenue") * ASSUMED_MARGIN)
    if "customer" in roles and "Total_Revenue" in out.columns:
        out = with_group_value(out, roles["customer"], Customer_Value=F.sum("Total_Revenue"))
    return out


def date_features_business(df: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """``<c>_Year`` and ``<c>_Quarter`` for each detected date column, which is converted too."""
    kinds = transform_date_columns(df) if kinds is None else kinds
    out = read_dates(df, kinds)
    return out.select(
        "*", *[f(quoted(c)).alias(f"{c}_{part}") for c in kinds for part, f in (("Year", F.year), ("Quarter", F.quarter))]
    )


def date_features_healthcare(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """``<c>_Year``, ``<c>_Month``, ``<c>_Quarter``; the date columns stay as they are."""
    parts = (("Year", F.year), ("Month", F.month), ("Quarter", F.quarter))
    return df.select(
        "*", *[f(time_of(df, c)).alias(f"{c}_{part}") for c in dates for part, f in parts]
    )


def encode_business(df: DataFrame) -> DataFrame:
    """Codes for text and low-variety numeric columns; missing text is the category ``Unknown``.

    A sketch of each column tells in one scan which may have few enough values to be encoded;
    only those columns' values are gathered, counted and sorted, all together. ``not_encoded``
    names the categorical columns that are left out.
    """
    return _encode_business(df)[0]


def not_encoded(df: DataFrame) -> list[str]:
    """The categorical columns that ``encode_business`` leaves as they are, for too many or too few values."""
    chosen, categories = _encode_business(df)[1:]
    return [c for c in categories if c not in chosen]


def _encode_business(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    texts = set(text_columns(df))
    estimates = estimated_sizes(df, [*texts, *numeric_columns(df)])[1]
    categories = categorical_columns(df, estimates)
    out = df.select(*[(F.coalesce(quoted(c), F.lit("Unknown")) if c in texts else quoted(c)).alias(c) for c in df.columns])
    near = [c for c in categories if estimates[c] < ENCODE_LESS_THAN * SKETCH_MARGIN]
    values = dictionary(out, near)
    sizes = sizes_of(values, near)
    chosen = [c for c in near if ENCODE_MORE_THAN < sizes[c] < ENCODE_LESS_THAN]
    # Texts first. A missing number is the category after all numbers.
    ordered = [c for c in chosen if c in texts] + [c for c in chosen if c not in texts]
    missing = {c: -1 if c in texts else sizes[c] for c in ordered}
    return with_codes(out, values, ordered, missing=missing), ordered, categories


def encode_healthcare(df: DataFrame) -> DataFrame:
    """Codes for text columns with more than one value and fewer than half as many values as rows."""
    texts = text_columns(df)
    rows, estimates = estimated_sizes(df, texts)
    near = [c for c in texts if estimates[c] < rows * ENCODE_SHARE * SKETCH_MARGIN]
    values = dictionary(df, near)
    sizes = sizes_of(values, near)
    return with_codes(df, values, [c for c in near if 1 < sizes[c] < rows * ENCODE_SHARE])


def _numbers(df: DataFrame, columns: Sequence[str]) -> dict:
    return {c: as_double(quoted(c), df.schema[c].dataType) for c in columns if is_numeric(df.schema[c].dataType)}


def risk_score(df: DataFrame, vitals: Sequence[str], name: str = "Patient_Risk_Score") -> DataFrame:
    """Row mean of the z-scores of numeric vitals."""
    values = _numbers(df, vitals)
    if not values:
        return df
    row = df.agg(*[f(v) for v in values.values() for f in (F.avg, F.stddev_samp)]).first()
    scores = [scaled(v, row[2 * i], row[2 * i + 1]) for i, v in enumerate(values.values())]
    return df.withColumn(name, row_mean(scores))


def _ranges(df: DataFrame, values: Mapping) -> list:
    row = df.agg(*[f(v) for v in values.values() for f in (F.min, F.max)]).first()
    out = []
    for i, value in enumerate(values.values()):
        low, high = row[2 * i], row[2 * i + 1]
        out.append(scaled(value, low, (high - low) if low is not None else None))
    return out


def treatment_scores(df: DataFrame, treatments: Sequence[str]) -> DataFrame:
    """Treatment_Effectiveness and Treatment_Outcome: row mean of min–max scaled numeric treatments."""
    values = _numbers(df, treatments)
    if not values:
        return df
    score = row_mean(_ranges(df, values))
    return df.withColumn("Treatment_Effectiveness", score).withColumn("Treatment_Outcome", score)


def healthcare_cost(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Row sum of numeric cost columns; NULL if one of them is missing."""
    values = _numbers(df, costs)
    return df.withColumn("Healthcare_Cost", row_sum(list(values.values()))) if values else df


def patient_severity(df: DataFrame, diagnoses: Sequence[str]) -> DataFrame:
    """Row mean over diagnosis columns: distinct values / 100 for text, min–max scaled numbers."""
    texts = [c for c in diagnoses if c in text_columns(df)]
    sizes = distinct_sizes(df, texts)
    factors = [F.lit(sizes[c] / 100.0) for c in texts]
    values = _numbers(df, diagnoses)
    if values:
        factors += _ranges(df, values)
    return df.withColumn("Patient_Severity", row_mean(factors)) if factors else df


def transform_healthcare(df: DataFrame, found: Mapping[str, Sequence[str]]) -> DataFrame:
    """All clinical features in turn; ``found`` maps a role to its columns."""
    out = df
    if found.get("patient") and found.get("vital"):
        out = risk_score(out, found["vital"])
    if found.get("treatment"):
        out = treatment_scores(out, found["treatment"])
    if found.get("cost"):
        out = healthcare_cost(out, found["cost"])
    if found.get("diagnosis"):
        out = patient_severity(out, found["diagnosis"])
    if found.get("date"):
        out = date_features_healthcare(out, found["date"])
    return encode_healthcare(out)


def transform_business(
    df: DataFrame, roles: Roles, add_business_metrics: bool = True, add_date_features: bool = True, encode_categoricals: bool = True
) -> DataFrame:
    """Metrics, date features and codes, each as asked for."""
    out = business_metrics(df, roles) if add_business_metrics else df
    out = date_features_business(out) if add_date_features else out
    return encode_business(out) if encode_categoricals else out


def finite_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in all floating columns."""
    infinity = F.lit(float("inf"))
    out = []
    for field in df.schema:
        value = quoted(field.name)
        if field.dataType.typeName() in ("double", "float"):
            value = F.when(~is_missing(value, field.dataType) & (F.abs(value) != infinity), value)
        out.append(value.alias(field.name))
    return df.select(*out)
