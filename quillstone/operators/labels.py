"""Features and targets of the models, as plain DataFrame jobs.

Where the data has no recorded outcome the targets are rules over age, cost, stay and how common
a condition is, with optional noise. The noise depends only on the row's keys and a seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    age_years,
    as_double,
    time_of,
    flipped,
    is_numeric,
    quoted,
    shifted,
    time_literal,
    to_number,
    whole_days,
)
from ..functions.grouping import top_per, with_group_value
from ..functions.quantiles import exact_quantiles
from ..session import stage_table
from .sales import Roles, _date_of, _double, _mean, revenue_of

# Fixed values of the target rules.
CHURN_DAYS = 90
FEW_PURCHASES = 0.3
DEFAULT_STAY = 7
READMISSION_NOISE = 0.3
OUTCOME_NOISE = 0.25
LEVEL_NOISE = 0.1
CARE_LEVELS = ("Routine", "Standard", "Intensive")


# ---- customers -----------------------------------------------------------------------------------


def churn_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Per customer: first and last purchase, counts, sums, days since, and the churn label.

    Churned: no purchase for more than 90 days, or fewer purchases than the 30 % value.
    """
    facts = df.select(
        quoted(roles["customer"]).alias("customer"),
        _date_of(df, roles).alias("date"),
        revenue_of(roles).alias("revenue"),
        (quoted(roles["quantity"]) if "quantity" in roles else F.lit(0.0)).alias("quantity"),
    ).filter(F.col("date").isNotNull() & F.col("customer").isNotNull())
    customers = stage_table(
        facts.groupBy("customer").agg(
            F.min("date").alias("first_purchase"),
            F.max("date").alias("last_purchase"),
            F.count(F.lit(1)).alias("transactions"),
            _double(F.sum("revenue")).alias("revenue"),
            _mean(F.col("revenue")).alias("mean_revenue"),
            F.sum("quantity").alias("quantity"),
        )
    )
    newest = customers.agg(F.max("last_purchase")).first()[0]
    few = exact_quantiles(customers, {"transactions": [FEW_PURCHASES]})["transactions"][0]
    days = whole_days(F.col("last_purchase"), time_literal(newest))
    churned = (F.col("days_since_last") > CHURN_DAYS) | (F.col("transactions") < F.lit(few))
    return customers.withColumn("days_since_last", days).withColumn("churn", churned.cast("int"))


def segment_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Per customer: money, frequency, quantity and recency in days; missing is 0."""
    facts = df.select(
        quoted(roles["customer"]).alias("customer"),
        (_date_of(df, roles) if "date" in roles else F.lit(None).cast("timestamp_ntz")).alias("date"),
        revenue_of(roles).alias("revenue"),
        (quoted(roles["quantity"]) if "quantity" in roles else F.lit(0.0)).alias("quantity"),
    ).filter(F.col("customer").isNotNull())
    customers = stage_table(
        facts.groupBy("customer").agg(
            _double(F.sum("revenue")).alias("monetary"),
            F.count("date").alias("frequency"),
            F.sum("quantity").alias("quantity"),
            F.max("date").alias("last"),
        )
    )
    newest = customers.agg(F.max("last")).first()[0]
    recency = whole_days(F.col("last"), time_literal(newest))
    return customers.select(
        "customer",
        F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
        "frequency",
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
        F.coalesce(recency, F.lit(0)).alias("recency"),
    )


def value_groups(features: DataFrame) -> DataFrame:
    """Sizes of five overlapping customer groups cut at quantiles of money and frequency."""
    cuts = exact_quantiles(features, {"monetary": [0.3, 0.4, 0.6, 0.8], "frequency": [0.3, 0.6, 0.7]})
    if cuts["monetary"][0] is None:
        cuts = {"monetary": [0.0] * 4, "frequency": [0.0] * 3}
    m30, m40, m60, m80 = cuts["monetary"]
    f30, f60, f70 = cuts["frequency"]
    money, often = F.col("monetary"), F.col("frequency")
    tests = {
        "High Value": (money > m80) & (often > f60),
        "Medium Value": (money > m40) & (money <= m80),
        "Low Value": money <= m40,
        "New Customers": (often <= f30) & (money > m60),
        "At Risk": (often > f70) & (money <= m30),
    }
    row = features.agg(*[F.count(F.when(t, 1)).alias(f"n{i}") for i, t in enumerate(tests.values())])
    cells = [F.struct(F.lit(k).alias("value_group"), F.col(f"n{i}").alias("customers")) for i, k in enumerate(tests)]
    return row.select(F.inline(F.array(*cells)))


# ---- patients ------------------------------------------------------------------------------------


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return as_double(quoted(column), kind) if is_numeric(kind) else to_number(quoted(column))


def age_of(df: DataFrame, roles: Mapping[str, str]) -> Column | None:
    if "age" not in roles:
        return None
    kind = df.schema[roles["age"]].dataType
    return as_double(quoted(roles["age"]), kind) if is_numeric(kind) else age_years(quoted(roles["age"]))


def cost_of(df: DataFrame, roles: Mapping[str, str]) -> Column | None:
    return _number(df, roles["cost"]) if "cost" in roles else None


def stay_of(df: DataFrame, roles: Mapping[str, str]) -> Column | None:
    if "admitted" not in roles or "discharged" not in roles:
        return None
    ends = [time_of(df, roles[r]) for r in ("admitted", "discharged")]
    return whole_days(*ends)


def _keys(roles: Mapping[str, str]) -> list[Column]:
    return [quoted(roles["id"])]


def _measures(df: DataFrame, roles: Mapping[str, str], **quantiles: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of age, cost and stay, for the roles that are there."""
    makers = {"age": age_of, "cost": cost_of, "stay": stay_of}
    columns = {n: makers[n](df, roles) for n in quantiles}
    columns = {n: c for n, c in columns.items() if c is not None}
    if not columns:
        return {}
    return exact_quantiles(df.select(*[c.alias(n) for n, c in columns.items()]), {n: quantiles[n] for n in columns})


def _with_condition_count(df: DataFrame, roles: Mapping[str, str], quantile: float) -> tuple[DataFrame, float | None]:
    """How often the row's condition occurs, and a quantile of those counts over conditions."""
    condition = quoted(roles["condition"])
    counts = df.filter(condition.isNotNull()).groupBy(condition.alias("_condition")).agg(F.count(F.lit(1)).alias("_common"))
    limit = exact_quantiles(counts, {"_common": [quantile]})["_common"][0]
    joined = df.join(counts, condition == F.col("_condition"), "left").drop("_condition")
    return joined, limit


def risk_label(df: DataFrame, roles: Mapping[str, str], noise: float = 0.0, seed: int = 42, name: str = "risk_level") -> DataFrame:
    """0 low, 1 medium, 2 high: by age quartiles, high cost, and at least medium for rare conditions."""
    cuts = _measures(df, roles, age=[0.25, 0.75], cost=[0.75])
    out, level = df, F.lit(0)
    if cuts.get("age", [None])[0] is not None:
        low, high = cuts["age"]
        years = F.coalesce(age_of(df, roles), F.lit(0.0))
        level = F.when(years >= F.lit(high), 2).when(years >= F.lit(low), 1).otherwise(level)
    if cuts.get("cost", [None])[0] is not None:
        level = F.when(cost_of(df, roles) >= F.lit(cuts["cost"][0]), 2).otherwise(level)
    if "condition" in roles:
        out, limit = _with_condition_count(df, roles, 0.3)
        level = F.when(F.col("_common") < F.lit(limit), F.greatest(level, F.lit(1))).otherwise(level)
    return out.withColumn(name, shifted(level, _keys(roles), seed, noise, 0, 2).cast("int")).drop("_common")


def discharge_label(df: DataFrame, roles: Mapping[str, str], noise: float = 0.0, seed: int = 42, name: str = "care_level") -> DataFrame:
    """0 routine, 1 standard, 2 intensive: high age or cost is intensive, a common condition routine."""
    cuts = _measures(df, roles, age=[0.75], cost=[0.75])
    out, level = df, F.lit(1)
    if cuts.get("age", [None])[0] is not None:
        level = F.when(age_of(df, roles) >= F.lit(cuts["age"][0]), 2).otherwise(level)
    if cuts.get("cost", [None])[0] is not None:
        level = F.when(cost_of(df, roles) >= F.lit(cuts["cost"][0]), 2).otherwise(level)
    if "condition" in roles:
        out, limit = _with_condition_count(df, roles, 0.5)
        level = F.when(F.col("_common") >= F.lit(limit), 0).otherwise(level)
    return out.withColumn(name, shifted(level, _keys(roles), seed, noise, 0, 2).cast("int")).drop("_common")


def outcome_label(df: DataFrame, roles: Mapping[str, str], noise: float = 0.0, seed: int = 42, name: str = "outcome") -> DataFrame:
    """1 success; 0 for the longest quarter of stays or a cost above 1.5 times the condition's mean."""
    cuts = _measures(df, roles, stay=[0.75])
    out, label = df, F.lit(1)
    if cuts.get("stay", [None])[0] is not None:
        label = F.when(stay_of(df, roles) >= F.lit(cuts["stay"][0]), 0).otherwise(label)
    if "cost" in roles and "condition" in roles:
        money = quoted(roles["cost"]) if is_numeric(df.schema[roles["cost"]].dataType) else to_number(quoted(roles["cost"]))
        out = with_group_value(df, roles["condition"], _mean_cost=_mean(money))
        label = F.when(cost_of(df, roles) > F.col("_mean_cost") * 1.5, 0).otherwise(label)
    return out.withColumn(name, flipped(label, _keys(roles), seed, noise).cast("int")).drop("_mean_cost")


def readmission_label(
    df: DataFrame, roles: Mapping[str, str], noise: float = READMISSION_NOISE, seed: int = 42, name: str = "readmission"
) -> DataFrame:
    """1 for patients with more than one admission; without names, for older patients and rare conditions."""
    if "patient" in roles and "admitted" in roles:
        out = with_group_value(df, roles["patient"], _admissions=F.count(quoted(roles["admitted"])))
        base = F.when(F.col("_admissions") > 1, 1).otherwise(0)
        noisy = out.withColumn(name, flipped(base, _keys(roles), seed, noise).cast("int"))
        kinds = noisy.agg(F.min(name), F.max(name)).first()
        if kinds[0] == kinds[1] and noise > 0:
            middle = exact_quantiles(out, {"_admissions": [0.5]})["_admissions"][0]
            base = F.when(F.col("_admissions") > F.lit(middle), 1).otherwise(0)
            noisy = out.withColumn(name, flipped(base, _keys(roles), seed, noise).cast("int"))
        return noisy.drop("_admissions")
    out, base = df, F.lit(0)
    cuts = _measures(df, roles, age=[0.5])
    if cuts.get("age", [None])[0] is not None and "condition" in roles:
        out, limit = _with_condition_count(df, roles, 0.3)
        older = F.coalesce(age_of(df, roles), F.lit(0.0)) > F.lit(cuts["age"][0])
        base = F.when(older | (F.col("_common") < F.lit(limit)), 1).otherwise(0)
    return out.withColumn(name, flipped(base, _keys(roles), seed, min(noise, 0.25)).cast("int")).drop("_common")


def los_label(df: DataFrame, roles: Mapping[str, str], name: str = "stay_days") -> DataFrame:
    """Length of stay in days, 7 where it is unknown."""
    stay = stay_of(df, roles)
    if stay is None:
        return df.withColumn(name, F.lit(float(DEFAULT_STAY)))
    return df.withColumn(name, F.coalesce(stay, F.lit(DEFAULT_STAY)).cast("double"))


def without_outliers(df: DataFrame, column: str, times: float = 3.0) -> DataFrame:
    """Rows within ``times`` deviations of the mean."""
    mean, std = df.agg(F.avg(quoted(column)), F.stddev_samp(quoted(column))).first()
    if not std:
        return df
    return df.filter((quoted(column) >= F.lit(mean - times * std)) & (quoted(column) <= F.lit(mean + times * std)))


def meds_by_condition(df: DataFrame, condition: str, medicine: str, k: int = 3, more_than: int = 5) -> DataFrame:
    """The k most frequent medicines of each condition that has more than five rows."""
    held = df.filter(quoted(condition).isNotNull())
    pairs = held.groupBy(quoted(condition).alias("condition"), quoted(medicine).alias("medicine")).agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("condition").agg(F.sum("n").alias("_rows")).filter(F.col("_rows") > more_than)
    ranked = top_per(pairs.filter(F.col("medicine").isNotNull()), ["condition"], [F.desc("n"), F.asc("medicine")], k)
    return ranked.join(sizes, "condition").select("condition", "rank", "medicine", "n")
