"""Clinical jobs: patients, vitals and labs, diagnoses, medicines, costs, trends.

Column lists and roles are arguments; ``functions.roles`` can propose them. Reports that
fall back from one grouping to the next look at a handful of top rows to choose.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    as_double,
    time_of,
    is_numeric,
    quoted,
    split_medicines,
    strip,
    to_number,
    unique_ignoring_case,
    whole_days,
)
from ..functions.grouping import distinct_sizes, long_values, numeric_columns, text_columns
from ..functions.quantiles import exact_quantiles
from ..functions.roles import clinical_columns
from ..session import stage_table
from . import models, profile
from .tables import counted, equal_width_histogram

# Age bands as (label, first age, first age beyond).
AGE_BANDS = (("0-18", 0, 19), ("19-35", 19, 36), ("36-50", 36, 51), ("51-65", 51, 66), ("65+", 66, 121))
CHRONIC = "(?i)chronic|diabetes|hypertension|heart"
# Words that class a text reading as normal, abnormal or critical.
VITAL_NORMAL = ("normal", "a+", "a-", "b+", "b-", "ab+", "ab-", "o+", "o-", "stable", "within range", "acceptable", "ok", "good")
VITAL_ABNORMAL = ("abnormal", "high", "low", "elevated", "decreased", "inconclusive", "borderline", "slightly", "mild", "moderate")
VITAL_CRITICAL = ("critical", "severe", "dangerous", "alarm", "alert", "emergency", "urgent", "life threatening", "extreme")
LAB_NORMAL = ("normal", "within range", "acceptable", "ok", "good")
LAB_ABNORMAL = ("abnormal", "high", "low", "elevated", "decreased", "inconclusive", "borderline")
LAB_CRITICAL = ("critical", "severe", "dangerous", "alarm", "alert", "emergency", "urgent")
# Words that class an outcome text.
OUTCOMES = (
    ("excellent", "excellent|good|recovered|healed|success"),
    ("good", "stable|improved|better"),
    ("fair", "fair|moderate|partial"),
    ("poor", "poor|bad|worse|critical|failed"),
)
# Treatment names by a part of the column name.
TREATMENT_NAMES = (("medic", "Medication"), ("surg", "Surgery"), ("ther", "Therapy"), ("rehab", "Rehabilitation"))
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return as_double(quoted(column), kind) if is_numeric(kind) else to_number(quoted(column))


def _title(column: str) -> str:
    return column.replace("_", " ").title()


def _rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short result that is already known."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def _metric_rows(row: DataFrame, values: Mapping[str, Column], name: str = "metric") -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias(name), v.alias("value")) for k, v in values.items()])))


# ---- patients ----------------------------------------------------------------------------------


def demographics(df: DataFrame, age: str | None = None) -> DataFrame:
    """Patients per age band; without an age column, five equal steps of the first number."""
    labels = [b[0] for b in AGE_BANDS]
    if age is None:
        numbers = numeric_columns(df)
        if not numbers:
            return _rows(df, [(label, df.count() // 5) for label in labels], "age_group string, n long")
        steps = equal_width_histogram(df, numbers[0], 5, compat=True)
        return steps.select(F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("bin")).alias("age_group"), "n")
    value = _number(df, age)
    row = df.agg(*[F.count(F.when((value >= low) & (value < high), 1)).alias(f"n{i}") for i, (_, low, high) in enumerate(AGE_BANDS)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("age_group"), F.col(f"n{i}").alias("n")) for i, x in enumerate(labels)])))


def _spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """Count, mean and sample deviation of numeric columns."""
    if not columns:
        return {}
    row = df.agg(*[f(_number(df, c)) for c in columns for f in (F.count, F.avg, F.stddev_samp)]).first()
    return {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(columns)}


def _beyond(value: Column, mean: float, std: float, times: float) -> Column:
    return (value < F.lit(mean - times * std)) | (value > F.lit(mean + times * std))


def _outside(df: DataFrame, columns: Sequence[str], spread: Mapping, times: float) -> Column:
    """How many values of all columns lie beyond ``times`` deviations."""
    total = F.lit(0).cast("long")
    for c in columns:
        n, mean, std = spread[c]
        if n and std:
            total = total + F.count(F.when(_beyond(_number(df, c), mean, std, times), 1))
    return total


def risk_factors(
    df: DataFrame,
    age: str | None = None,
    diagnoses: Sequence[str] = (),
    medicines: Sequence[str] = (),
    labs: Sequence[str] = (),
    vitals: Sequence[str] = (),
) -> DataFrame:
    """Five factor scores from 0 to 100, whole numbers."""
    numbers = set(numeric_columns(df))
    spread = _spread(df, [c for c in dict.fromkeys([*labs, *vitals]) if c in numbers])
    rows = F.count(F.lit(1))

    def percent(part: Column, whole: Column) -> Column:
        return F.least(F.lit(100.0), F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))).cast("long")

    def summed(columns: Sequence[str], test: Callable[[str], Column]) -> Column:
        total = F.lit(0).cast("long")
        for c in columns:
            total = total + F.count(F.when(test(c), 1))
        return percent(total, rows * len(columns)) if columns else F.lit(0).cast("long")

    zero = F.lit(0).cast("long")
    if age:
        years = _number(df, age)
        aged = percent(F.count(F.when((years < 5) | (years > 65), 1)), F.count(years))
    else:
        aged = zero
    scores = {
        "Age": aged,
        "Chronic Conditions": summed(diagnoses, lambda c: quoted(c).cast("string").rlike(CHRONIC)),
        "Medication History": summed(medicines, lambda c: quoted(c).isNotNull() & (quoted(c).cast("string") != "")),
        "Lab Results": percent(_outside(df, [c for c in labs if c in spread], spread, 2), rows * len(labs)) if labs else zero,
        "Vital Signs": percent(_outside(df, [c for c in vitals if c in spread], spread, 1), rows * len(vitals)) if vitals else zero,
    }
    row = df.agg(*[v.alias(f"s{i}") for i, v in enumerate(scores.values())], rows.alias("rows"))
    cells = [F.struct(F.lit(k).alias("factor"), F.col(f"s{i}").alias("score"), F.col("rows")) for i, k in enumerate(scores)]
    return row.select(F.inline(F.array(*cells)))


def risk_sizes(factors: DataFrame) -> DataFrame:
    """Patients at high, medium and low risk from the mean factor score."""
    row = factors.agg(F.avg("score").alias("mean"), F.max("rows").alias("rows"))
    share = F.col("rows") * (F.col("mean") / 100)
    high, medium = (share * 0.3).cast("long"), (share * 0.5).cast("long")
    return row.select(
        high.alias("high_risk"), medium.alias("medium_risk"), (F.col("rows") - high - medium).alias("low_risk")
    )


def _pattern(words: Sequence[str], escape: bool = True) -> str:
    """Any of the words, as whole words; without ``escape`` the plain alternation, also inside other words."""
    if not escape:
        return "|".join(words)
    return r"(^|[^\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")($|[^\p{L}\p{N}])"


def _readings(
    df: DataFrame,
    columns: Sequence[str],
    words: tuple[Sequence[str], Sequence[str], Sequence[str]],
    times: tuple[float, float],
    lone: float,
    compat: bool,
) -> DataFrame:
    """Normal, abnormal and critical counts per column, all in one aggregate.

    ``lone`` times the mean stands in for the deviation of a single value.
    """
    numbers = [c for c in columns if c in numeric_columns(df)]
    spread = _spread(df, numbers)
    counts, kept = [], []
    for i, c in enumerate(columns):
        if c in spread:
            n, mean, std = spread[c]
            if not n:
                continue
            std = std if std is not None else mean * lone
            value = _number(df, c)
            outside = _beyond(value, mean, std, times[0])
            normal, abnormal = F.count(F.when(~outside, 1)), F.count(F.when(outside, 1))
            critical = F.count(F.when(_beyond(value, mean, std, times[1]), 1))
        else:
            text = F.lower(quoted(c).cast("string"))
            hits = [text.rlike(_pattern(w, escape=not compat)) for w in words]
            total = F.count(text)
            if compat:
                # Classes overlap, as the plain alternations do; what is left over counts as normal.
                seen = [F.count(F.when(h, 1)) for h in hits]
                rest = F.greatest(F.lit(0), total - (seen[0] + seen[1] + seen[2]))
                normal, abnormal, critical = seen[0] + rest, seen[1], seen[2]
            else:
                critical = F.count(F.when(hits[2], 1))
                abnormal = F.count(F.when(~hits[2] & hits[1], 1))
                normal = total - abnormal - critical
        counts += [normal.alias(f"n{i}"), abnormal.alias(f"a{i}"), critical.alias(f"c{i}")]
        kept.append((i, c))
    if not kept:
        return _rows(df, [], "column string, normal long, abnormal long, critical long")
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("normal"), F.col(f"a{i}").alias("abnormal"), F.col(f"c{i}").alias("critical"))
        for i, c in kept
    ]
    filled = F.col("normal") + F.col("abnormal") + F.col("critical")
    return df.agg(*counts).select(F.inline(F.array(*cells))).filter(filled > 0)


def vital_signs(df: DataFrame, vitals: Sequence[str], compat: bool = False) -> DataFrame:
    """Numbers: within and beyond one deviation, beyond two. Texts: by words.

    By default a text is in one class, critical before abnormal before normal; ``compat``
    counts the classes independently with unescaped words.
    """
    return _readings(df, vitals, (VITAL_NORMAL, VITAL_ABNORMAL, VITAL_CRITICAL), (1, 2), 0.1, compat)


def lab_results(df: DataFrame, labs: Sequence[str], compat: bool = False) -> DataFrame:
    """Numbers: within and beyond two deviations, beyond three. Texts: by words."""
    return _readings(df, labs, (LAB_NORMAL, LAB_ABNORMAL, LAB_CRITICAL), (2, 3), 0.0, compat)


def outcomes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Outcome texts in four classes over all columns and the share of the two good ones.

    If no text fits any class, complete and incomplete rows stand in.
    """
    counts = []
    for name, words in OUTCOMES:
        total = F.lit(0).cast("long")
        for c in columns:
            total = total + F.count(F.when(F.lower(quoted(c).cast("string")).rlike(words), 1))
        counts.append(total.alias(name))
    whole = F.lit(True)
    for field in df.schema:
        whole = whole & quoted(field.name).isNotNull()
    row = df.agg(*counts, F.count(F.lit(1)).alias("rows"), F.count(F.when(whole, 1)).alias("whole"))
    none = F.col("excellent") + F.col("good") + F.col("fair") + F.col("poor") == 0
    stand_in = {
        "excellent": F.floor(F.col("whole") / 2).cast("long"),
        "good": F.floor(F.col("whole") / 4).cast("long"),
        "fair": F.col("rows") - F.col("whole"),
        "poor": F.lit(0).cast("long"),
    }
    found = row.select(*[F.when(none, v).otherwise(F.col(k)).alias(k) for k, v in stand_in.items()])
    everything = F.col("excellent") + F.col("good") + F.col("fair") + F.col("poor")
    return found.withColumn(
        "success_rate", (F.try_divide(F.col("excellent") + F.col("good"), everything) * 100).cast("long")
    )


def risk_segments(
    df: DataFrame, age: str | None = None, severity: str | None = None, conditions: Sequence[str] = ()
) -> DataFrame:
    """Low, medium and high risk by age (30, 60), else by the three lowest severity levels, else by fixed shares."""
    schema = "low_risk long, medium_risk long, high_risk long, total_patients long"
    rows = df.count()
    counts = (0, 0, 0)
    if age:
        years = _number(df, age)
        counts = tuple(
            df.agg(
                F.count(F.when((years >= 0) & (years <= 30), 1)),
                F.count(F.when((years > 30) & (years <= 60), 1)),
                F.count(F.when(years > 60, 1)),
            ).first()
        )
    elif severity:
        # The levels in order, in three bands of as many levels; fewer than three levels are split evenly.
        ordered = counted(df, severity).withColumn("_band", F.ntile(3).over(Window.orderBy("value")))
        bands = ordered.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.when(F.col("_band") == b, F.col("n"))), F.lit(0)) for b in (1, 2, 3)]).first()
        counts = tuple(bands[1:])
        if bands[0] < 3:
            total = sum(counts)
            counts = (total // 3, total // 3, total - 2 * (total // 3))
    elif conditions:
        counts = (int(rows * 0.4), int(rows * 0.4), rows - 2 * int(rows * 0.4))
    if not any(counts):
        counts = (int(rows * 0.5), int(rows * 0.35), rows - int(rows * 0.5) - int(rows * 0.35))
    return _rows(df, [(*counts, rows)], schema)


# ---- diagnoses, treatments, medicines ------------------------------------------------------------


def _pooled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed values of several columns with their counts."""
    values = long_values(df, columns).select(strip(F.col("value")).alias("value"))
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def diagnosis_patterns(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The most frequent diagnoses over all diagnosis columns."""
    return _pooled(df, columns).orderBy(F.desc("n"), "value").limit(k)


def diagnosis_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = _pooled(df, columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_diagnoses"))
    variety = F.col("distinct_diagnoses") / F.greatest(F.col("total"), F.lit(1))
    score = F.least(F.lit(100), ((1 - variety) * 100 + 80).cast("long")).cast("long")
    return row.select("total", "distinct_diagnoses", F.when(F.col("total") > 0, score).otherwise(0).alias("accuracy_rate"))


def treatment_effectiveness(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Score per treatment column from how many rows are filled and how varied the values are."""
    chosen = list(columns)[:limit]
    texts = [c for c in chosen if c in text_columns(df)]
    sizes = distinct_sizes(df, texts)
    measured = []
    for i, c in enumerate(chosen):
        measured.append(F.count(quoted(c)).alias(f"filled{i}"))
        measured.append(F.count(F.when(strip(quoted(c).cast("string")) != "", 1)).alias(f"used{i}"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *measured)
    cells = []
    for i, c in enumerate(chosen):
        name = next((v for k, v in TREATMENT_NAMES if k in c.lower()), _title(c))
        complete = F.try_divide(F.col(f"used{i}"), F.col("rows")) * 100
        if c in texts:
            raw = (60 + complete * 0.3 + min(1.0, sizes[c] / 50) * 10).cast("long")
            score = F.least(F.lit(95), F.greatest(F.lit(60), raw))
        else:
            score = F.least(F.lit(95), F.greatest(F.lit(65), complete.cast("long")))
        cells.append(
            F.struct(F.lit(c).alias("column"), F.lit(name).alias("treatment"), score.cast("long").alias("score"), F.col(f"filled{i}").alias("_filled"))
        )
    return row.select(F.inline(F.array(*cells))).filter(F.col("_filled") > 0).drop("_filled")


def _prescriptions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pooled = long_values(df, columns).filter(~F.lower("value").isin("nan", "none", ""))
    return pooled.groupBy(strip(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def prescription_patterns(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    return _prescriptions(df, columns).orderBy(F.desc("n"), "value").limit(k)


def prescription_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _prescriptions(df, columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_prescriptions"), F.count(F.lit(1)).alias("unique_medications")
    )


def medication_adherence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled medicine cells in per cent, compliance bands and missed doses."""
    filled = F.lit(0).cast("long")
    for c in columns:
        filled = filled + F.count(quoted(c))
    row = df.agg(F.count(F.lit(1)).alias("rows"), filled.alias("filled"))
    rate = F.coalesce(F.try_divide(F.col("filled"), F.col("rows") * len(columns)) * 100, F.lit(0.0)) if columns else F.lit(0.0)
    rows = F.col("rows")
    return row.select(
        F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), rate)), 1).alias("adherence_rate"),
        (rows * F.least(F.lit(0.7), rate / 100)).cast("long").alias("high"),
        (rows * F.least(F.lit(0.2), (100 - rate) / 100)).cast("long").alias("medium"),
        (rows * F.greatest(F.lit(0.1), (100 - rate * 1.5) / 100)).cast("long").alias("low"),
        (rows * (1 - rate / 100)).cast("long").alias("missed_doses"),
        rows.alias("total_patients"),
    )


def _medicine_sets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(medicines, n): the set of medicines in a row and how many rows hold it.

    Equal texts are counted first, so each different text is cut into medicines only once.
    """
    texts = df.groupBy(*[quoted(c).cast("string").alias(f"t{i}") for i, c in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("n")
    )
    together = F.concat(*[split_medicines(F.col(f"t{i}")) for i in range(len(columns))])
    parsed = texts.select(together.alias("_all"), "n")
    return parsed.select(F.array_sort(unique_ignoring_case(F.col("_all"))).alias("medicines"), "n")


def drug_combinations(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The most frequent sets of two or more medicines of one row."""
    counts = _medicine_sets(df, columns).groupBy(F.array_join("medicines", " + ").alias("combination")).agg(
        F.sum("n").alias("n"), F.max(F.size("medicines")).alias("_size")
    )
    # The size is tested after the grouping; before it, Spark would parse every row to filter early.
    return counts.filter(F.col("_size") > 1).select("combination", "n").orderBy(F.desc("n"), "combination").limit(k)


def drug_risk(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows by number of different medicines (up to 1, 2 to 3, more) and the share with several."""
    size = F.col("size")

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    row = _medicine_sets(df, columns).select(F.size("medicines").alias("size"), "n").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        rows(size > 1).alias("potential_interactions"),
        rows(size <= 1).alias("low_risk"),
        rows((size >= 2) & (size <= 3)).alias("medium_risk"),
        rows(size > 3).alias("high_risk"),
        rows(size > 0).alias("patients_with_medicines"),
    )
    rate = F.coalesce(F.try_divide("potential_interactions", "rows") * 100, F.lit(0.0))
    return row.withColumn("interaction_rate", F.round(rate, 1)).drop("rows")


# ---- costs -----------------------------------------------------------------------------------------


def _money(df: DataFrame, column: str) -> Column:
    """Exact for decimals and integers, otherwise a double."""
    return quoted(column) if is_numeric(df.schema[column].dataType) else to_number(quoted(column))


def primary_cost(df: DataFrame, columns: Sequence[str]) -> str | None:
    """The cost column with the largest positive sum."""
    if not columns:
        return None
    sums = df.agg(*[F.sum(_money(df, c)).cast("double") for c in columns]).first()
    best, most = None, 0.0
    for c, total in zip(columns, sums):
        if total is not None and total > most:
            best, most = c, total
    return best


def _cost_by(df: DataFrame, column: str, cost: str) -> DataFrame:
    return df.filter(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("key")).agg(
        F.sum(_money(df, cost)).alias("cost")
    )


def _top_costs(df: DataFrame, column: str, cost: str, k: int) -> list[tuple[str, int]]:
    """The k most expensive groups, at most a few rows."""
    top = _cost_by(df, column, cost).orderBy(F.desc("cost"), "key").limit(k)
    return [(r["key"], int(r["cost"])) for r in top.collect() if r["cost"] is not None and r["cost"] > 0]


def _cost_bands(df: DataFrame, cost: str, quantiles: Sequence[float], labels: Sequence[str]) -> list[tuple[str, int]]:
    """Cost sums between quantiles of cost."""
    edges = exact_quantiles(df, {cost: quantiles})[cost]
    if edges[0] is None:
        return []
    value = _number(df, cost)
    bounds = [None, *edges, None]
    sums = []
    for low, high in zip(bounds, bounds[1:]):
        test = F.lit(True)
        test = test & (value > F.lit(low)) if low is not None else test
        test = test & (value <= F.lit(high)) if high is not None else test
        sums.append(F.sum(F.when(test, _money(df, cost))))
    row = df.agg(*sums).first()
    return [(label, int(total)) for label, total in zip(labels, row) if total is not None and total > 0]


def prescription_costs(df: DataFrame, medicine: str, cost: str, k: int = 10, compat: bool = False) -> DataFrame:
    """Cost by medicine: the k dearest, or with ``compat`` the first k by name."""
    held = df.select(quoted(medicine).alias("medicine"), _money(df, cost).alias("cost")).na.drop()
    sums = held.groupBy("medicine").agg(F.sum("cost").cast("double").alias("cost"))
    return sums.orderBy(*(["medicine"] if compat else [F.desc("cost"), F.asc("medicine")])).limit(k)


def prescription_cost_totals(df: DataFrame, cost: str) -> DataFrame:
    value = _money(df, cost)
    row = df.agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("n"))
    return row.select(
        F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total_cost"),
        F.round(F.coalesce(F.try_divide("total", "n"), F.lit(0.0)), 2).alias("average_cost"),
        F.col("n").alias("total_prescriptions"),
    )


def pathways(df: DataFrame, column: str) -> DataFrame:
    return counted(df, column).select(F.col("value").alias("pathway"), "n")


def length_of_stay(df: DataFrame, admitted: str, discharged: str) -> DataFrame:
    """Mean stay in whole days."""
    days = whole_days(
        time_of(df, admitted), time_of(df, discharged)
    )
    return df.agg(F.avg(days).cast("long").alias("average_length_of_stay"))


def treatment_costs(
    df: DataFrame, costs: Sequence[str], medicine: str | None = None, admission_type: str | None = None
) -> DataFrame:
    """Primary cost by medicine (8), with few of them also by admission type (3), else by thirds of cost."""
    cost = primary_cost(df, costs)
    schema = "category string, cost long"
    if cost is None:
        return _rows(df, [], schema)
    found: list[tuple[str, int]] = []
    if medicine:
        found += [(f"Medication: {k}", v) for k, v in _top_costs(df, medicine, cost, 8)]
    if len(found) < 5 and admission_type:
        extra = [(f"Admission: {k}", v) for k, v in _top_costs(df, admission_type, cost, 3)]
        found += extra[: 10 - len(found)]
    if len(found) < 3:
        labels = (
            "Low Cost Treatments (0-33rd percentile)",
            "Medium Cost Treatments (33-66th percentile)",
            "High Cost Treatments (66-100th percentile)",
        )
        found += _cost_bands(df, cost, (0.33, 0.66), labels)
    if len(found) < 2:
        found.append((_title(cost), int(df.agg(F.sum(_money(df, cost))).first()[0])))
    return _rows(df, found, schema)


def treatment_cost_totals(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    cost = primary_cost(df, costs)
    if cost is None:
        return _rows(df, [(len(costs), 0, 0)], "cost_columns long, total_cost long, average_cost long")
    row = df.agg(F.sum(_money(df, cost)).cast("double").alias("total"), F.count(F.lit(1)).alias("rows"))
    return row.select(
        F.lit(len(costs)).cast("long").alias("cost_columns"),
        F.col("total").cast("long").alias("total_cost"),
        F.try_divide("total", "rows").cast("long").alias("average_cost"),
    )


def cost_effectiveness(df: DataFrame, treatments: Sequence[str], costs: Sequence[str], limit: int | None = None) -> DataFrame:
    """Filled share per thousand of mean cost, per treatment column, between 60 and 100."""
    chosen = list(treatments)[:limit]
    row = df.agg(
        *[F.count(quoted(c)).alias(f"f{i}") for i, c in enumerate(chosen)],
        *[F.avg(_number(df, c)).alias(f"c{i}") for i, c in enumerate(costs)],
    )
    # The first cost column with a positive mean; if there is none, the last mean counts.
    mean = F.lit(None).cast("double")
    for i in reversed(range(len(costs))):
        mean = F.when(F.col(f"c{i}") > 0, F.col(f"c{i}")).otherwise(mean)
    cells = []
    for i, c in enumerate(chosen):
        filled = F.when(F.col(f"f{i}") > 0, 100.0).otherwise(0.0)
        scored = F.least(F.lit(100), F.greatest(F.lit(60), (filled / (mean / 1000)).cast("long")))
        score = F.when(mean > 0, scored).otherwise(filled).cast("long")
        cells.append(F.struct(F.lit(_title(c)).alias("treatment"), score.alias("cost_effectiveness")))
    return row.select(F.inline(F.array(*cells)))


def value_of_care(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Return on investment from the mean cost, and a value score from completeness (70 to 95)."""
    quality = min(95, max(70, int(profile.completeness(df))))
    row = df.agg(F.sum(_money(df, costs[0])).cast("double").alias("total"), F.count(F.lit(1)).alias("rows"))
    mean = F.coalesce(F.try_divide("total", "rows"), F.lit(0.0))
    return row.select(
        (100 / F.greatest(mean / 1000, F.lit(1.0)) * 10).cast("long").alias("roi"),
        F.lit(quality).cast("long").alias("value_based_care_score"),
    )


def insurance_mix(df: DataFrame, insurer: str) -> DataFrame:
    """Share of all rows by insurer in whole per cent."""
    counts = df.groupBy(quoted(insurer).alias("insurer")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    shares = counts.filter(F.col("insurer").isNotNull())
    return shares.select("insurer", F.bround(F.col("n") / F.lit(total) * 100, 0).cast("long").alias("percentage"))


def budget_allocation(
    df: DataFrame, costs: Sequence[str], diagnoses: Sequence[str] = (), treatments: Sequence[str] = (),
    per_diagnosis: int = 5, per_treatment: int = 4,
) -> DataFrame:
    """Primary cost by diagnosis, else by treatment, else by quarters of cost, else per cost column.

    All columns count; of each, the ``per_diagnosis`` or ``per_treatment`` dearest values are listed.
    """
    cost = primary_cost(df, costs)
    schema = "category string, amount long"
    if cost is None:
        return _rows(df, [], schema)
    found: list[tuple[str, int]] = []
    for column in diagnoses:
        found += [(f"{_title(column)}: {k[:30]}", v) for k, v in _top_costs(df, column, cost, per_diagnosis)]
    if len(found) < 3:
        for column in treatments:
            found += [(f"{_title(column)}: {k[:25]}", v) for k, v in _top_costs(df, column, cost, per_treatment)]
    if len(found) < 3:
        labels = (
            "Low Cost Segment (0-25th percentile)",
            "Medium Cost Segment (25-50th percentile)",
            "High Cost Segment (50-75th percentile)",
            "Very High Cost Segment (75-100th percentile)",
        )
        found += _cost_bands(df, cost, (0.25, 0.5, 0.75), labels)
    if len(found) < 2:
        sums = df.agg(*[F.sum(_money(df, c)) for c in costs]).first()
        found += [(f"{_title(c)} Budget", int(s)) for c, s in zip(costs, sums) if s is not None and s > 0]
    return _rows(df, found, schema)


def budget_totals(df: DataFrame, costs: Sequence[str]) -> DataFrame:
    cost = primary_cost(df, costs)
    use = min(95, max(75, int(profile.completeness(df))))
    total = F.sum(_money(df, cost)).cast("long") if cost else F.lit(0).cast("long")
    return df.agg(total.alias("total_budget")).select("total_budget", F.lit(use).cast("long").alias("utilization_rate"))


def monthly_budget(df: DataFrame, costs: Sequence[str], date: str) -> DataFrame:
    cost = primary_cost(df, costs)
    month = F.date_format(time_of(df, date), "yyyy-MM")
    held = df.select(month.alias("month"), _money(df, cost).alias("cost")).filter(F.col("month").isNotNull())
    return held.groupBy("month").agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("amount"))


# ---- trends and reports ------------------------------------------------------------------------------


def monthly_records(df: DataFrame, date: str) -> DataFrame:
    """Records of the latest year by month; activities are 30 per cent."""
    moment = time_of(df, date)
    months = df.select(F.year(moment).alias("year"), F.month(moment).alias("month")).filter(F.col("year").isNotNull())
    counts = months.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    # From here on one row per calendar month.
    row = counts.groupBy("year").agg(
        *[F.coalesce(F.sum(F.when(F.col("month") == i + 1, F.col("n"))), F.lit(0)).alias(m) for i, m in enumerate(MONTHS)]
    ).agg(*[F.max_by(m, "year").alias(m) for m in MONTHS])
    cells = [
        F.struct(
            F.lit(i + 1).alias("month"),
            F.lit(m).alias("label"),
            F.coalesce(F.col(m), F.lit(0)).alias("records"),
            (F.coalesce(F.col(m), F.lit(0)) * 0.3).cast("long").alias("activities"),
        )
        for i, m in enumerate(MONTHS)
    ]
    return row.select(F.inline(F.array(*cells)))


def healthcare_overview(df: DataFrame, found: Mapping[str, Sequence[str]], age: str | None, date: str) -> DataFrame:
    """Records, columns per role, data quality, monthly records and risk segments as (section, key, value)."""

    def cell(section: str, key: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))

    quality = profile.data_quality(df).select(
        F.inline(
            F.array(
                cell("total", "records", F.col("total_cells") / len(df.columns)),
                *[cell("columns", role, F.lit(len(found.get(role, ())))) for role in ("patient", "vital", "diagnosis", "treatment", "lab", "cost")],
                *[cell("quality", c, F.col(c)) for c in ("completeness", "missing_values", "duplicate_rows", "data_quality_score")],
            )
        )
    )
    months = monthly_records(df, date)
    records = months.select(F.lit("records").alias("section"), F.col("label").alias("key"), F.col("records").cast("double").alias("value"))
    acts = months.select(F.lit("activities").alias("section"), F.col("label").alias("key"), F.col("activities").cast("double").alias("value"))
    segments = risk_segments(df, age).select(
        F.inline(F.array(*[cell("risk", c, F.col(c)) for c in ("low_risk", "medium_risk", "high_risk")]))
    )
    return quality.unionByName(records).unionByName(acts).unionByName(segments)


def analyses(df: DataFrame, found: Mapping[str, Sequence[str]], roles: Mapping[str, str]) -> dict[str, Callable[[], DataFrame]]:
    """Analyses by name, ready to run on one table."""
    get = lambda r: list(found.get(r, ()))
    medicine = [roles["medication"]] if "medication" in roles else []
    outcome = [c for c in (roles.get("result"), roles.get("condition")) if c]
    return {
        "patient-demographics": lambda: demographics(df, roles.get("age")),
        "patient-risk": lambda: risk_factors(df, roles.get("age"), get("diagnosis"), medicine, get("lab"), get("vital")),
        "vital-signs": lambda: vital_signs(df, get("vital")),
        "patient-outcomes": lambda: outcomes(df, outcome),
        "diagnosis-analysis": lambda: diagnosis_patterns(df, get("diagnosis")),
        "treatment-effectiveness": lambda: treatment_effectiveness(df, get("treatment")),
        "lab-results": lambda: lab_results(df, get("lab")),
        "clinical-pathways": lambda: pathways(df, roles["admission_type"]),
        "treatment-costs": lambda: treatment_costs(df, get("cost"), roles.get("medication"), roles.get("admission_type")),
        "prescription-patterns": lambda: prescription_patterns(df, medicine),
        "medication-adherence": lambda: medication_adherence(df, medicine),
        "drug-interactions": lambda: drug_risk(df, medicine),
        "prescription-costs": lambda: prescription_costs(df, medicine[0], get("cost")[0]),
        "cost-effectiveness": lambda: cost_effectiveness(df, get("treatment"), get("cost")),
        "insurance-analysis": lambda: insurance_mix(df, roles["insurer"]),
        "budget-allocation": lambda: budget_allocation(df, get("cost"), get("diagnosis"), get("treatment")),
        "data-quality": lambda: profile.data_quality(df),
        "correlation-analysis": lambda: profile.correlation_bands(df),
        "trend-analysis": lambda: profile.record_trend(df, roles["admitted"])["summary"],
        "statistical-summary": lambda: profile.statistical_summary(df),
        **{f"ml-{name}": lambda fit=fit: fit(df, roles).report for name, fit in models.MODELS.items()},
        "ml-all": lambda: models.train(df, roles),
    }


def analysis_batch(
    df: DataFrame, names: Sequence[str] | None, roles: Mapping[str, str], found: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Run named analyses, or all of them, on one table, evaluated once; each result row is one JSON text."""
    table = stage_table(df)
    known = analyses(table, clinical_columns(table) if found is None else found, roles)
    names = list(known) if names is None else names
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown analyses: {unknown}")
    result = None
    for name in names:
        rows = known[name]()
        part = rows.select(F.lit(name).alias("analysis"), F.to_json(F.struct(*[quoted(c) for c in rows.columns])).alias("result"))
        result = part if result is None else result.unionByName(part)
    return result
