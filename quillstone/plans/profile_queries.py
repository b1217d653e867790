"""Profiling and data-quality queries over the raw tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import roles
from ..operators import profile as job
from ..sources.views import admissions, table
from .registry import Query, on_admissions

# Columns of lineitem in order, with their types.
LINE = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
NUMBERS = [c for c, t in LINE.items() if t in ("bigint", "int", "double")]
TEXTS = [c for c, t in LINE.items() if t == "string"]


def lines(spark, folder):
    """lineitem with missing cells: no discount and return flag N count as missing."""
    source = table(spark, folder, "lineitem")
    changed = {"l_discount": F.expr("nullif(l_discount, 0.0D)"), "l_returnflag": F.expr("nullif(l_returnflag, 'N')")}
    return source.select(*[changed.get(c, F.col(c)).alias(c) for c in source.columns])


def flags(spark, folder):
    """Two low-variety columns of lineitem, so nearly every row is a duplicate."""
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")


_GAPPED = {"l_discount": "nullif(l_discount, 0.0) AS l_discount", "l_returnflag": "nullif(l_returnflag, 'N') AS l_returnflag"}
_SELECT = ", ".join(_GAPPED.get(c, c) for c in LINE)
_LINES = f"lines AS (SELECT {_SELECT} FROM lineitem)"
_FLAGS = "lines AS (SELECT l_returnflag, l_linestatus FROM lineitem)"


def _copies(columns) -> str:
    return (
        "copies AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lines GROUP BY "
        + ", ".join(columns)
        + "))"
    )


def _gaps(columns) -> str:
    missing = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    return f"gaps AS (SELECT count(*) AS n, {missing} AS missing, count(*) * {len(list(columns))} AS cells FROM lines)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def _stack(columns, expr, source="lines") -> str:
    return "\nUNION ALL ".join("SELECT " + expr(c) + f" FROM {source}" for c in columns)


def _outliers(c: str) -> str:
    q1, q3 = f"(SELECT quantile_cont({_d(c)}, 0.25) FROM lines)", f"(SELECT quantile_cont({_d(c)}, 0.75) FROM lines)"
    return f"count(*) FILTER ({_d(c)} < {q1} - 1.5::DOUBLE * ({q3} - {q1}) OR {_d(c)} > {q3} + 1.5::DOUBLE * ({q3} - {q1}))"


def _profile(c: str) -> str:
    numeric = c in NUMBERS
    value = lambda e: f"round(CAST({e} AS DOUBLE), 4)" if numeric else "CAST(NULL AS DOUBLE)"
    quarter = lambda q: value(f"quantile_cont({_d(c)}, {q})")
    return f"""'{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing, count(*) AS total_rows,
  CAST({len(LINE)} AS BIGINT) AS total_columns, '{LINE[c]}' AS data_type,
  {f'count({c})' if numeric else 'CAST(NULL AS BIGINT)'} AS n, {value(f'avg({c})')} AS mean, {value(f'stddev_samp({_d(c)})')} AS std,
  {value(f'min({c})')} AS lo, {quarter(0.25)} AS q25, {quarter(0.5)} AS q50, {quarter(0.75)} AS q75, {value(f'max({c})')} AS hi"""


def _distribution(c: str) -> str:
    n = f"CAST(count({c}) AS DOUBLE)"
    return f"""'{c}' AS "column", round(avg({c}), 4) AS mean, round(quantile_cont({_d(c)}, 0.5), 4) AS median,
  round(stddev_samp({_d(c)}), 4) AS std, round({_d(f'min({c})')}, 4) AS min, round({_d(f'max({c})')}, 4) AS max,
  round(skewness({_d(c)}) * ({n} - 2) / sqrt({n} * ({n} - 1)), 4) AS skewness,
  round(kurtosis_pop({_d(c)}), 4) AS kurtosis, count({c}) AS count"""


def _box(c: str) -> str:
    q = lambda p: f"quantile_cont({_d(c)}, {p})"
    return f"""'{c}' AS "column", round({q(0.25)}, 4) AS q1, round({q(0.5)}, 4) AS median, round({q(0.75)}, 4) AS q3,
  round({_d(f'min({c})')}, 4) AS min, round({_d(f'max({c})')}, 4) AS max, round({q(0.75)} - {q(0.25)}, 4) AS iqr,
  {_outliers(c)} AS outliers, round(CAST({_outliers(c)} AS DOUBLE) / count({c}) * 100, 2) AS outlier_percentage"""


def _summary(c: str) -> str:
    q = lambda p: f"quantile_cont({_d(c)}, {p})"
    return f"""'{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({_d(c)}), 4) AS std,
  round({_d(f'min({c})')}, 4) AS min, round({_d(f'max({c})')}, 4) AS max, round({q(0.5)}, 4) AS median,
  round({q(0.25)}, 4) AS q25, round({q(0.75)}, 4) AS q75, round({q(0.75)} - {q(0.25)}, 4) AS iqr,
  round({_d(f'max({c})')} - {_d(f'min({c})')}, 4) AS range, round(var_samp({_d(c)}), 2) AS variance,
  round(stddev_samp({_d(c)}) / avg({c}), 4) AS variation, round(skewness({_d(c)}), 4) AS skewness,
  round(kurtosis({_d(c)}), 4) AS kurtosis, count(*) - count({c}) AS missing,
  round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 4) AS missing_percentage, {_outliers(c)} AS outliers"""


def _corr(a: str, b: str) -> str:
    return f"corr({_d(a)}, {_d(b)})"


_PAIRS = list(combinations(NUMBERS, 2))
_CORRS = "corrs AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {_corr(a, b)} AS r FROM lines" for a, b in _PAIRS
) + ")"


def _scatter(a: str, b: str) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT '{a}' AS x, '{b}' AS y, round({_corr(a, b)}, 4) AS correlation, count(*) {both} AS points,
  round(avg({a}) {both}, 4) AS x_mean, round(avg({b}) {both}, 4) AS y_mean, round(stddev_samp({_d(a)}) {both}, 4) AS x_std,
  round(stddev_samp({_d(b)}) {both}, 4) AS y_std, round({_corr(a, b)} * {_corr(a, b)}, 4) AS r_squared FROM lines"""


def _text_counts(names, source) -> str:
    return "counts AS (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in names
    ) + ")"


_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM counts)"""


def _overview(columns: dict[str, str]) -> str:
    kinds: dict[str, int] = {}
    for t in columns.values():
        kinds[t] = kinds.get(t, 0) + 1
    rows = [("shape", "total_columns", len(columns))]
    rows += [("type", t, n) for t, n in kinds.items()]
    rows += [("count", "numeric_columns", len(NUMBERS)), ("count", "categorical_columns", len(TEXTS))]
    rows += [("name", c, i + 1) for i, c in enumerate(columns)]
    parts = [f"SELECT '{s}' AS section, '{k}' AS key, CAST({v} AS BIGINT) AS value" for s, k, v in rows]
    parts.append("SELECT 'shape', 'total_rows', count(*) FROM lines")
    parts += [f"SELECT 'missing', '{c}', count(*) FILTER ({c} IS NULL) FROM lines HAVING count(*) FILTER ({c} IS NULL) > 0" for c in columns]
    return "\nUNION ALL ".join(parts)


def _totals() -> str:
    kinds: dict[str, int] = {}
    for t in LINE.values():
        kinds[t] = kinds.get(t, 0) + 1
    parts = [f"SELECT 'type' AS section, '{t}' AS key, CAST({n} AS BIGINT) AS value" for t, n in kinds.items()]
    parts += [
        "SELECT 'total', 'records', n FROM gaps",
        f"SELECT 'total', 'columns', {len(LINE)}",
        f"SELECT 'total', 'numeric_columns', {len(NUMBERS)}",
        f"SELECT 'total', 'categorical_columns', {len(TEXTS)}",
        "SELECT 'total', 'missing_values', missing FROM gaps",
        "SELECT 'total', 'duplicate_rows', duplicates FROM copies",
    ]
    return "\nUNION ALL ".join(parts)


_EVENT_ROWS = """placed AS (SELECT ts, value, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS place,
  stddev_samp(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS rolling FROM events)"""

_TREND = """SELECT 'ts - value' AS series, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend,
  round(slope, 8) AS slope, round(r2, 8) AS r_squared, points, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_date,
  strftime(e, '%Y-%m-%d %H:%M:%S') AS end_date, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max,
  CASE WHEN rolled > std * 0.1 THEN 'detected' ELSE 'not_detected' END AS seasonality,
  CASE WHEN abs(slope) > 0.1 THEN 'strong' WHEN abs(slope) > 0.01 THEN 'weak' ELSE 'stable' END AS strength,
  CASE WHEN std > mean * 0.5 THEN 'high' WHEN std > mean * 0.2 THEN 'medium' ELSE 'low' END AS volatility
FROM (SELECT regr_slope(value, place) AS slope, regr_r2(value, place) AS r2, count(*) AS points, min(ts) AS s, max(ts) AS e,
  avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, avg(rolling) AS rolled FROM placed)"""

_MONTHS = "months AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1)"
_YEARS = "years AS (SELECT CAST(year(m) AS INTEGER) AS year, CAST(sum(n) AS BIGINT) AS n FROM months GROUP BY 1)"
_QUARTERS = "quarters AS (SELECT 'Q' || CAST(quarter(m) AS VARCHAR) AS quarter, CAST(sum(n) AS BIGINT) AS n FROM months GROUP BY 1)"


def _orders_trend(part):
    return lambda s, d: job.record_trend(table(s, d, "orders"), "o_orderdate")[part]


QUERIES = {
    "profile_file": Query(
        lambda s, d: job.profile_file(lines(s, d)), _with(_LINES) + _stack(LINE, _profile)
    ),
    "quality_business": Query(
        lambda s, d: job.quality_business(lines(s, d)),
        _with(_LINES, _gaps(LINE), _copies(LINE))
        + f"""SELECT n AS total_rows, CAST({len(LINE)} AS BIGINT) AS total_columns, missing AS missing_values, duplicates AS duplicate_rows,
  round(greatest(0, 100 - missing::DOUBLE / cells * 100 - duplicates::DOUBLE / n * 100), 2) AS quality_score FROM gaps, copies""",
    ),
    "quality_duplicates": Query(
        lambda s, d: job.quality_business(flags(s, d)),
        _with(_FLAGS, _gaps(["l_returnflag", "l_linestatus"]), _copies(["l_returnflag", "l_linestatus"]))
        + """SELECT n AS total_rows, CAST(2 AS BIGINT) AS total_columns, missing AS missing_values, duplicates AS duplicate_rows,
  round(greatest(0, 100 - missing::DOUBLE / cells * 100 - duplicates::DOUBLE / n * 100), 2) AS quality_score FROM gaps, copies""",
    ),
    "quality_healthcare": Query(
        lambda s, d: (lambda a: job.quality_healthcare(a, roles.clinical_columns(a)))(admissions(s, d)),
        on_admissions(
            """SELECT count(*) AS total_rows, CAST(15 AS BIGINT) AS total_columns, CAST(0 AS BIGINT) AS missing_values,
  0.0::DOUBLE AS missing_percentage, CAST(0 AS BIGINT) AS duplicate_rows, 0.0::DOUBLE AS duplicate_percentage,
  CAST(4 AS BIGINT) AS numeric_columns, CAST(9 AS BIGINT) AS text_columns, CAST(2 AS BIGINT) AS date_columns,
  CAST(3 AS BIGINT) AS patient_columns, CAST(2 AS BIGINT) AS vital_columns, CAST(2 AS BIGINT) AS lab_columns,
  CAST(1 AS BIGINT) AS diagnosis_columns, CAST(1 AS BIGINT) AS treatment_columns, CAST(1 AS BIGINT) AS cost_columns,
  100.0::DOUBLE AS quality_score FROM admissions"""
        ),
    ),
    "data_quality": Query(
        lambda s, d: job.data_quality(lines(s, d)),
        _with(_LINES, _gaps(LINE), _copies(LINE))
        + """SELECT round((cells - missing)::DOUBLE / cells * 100, 2) AS completeness, missing AS missing_values, cells AS total_cells,
  duplicates AS duplicate_rows, round((cells - missing)::DOUBLE / cells * 100, 2) AS data_quality_score FROM gaps, copies""",
    ),
    "eda_overview": Query(lambda s, d: job.eda_overview(lines(s, d)), _with(_LINES) + _overview(LINE)),
    "eda_missing": Query(
        lambda s, d: job.eda_missing(lines(s, d)),
        _with(_LINES)
        + _stack(
            LINE,
            lambda c: f"""'{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing,
  round(CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) * 100, 2) AS missing_percentage, '{LINE[c]}' AS data_type,
  count(*) AS total, count({c}) AS filled""",
        ),
    ),
    "eda_missing_total": Query(
        lambda s, d: job.eda_missing_total(lines(s, d)),
        _with(_LINES, _gaps(LINE))
        + "SELECT n AS total_rows, missing AS total_missing, CAST(2 AS BIGINT) AS columns_with_missing, "
        + "round(missing::DOUBLE / cells * 100, 2) AS missing_percentage FROM gaps",
    ),
    "eda_distribution": Query(
        lambda s, d: job.eda_distribution(lines(s, d)), _with(_LINES) + _stack(NUMBERS, _distribution)
    ),
    "eda_box": Query(lambda s, d: job.eda_box(lines(s, d)), _with(_LINES) + _stack(NUMBERS, _box)),
    "statistical_summary": Query(
        lambda s, d: job.statistical_summary(lines(s, d)), _with(_LINES) + _stack(NUMBERS, _summary)
    ),
    "statistical_totals": Query(
        lambda s, d: job.statistical_totals(lines(s, d)), _with(_LINES, _gaps(LINE), _copies(LINE)) + _totals()
    ),
    "eda_correlation": Query(
        lambda s, d: job.eda_correlation(lines(s, d)),
        _with(_LINES, _CORRS)
        + """SELECT x, y, round(r, 4) AS correlation, CASE WHEN abs(r) > 0.8 THEN 'strong' WHEN abs(r) > 0.7 THEN 'moderate' END AS strength FROM corrs
UNION ALL SELECT y, x, round(r, 4), NULL FROM corrs\nUNION ALL """
        + "\nUNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::DOUBLE, NULL" for c in NUMBERS),
    ),
    "eda_scatter": Query(
        lambda s, d: job.eda_scatter(lines(s, d)),
        _with(_LINES) + "\nUNION ALL ".join(_scatter(a, b) for a, b in combinations(NUMBERS, 2)),
    ),
    "corr_bands": Query(
        lambda s, d: job.correlation_bands(lines(s, d)),
        _with(_LINES, _CORRS)
        + """SELECT x, y, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation,
  CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM corrs""",
    ),
    "corr_summary": Query(
        lambda s, d: job.correlation_summary(lines(s, d)),
        _with(_LINES, _CORRS)
        + """SELECT count(*) AS total_pairs, count(*) FILTER (abs(r) > 0.7) AS strong_count,
  count(*) FILTER (abs(r) > 0.5 AND abs(r) <= 0.7) AS moderate_count, count(*) FILTER (abs(r) <= 0.5) AS weak_count,
  round(avg(r), 4) AS average_correlation, round(max(r), 4) AS max_correlation, round(min(r), 4) AS min_correlation FROM corrs""",
    ),
    "eda_categorical": Query(
        lambda s, d: job.eda_categorical(table(s, d, "orders")),
        _with(_text_counts(["o_orderstatus", "o_orderpriority"], "orders"), _RANKED)
        + """SELECT "column", count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS total, max(value) FILTER (place = 1) AS most_frequent,
  max(n) AS most_frequent_count, round(max(n)::DOUBLE / sum(n)::DOUBLE * 100, 2) AS most_frequent_percentage FROM ranked GROUP BY 1""",
    ),
    "eda_categorical_top": Query(
        lambda s, d: job.eda_categorical_top(table(s, d, "customer")),
        _with(_text_counts(["c_name", "c_mktsegment"], "customer"), _RANKED)
        + 'SELECT "column", CAST(place AS INTEGER) AS rank, value, n FROM ranked WHERE place <= 5',
    ),
    "eda_timeseries": Query(
        lambda s, d: job.eda_timeseries(table(s, d, "events"), ["ts"], ["value"], ["event_id"], unique=True),
        _with(_EVENT_ROWS) + _TREND,
    ),
    "eda_timeseries_pvalue": Query(
        lambda s, d: job.with_p_values(
            job.eda_timeseries(table(s, d, "orders"), ["o_orderdate"], ["o_custkey", "o_totalprice"], ["o_orderkey"], unique=True)
        )
    ),
    "trend_by_month": Query(
        _orders_trend("month"),
        _with(_MONTHS) + "SELECT strftime(m, '%Y-%m') AS month, strftime(m, '%b %Y') AS label, n FROM months",
    ),
    "trend_by_year": Query(_orders_trend("year"), _with(_MONTHS, _YEARS) + "SELECT * FROM years"),
    "trend_by_quarter": Query(_orders_trend("quarter"), _with(_MONTHS, _QUARTERS) + "SELECT * FROM quarters"),
    "trend_summary": Query(
        _orders_trend("summary"),
        _with(
            _MONTHS,
            _YEARS,
            _QUARTERS,
            "g AS (SELECT (arg_max(n, year) - arg_min(n, year))::DOUBLE / arg_min(n, year) * 100 AS growth FROM years)",
        )
        + """SELECT round(growth, 2) AS growth_rate, CASE WHEN growth > 5 THEN 'strongly_increasing' WHEN growth > 0 THEN 'increasing'
  WHEN growth < -5 THEN 'strongly_decreasing' WHEN growth < 0 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  (SELECT round(stddev_pop(n) / avg(n) * 100, 2) FROM months) AS volatility,
  (SELECT strftime(m, '%b %Y') FROM months ORDER BY n DESC, m LIMIT 1) AS peak_period,
  (SELECT strftime(m, '%b %Y') FROM months ORDER BY n, m LIMIT 1) AS low_period,
  (SELECT CAST(sum(n) AS BIGINT) FROM months) AS total_data_points,
  (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders) AS first_day,
  (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS last_day,
  (SELECT quarter FROM quarters ORDER BY n DESC, quarter LIMIT 1) AS peak_quarter,
  (SELECT quarter FROM quarters ORDER BY n, quarter LIMIT 1) AS low_quarter FROM g""",
    ),
}
