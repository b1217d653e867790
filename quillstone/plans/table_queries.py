"""Single table operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.grouping import with_group_value
from ..functions.ordering import rolling_std, row_index
from ..operators import tables as op, transform
from ..operators.sales import with_revenue
from ..sources.views import admissions, sales, table
from .profile_queries import _LINES, lines
from .registry import Query, on_admissions, on_sales


def _odd_numbers(spark, folder):
    """events whose value is sometimes NaN or infinite."""
    return table(spark, folder, "events").select(
        "event_id",
        F.expr("CASE event_id % 9 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -double('Infinity') ELSE value END").alias("value"),
    )


def _date_texts(spark, folder):
    """The day of each order, and a minute of it, written in six ways."""
    formats = {
        "month_first": "M/d/yyyy", "day_first": "d/M/yyyy H:mm", "minutes": "yyyy-MM-dd HH:mm",
        "zone": "yyyy-MM-dd'T'HH:mm:ss'Z'", "fraction": "yyyy-MM-dd HH:mm:ss.SSS", "named": "d-MMM-yyyy",
    }
    orders = table(spark, folder, "orders")
    minute = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    exact = F.timestamp_add("MICROSECOND", F.lit(250_000), minute)
    return orders.select("o_orderkey", *[F.date_format(exact if c == "fraction" else minute, f).alias(c) for c, f in formats.items()])


def _odd_texts(spark, folder):
    """orders with numbers and dates as text, readable or not."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' ', cast(o_custkey AS STRING)) WHEN 1 THEN concat(o_custkey, ',5') WHEN 2 THEN '1.5e2' ELSE 'n/a' END").alias("number"),
        F.expr(
            """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
               WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 3 THEN 'soon' END"""
        ).alias("day"),
    )




def _draw(purpose, key):
    """The same draw as ``columns.chance`` with seed 42."""
    return f"(('0x' || substr(md5('{purpose}:42:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


def _hold_out_counts(orders):
    key = [F.col("o_orderkey")]
    drawn = orders.select((fn.chance(key, 42, "hold-out") < 0.2).alias("held_out"), (fn.chance(key, 42, "noise") < 0.3).alias("_noisy"))
    return drawn.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_noisy"), 1)).alias("noisy"))


QUERIES = {
    "range_filter": Query(
        lambda s, d: table(s, d, "lineitem")
        .filter((F.col("l_quantity") >= 10) & (F.col("l_quantity") <= 20) & ((F.col("l_discount") > 0.05) | (F.col("l_tax") == 0)))
        .select("l_orderkey", "l_partkey", "l_quantity"),
        """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_quantity >= 10 AND l_quantity <= 20 AND (l_discount > 0.05::DOUBLE OR l_tax = 0)""",
    ),
    "drop_missing": Query(
        lambda s, d: lines(s, d).na.drop(subset=["l_discount"]).select("l_orderkey", "l_partkey", "l_discount", "l_returnflag"),
        f"WITH {_LINES} SELECT l_orderkey, l_partkey, l_discount, l_returnflag FROM lines WHERE l_discount IS NOT NULL",
    ),
    "keep_top_values": Query(
        lambda s, d: op.keep_top_values(table(s, d, "orders"), "o_custkey", 20).select("o_orderkey", "o_custkey"),
        """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
(SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)""",
    ),
    "text_pattern": Query(
        lambda s, d: table(s, d, "documents").filter(F.col("text").rlike("(?i)than|quei|eron")).select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)than|quei|eron')",
    ),
    "conditional_update": Query(
        lambda s, d: op.updated(
            table(s, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("level")),
            "level",
            [(F.col("o_totalprice") >= 100000, F.lit(1)), (F.col("o_totalprice") >= 300000, F.lit(2)), (F.col("o_orderkey") % 10 == 0, lambda level: F.greatest(level, F.lit(1)))],
        ).select("o_orderkey", "level"),
        """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 2 WHEN o_totalprice >= 100000 THEN 1
  WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS level FROM orders""",
    ),
    "group_value_on_rows": Query(
        lambda s, d: with_group_value(
            table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", orders=F.count(F.lit(1)), newest=F.max("o_orderkey")
        ),
        """SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS orders, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest
FROM orders""",
    ),
    "lookup_map": Query(
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", F.create_map(F.lit("F"), F.lit(0), F.lit("O"), F.lit(1), F.lit("P"), F.lit(2))[F.col("o_orderstatus")].alias("level")
        ),
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS level FROM orders",
    ),
    "complete_pairs": Query(
        lambda s, d: lines(s, d)
        .filter(F.col("l_discount").isNotNull() & F.col("l_returnflag").isNotNull())
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean")),
        f"""WITH {_LINES} SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lines
WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1""",
    ),
    "global_aggregates": Query(
        lambda s, d: table(s, d, "events").agg(
            F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
            F.round(F.avg("value"), 4).alias("mean"),
            F.round(F.stddev_samp("value"), 4).alias("std"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("value").alias("n"),
        ),
        """SELECT round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, round(avg(value), 4) AS mean,
  round(stddev_samp(value), 4) AS std, min(value) AS low, max(value) AS high, count(value) AS n FROM events""",
    ),
    "grouped_aggregates": Query(
        lambda s, d: table(s, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("l_partkey").alias("parts"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        ),
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n,
  count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""",
    ),
    "distinct_counts": Query(
        lambda s, d: table(s, d, "events").agg(
            F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct("value").alias("amounts")
        ),
        "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(DISTINCT value) AS amounts FROM events",
    ),
    "value_counts": Query(
        lambda s, d: op.counted(lines(s, d), "l_returnflag"),
        f"WITH {_LINES} SELECT l_returnflag AS value, count(*) AS n FROM lines WHERE l_returnflag IS NOT NULL GROUP BY 1",
    ),
    "most_frequent": Query(
        lambda s, d: op.counted(table(s, d, "events"), "user_id").orderBy(F.desc("n"), "value").limit(1),
        "SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    ),
    "exact_quantiles": Query(
        lambda s, d: op.quantile_table(table(s, d, "events"), ["value", "user_id"], [0.2, 0.25, 0.3, 0.33, 0.4, 0.5, 0.66, 0.75, 0.8]).select(
            "column", "quantile", F.round("value", 4).alias("value")
        ),
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS quantile, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS value FROM events"
            for c in ("value", "user_id")
            for q in (0.2, 0.25, 0.3, 0.33, 0.4, 0.5, 0.66, 0.75, 0.8)
        ),
    ),
    "purchase_lists": Query(
        lambda s, d: op.pair_table(sales(s, d, ["CustomerNo", "ProductName"]), "CustomerNo", "ProductName"),
        on_sales("SELECT CustomerNo, ProductName, count(*) AS n FROM sales GROUP BY 1, 2"),
    ),
    "pivot_counts": Query(
        lambda s, d: op.pivot_counts(table(s, d, "events"), "user_id", "event_type", ["click", "error", "view"]).select(
            "user_id", "click", "error", "view"
        ),
        """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
  count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""",
    ),
    "linear_fit": Query(
        lambda s, d: op.linear_fit(table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(
            *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r", "r_squared", "slope_error")], "points"
        ),
        """SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(corr(x, y), 4) AS r,
  round(regr_r2(y, x), 4) AS r_squared, round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)), 4) AS slope_error,
  count(*) AS points FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)""",
    ),
    "fixed_histogram": Query(
        lambda s, d: op.fixed_histogram(table(s, d, "events"), "value"),
        """SELECT b.bin, b.label, count(e.value) AS n FROM (VALUES (1, '0-100', 0, 100), (2, '100-500', 100, 500), (3, '500-1000', 500, 1000),
  (4, '1000+', 1000, 1e18)) AS b(bin, label, lo, hi)
LEFT JOIN events e ON (e.value > b.lo OR (b.lo = 0 AND e.value = 0)) AND e.value <= b.hi GROUP BY 1, 2""",
    ),
    **{
        name: Query(
            lambda s, d, compat=compat: op.equal_width_histogram(table(s, d, "events"), "value", compat=compat),
            f"""WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events)
SELECT CAST(i AS INTEGER) AS bin, CAST(i AS VARCHAR) AS label, count(value) AS n FROM range(1, 6) r(i), m
LEFT JOIN events ON value >= lo + (i - 1) * w AND (value < lo + i * w {'' if compat else 'OR i = 5'}) GROUP BY 1, 2""",
        )
        for name, compat in (("equal_width_histogram", False), ("equal_width_histogram_half_open", True))
    },
    "row_positions": Query(
        lambda s, d: row_index(
            table(s, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"),
            ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
        ),
        """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS row_index FROM lineitem""",
    ),
    "rolling_deviation": Query(
        lambda s, d: rolling_std(
            row_index(table(s, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "place", unique=True), "value", "place"
        ).select("event_id", F.round("rolling_std", 4).alias("rolling_std")),
        """SELECT event_id, round(stddev_samp(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) AS rolling_std
FROM events""",
    ),
    "quantile_buckets": Query(
        lambda s, d: op.quantile_buckets(table(s, d, "customer"), "c_acctbal").select("c_custkey", "bucket"),
        """SELECT c_custkey, 1 + (c_acctbal > a)::INTEGER + (c_acctbal > b)::INTEGER + (c_acctbal > c)::INTEGER + (c_acctbal > d)::INTEGER AS bucket
FROM customer, (SELECT quantile_cont(c_acctbal, 0.2) AS a, quantile_cont(c_acctbal, 0.4) AS b, quantile_cont(c_acctbal, 0.6) AS c,
  quantile_cont(c_acctbal, 0.8) AS d FROM customer)""",
    ),
    "pooled_values": Query(
        lambda s, d: op.pooled_counts(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]),
        """SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY 1""",
    ),
    "resolved_revenue": Query(
        lambda s, d: with_revenue(
            with_revenue(sales(s, d, ["TransactionNo", "LineNo", "ProductNo", "Price", "Quantity"]), {"price": "Price", "quantity": "Quantity"}),
            {"price": "Price"},
            "price_only",
        ).select("TransactionNo", "LineNo", "ProductNo", F.round("revenue", 2).alias("revenue"), F.round("price_only", 8).alias("price_only")),
        on_sales("SELECT TransactionNo, LineNo, ProductNo, round(Price * Quantity, 2) AS revenue, round(Price, 8) AS price_only FROM sales"),
    ),
    # scalar functions
    "text_functions": Query(
        lambda s, d: table(s, d, "part").select(
            "p_partkey",
            F.lower("p_type").alias("lowered"),
            F.initcap("p_name").alias("titled"),
            F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("replaced"),
            fn.first_word(F.col("p_name")).alias("category"),
            F.col("p_name").contains("ring").alias("has_ring"),
            F.concat(F.col("p_size").cast("string"), F.lit("-"), "p_type").alias("joined"),
            fn.short_label(F.col("p_name"), 7).alias("label"),
            fn.strip(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))).alias("stripped"),
        ),
        """SELECT p_partkey, lower(p_type) AS lowered, array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled, replace(p_brand, '#', ' ') AS replaced, string_split(p_name, ' ')[1] AS category,
  contains(p_name, 'ring') AS has_ring, CAST(p_size AS VARCHAR) || '-' || p_type AS joined, left(p_name, 7) AS label, p_name AS stripped FROM part""",
    ),
    "medicine_lists": Query(
        lambda s, d: admissions(s, d)
        .select(
            "AdmissionId",
            fn.split_medicines(
                F.expr("CASE AdmissionId % 5 WHEN 0 THEN concat(Medication, ' & ', Name) WHEN 1 THEN concat(lower(Medication), '; ', Medication, ';nan') WHEN 2 THEN 'none' ELSE Medication END")
            ).alias("parts"),
        )
        .select(
            "AdmissionId",
            F.array_join("parts", "|").alias("medicines"),
            F.array_join(fn.unique_ignoring_case(F.col("parts")), "|").alias("unique_medicines"),
            F.array_join(F.array_sort(fn.unique_ignoring_case(F.col("parts"))), "|").alias("combination"),
        ),
        on_admissions(
            """SELECT AdmissionId, array_to_string(m, '|') AS medicines, array_to_string(u, '|') AS unique_medicines, array_to_string(list_sort(u), '|') AS combination
FROM (SELECT AdmissionId, m, list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i) AS u FROM
  (SELECT AdmissionId, list_filter(list_transform(CASE WHEN contains(t, ',') THEN string_split(t, ',') WHEN contains(t, ';') THEN string_split(t, ';')
     WHEN contains(t, ' & ') THEN string_split(t, ' & ') ELSE [t] END, lambda p: trim(p)), lambda p: lower(p) NOT IN ('nan', 'none', 'null', '')) AS m
   FROM (SELECT AdmissionId, CASE AdmissionId % 5 WHEN 0 THEN Medication || ' & ' || Name WHEN 1 THEN lower(Medication) || '; ' || Medication || ';nan'
     WHEN 2 THEN 'none' ELSE Medication END AS t FROM admissions)))"""
        ),
    ),
    "age_numbers": Query(
        lambda s, d: admissions(s, d).select("AdmissionId", fn.age_years(F.col("AgeText")).alias("years")),
        on_admissions(
            """SELECT AdmissionId, CASE AgeText WHEN '71-80' THEN 75.5::DOUBLE WHEN '65+' THEN 65.0::DOUBLE ELSE TRY_CAST(AgeText AS DOUBLE) END AS years
FROM admissions"""
        ),
    ),
    "safe_casts": Query(
        lambda s, d: (lambda t: t.select("o_orderkey", fn.to_number(F.col("number")).alias("number"), fn.time_of(t, "day").alias("day")))(_odd_texts(s, d)),
        """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN 150.0::DOUBLE END AS number,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN date_trunc('day', o_orderdate) WHEN o_orderkey % 5 = 2 THEN date_trunc('second', o_orderdate) END AS day
FROM orders""",
    ),
    "text_dates": Query(
        lambda s, d: (lambda t: t.select("o_orderkey", *[fn.time_of(t, c).alias(c) for c in t.columns if c != "o_orderkey"]))(_date_texts(s, d)),
        """WITH t AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d, o_orderkey % 1440 AS m FROM orders)
SELECT o_orderkey, d AS month_first, d + to_minutes(m) AS day_first, d + to_minutes(m) AS minutes, d + to_minutes(m) AS zone,
  d + to_minutes(m) + INTERVAL 250 MILLISECOND AS fraction, d AS named FROM t""",
    ),
    "date_functions": Query(
        lambda s, d: table(s, d, "events").select(
            "event_id",
            *[c.alias(n) for n, c in fn.date_parts(F.col("ts")).items()],
            F.to_date("ts").alias("date_only"),
            F.date_format("ts", "yyyy-MM").alias("period"),
            F.date_format("ts", "MMM yyyy").alias("label"),
        ),
        """SELECT event_id, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day,
  (isodow(ts) - 1)::INTEGER AS weekday, week(ts)::INTEGER AS week, CAST(ts AS DATE) AS date_only, strftime(ts, '%Y-%m') AS period,
  strftime(ts, '%b %Y') AS label FROM events""",
    ),
    "day_spans": Query(
        lambda s, d: admissions(s, d).select(
            "AdmissionId", fn.whole_days(F.col("Date of Admission"), F.col("Discharge Date")).alias("days")
        ),
        on_admissions(
            """SELECT AdmissionId, CAST(floor(epoch("Discharge Date" - "Date of Admission") / 86400) AS BIGINT) AS days FROM admissions"""
        ),
    ),
    "number_functions": Query(
        lambda s, d: table(s, d, "customer").select(
            "c_custkey",
            F.abs(F.col("c_acctbal") - 5000).alias("distance"),
            F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("root"),
            F.round(F.col("c_acctbal") * F.col("c_acctbal"), 2).alias("square"),
            fn.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"),
            F.floor(F.col("c_acctbal") / 1000).cast("long").alias("whole"),
        ),
        """SELECT c_custkey, abs(c_acctbal - 5000) AS distance, round(sqrt(abs(c_acctbal)), 6) AS root, round(c_acctbal * c_acctbal, 2) AS square,
  greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clipped, CAST(floor(c_acctbal / 1000) AS BIGINT) AS whole FROM customer""",
    ),
    "finite_numbers": Query(
        lambda s, d: transform.finite_numbers(_odd_numbers(s, d)),
        "SELECT event_id, CASE WHEN event_id % 9 > 2 THEN value END AS value FROM events",
    ),
    "label_noise": Query(
        lambda s, d: table(s, d, "orders").select(
            "o_orderkey", fn.flipped((F.col("o_orderkey") % 2).cast("int"), [F.col("o_orderkey")], 42, 0.3).alias("noisy")
        ),
        f"SELECT o_orderkey, CAST(CASE WHEN {_draw('noise', 'o_orderkey')} < 0.3 THEN 1 - o_orderkey % 2 ELSE o_orderkey % 2 END AS INTEGER) AS noisy FROM orders",
    ),
    "hold_out_counts": Query(
        lambda s, d: _hold_out_counts(table(s, d, "orders")),
        f"""SELECT {_draw('hold-out', 'o_orderkey')} < 0.2 AS held_out, count(*) AS n,
  count(*) FILTER ({_draw('noise', 'o_orderkey')} < 0.3) AS noisy FROM orders GROUP BY 1""",
    ),
}
