"""Merging, cleaning, feature and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import epoch_micros
from ..functions.grouping import time_columns
from ..functions import roles
from ..functions.roles import clinical_columns
from ..operators import clean, tables, transform
from ..session import new_folder
from ..sources import files
from ..sources.views import admissions, sales, table
from .profile_queries import _LINES, LINE, lines
from .registry import Query, on_admissions, on_sales


def gapped_events(spark, folder):
    """events with missing values and types in most rows, as an ordered table to fill."""
    return table(spark, folder, "events").select(
        "event_id",
        F.expr("CASE WHEN event_id % 7 IN (0, 3) THEN value END").alias("value"),
        F.expr("CASE WHEN event_id % 11 = 5 THEN event_type END").alias("event_type"),
    )


_GAPPED = """gapped AS (SELECT event_id, CASE WHEN event_id % 7 IN (0, 3) THEN value END AS value,
  CASE WHEN event_id % 11 = 5 THEN event_type END AS event_type FROM events)"""


def spaced(spark, folder):
    """customer with missing balances and segments and untidy text."""
    return table(spark, folder, "customer").select(
        F.expr("c_custkey % 40").alias("c_group"),
        F.expr("CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END").alias("c_acctbal"),
        F.expr("CASE WHEN c_custkey % 7 <> 0 THEN concat('  ', c_mktsegment, ' ') END").alias("c_mktsegment"),
    )


_SPACED = """spaced AS (SELECT c_custkey % 40 AS c_group, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 7 <> 0 THEN '  ' || c_mktsegment || ' ' END AS c_mktsegment FROM customer)"""


def texts(spark, folder):
    """orders with dates as text, one of them unreadable in some rows."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.expr("CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END").alias("mixed"),
        (F.floor(epoch_micros(F.col("o_orderdate")) / 1000000) + 800000000).alias("epoch"),
    )


def _named(spark, folder, name, letter, key):
    return table(spark, folder, name).select(F.col(f"{letter}_{key}").alias("id"), F.col(f"{letter}_name").alias("name"))


def _merged(spark, folder):
    frames = [
        _named(spark, folder, "customer", "c", "custkey"),
        _named(spark, folder, "supplier", "s", "suppkey"),
        _named(spark, folder, "part", "p", "partkey"),
    ]
    return clean.merge_side_by_side(frames, [["id"], ["name"], ["id"]], unique=True)


_METRIC_COLUMNS = ["TransactionNo", "LineNo", "ProductNo", "CustomerNo", "Price", "Quantity"]


def _metrics(spark, folder):
    out = transform.business_metrics(
        sales(spark, folder, _METRIC_COLUMNS), {"price": "Price", "quantity": "Quantity", "customer": "CustomerNo"}
    )
    return out.select(
        "TransactionNo", "LineNo", "ProductNo", "CustomerNo", *[F.round(c, 2).alias(c) for c in ("Total_Revenue", "Profit", "Customer_Value")]
    )





def _plain_sales(spark, folder):
    """Order lines with plain column names and the date as text, month first."""
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("TransactionNo"), F.col("l_linenumber").alias("LineNo"), F.col("o_custkey").alias("CustomerNo"),
        F.col("l_returnflag").alias("Flag"), F.date_format("o_orderdate", "M/d/yyyy").alias("Date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"), F.col("l_quantity").alias("Quantity"),
    )


def _codes(column: str, source: str) -> str:
    return f"SELECT {column} AS v, dense_rank() OVER (ORDER BY {column}) - 1 AS code FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)"


_Z = {c: f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp(CAST({c} AS DOUBLE)) FROM lineitem)" for c in ("l_quantity", "l_extendedprice")}
_SCALED = {c: f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)" for c in ("l_discount", "l_tax")}
_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

_TABLE_FILES = ("nation", "customer", "supplier")


def _as_files(spark, folder, form):
    """Write three given tables as text files into the shared folder and return their paths."""
    target = new_folder(spark, "files")
    paths = []
    for name in _TABLE_FILES:
        path = f"{target}/{name}.{form}"
        source = table(spark, folder, name)
        files.write_csv(source, path) if form == "csv" else source.write.json(path)
        paths.append(path)
    return paths


def _csv_customers(spark, folder):
    return files.read_csv(spark, _as_files(spark, folder, "csv")[1])


def _json_customers(spark, folder):
    out = files.read_json(spark, _as_files(spark, folder, "json")[1])
    return out.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _written(spark, folder, name, form):
    path = f"{new_folder(spark, 'files')}/{name}.{form}"
    source = table(spark, folder, name)
    if form == "csv":
        files.write_csv(source, path)
    elif name == "orders":
        files.write_json_arrays(source, path)
    else:
        source.write.json(path)
    return files.ingest(spark, [path])[0]


def _file_counts(spark, folder):
    return files.file_counts(files.ingest(spark, _as_files(spark, folder, "csv")), _TABLE_FILES)


def _latest(spark, folder):
    target = new_folder(spark, "datasets")
    files.write_stage(table(spark, folder, "supplier"), f"{target}/merged_2")
    files.write_stage(table(spark, folder, "customer"), f"{target}/transformed_1")
    return spark.read.parquet(files.latest_dataset(spark, target))


def _deep_page(spark, folder):
    """The page in the middle of all order lines."""
    lines_ = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    pages = files.Pages(lines_, ["l_quantity", "l_orderkey", "l_linenumber"], unique=True)
    return pages.page(100, pages.rows // 200)


def _file_names(spark, folder):
    return table(spark, folder, "part").select(
        F.expr("concat(p_type, '_', p_name, '-', p_brand, CASE p_partkey % 3 WHEN 0 THEN ' health' WHEN 1 THEN ' financial' ELSE '' END, '.csv')").alias("file")
    )


_CUSTOMER_TEXT = "CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment"

# What names alone decide is given; ranges and distinct counts decide the rest.
_ROLES_FOUND = """WITH t AS (SELECT l_orderkey AS TransactionNo, l_linenumber AS LineNo, o_custkey AS CustomerNo, l_extendedprice / l_quantity AS Price, l_quantity AS Quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
""" + ",\n".join(
    f"""n{i} AS (SELECT '{c}' AS c, {whole} AS whole, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count(DISTINCT {c}) AS kinds, count(*) AS n FROM t)"""
    for i, (c, whole) in enumerate({"TransactionNo": "true", "LineNo": "true", "CustomerNo": "true", "Price": "false", "Quantity": "false"}.items())
) + """,
numbers AS (""" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(5)) + """)
SELECT * FROM (VALUES ('date', 'Date'), ('trend_date', 'Date'), ('product_name', 'ProductName'), ('transform_date', 'Date'),
  ('categorical', 'Flag'), ('categorical', 'Date'), ('categorical', 'Country'), ('categorical', 'ProductName'),
  ('text', 'Flag'), ('text', 'Date'), ('text', 'Country'), ('text', 'ProductName'), ('customer_text', 'ProductName'), ('product_text', 'ProductName'),
  ('sales_customer', 'CustomerNo'), ('sales_product', 'ProductName'), ('sales_country', 'Country'), ('sales_quantity', 'Quantity'), ('sales_price', 'Price'),
  ('sales_date', 'Date'), ('sales_product_id', 'TransactionNo')) AS named(role, "column")
UNION ALL SELECT 'id', c FROM numbers WHERE c LIKE '%No' OR kinds > 0.8 * n
UNION ALL SELECT 'price', c FROM numbers WHERE c = 'Price' OR (lo >= 0 AND hi < 1000000)
UNION ALL SELECT 'quantity', c FROM numbers WHERE c = 'Quantity' OR (whole AND hi < 10000)
UNION ALL SELECT 'categorical', c FROM numbers WHERE kinds BETWEEN 2 AND 20"""


def _role_rows(spark, folder):
    """What each sales role finds in order lines under plain names, as (role, column) rows."""
    t = _plain_sales(spark, folder).withColumn("Country", F.lit("x")).withColumn("ProductName", F.concat(F.lit("part "), F.col("LineNo")))
    found = {"date": [roles.sales_date_column(t)], "trend_date": [roles.trend_date_column(t)], "product_name": [roles.product_name_column(t)]}
    found |= {"transform_date": list(roles.transform_date_columns(t)), "id": roles.id_columns(t), "price": roles.price_columns(t)}
    found |= {"quantity": roles.quantity_columns(t), "categorical": list(roles.categorical_columns(t)), "text": tables.of_kind(t, lambda kind: kind.typeName() == "string").columns}
    found |= {"customer_text": roles.customer_text_columns(t), "product_text": roles.product_text_columns(t)}
    found |= {f"sales_{r}": [c] for r, c in roles.sales_roles(t).items()}
    rows = [F.struct(F.lit(role).alias("role"), F.lit(c).alias("column")) for role, columns in found.items() for c in columns if c]
    return spark.range(1).select(F.inline(F.array(*rows)))


QUERIES = {
    # sources and sinks
    "csv_round_trip": Query(
        _csv_customers, "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
    ),
    "json_round_trip": Query(
        _json_customers, "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
    ),
    "csv_documents": Query(
        lambda s, d: _written(s, d, "documents", "csv"), "SELECT doc_id, text, lang, source, n_chars FROM documents"
    ),
    "json_documents": Query(
        lambda s, d: _written(s, d, "documents", "json"), "SELECT doc_id, text, lang, source, n_chars FROM documents"
    ),
    "json_array": Query(
        lambda s, d: _written(s, d, "orders", "json").drop("o_orderdate"),
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    ),
    "many_files": Query(
        _file_counts,
        """SELECT 'nation' AS file, count(*) AS rows, CAST(3 AS BIGINT) AS columns FROM nation
UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'supplier', count(*), 4 FROM supplier""",
    ),
    "latest_dataset": Query(_latest, "SELECT * FROM customer"),
    "preview": Query(
        lambda s, d: files.preview(table(s, d, "customer"), order_by=["c_custkey"]),
        f"SELECT {_CUSTOMER_TEXT} FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50)",
    ),
    "export_text": Query(
        lambda s, d: files.export_text(lines(s, d).drop("l_shipdate")),
        f"WITH {_LINES} SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}" for c in LINE if c != "l_shipdate") + " FROM lines",
    ),
    "page_of_rows": Query(
        lambda s, d: files.page(table(s, d, "customer"), ["c_acctbal", "c_custkey"], 25, 3),
        "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 75",
    ),
    "deep_page": Query(
        _deep_page,
        """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity, l_orderkey, l_linenumber
LIMIT 100 OFFSET (SELECT count(*) // 200 * 100 FROM lineitem))""",
    ),
    "page_after": Query(
        lambda s, d: files.page_after(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], 100, [50, 2]),
        """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 50 OR l_orderkey = 50 AND l_linenumber > 2
ORDER BY l_orderkey, l_linenumber LIMIT 100""",
    ),
    "stable_sample": Query(
        lambda s, d: files.stable_sample(table(s, d, "orders"), ["o_orderkey"], 1000).select("o_orderkey"),
        "SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5('sample:42:' || o_orderkey), 1, 13))::BIGINT, o_orderkey LIMIT 1000",
    ),
    "catalogue_search": Query(
        lambda s, d: files.catalogue_search(
            table(s, d, "documents").withColumn("keywords", F.array("lang", "source")), "THEN", ["text"], "keywords"
        ).select("doc_id"),
        "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'then')",
    ),
    "catalogue_entry": Query(
        lambda s, d: files.catalogue_entry(_file_names(s, d), "file").withColumn("keywords", F.array_join("keywords", "|")),
        """WITH f AS (SELECT p_type || '_' || p_name || '-' || p_brand || CASE p_partkey % 3 WHEN 0 THEN ' health' WHEN 1 THEN ' financial' ELSE '' END || '.csv' AS file FROM part),
g AS (SELECT file, CASE WHEN lower(file) LIKE '%health%' OR lower(file) LIKE '%medical%' THEN 'healthcare'
  WHEN lower(file) LIKE '%finance%' OR lower(file) LIKE '%financial%' THEN 'finance' ELSE 'business' END AS category FROM f)
SELECT file AS filename, lower(regexp_replace(file, '[^a-zA-Z0-9]', '_', 'g')) AS id, category,
  array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(file, '\\.csv$', ''), '[_-]', ' ', 'g'), '\\w+|\\W'),
    lambda p: upper(p[1]) || p[2:]), '') AS name,
  category || '|' || array_to_string(list_transform(list_filter(regexp_split_to_array(file, '[_\\s.-]+'), lambda w: length(w) > 2), lambda w: lower(w)), '|') AS keywords FROM g""",
    ),
    # merging and cleaning
    "merge_side_by_side": Query(
        _merged,
        """SELECT a.id, a.name, b.id AS id_file2, b.name AS name_file2, c.id AS id_file3, c.name AS name_file3
FROM (SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) a
LEFT JOIN (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY s_name) AS r FROM supplier) b ON a.r = b.r
LEFT JOIN (SELECT p_partkey AS id, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) c ON a.r = c.r""",
    ),
    "clean_drop": Query(
        lambda s, d: clean.clean_business(lines(s, d), remove_duplicates=True, handle_missing="drop"),
        f"WITH {_LINES} SELECT DISTINCT * FROM lines WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL",
    ),
    "clean_forward": Query(
        lambda s, d: clean.clean_business(gapped_events(s, d), handle_missing="fill", order_by=["event_id"], unique=True),
        f"""WITH {_GAPPED} SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(event_type IGNORE NULLS) OVER w AS event_type
FROM gapped WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "clean_backward": Query(
        lambda s, d: clean.clean_business(
            gapped_events(s, d), handle_missing="fill", fill_method="backward", order_by=["event_id"]
        ),
        f"""WITH {_GAPPED} SELECT event_id, first_value(value IGNORE NULLS) OVER w AS value, first_value(event_type IGNORE NULLS) OVER w AS event_type
FROM gapped WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ),
    "clean_mean": Query(
        lambda s, d: clean.clean_business(lines(s, d), handle_missing="fill", fill_method="mean").select(
            *_KEYS, F.round("l_discount", 6).alias("l_discount"), "l_returnflag"
        ),
        f"""WITH {_LINES} SELECT {", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in _KEYS)},
  round(coalesce(l_discount, (SELECT avg(l_discount) FROM lines)), 6) AS l_discount, l_returnflag FROM lines""",
    ),
    "clean_dates": Query(
        lambda s, d: clean.clean_business(texts(s, d), standardize_formats=True).select("o_orderkey", "iso", "mixed"),
        """SELECT o_orderkey, o_orderdate AS iso, CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS mixed
FROM orders""",
    ),
    "clean_healthcare": Query(
        lambda s, d: clean.clean_healthcare(spaced(s, d)),
        f"""WITH {_SPACED}, m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med,
  (SELECT c_mktsegment FROM spaced WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top FROM spaced)
SELECT c_group, c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM (SELECT DISTINCT c_group, coalesce(c_acctbal, med) AS c_acctbal,
  coalesce(c_mktsegment, top) AS c_mktsegment FROM spaced, m)""",
    ),
    "cleaning_report": Query(
        lambda s, d: (lambda before: clean.cleaning_report(before, clean.clean_business(before, True, "drop")))(
            spaced(s, d).drop("c_acctbal")
        ),
        f"""WITH {_SPACED}, t AS (SELECT c_group, c_mktsegment FROM spaced)
SELECT count(*) AS original_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM t WHERE c_group IS NOT NULL AND c_mktsegment IS NOT NULL)) AS cleaned_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t WHERE c_group IS NOT NULL AND c_mktsegment IS NOT NULL)) AS rows_removed,
  count(*) FILTER (c_mktsegment IS NULL) AS missing_values_found,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows_found FROM t""",
    ),
    # features
    "business_metrics": Query(
        _metrics,
        on_sales(
            """SELECT TransactionNo, LineNo, ProductNo, CustomerNo, round(Price * Quantity, 2) AS Total_Revenue,
  round(Price * Quantity * 0.2::DOUBLE, 2) AS Profit, round(sum(Price * Quantity) OVER (PARTITION BY CustomerNo), 2) AS Customer_Value FROM sales"""
        ),
    ),
    "business_metrics_of_revenue": Query(
        lambda s, d: transform.business_metrics(
            sales(s, d, ["TransactionNo", "LineNo", "CustomerNo", "Total_Revenue"]).select("TransactionNo", "LineNo", "CustomerNo", F.col("Total_Revenue").cast("double").alias("Total_Revenue")),
            {"customer": "CustomerNo"},
        ).select("TransactionNo", "LineNo", *[F.round(c, 2).alias(c) for c in ("Profit", "Customer_Value")]),
        on_sales(
            """SELECT TransactionNo, LineNo, round(Total_Revenue::DOUBLE * 0.2::DOUBLE, 2) AS Profit,
  round(sum(Total_Revenue::DOUBLE) OVER (PARTITION BY CustomerNo), 2) AS Customer_Value FROM sales"""
        ),
    ),
    "transform_business": Query(
        lambda s, d: transform.transform_business(_plain_sales(s, d), {"price": "Price", "quantity": "Quantity", "customer": "CustomerNo"}).select(
            "TransactionNo", "LineNo", "Date_Year", "Date_Quarter", "Flag_Encoded", *[F.round(c, 2).alias(c) for c in ("Total_Revenue", "Profit", "Customer_Value")]
        ),
        """WITH t AS (SELECT l_orderkey AS TransactionNo, l_linenumber AS LineNo, o_custkey AS CustomerNo, l_returnflag AS Flag, o_orderdate AS Date,
  l_extendedprice / l_quantity AS Price, l_quantity AS Quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT *, Price * Quantity AS r FROM t), f AS (SELECT Flag, dense_rank() OVER (ORDER BY Flag) - 1 AS code FROM (SELECT DISTINCT Flag FROM t))
SELECT TransactionNo, LineNo, year(Date)::INTEGER AS "Date_Year", quarter(Date)::INTEGER AS "Date_Quarter", code::BIGINT AS "Flag_Encoded", round(r, 2) AS Total_Revenue,
  round(r * 0.2::DOUBLE, 2) AS Profit, round(sum(r) OVER (PARTITION BY CustomerNo), 2) AS Customer_Value FROM m JOIN f USING (Flag)""",
    ),
    "date_features_business": Query(
        lambda s, d: transform.date_features_business(texts(s, d)).drop("mixed"),
        """SELECT o_orderkey, o_orderdate AS iso, o_orderdate + to_seconds(800000000) AS epoch,
  year(o_orderdate)::INTEGER AS "iso_Year", quarter(o_orderdate)::INTEGER AS "iso_Quarter",
  CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate)::INTEGER END AS "mixed_Year",
  CASE WHEN o_orderkey % 50 <> 0 THEN quarter(o_orderdate)::INTEGER END AS "mixed_Quarter",
  year(o_orderdate + to_seconds(800000000))::INTEGER AS "epoch_Year", quarter(o_orderdate + to_seconds(800000000))::INTEGER AS "epoch_Quarter"
FROM orders""",
    ),
    "encode_business": Query(
        lambda s, d: transform.encode_business(
            lines(s, d).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
        ),
        f"""WITH {_LINES}, t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, coalesce(l_returnflag, 'Unknown') AS l_returnflag, l_linestatus FROM lines)
SELECT t.*, coalesce(n.code, 0)::INTEGER AS "l_linenumber_Encoded", coalesce(x.code, (SELECT count(DISTINCT l_discount) FROM t))::INTEGER AS "l_discount_Encoded",
  f.code::INTEGER AS "l_returnflag_Encoded", g.code::INTEGER AS "l_linestatus_Encoded"
FROM t LEFT JOIN ({_codes('l_linenumber', 't')}) n ON n.v = t.l_linenumber LEFT JOIN ({_codes('l_discount', 't')}) x ON x.v = t.l_discount
LEFT JOIN ({_codes('l_returnflag', 't')}) f ON f.v = t.l_returnflag LEFT JOIN ({_codes('l_linestatus', 't')}) g ON g.v = t.l_linestatus""",
    ),
    "encode_healthcare": Query(
        lambda s, d: transform.encode_healthcare(lines(s, d).select(*_KEYS, "l_returnflag", "l_linestatus")),
        f"""WITH {_LINES}, t AS (SELECT {_KEY}, l_returnflag, l_linestatus FROM lines)
SELECT t.*, coalesce(f.code, -1)::INTEGER AS "l_returnflag_Encoded", coalesce(g.code, -1)::INTEGER AS "l_linestatus_Encoded"
FROM t LEFT JOIN ({_codes('l_returnflag', 't')}) f ON f.v = t.l_returnflag LEFT JOIN ({_codes('l_linestatus', 't')}) g ON g.v = t.l_linestatus""",
    ),
    "risk_score": Query(
        lambda s, d: transform.risk_score(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select(
            *_KEYS, F.round("Patient_Risk_Score", 6).alias("Patient_Risk_Score")
        ),
        f'SELECT {_KEY}, round(({_Z["l_quantity"]} + {_Z["l_extendedprice"]}) / 2, 6) AS "Patient_Risk_Score" FROM lineitem',
    ),
    "treatment_scores": Query(
        lambda s, d: transform.treatment_scores(table(s, d, "lineitem"), ["l_discount", "l_tax"]).select(
            *_KEYS, *[F.round(c, 6).alias(c) for c in ("Treatment_Effectiveness", "Treatment_Outcome")]
        ),
        f'SELECT {_KEY}, round(({_SCALED["l_discount"]} + {_SCALED["l_tax"]}) / 2, 6) AS "Treatment_Effectiveness", '
        f'round(({_SCALED["l_discount"]} + {_SCALED["l_tax"]}) / 2, 6) AS "Treatment_Outcome" FROM lineitem',
    ),
    "healthcare_cost": Query(
        lambda s, d: transform.healthcare_cost(lines(s, d), ["l_extendedprice", "l_discount"]).select(
            *_KEYS, F.round("Healthcare_Cost", 2).alias("Healthcare_Cost")
        ),
        f'WITH {_LINES} SELECT {_KEY}, round(l_extendedprice + l_discount, 2) AS "Healthcare_Cost" FROM lines',
    ),
    "patient_severity": Query(
        lambda s, d: transform.patient_severity(table(s, d, "lineitem"), ["l_returnflag", "l_discount"]).select(
            *_KEYS, F.round("Patient_Severity", 6).alias("Patient_Severity")
        ),
        f"""SELECT {_KEY}, round(((SELECT count(DISTINCT l_returnflag) FROM lineitem) / 100.0::DOUBLE + {_SCALED["l_discount"]}) / 2, 6) AS "Patient_Severity" FROM lineitem""",
    ),
    "date_features_healthcare": Query(
        lambda s, d: (lambda a: transform.date_features_healthcare(a.select("AdmissionId", *time_columns(a)), time_columns(a)))(
            admissions(s, d)
        ),
        on_admissions(
            """SELECT AdmissionId, "Date of Admission", "Discharge Date", """
            + ", ".join(
                f'{f}("{c}")::INTEGER AS "{c}_{n}"'
                for c in ("Date of Admission", "Discharge Date")
                for f, n in (("year", "Year"), ("month", "Month"), ("quarter", "Quarter"))
            )
            + " FROM admissions"
        ),
    ),
    "sales_roles_found": Query(_role_rows, _ROLES_FOUND),
    "transform_healthcare": Query(
        lambda s, d: (lambda a: transform.transform_healthcare(a, clinical_columns(a)))(admissions(s, d)),
        on_admissions(
            """SELECT *, CAST("Billing Amount" AS DOUBLE) AS "Healthcare_Cost", (SELECT count(DISTINCT "Medical Condition") FROM admissions) / 100.0::DOUBLE AS "Patient_Severity", """
            + ", ".join(
                f'{f}("{c}")::INTEGER AS "{c}_{n}"'
                for c in ("Date of Admission", "Discharge Date")
                for f, n in (("year", "Year"), ("month", "Month"), ("quarter", "Quarter"))
            )
            + ", "
            + ", ".join(
                f'dense_rank() OVER (ORDER BY "{c}") - 1 AS "{c}_Encoded"'
                for c in ("Name", "AgeText", "Gender", "Blood Type", "Medical Condition", "Admission Type", "Insurance Provider", "Medication", "Test Results")
            )
            + " FROM admissions"
        ),
    ),
}
