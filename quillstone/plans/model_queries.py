"""Features, targets and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, labels, models
from ..sources.views import ADMISSION_ROLES as ROLES, SALES_ROLES, admissions, sales, staged_admissions, staged_sales, table
from .registry import Query, on_admissions, on_sales

_CUSTOMER = ["CustomerNo", "Date", "Total_Revenue", "Quantity"]
_KEY = ["TransactionNo", "LineNo", "ProductNo"]
_MEASURES = ["Total_Revenue", "Quantity", "Price"]

_CHURN = """features AS (SELECT CustomerNo AS customer, min(Date) AS first_purchase, max(Date) AS last_purchase, count(*) AS transactions,
  CAST(sum(Total_Revenue) AS DOUBLE) AS revenue, CAST(sum(Total_Revenue) AS DOUBLE) / count(*) AS mean_revenue, sum(Quantity) AS quantity,
  date_diff('day', max(Date), (SELECT max(Date) FROM sales)) AS days_since_last FROM sales GROUP BY 1)"""

_SEGMENTS = """features AS (SELECT CustomerNo AS customer, CAST(sum(Total_Revenue) AS DOUBLE) AS monetary, count(Date) AS frequency,
  sum(Quantity) AS quantity, date_diff('day', max(Date), (SELECT max(Date) FROM sales)) AS recency FROM sales GROUP BY 1)"""

_CUTS = """cuts AS (SELECT quantile_cont(CAST(Age AS DOUBLE), 0.25) AS a25, quantile_cont(CAST(Age AS DOUBLE), 0.75) AS a75,
  quantile_cont(CAST("Billing Amount" AS DOUBLE), 0.75) AS c75, quantile_cont(CAST(date_diff('day', "Date of Admission", "Discharge Date") AS DOUBLE), 0.75) AS s75 FROM admissions)"""

_COMMON = """common AS (SELECT "Medical Condition" AS c, count(*) AS n, CAST(sum("Billing Amount") AS DOUBLE) / count(*) AS mean_cost FROM admissions GROUP BY 1)"""

_SIMILAR = """bought AS (SELECT CustomerNo, ProductName AS product, count(*)::DOUBLE AS n FROM sales GROUP BY 1, 2),
many AS (SELECT count(DISTINCT CustomerNo)::DOUBLE AS customers FROM bought),
sums AS (SELECT product, sum(n) AS s, customers * sum(n * n) - sum(n) * sum(n) AS v FROM bought, many GROUP BY product, customers),
met AS (SELECT a.product AS one, b.product AS other, sum(a.n * b.n) AS total FROM bought a JOIN bought b ON a.CustomerNo = b.CustomerNo AND a.product <> b.product GROUP BY 1, 2),
pairs AS (SELECT a.product, b.product AS similar_product, (customers * coalesce(total, 0) - a.s * b.s) / sqrt(a.v * b.v) AS raw
  FROM many, sums a JOIN sums b ON a.product <> b.product LEFT JOIN met ON one = a.product AND other = b.product WHERE a.v > 0 AND b.v > 0)"""

# A plain prediction to measure: late orders are the dear ones; price is 5 000 per unit.
_BINARY = "t AS (SELECT CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS prediction FROM orders)"


def _binary(spark, folder):
    return table(spark, folder, "orders").select(
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("label"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("prediction"),
    )


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c == "value" else c for c in df.columns])


def _model(name):
    return Query(lambda s, d: _rounded(models.MODELS[name](staged_admissions(s, d), ROLES).report))


QUERIES = {
    "churn_features": Query(
        lambda s, d: labels.churn_features(sales(s, d, _CUSTOMER), SALES_ROLES).withColumn("mean_revenue", F.round("mean_revenue", 4)),
        on_sales(
            """SELECT * REPLACE (round(mean_revenue, 4) AS mean_revenue),
  CAST(days_since_last > 90 OR transactions < (SELECT quantile_cont(CAST(transactions AS DOUBLE), 0.3) FROM features) AS INTEGER) AS churn FROM features""",
            _CHURN,
        ),
    ),
    "segment_features": Query(
        lambda s, d: labels.segment_features(sales(s, d, _CUSTOMER), SALES_ROLES), on_sales("SELECT * FROM features", _SEGMENTS)
    ),
    "value_groups": Query(
        lambda s, d: labels.value_groups(labels.segment_features(sales(s, d, _CUSTOMER), SALES_ROLES)),
        on_sales(
            "\nUNION ALL ".join(
                f"SELECT '{name}' AS value_group, count(*) FILTER ({test}) AS customers FROM features, q"
                for name, test in (
                    ("High Value", "monetary > m80 AND frequency > f60"),
                    ("Medium Value", "monetary > m40 AND monetary <= m80"),
                    ("Low Value", "monetary <= m40"),
                    ("New Customers", "frequency <= f30 AND monetary > m60"),
                    ("At Risk", "frequency > f70 AND monetary <= m30"),
                )
            ),
            _SEGMENTS,
            "q AS (SELECT "
            + ", ".join(
                f"quantile_cont(CAST({c} AS DOUBLE), 0.{p}) AS {c[0]}{p * 10}"
                for c, ps in (("monetary", (3, 4, 6, 8)), ("frequency", (3, 6, 7)))
                for p in ps
            )
            + " FROM features)",
        ),
    ),
    "item_similarity": Query(
        lambda s, d: models.item_similarity(staged_sales(s, d, ["CustomerNo", "ProductName"]), SALES_ROLES),
        on_sales(
            """SELECT product, CAST(place AS INTEGER) AS rank, similar_product, round(raw, 6) AS similarity FROM (SELECT *,
  row_number() OVER (PARTITION BY product ORDER BY raw DESC, similar_product) AS place FROM pairs) WHERE place <= 5""",
            _SIMILAR,
        ),
    ),
    "item_popularity": Query(
        lambda s, d: models.item_popularity(sales(s, d, ["ProductName"]), SALES_ROLES),
        on_sales("SELECT ProductName AS product, count(*) AS n FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    ),
    "meds_by_condition": Query(
        lambda s, d: labels.meds_by_condition(admissions(s, d), "Medical Condition", "Medication"),
        on_admissions(
            """SELECT condition, CAST(place AS INTEGER) AS rank, medicine, n FROM (SELECT "Medical Condition" AS condition, Medication AS medicine, count(*) AS n,
  row_number() OVER (PARTITION BY "Medical Condition" ORDER BY count(*) DESC, Medication) AS place,
  sum(count(*)) OVER (PARTITION BY "Medical Condition") AS held FROM admissions GROUP BY 1, 2) WHERE place <= 3 AND held > 5"""
        ),
    ),
    "risk_label": Query(
        lambda s, d: labels.risk_label(staged_admissions(s, d), ROLES).select("AdmissionId", "risk_level"),
        on_admissions(
            """SELECT AdmissionId, CAST(CASE WHEN n < (SELECT quantile_cont(CAST(n AS DOUBLE), 0.3) FROM common) THEN greatest(level, 1) ELSE level END AS INTEGER) AS risk_level
FROM (SELECT *, CASE WHEN "Billing Amount"::DOUBLE >= c75 THEN 2 WHEN Age >= a75 THEN 2 WHEN Age >= a25 THEN 1 ELSE 0 END AS level
  FROM admissions JOIN common ON c = "Medical Condition", cuts)""",
            _CUTS,
            _COMMON,
        ),
    ),
    "discharge_label": Query(
        lambda s, d: labels.discharge_label(staged_admissions(s, d), ROLES).select("AdmissionId", "care_level"),
        on_admissions(
            """SELECT AdmissionId, CASE WHEN n >= (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM common) THEN 0
  WHEN "Billing Amount"::DOUBLE >= c75 OR Age >= a75 THEN 2 ELSE 1 END AS care_level FROM admissions JOIN common ON c = "Medical Condition", cuts""",
            _CUTS,
            _COMMON,
        ),
    ),
    "outcome_label": Query(
        lambda s, d: labels.outcome_label(staged_admissions(s, d), ROLES).select("AdmissionId", "outcome"),
        on_admissions(
            """SELECT AdmissionId, CASE WHEN "Billing Amount"::DOUBLE > mean_cost * 1.5::DOUBLE
  OR date_diff('day', "Date of Admission", "Discharge Date") >= s75 THEN 0 ELSE 1 END AS outcome FROM admissions JOIN common ON c = "Medical Condition", cuts""",
            _CUTS,
            _COMMON,
        ),
    ),
    "readmission_label": Query(
        lambda s, d: labels.readmission_label(admissions(s, d), ROLES, noise=0.0).select("AdmissionId", "readmission"),
        on_admissions(
            "SELECT AdmissionId, CASE WHEN count(*) OVER (PARTITION BY Name) > 1 THEN 1 ELSE 0 END AS readmission FROM admissions"
        ),
    ),
    "los_label": Query(
        lambda s, d: labels.without_outliers(labels.los_label(staged_admissions(s, d), ROLES), "stay_days").select("AdmissionId", "stay_days"),
        on_admissions(
            """SELECT AdmissionId, d AS stay_days FROM t, (SELECT avg(d) AS m, stddev_samp(d) AS s FROM t) WHERE d BETWEEN m - 3 * s AND m + 3 * s""",
            """t AS (SELECT AdmissionId, CAST(date_diff('day', "Date of Admission", "Discharge Date") AS DOUBLE) AS d FROM admissions)""",
        ),
    ),
    "classification_metrics": Query(
        lambda s, d: _rounded(models.classification_metrics(_binary(s, d), "label", "prediction")),
        f"""WITH {_BINARY}, c AS (SELECT sum(label * prediction)::DOUBLE AS tp, sum((1 - label) * prediction)::DOUBLE AS fp,
  sum(label * (1 - prediction))::DOUBLE AS fn, sum((1 - label) * (1 - prediction))::DOUBLE AS tn FROM t)
SELECT 'metric' AS section, 'accuracy' AS key, round((tp + tn) / (tp + fp + fn + tn), 6) AS value FROM c
UNION ALL SELECT 'metric', 'precision', round(tp / (tp + fp), 6) FROM c UNION ALL SELECT 'metric', 'recall', round(tp / (tp + fn), 6) FROM c
UNION ALL SELECT 'metric', 'f1_score', round(2 * tp / (2 * tp + fp + fn), 6) FROM c
UNION ALL SELECT 'confusion', 'true_positive', tp FROM c UNION ALL SELECT 'confusion', 'false_positive', fp FROM c
UNION ALL SELECT 'confusion', 'false_negative', fn FROM c UNION ALL SELECT 'confusion', 'true_negative', tn FROM c""",
    ),
    "regression_metrics": Query(
        lambda s, d: models.regression_metrics(
            table(s, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess")), "l_extendedprice", "guess"
        ).select("section", "key", F.round("value", 2).alias("value")),
        """WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM t)
SELECT 'metric' AS section, 'mse' AS key, round(mse, 2) AS value FROM m UNION ALL SELECT 'metric', 'rmse', round(sqrt(mse), 2) FROM m
UNION ALL SELECT 'metric', 'mae', round(mae, 2) FROM m UNION ALL SELECT 'metric', 'r2_score', round(1 - mse / v, 2) FROM m""",
    ),
    # fits: rows only
    "ml_demand": Query(
        lambda s, d: _rounded(models.demand(sales(s, d, [*_KEY, "Date", "Quantity", "Price"]), SALES_ROLES, _KEY).report)
    ),
    "ml_churn": Query(lambda s, d: _rounded(models.churn(sales(s, d, _CUSTOMER), SALES_ROLES).report)),
    "ml_segments": Query(lambda s, d: models.segments(sales(s, d, _CUSTOMER), SALES_ROLES).report),
    "ml_anomaly": Query(
        lambda s, d: _rounded(
            anomaly.anomaly_report(anomaly.isolation_scores(sales(s, d, [*_KEY, *_MEASURES]), _MEASURES, _KEY), _MEASURES)
        )
    ),
    "ml_readmission": _model("readmission"),
    "ml_cost": _model("cost"),
    "ml_risk": _model("risk"),
    "ml_outcome": _model("outcome"),
    "ml_length_of_stay": _model("lengthofstay"),
    "ml_medication": _model("medication"),
    "ml_discharge": _model("discharge"),
    "ml_train_all": Query(lambda s, d: _rounded(models.train(admissions(s, d), ROLES))),
}
