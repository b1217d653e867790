"""A registered query: a Spark job over the given tables and, where possible, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


SALES = """sales AS (
SELECT l.l_orderkey AS TransactionNo, l.l_linenumber AS LineNo, o.o_custkey AS CustomerNo,
       l.l_partkey AS ProductNo, p.p_name AS ProductName, o.o_orderdate AS Date,
       l.l_extendedprice / l.l_quantity AS Price, l.l_quantity AS Quantity, n.n_name AS Country,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS Total_Revenue,
       CAST(l.l_extendedprice * 0.2 AS DECIMAL(18,2)) AS Profit
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey)"""

ADMISSIONS = """admissions AS (
SELECT o_orderkey AS AdmissionId, c_name AS Name, (o_custkey * 7) % 90 + 1 AS Age,
  CASE o_orderkey % 4 WHEN 0 THEN '71-80' WHEN 1 THEN '65+' WHEN 2 THEN '42' ELSE 'n/a' END AS AgeText,
  CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
  (['A+','A-','B+','B-','AB+','AB-','O+','O-'])[o_custkey % 8 + 1] AS "Blood Type",
  (['Diabetes','Hypertension','Asthma','Cancer','Obesity','Arthritis'])[o_orderkey % 6 + 1] AS "Medical Condition",
  CASE o_orderstatus WHEN 'F' THEN 'Emergency' WHEN 'O' THEN 'Elective' ELSE 'Urgent' END AS "Admission Type",
  (['Medicare','Aetna','Cigna','UnitedHealthcare','Blue Cross'])[c_nationkey % 5 + 1] AS "Insurance Provider",
  CASE WHEN o_orderkey % 4 = 0
    THEN (['Aspirin','Ibuprofen','Lipitor','Paracetamol','Penicillin'])[o_custkey % 5 + 1] || ', '
      || (['Aspirin','Ibuprofen','Lipitor','Paracetamol','Penicillin'])[(o_custkey + 1) % 5 + 1]
    ELSE (['Aspirin','Ibuprofen','Lipitor','Paracetamol','Penicillin'])[o_custkey % 5 + 1] END AS Medication,
  (['Normal','Abnormal','Inconclusive'])[o_orderkey % 3 + 1] AS "Test Results",
  CAST(o_totalprice AS DECIMAL(18,2)) AS "Billing Amount", o_orderkey % 400 + 101 AS "Room Number",
  o_orderdate AS "Date of Admission", o_orderdate + to_days(CAST(o_orderkey % 30 + 1 AS INTEGER)) AS "Discharge Date"
FROM orders JOIN customer ON o_custkey = c_custkey)"""


def on_sales(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([SALES, *more]) + "\n" + body


def on_admissions(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([ADMISSIONS, *more]) + "\n" + body
