"""The two modelled tables that the jobs run on: sales lines and hospital admissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage_table

SALES_ROLES = {
    "date": "Date",
    "customer": "CustomerNo",
    "product": "ProductName",
    "product_id": "ProductNo",
    "price": "Price",
    "quantity": "Quantity",
    "country": "Country",
    "revenue": "Total_Revenue",
    "profit": "Profit",
}

# Fixed values of the admissions view.
BLOOD_TYPES = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
CONDITIONS = ("Diabetes", "Hypertension", "Asthma", "Cancer", "Obesity", "Arthritis")
INSURERS = ("Medicare", "Aetna", "Cigna", "UnitedHealthcare", "Blue Cross")
MEDICINES = ("Aspirin", "Ibuprofen", "Lipitor", "Paracetamol", "Penicillin")
TEST_RESULTS = ("Normal", "Abnormal", "Inconclusive")
AGE_TEXTS = ("71-80", "65+", "42", "n/a")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per order line. Only the tables that the wanted columns need are joined."""
    lines = table(spark, folder, "lineitem")
    sources: dict[str, tuple[str, Column]] = {
        "TransactionNo": ("l", F.col("l_orderkey")),
        "LineNo": ("l", F.col("l_linenumber")),
        "CustomerNo": ("o", F.col("o_custkey")),
        "ProductNo": ("l", F.col("l_partkey")),
        "ProductName": ("p", F.col("p_name")),
        "Date": ("o", F.col("o_orderdate")),
        "Price": ("l", F.col("l_extendedprice") / F.col("l_quantity")),
        "Quantity": ("l", F.col("l_quantity")),
        "Country": ("n", F.col("n_name")),
        "Total_Revenue": ("l", F.col("l_extendedprice").cast("decimal(18,2)")),
        "Profit": ("l", (F.col("l_extendedprice") * 0.2).cast("decimal(18,2)")),
    }
    wanted = list(sources) if columns is None else list(columns)
    needs = {sources[c][0] for c in wanted}
    joined = lines
    if needs & {"o", "n"}:
        joined = joined.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "n" in needs:
        joined = joined.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
    if "p" in needs:
        joined = joined.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*[sources[c][1].alias(c) for c in wanted])


def staged_sales(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """The wanted columns of ``sales`` written out once, for jobs that pass over them several times."""
    return stage_table(sales(spark, folder, columns))


def _choice(column: Column, values: Sequence[str]) -> Column:
    number = (column % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), number)


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per hospital stay, derived from orders and customers by fixed arithmetic."""
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key, person, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    medicine = _choice(person, MEDICINES)
    two = F.concat(medicine, F.lit(", "), _choice(person + 1, MEDICINES))
    return joined.select(
        key.alias("AdmissionId"),
        F.col("c_name").alias("Name"),
        ((person * 7) % 90 + 1).alias("Age"),
        _choice(key, AGE_TEXTS).alias("AgeText"),
        F.when(person % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        _choice(person, BLOOD_TYPES).alias("Blood Type"),
        _choice(key, CONDITIONS).alias("Medical Condition"),
        F.when(F.col("o_orderstatus") == "F", "Emergency")
        .when(F.col("o_orderstatus") == "O", "Elective")
        .otherwise("Urgent")
        .alias("Admission Type"),
        _choice(nation, INSURERS).alias("Insurance Provider"),
        F.when(key % 4 == 0, two).otherwise(medicine).alias("Medication"),
        _choice(key, TEST_RESULTS).alias("Test Results"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("Billing Amount"),
        (key % 400 + 101).alias("Room Number"),
        F.col("o_orderdate").alias("Date of Admission"),
        F.timestamp_add("DAY", (key % 30 + 1).cast("int"), F.col("o_orderdate")).alias("Discharge Date"),
    )


ADMISSION_ROLES = {
    "id": "AdmissionId",
    "patient": "Name",
    "age": "Age",
    "gender": "Gender",
    "blood_type": "Blood Type",
    "condition": "Medical Condition",
    "admission_type": "Admission Type",
    "insurer": "Insurance Provider",
    "medication": "Medication",
    "result": "Test Results",
    "cost": "Billing Amount",
    "room": "Room Number",
    "admitted": "Date of Admission",
    "discharged": "Discharge Date",
}


def staged_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """``admissions`` written out once, for jobs that pass over it several times."""
    return stage_table(admissions(spark, folder))
