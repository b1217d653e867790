"""Clinical queries over the ``admissions`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.roles import clinical_columns
from ..operators import clinical as job
from ..sources.views import ADMISSION_ROLES as ROLES, admissions, staged_admissions, table
from .registry import Query, on_admissions

_DIAGNOSES = ["Medical Condition"]
_MEDICINES = ["Medication"]
_VITALS = ["Age", "Blood Type", "Test Results", "Room Number"]
_LABS = ["Billing Amount", "Test Results", "Admission Type"]
_COSTS = ["Billing Amount"]


def _spread(c: str, times: float) -> str:
    v = f'CAST("{c}" AS DOUBLE)'
    mean, std = f"(SELECT avg({v}) FROM admissions)", f"(SELECT stddev_samp({v}) FROM admissions)"
    return f"({v} < {mean} - {times} * {std} OR {v} > {mean} + {times} * {std})"


def _percent(part: str, whole: str) -> str:
    return f"CAST(trunc(least(100, CAST({part} AS DOUBLE) / ({whole}) * 100)) AS BIGINT)"


_FACTORS = "factors AS (" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS factor, {score} AS score, count(*) AS rows FROM admissions"
    for name, score in {
        "Age": _percent("count(*) FILTER (Age < 5 OR Age > 65)", "count(Age)"),
        "Chronic Conditions": _percent(
            """count(*) FILTER (regexp_matches("Medical Condition", '(?i)chronic|diabetes|hypertension|heart'))""", "count(*)"
        ),
        "Medication History": _percent("count(*) FILTER (Medication <> '')", "count(*)"),
        "Lab Results": _percent(f"count(*) FILTER ({_spread('Billing Amount', 2)})", "count(*) * 3"),
        "Vital Signs": _percent(
            f"(count(*) FILTER ({_spread('Age', 1)}) + count(*) FILTER ({_spread('Room Number', 1)}))", "count(*) * 4"
        ),
    }.items()
) + ")"


def _numeric_reading(c: str, one: float, two: float) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (NOT {_spread(c, one)}) AS normal, count(*) FILTER ({_spread(c, one)}) AS abnormal,
  count(*) FILTER ({_spread(c, two)}) AS critical FROM admissions"""


def _words(words) -> str:
    return r"(^|[^\p{L}\p{N}])(" + "|".join(w.replace("+", "\\+") for w in words) + r")($|[^\p{L}\p{N}])"


def _text_reading(c: str, abnormal, critical) -> str:
    t = f'lower("{c}")'
    bad, worse = f"regexp_matches({t}, '{_words(abnormal)}')", f"regexp_matches({t}, '{_words(critical)}')"
    return f"""SELECT '{c}' AS "column", count(*) FILTER (NOT {bad} AND NOT {worse}) AS normal, count(*) FILTER ({bad} AND NOT {worse}) AS abnormal,
  count(*) FILTER ({worse}) AS critical FROM admissions"""


def _overlapping_reading(c: str, normal, abnormal, critical) -> str:
    t = f'lower("{c}")'
    n, a, k = (f"count(*) FILTER (regexp_matches({t}, '{'|'.join(w)}'))" for w in (normal, abnormal, critical))
    return f"""SELECT '{c}' AS "column", {n} + greatest(0, count(*) - ({n} + {a} + {k})) AS normal, {a} AS abnormal, {k} AS critical FROM admissions"""


_POOLED = "pooled AS (SELECT trim(\"Medical Condition\") AS value, count(*) AS n FROM admissions GROUP BY 1)"

_SETS = """sets AS (SELECT list_sort(list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i)) AS u
FROM (SELECT list_transform(string_split(Medication, ','), lambda p: trim(p)) AS m FROM admissions))"""


def _by(c: str, label: str, k: int, tail: str) -> str:
    return f"""(SELECT '{label}: ' || "{c}" AS category, CAST(trunc(sum("Billing Amount")) AS BIGINT) AS {tail} FROM admissions
GROUP BY "{c}" ORDER BY sum("Billing Amount") DESC, "{c}" LIMIT {k})"""


def _with_outcomes(spark, folder):
    texts = F.create_map(
        F.lit("Normal"), F.lit("Recovered well"), F.lit("Abnormal"), F.lit("Stable"), F.lit("Inconclusive"), F.lit("Moderate, then WORSE")
    )
    return admissions(spark, folder).select("Name", texts[F.col("Test Results")].alias("Outcome"))


def _bands(labels, quantiles, tail) -> str:
    v = 'CAST("Billing Amount" AS DOUBLE)'
    edges = [f"(SELECT quantile_cont({v}, {q}) FROM admissions)" for q in quantiles]
    tests = []
    for i, label in enumerate(labels):
        low = f"{v} > {edges[i - 1]}" if i else "true"
        high = f"{v} <= {edges[i]}" if i < len(edges) else "true"
        tests.append(f"""SELECT '{label}' AS category, CAST(trunc(sum("Billing Amount")) AS BIGINT) AS {tail} FROM admissions WHERE {low} AND {high}""")
    return "\nUNION ALL ".join(tests)


_MONTHLY = """monthly AS (SELECT m AS month, (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[m] AS label, count("Date of Admission") AS records
FROM range(1, 13) r(m) LEFT JOIN admissions ON month("Date of Admission") = m
  AND year("Date of Admission") = (SELECT max(year("Date of Admission")) FROM admissions) GROUP BY m)"""

QUERIES = {
    "demographics": Query(
        lambda s, d: job.demographics(admissions(s, d), "Age"),
        on_admissions(
            """SELECT label AS age_group, count(Age) AS n FROM (VALUES ('0-18', 0, 19), ('19-35', 19, 36), ('36-50', 36, 51), ('51-65', 51, 66),
  ('65+', 66, 121)) AS b(label, lo, hi) LEFT JOIN admissions ON Age >= lo AND Age < hi GROUP BY 1"""
        ),
    ),
    "demographics_without_age": Query(
        lambda s, d: job.demographics(table(s, d, "customer").select("c_acctbal", "c_name")),
        """WITH m AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 5 AS w FROM customer)
SELECT (['0-18','19-35','36-50','51-65','65+'])[i] AS age_group, count(c_acctbal) AS n FROM range(1, 6) r(i), m
LEFT JOIN customer ON c_acctbal >= lo + (i - 1) * w AND c_acctbal < lo + i * w GROUP BY 1""",
    ),
    "risk_factors": Query(
        lambda s, d: job.risk_factors(staged_admissions(s, d), "Age", _DIAGNOSES, _MEDICINES, _LABS, _VITALS),
        on_admissions("SELECT * FROM factors", _FACTORS),
    ),
    "risk_sizes": Query(
        lambda s, d: job.risk_sizes(job.risk_factors(staged_admissions(s, d), "Age", _DIAGNOSES, _MEDICINES, _LABS, _VITALS)),
        on_admissions(
            """SELECT high_risk, medium_risk, rows - high_risk - medium_risk AS low_risk FROM (SELECT max(rows) AS rows,
  CAST(trunc(max(rows) * (avg(score) / 100) * 0.3::DOUBLE) AS BIGINT) AS high_risk,
  CAST(trunc(max(rows) * (avg(score) / 100) * 0.5::DOUBLE) AS BIGINT) AS medium_risk FROM factors)""",
            _FACTORS,
        ),
    ),
    "vital_signs": Query(
        lambda s, d: job.vital_signs(staged_admissions(s, d), _VITALS),
        on_admissions(
            "\nUNION ALL ".join(
                [_numeric_reading("Age", 1, 2), _numeric_reading("Room Number", 1, 2)]
                + [_text_reading(c, job.VITAL_ABNORMAL, job.VITAL_CRITICAL) for c in ("Blood Type", "Test Results")]
            )
        ),
    ),
    "vital_signs_overlapping": Query(
        lambda s, d: job.vital_signs(staged_admissions(s, d), ["Blood Type", "Test Results", "Admission Type"], compat=True),
        on_admissions(
            "\nUNION ALL ".join(
                _overlapping_reading(c, job.VITAL_NORMAL, job.VITAL_ABNORMAL, job.VITAL_CRITICAL)
                for c in ("Blood Type", "Test Results", "Admission Type")
            )
        ),
    ),
    "lab_results": Query(
        lambda s, d: job.lab_results(admissions(s, d), _LABS),
        on_admissions(
            "\nUNION ALL ".join(
                [_numeric_reading("Billing Amount", 2, 3)]
                + [_text_reading(c, job.LAB_ABNORMAL, job.LAB_CRITICAL) for c in ("Test Results", "Admission Type")]
            )
        ),
    ),
    "lab_results_overlapping": Query(
        lambda s, d: job.lab_results(admissions(s, d), ["Test Results", "Admission Type"], compat=True),
        on_admissions(
            "\nUNION ALL ".join(
                _overlapping_reading(c, job.LAB_NORMAL, job.LAB_ABNORMAL, job.LAB_CRITICAL) for c in ("Test Results", "Admission Type")
            )
        ),
    ),
    "outcomes": Query(
        lambda s, d: job.outcomes(_with_outcomes(s, d), ["Outcome"]),
        on_admissions(
            """SELECT *, CAST(trunc(CAST(excellent + good AS DOUBLE) / (excellent + good + fair + poor) * 100) AS BIGINT) AS success_rate FROM (
SELECT count(*) FILTER ("Test Results" = 'Normal') AS excellent, count(*) FILTER ("Test Results" = 'Abnormal') AS good,
  count(*) FILTER ("Test Results" = 'Inconclusive') AS fair, count(*) FILTER ("Test Results" = 'Inconclusive') AS poor FROM admissions)"""
        ),
    ),
    "outcomes_by_completeness": Query(
        lambda s, d: job.outcomes(admissions(s, d), ["Medical Condition", "Discharge Date"]),
        on_admissions(
            """SELECT *, CAST(trunc(CAST(excellent + good AS DOUBLE) / (excellent + good + fair + poor) * 100) AS BIGINT) AS success_rate FROM (
SELECT count(*) // 2 AS excellent, count(*) // 4 AS good, CAST(0 AS BIGINT) AS fair, CAST(0 AS BIGINT) AS poor FROM admissions)"""
        ),
    ),
    "diagnosis_patterns": Query(
        lambda s, d: job.diagnosis_patterns(admissions(s, d), _DIAGNOSES),
        on_admissions("SELECT value, n FROM pooled ORDER BY n DESC, value LIMIT 10", _POOLED),
    ),
    "diagnosis_score": Query(
        lambda s, d: job.diagnosis_score(admissions(s, d), _DIAGNOSES),
        on_admissions(
            """SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_diagnoses,
  least(100, CAST(trunc((1 - count(*) / sum(n)) * 100 + 80) AS BIGINT)) AS accuracy_rate FROM pooled""",
            _POOLED,
        ),
    ),
    "treatment_effectiveness": Query(
        lambda s, d: job.treatment_effectiveness(admissions(s, d), ["Medication", "Room Number"]),
        on_admissions(
            """SELECT 'Medication' AS "column", 'Medication' AS treatment, least(95, greatest(60, CAST(trunc(60
  + count(*) FILTER (trim(Medication) <> '')::DOUBLE / count(*) * 100 * 0.3::DOUBLE + least(1.0::DOUBLE, count(DISTINCT Medication) / 50) * 10) AS BIGINT))) AS score FROM admissions
UNION ALL SELECT 'Room Number', 'Room Number', least(95, greatest(65, CAST(trunc(count("Room Number")::DOUBLE / count(*) * 100) AS BIGINT))) FROM admissions"""
        ),
    ),
    "prescription_patterns": Query(
        lambda s, d: job.prescription_patterns(admissions(s, d), _MEDICINES),
        on_admissions("SELECT Medication AS value, count(*) AS n FROM admissions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ),
    "prescription_totals": Query(
        lambda s, d: job.prescription_totals(admissions(s, d), _MEDICINES),
        on_admissions("SELECT count(*) AS total_prescriptions, count(DISTINCT Medication) AS unique_medications FROM admissions"),
    ),
    "medication_adherence": Query(
        lambda s, d: job.medication_adherence(
            admissions(s, d).withColumn("Second", F.expr("CASE WHEN AdmissionId % 3 = 0 THEN Medication END")), ["Medication", "Second"]
        ),
        on_admissions(
            """SELECT round(rate, 1) AS adherence_rate, CAST(trunc(n * least(0.7::DOUBLE, rate / 100)) AS BIGINT) AS high,
  CAST(trunc(n * least(0.2::DOUBLE, (100 - rate) / 100)) AS BIGINT) AS medium,
  CAST(trunc(n * greatest(0.1::DOUBLE, (100 - rate * 1.5::DOUBLE) / 100)) AS BIGINT) AS low,
  CAST(trunc(n * (1 - rate / 100)) AS BIGINT) AS missed_doses, n AS total_patients
FROM (SELECT count(*) AS n, CAST(count(*) + count(*) FILTER (AdmissionId % 3 = 0) AS DOUBLE) / (count(*) * 2) * 100 AS rate FROM admissions)"""
        ),
    ),
    "drug_combinations": Query(
        lambda s, d: job.drug_combinations(admissions(s, d), _MEDICINES),
        on_admissions(
            "SELECT array_to_string(u, ' + ') AS combination, count(*) AS n FROM sets WHERE len(u) > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
            _SETS,
        ),
    ),
    "drug_risk": Query(
        lambda s, d: job.drug_risk(admissions(s, d), _MEDICINES),
        on_admissions(
            """SELECT count(*) FILTER (len(u) > 1) AS potential_interactions, count(*) FILTER (len(u) <= 1) AS low_risk,
  count(*) FILTER (len(u) BETWEEN 2 AND 3) AS medium_risk, count(*) FILTER (len(u) > 3) AS high_risk,
  count(*) FILTER (len(u) > 0) AS patients_with_medicines, round(count(*) FILTER (len(u) > 1)::DOUBLE / count(*) * 100, 1) AS interaction_rate FROM sets""",
            _SETS,
        ),
    ),
    **{
        name: Query(
            lambda s, d, compat=compat: job.prescription_costs(admissions(s, d), "Medication", "Billing Amount", compat=compat),
            on_admissions(
                f"""SELECT Medication AS medicine, CAST(sum("Billing Amount") AS DOUBLE) AS cost FROM admissions GROUP BY 1
ORDER BY {'1' if compat else '2 DESC, 1'} LIMIT 10"""
            ),
        )
        for name, compat in (("prescription_costs", False), ("prescription_costs_by_name", True))
    },
    "prescription_cost_totals": Query(
        lambda s, d: job.prescription_cost_totals(admissions(s, d), "Billing Amount"),
        on_admissions(
            """SELECT round(CAST(sum("Billing Amount") AS DOUBLE), 2) AS total_cost,
  round(CAST(sum("Billing Amount") AS DOUBLE) / count(*), 2) AS average_cost, count(*) AS total_prescriptions FROM admissions"""
        ),
    ),
    "pathways": Query(
        lambda s, d: job.pathways(admissions(s, d), "Admission Type"),
        on_admissions('SELECT "Admission Type" AS pathway, count(*) AS n FROM admissions GROUP BY 1'),
    ),
    "length_of_stay": Query(
        lambda s, d: job.length_of_stay(admissions(s, d), "Date of Admission", "Discharge Date"),
        on_admissions(
            """SELECT CAST(trunc(avg(date_diff('day', "Date of Admission", "Discharge Date"))) AS BIGINT) AS average_length_of_stay FROM admissions"""
        ),
    ),
    "treatment_costs": Query(
        lambda s, d: job.treatment_costs(staged_admissions(s, d), _COSTS, "Medication", "Admission Type"),
        on_admissions(_by("Medication", "Medication", 8, "cost")),
    ),
    "treatment_costs_by_type": Query(
        lambda s, d: job.treatment_costs(staged_admissions(s, d), _COSTS, "Gender", "Admission Type"),
        on_admissions(_by("Gender", "Medication", 8, "cost") + "\nUNION ALL " + _by("Admission Type", "Admission", 3, "cost")),
    ),
    "treatment_costs_by_third": Query(
        lambda s, d: job.treatment_costs(staged_admissions(s, d), _COSTS),
        on_admissions(
            _bands(
                ("Low Cost Treatments (0-33rd percentile)", "Medium Cost Treatments (33-66th percentile)", "High Cost Treatments (66-100th percentile)"),
                (0.33, 0.66),
                "cost",
            )
        ),
    ),
    "treatment_cost_totals": Query(
        lambda s, d: job.treatment_cost_totals(admissions(s, d), _COSTS),
        on_admissions(
            """SELECT CAST(1 AS BIGINT) AS cost_columns, CAST(trunc(sum("Billing Amount")) AS BIGINT) AS total_cost,
  CAST(trunc(CAST(sum("Billing Amount") AS DOUBLE) / count(*)) AS BIGINT) AS average_cost FROM admissions"""
        ),
    ),
    "cost_effectiveness": Query(
        lambda s, d: job.cost_effectiveness(
            admissions(s, d).withColumn("Fee", F.col("Billing Amount").cast("double") / 200), ["Medication", "Gender"], ["Fee"]
        ),
        on_admissions(
            """SELECT t AS treatment, least(100, greatest(60, CAST(trunc(100 / (avg(CAST("Billing Amount" AS DOUBLE) / 200) / 1000)) AS BIGINT))) AS cost_effectiveness
FROM admissions, (VALUES ('Medication'), ('Gender')) AS v(t) GROUP BY t"""
        ),
    ),
    "value_of_care": Query(
        lambda s, d: job.value_of_care(
            admissions(s, d).withColumn("Fee", (F.col("Billing Amount") / 20).cast("decimal(18,2)")).drop("Billing Amount"), ["Fee"]
        ),
        on_admissions(
            """SELECT CAST(trunc(100 / greatest(CAST(sum(CAST("Billing Amount" / 20 AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000, 1) * 10) AS BIGINT) AS roi,
  CAST(95 AS BIGINT) AS value_based_care_score FROM admissions"""
        ),
    ),
    "insurance_mix": Query(
        lambda s, d: job.insurance_mix(admissions(s, d), "Insurance Provider"),
        on_admissions(
            """SELECT "Insurance Provider" AS insurer, CAST(round_even(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM admissions) * 100, 0) AS BIGINT) AS percentage
FROM admissions GROUP BY 1"""
        ),
    ),
    "budget_allocation": Query(
        lambda s, d: job.budget_allocation(staged_admissions(s, d), _COSTS, ["Medical Condition", "Test Results"], _MEDICINES),
        on_admissions(
            _by("Medical Condition", "Medical Condition", 5, "amount") + "\nUNION ALL " + _by("Test Results", "Test Results", 5, "amount")
        ),
    ),
    "budget_by_treatment": Query(
        lambda s, d: job.budget_allocation(staged_admissions(s, d), _COSTS, [], ["Medication", "Admission Type"]),
        on_admissions(
            _by("Medication", "Medication", 4, "amount") + "\nUNION ALL " + _by("Admission Type", "Admission Type", 4, "amount")
        ),
    ),
    "budget_by_quarter": Query(
        lambda s, d: job.budget_allocation(staged_admissions(s, d), _COSTS),
        on_admissions(
            _bands(
                (
                    "Low Cost Segment (0-25th percentile)",
                    "Medium Cost Segment (25-50th percentile)",
                    "High Cost Segment (50-75th percentile)",
                    "Very High Cost Segment (75-100th percentile)",
                ),
                (0.25, 0.5, 0.75),
                "amount",
            )
        ),
    ),
    "budget_totals": Query(
        lambda s, d: job.budget_totals(staged_admissions(s, d), _COSTS),
        on_admissions(
            'SELECT CAST(trunc(sum("Billing Amount")) AS BIGINT) AS total_budget, CAST(95 AS BIGINT) AS utilization_rate FROM admissions'
        ),
    ),
    "monthly_budget": Query(
        lambda s, d: job.monthly_budget(admissions(s, d), _COSTS, "Date of Admission"),
        on_admissions(
            """SELECT strftime("Date of Admission", '%Y-%m') AS month, CAST(trunc(sum("Billing Amount")) AS BIGINT) AS amount FROM admissions GROUP BY 1"""
        ),
    ),
    "risk_segments": Query(
        lambda s, d: job.risk_segments(admissions(s, d), "Age"),
        on_admissions(
            """SELECT count(*) FILTER (Age BETWEEN 0 AND 30) AS low_risk, count(*) FILTER (Age > 30 AND Age <= 60) AS medium_risk,
  count(*) FILTER (Age > 60) AS high_risk, count(*) AS total_patients FROM admissions"""
        ),
    ),
    "risk_segments_by_severity": Query(
        lambda s, d: job.risk_segments(admissions(s, d), severity="Admission Type"),
        on_admissions(
            """SELECT count(*) FILTER ("Admission Type" = 'Elective') AS low_risk, count(*) FILTER ("Admission Type" = 'Emergency') AS medium_risk,
  count(*) FILTER ("Admission Type" = 'Urgent') AS high_risk, count(*) AS total_patients FROM admissions"""
        ),
    ),
    "risk_segments_by_condition": Query(
        lambda s, d: job.risk_segments(admissions(s, d), conditions=_DIAGNOSES),
        on_admissions(
            """SELECT CAST(trunc(count(*) * 0.4::DOUBLE) AS BIGINT) AS low_risk, CAST(trunc(count(*) * 0.4::DOUBLE) AS BIGINT) AS medium_risk,
  count(*) - 2 * CAST(trunc(count(*) * 0.4::DOUBLE) AS BIGINT) AS high_risk, count(*) AS total_patients FROM admissions"""
        ),
    ),
    "monthly_records": Query(
        lambda s, d: job.monthly_records(admissions(s, d), "Date of Admission"),
        on_admissions(
            "SELECT CAST(month AS INTEGER) AS month, label, records, CAST(trunc(records * 0.3::DOUBLE) AS BIGINT) AS activities FROM monthly",
            _MONTHLY,
        ),
    ),
    "healthcare_overview": Query(
        lambda s, d: (lambda a: job.healthcare_overview(a, clinical_columns(a), "Age", "Date of Admission"))(staged_admissions(s, d)),
        on_admissions(
            """SELECT 'total' AS section, 'records' AS key, CAST(count(*) AS DOUBLE) AS value FROM admissions
UNION ALL SELECT * FROM (VALUES ('columns', 'patient', 3.0::DOUBLE), ('columns', 'vital', 2), ('columns', 'diagnosis', 1), ('columns', 'treatment', 1),
  ('columns', 'lab', 2), ('columns', 'cost', 1), ('quality', 'completeness', 100), ('quality', 'missing_values', 0), ('quality', 'duplicate_rows', 0),
  ('quality', 'data_quality_score', 100))
UNION ALL SELECT 'records', label, records FROM monthly
UNION ALL SELECT 'activities', label, trunc(records * 0.3::DOUBLE) FROM monthly
UNION ALL SELECT 'risk', 'low_risk', count(*) FILTER (Age <= 30) FROM admissions
UNION ALL SELECT 'risk', 'medium_risk', count(*) FILTER (Age > 30 AND Age <= 60) FROM admissions
UNION ALL SELECT 'risk', 'high_risk', count(*) FILTER (Age > 60) FROM admissions""",
            _MONTHLY,
        ),
    ),
    "analysis_batch": Query(lambda s, d: job.analysis_batch(admissions(s, d), None, ROLES)),
}
