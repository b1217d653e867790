from __future__ import annotations

import json
import os
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from quillstone.functions import roles
from quillstone.functions.columns import chance
from quillstone.operators import anomaly, clean, clinical, labels, models, profile, sales, tables, transform
from quillstone.session import scratch, shared_folder
from quillstone.sources import files, ranges
from quillstone.streaming.daily import daily_revenue_stream

SALE = "customer long, product string, date string, price double, quantity double, country string"
ROLES = {"customer": "customer", "product": "product", "product_id": "product", "date": "date", "price": "price", "quantity": "quantity", "country": "country"}


def _sales(spark, rows):
    return spark.createDataFrame(rows, SALE)


@pytest.fixture(scope="module")
def lines(spark):
    draw = np.random.RandomState(11)
    rows = []
    for i in range(900):
        # Customer 0 holds a third of all rows.
        customer = 0 if i % 3 == 0 else int(draw.randint(1, 40))
        day = pd.Timestamp("2023-01-01") + pd.Timedelta(days=int(draw.randint(0, 200)))
        rows.append((customer, f"item {draw.randint(0, 15):02d}", day.strftime("%Y-%m-%d"), float(draw.randint(1, 90)), float(draw.randint(1, 5)), f"C{draw.randint(0, 4)}"))
    return rows


# ---- sales -------------------------------------------------------------------------------------


def test_pairs_match_brute_force(spark, lines):
    got = {(r["product_a"], r["product_b"]): r["co_purchases"] for r in sales.co_purchases(_sales(spark, lines), ROLES).collect()}
    baskets: dict = {}
    for row in lines:
        baskets.setdefault(row[0], set()).add(row[1])
    want: dict = {}
    for items in baskets.values():
        for pair in combinations(sorted(items), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_pairs_stay_with_popular_products(spark, lines):
    counts = pd.Series([r[1] for r in lines]).value_counts().rename_axis("p").reset_index(name="n")
    top = set(counts.sort_values(["n", "p"], ascending=[False, True]).head(4)["p"])
    got = sales.co_purchases(_sales(spark, lines), ROLES, products=4).collect()
    assert {x for r in got for x in (r["product_a"], r["product_b"])} <= top


@pytest.fixture(scope="module")
def many_products():
    """Five thousand products, most of them rare, and a customer who bought two thousand."""
    draw = np.random.RandomState(3)
    rows = {(int(c), int(p)) for c, p in zip(draw.randint(1, 3000, 40_000), np.minimum(4999, draw.pareto(0.6, 40_000) * 8))}
    rows |= {(0, int(p)) for p in draw.choice(5000, 2000, False)} | {(5000 + p, p) for p in range(5000)}
    return sorted((c, f"p{p * 7919 % 5000:04d}") for c, p in rows)


def _purchases(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["customer", "product"])).withColumn("country", F.lit("c"))


@pytest.mark.parametrize("first", [16, 4096])
def test_best_pairs_of_all_products(spark, many_products, first):
    matrix = np.zeros((5000, 10_000), np.float32)
    for c, p in many_products:
        matrix[int(p[1:]), c] = 1
    together = np.triu(matrix @ matrix.T, 1).astype(int)
    want = sorted((-together[a, b], f"p{a:04d}", f"p{b:04d}") for a, b in zip(*np.nonzero(together >= 3)))[:50]
    assert len(want) == 50
    got = sales.cross_sell(_purchases(spark, many_products), ROLES, first=first).collect()
    assert [(-r["co_purchases"], r["product_a"], r["product_b"]) for r in got] == want


def test_similarity_of_all_products(spark, many_products):
    matrix = np.zeros((5000, 10_000))
    for c, p in many_products:
        matrix[int(p[1:]), c] += 1
    customers, total = len({c for c, _ in many_products}), matrix @ matrix.T
    s, v = matrix.sum(axis=1), customers * (matrix**2).sum(axis=1) - matrix.sum(axis=1) ** 2
    raw = (customers * total - s[:, None] * s) / np.sqrt(v[:, None] * v)
    np.fill_diagonal(raw, -9)
    names = [f"p{p:04d}" for p in range(5000)]
    got = {}
    for r in models.item_similarity(_purchases(spark, many_products), ROLES).collect():
        got.setdefault(r["product"], {})[r["rank"]] = (r["similar_product"], r["similarity"])
    assert len(got) == 5000
    for p in range(0, 5000, 7):
        best = np.lexsort((np.arange(5000), -raw[p]))[:5]
        assert [got[names[p]][n + 1] for n in range(5)] == [(names[b], pytest.approx(raw[p, b], abs=1e-6)) for b in best]


def test_similarity_matches_pandas(spark, lines):
    frame = pd.DataFrame(lines, columns=[c.split()[0] for c in SALE.split(", ")])
    want = frame.groupby(["customer", "product"]).size().unstack(fill_value=0).corr()
    got = models.item_similarity(_sales(spark, lines), ROLES, k=3).collect()
    assert len(got) == 3 * len(want)
    for r in got:
        assert r["similarity"] == pytest.approx(want.loc[r["product"], r["similar_product"]], abs=1e-6)
        better = want[r["product"]].drop(r["product"]).round(6)
        assert (better > r["similarity"] + 1e-9).sum() == r["rank"] - 1 or (better == r["similarity"]).sum() > 1


def test_segment_counts_sum_to_customers(spark, lines):
    scores = sales.rfm_scores(_sales(spark, lines), ROLES)
    assert sales.rfm_segments(scores).agg(F.sum("customers")).first()[0] == len({r[0] for r in lines})
    value = sales.rfm_value(scores).first()
    assert value["high_clv"] + value["medium_clv"] + value["low_clv"] == value["customers"]


def test_tied_frequencies_share_a_score(spark):
    rows = [(c, "p", f"2023-01-{d:02d}", 1.0 * c, 1.0, "X") for c in range(1, 11) for d in range(1, (3 if c < 9 else 6))]
    got = sales.rfm_scores(_sales(spark, rows), ROLES).collect()
    assert len({r["f_score"] for r in got if r["frequency"] == 2}) == 1
    assert all(1 <= r[c] <= 5 for r in got for c in ("r_score", "f_score", "m_score"))


def test_halves_with_one_hot_day(spark):
    rows = [(i, "p", "2023-05-05" if i < 70 else "2023-01-01", float(i), 1.0, "X") for i in range(100)]
    got = sales.half_trend(_sales(spark, rows), ROLES, ["customer"]).first()
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    want = [sum(r[3] for r in part) / len(part) for part in (ordered[:50], ordered[50:])]
    assert [got["first_half"], got["second_half"]] == pytest.approx(want, abs=1e-4)
    assert got["trend"] == "Decreasing"


def test_shares_sum_to_hundred(spark, lines):
    shares = sales.geo_revenue(_sales(spark, lines), ROLES).agg(F.sum("market_share"), F.sum("customer_share")).first()
    assert list(shares) == pytest.approx([100.0, 100.0], abs=0.05)


def test_sales_jobs_on_an_empty_table(spark):
    empty = _sales(spark, [])
    assert sales.rfm_scores(empty, ROLES).count() == 0
    assert sales.top_products(empty, ROLES).count() == 0
    assert sales.co_purchases(empty, ROLES).count() == 0
    assert sales.half_trend(empty, ROLES).first()["trend"] == "Stable"
    assert {r["metric"]: r["value"] for r in sales.revenue_total(empty, ROLES).collect()}["total_transactions"] == 0


def test_missing_roles_give_zero(spark, lines):
    few = {"product": "product", "product_id": "product", "price": "price"}
    row = sales.product_performance(_sales(spark, lines), few).first()
    assert row["total_quantity"] == 0
    assert sales.dashboard_kpis(_sales(spark, lines), few).first()["total_customers"] == 0


def test_null_keys_are_left_out(spark):
    rows = [(None, None, "2023-01-01", 5.0, 1.0, None), (1, "a", "2023-01-02", 2.0, 1.0, "X")]
    df = _sales(spark, rows)
    assert [r["customer"] for r in sales.customer_summary(df, ROLES).collect()] == [1]
    assert [r["country"] for r in sales.geo_revenue(df, ROLES).collect()] == ["X"]


# ---- profile -------------------------------------------------------------------------------------


def test_moments_match_pandas(spark):
    draw = np.random.RandomState(2)
    frame = pd.DataFrame({"a": draw.gamma(2, 3, 500) + 1e6, "b": np.where(draw.rand(500) < 0.2, np.nan, draw.normal(size=500))})
    got = {r["column"]: r for r in profile.statistical_summary(spark.createDataFrame(frame)).collect()}
    for c in frame:
        assert got[c]["skewness"] == pytest.approx(frame[c].skew(), abs=2e-4)
        assert got[c]["kurtosis"] == pytest.approx(frame[c].kurtosis(), abs=2e-4)
        assert got[c]["std"] == pytest.approx(frame[c].std(), abs=1e-4)
        assert got[c]["missing"] == frame[c].isna().sum()


def test_correlation_is_pairwise_complete(spark):
    draw = np.random.RandomState(4)
    frame = pd.DataFrame(draw.normal(size=(300, 3)), columns=list("abc"))
    frame["b"] += frame["a"]
    frame.loc[draw.rand(300) < 0.3, "b"] = np.nan
    got = {(r["x"], r["y"]): r["correlation"] for r in profile.eda_correlation(spark.createDataFrame(frame)).collect()}
    want = frame.corr()
    for x, y in got:
        assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-4)


def test_profile_of_odd_columns(spark):
    schema = "same double, none double, odd double, text string"
    df = spark.createDataFrame([(2.0, None, float("nan"), None), (2.0, None, 1.0, "x"), (2.0, None, 3.0, "x")], schema)
    got = {r["column"]: r for r in profile.eda_distribution(df).collect()}
    assert set(got) == {"same", "odd"}
    assert got["same"]["std"] == 0 and got["same"]["skewness"] is None
    assert got["odd"]["count"] == 2
    missing = {r["column"]: r["missing"] for r in profile.eda_missing(df).collect()}
    assert missing == {"same": 0, "none": 3, "odd": 1, "text": 1}
    assert profile.eda_correlation(df).filter("x = 'same' AND y = 'odd'").first()["correlation"] is None


def test_quality_of_empty_and_single_row(spark):
    schema = "a int, b string"
    assert profile.quality_business(spark.createDataFrame([], schema)).first()["quality_score"] == 100.0
    row = profile.quality_business(spark.createDataFrame([(1, None)], schema)).first()
    assert (row["missing_values"], row["duplicate_rows"], row["quality_score"]) == (1, 0, 50.0)


def test_histogram_counts_sum_to_rows(spark):
    df = spark.createDataFrame([(float(i % 11),) for i in range(200)], "x double")
    assert tables.equal_width_histogram(df, "x").agg(F.sum("n")).first()[0] == 200
    half_open = tables.equal_width_histogram(df, "x", compat=True).agg(F.sum("n")).first()[0]
    assert half_open == 200 - df.filter("x = 10").count()


def test_top_values_of_a_column_called_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "value string, n int")
    assert sorted(r["n"] for r in tables.keep_top_values(df, "value", 1).collect()) == [1, 2]


# ---- clean and transform ---------------------------------------------------------------------------


def test_merge_pads_and_drops(spark):
    frames = [spark.createDataFrame([(i, f"{n}{i}") for i in range(size)], "k int, v string") for n, size in (("a", 5), ("b", 3), ("c", 8))]
    got = clean.merge_side_by_side(frames, [["k"], ["k"], ["k"]], unique=True).orderBy("k").collect()
    assert got[0].asDict().keys() == {"k", "v", "k_file2", "v_file2", "k_file3", "v_file3"}
    assert [r["v_file2"] for r in got] == ["b0", "b1", "b2", None, None]
    assert [r["v_file3"] for r in got] == [f"c{i}" for i in range(5)]


@pytest.fixture
def several_files(spark):
    """Sorts of small tables keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows", [1, 7, 8192])
def test_merge_reads_ranges_of_files(spark, monkeypatch, several_files, rows):
    """Frames of different sizes and kinds, in several files; no join and no exchange after the sorts."""
    monkeypatch.setattr(clean, "MERGED_ROWS", rows)
    draw = np.random.RandomState(2)
    made = []
    for size in (300, 170, 421):
        keys = draw.permutation(size)
        made.append(pd.DataFrame({"k": keys, "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(keys, "h"), "s": [f"t{k}" if k % 5 else None for k in keys], "f": keys / 7}))
    frames = [spark.createDataFrame(frame).repartition(4).withColumn("l", F.array("k")) for frame in made]
    merged = clean.merge_side_by_side(frames, [["k"], ["k"], ["k"]], unique=True)
    assert "Join" not in merged._jdf.queryExecution().toString() and "Exchange" not in merged._jdf.queryExecution().toString()
    got = merged.orderBy("k").collect()
    assert len(got) == 300 and merged.columns[5:7] == ["k_file2", "t_file2"]
    for k, r in enumerate(got):
        assert (r["k"], r["l"], r["t"]) == (k, [k], pd.Timestamp("2020-01-01") + pd.Timedelta(k, "h"))
        assert (r["k_file2"], r["l_file2"]) == ((k, [k]) if k < 170 else (None, None)) and r["s_file3"] == (f"t{k}" if k % 5 else None)
    none = clean.merge_side_by_side([frames[0].limit(0), frames[1]], [["k"], ["k"]])
    assert none.count() == 0 and len(none.columns) == 10


def test_clean_healthcare_fills(spark):
    df = spark.createDataFrame([(1.0, " b "), (3.0, "a"), (None, None), (8.0, "a"), (8.0, " b ")], "n double, t string")
    got = sorted((r["n"], r["t"]) for r in clean.clean_healthcare(df).collect())
    # Ties for the most frequent text go to the smallest one.
    assert got == [(1.0, "b"), (3.0, "a"), (5.5, "b"), (8.0, "a"), (8.0, "b")]


def test_clean_healthcare_with_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "n double, t string")
    assert [tuple(r) for r in clean.clean_healthcare(df).collect()] == [(None, "Unknown")]


def test_fill_needs_an_order(spark):
    with pytest.raises(ValueError):
        clean.clean_business(spark.createDataFrame([(1,)], "a int"), handle_missing="fill")


def test_dates_only_where_whole(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("05/06/2024", "x"), (None, "2024-02-02")], "a string, b string")
    types = {f.name: f.dataType for f in clean.dates_where_whole(df).schema}
    assert isinstance(types["a"], T.TimestampNTZType) and isinstance(types["b"], T.StringType)


def test_scores_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "v double, same double")
    got = [r["Patient_Risk_Score"] for r in transform.risk_score(df, ["v", "same"]).orderBy("v").collect()]
    assert got == pytest.approx([-0.5, 0.0, 0.5])


def test_encode_leaves_out_long_lists(spark):
    df = spark.createDataFrame([(f"k{i}", "ab"[i % 2], i % 3) for i in range(150)], "id string, t string, n int")
    out = transform.encode_business(df)
    assert {c for c in out.columns if c.endswith("_Encoded")} == {"t_Encoded", "n_Encoded"}


def test_infinite_numbers(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 2), (float("nan"), 3), (1.5, 4)], "x double, y int")
    assert [r["x"] for r in transform.finite_numbers(df).orderBy("y").collect()] == [None, None, None, 1.5]


# ---- roles --------------------------------------------------------------------------------------------


def test_words():
    assert roles.words("OrderDate_2 (USD)") == ["order", "date", "2", "usd"]
    assert roles.has_word("Medications", ("medication",)) and not roles.has_word("human", ("hum", "ma"))


def test_clinical_roles(spark):
    df = spark.createDataFrame(
        [("p1", 98.0, 99.0, "Normal", "2024-01-02", "Aspirin", "flu", 3.5, "F")] * 3,
        "patient_id string, body_temp double, tempo double, `Test Results` string, seen string, intake string, disease string, fee double, gender string",
    )
    found = roles.clinical_columns(df)
    assert found["patient"] == ["patient_id"]
    assert "body_temp" in found["vital"] and "Test Results" in found["vital"]
    assert found["lab"] == ["Test Results"] and found["diagnosis"] == ["disease"]
    assert found["treatment"] == ["intake"] and found["cost"] == ["fee"] and found["date"] == ["seen"]
    assert roles.named(["precio", "fecha"], roles.clinical_words("cost", languages=True)) == ["precio"]


def test_sales_roles(spark):
    df = spark.createDataFrame(
        [(1, "buyer a", "red pen", 2.0, 3, "2024-01-02", "X")], "order_no int, buyer string, item string, price double, qty int, created string, region string"
    )
    found = roles.sales_roles(df)
    assert found["customer"] == "buyer" and found["product"] == "item" and found["country"] == "region"
    assert found["quantity"] == "qty" and found["date"] == "created" and found["product_id"] == "order_no"
    assert roles.price_columns(df)[-1] == "qty" and "price" in roles.price_columns(df)
    assert roles.quantity_columns(df) == ["order_no", "qty"]
    assert roles.product_name_column(df) == "item"


def test_date_roles(spark):
    df = spark.createDataFrame([("2024-01-02", 1_700_000_000, "abc", "x")], "day string, epoch long, note string, admission_type string")
    assert roles.transform_date_columns(df) == {"day": "text", "epoch": "epoch"}
    assert roles.trend_date_column(df.withColumn("visit_date", F.col("day"))) == "visit_date"
    read = roles.read_dates(df, roles.transform_date_columns(df)).first()
    assert read["epoch"].year == 2023 and read["day"].year == 2024


def test_dates_after_empty_rows(spark):
    df = spark.createDataFrame([(None,)] * 300 + [("2024-01-05",)] * 20, "late string").coalesce(1)
    assert roles.date_share(df, ["late"]) == {"late": 1.0}


def test_categorical_columns(spark):
    df = spark.createDataFrame([(i, i % 4, "a") for i in range(100)], "id int, few int, t string")
    assert roles.categorical_columns(df) == ["few", "t"]


def test_ids_by_variety(spark):
    df = spark.createDataFrame([(f"v{i}", i % 2) for i in range(500)], "serial string, flag int")
    assert roles.id_columns(df) == ["serial"]


# ---- clinical -------------------------------------------------------------------------------------------


def test_overlapping_and_exclusive_readings(spark):
    df = spark.createDataFrame([("Normal",), ("Abnormal",), ("critical low",), ("fine",)], "r string")
    strict = clinical.lab_results(df, ["r"]).first()
    assert (strict["normal"], strict["abnormal"], strict["critical"]) == (2, 1, 1)
    loose = clinical.lab_results(df, ["r"], compat=True).first()
    assert (loose["normal"], loose["abnormal"], loose["critical"]) == (2, 2, 1)


def test_age_bands_keep_fractions(spark):
    df = spark.createDataFrame([(a,) for a in (0.0, 18.5, 35.5, 66.0, 130.0)], "age double")
    got = {r["age_group"]: r["n"] for r in clinical.demographics(df, "age").collect()}
    assert got == {"0-18": 2, "19-35": 1, "36-50": 0, "51-65": 0, "65+": 1}


def test_medicine_sets(spark):
    df = spark.createDataFrame([("a, B", "b"), ("B,a", None), ("c", None), (None, None)], "m string, n string")
    combos = {r["combination"]: r["n"] for r in clinical.drug_combinations(df, ["m", "n"]).collect()}
    assert combos == {"B + a": 2}
    row = clinical.drug_risk(df, ["m", "n"]).first()
    assert (row["low_risk"], row["medium_risk"], row["patients_with_medicines"]) == (2, 2, 3)


def test_severity_levels(spark):
    df = spark.createDataFrame([(x,) for x in "aabbbcd"], "severity string")
    assert tuple(clinical.risk_segments(df, severity="severity").first()) == (5, 1, 1, 7)
    two = clinical.risk_segments(df.filter("severity < 'c'"), severity="severity").first()
    assert (two["low_risk"], two["medium_risk"], two["high_risk"]) == (1, 1, 3)


def test_budget_falls_back(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "cost double")
    got = clinical.budget_allocation(df, ["cost"]).collect()
    assert sum(r["amount"] for r in got) == 5050 and len(got) == 4
    flat = clinical.budget_allocation(spark.createDataFrame([(7.0,)] * 4, "cost double"), ["cost"]).collect()
    assert [(r["category"], r["amount"]) for r in flat] == [("Low Cost Segment (0-25th percentile)", 28), ("Cost Budget", 28)]


def test_unknown_analysis(spark):
    with pytest.raises(ValueError):
        clinical.analysis_batch(spark.createDataFrame([(1,)], "Age int"), ["nothing"], {})


# ---- models -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stays(spark):
    draw = np.random.RandomState(9)
    n = 600
    admitted = pd.Timestamp("2024-01-01") + pd.to_timedelta(draw.randint(0, 300, n), unit="D")
    age = draw.randint(1, 95, n)
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "name": [f"n{i}" for i in draw.randint(0, 350, n)],
            "age": age,
            "condition": np.array(["A", "B", "C", "D"])[draw.choice(4, n, p=[0.5, 0.3, 0.15, 0.05])],
            "medicine": np.array(["x", "y", "z"])[draw.randint(0, 3, n)],
            "cost": age * 100.0 + draw.normal(0, 50, n),
            "room": draw.randint(1, 50, n),
            "admitted": admitted,
            "discharged": admitted + pd.to_timedelta(draw.randint(1, 20, n), unit="D"),
        }
    )
    return spark.createDataFrame(frame)


CARE = {"id": "id", "patient": "name", "age": "age", "condition": "condition", "medication": "medicine", "cost": "cost", "room": "room", "admitted": "admitted", "discharged": "discharged"}


def _report(trained):
    return {(r["section"], r["key"]): r["value"] for r in trained.report.collect()}


@pytest.fixture(autouse=True)
def small_models(monkeypatch):
    monkeypatch.setattr(models, "TREES", 10)
    monkeypatch.setattr(models, "DEPTH", 5)


def test_cost_model_learns_and_repeats(stays):
    first, second = (_report(models.cost(stays.repartition(n), CARE)) for n in (2, 5))
    assert first["test", "r2_score"] > 0.9
    assert sum(v for (s, _), v in first.items() if s == "importance") == pytest.approx(1.0)
    assert first["test", "rmse"] == pytest.approx(second["test", "rmse"], rel=0.2)


def test_readmission_beats_majority(stays):
    got = _report(models.readmission(stays, CARE))
    assert got["metric", "train_accuracy"] > 0.5
    bands = sum(got["distribution", b] for b in ("low_risk", "medium_risk", "high_risk"))
    assert bands == got["metric", "test_rows"]


def test_all_models_report(stays, monkeypatch):
    monkeypatch.setitem(models.MODELS, "outcome", lambda df, r, **options: models.outcome(df, r, rounds=3, **options))
    reports = models.train(stays, CARE)
    assert {r["model"] for r in reports.select("model").distinct().collect()} == set(models.MODELS)
    with pytest.raises(ValueError):
        models.train(stays, CARE, ["nothing"])


def test_too_little_data(stays):
    assert _report(models.readmission(stays.limit(50), CARE, min_rows=101)) == {("status", "insufficient_data"): 50.0}
    assert _report(models.cost(stays.limit(0), CARE)) == {("status", "insufficient_data"): 0.0}
    few = _report(models.cost(stays.limit(15), CARE))
    assert ("importance", "age") in few


def test_text_roles(spark):
    df = spark.createDataFrame([("a", 1, "b", "c", "d")], "Customer string, ClientNo int, `Person Name` string, ItemClass string, Note string")
    assert roles.customer_text_columns(df) == ["Customer", "Person Name"] and roles.product_text_columns(df) == ["ItemClass"]


def test_label_levels(stays):
    risk = labels.risk_label(stays, CARE).toPandas()
    high, low = risk["age"].quantile(0.75), risk["age"].quantile(0.25)
    dear = risk["cost"].quantile(0.75)
    counts = risk["condition"].value_counts()
    rare = counts[counts < counts.quantile(0.3)].index
    want = np.where(risk["age"] >= high, 2, np.where(risk["age"] >= low, 1, 0))
    want = np.where(risk["cost"] >= dear, 2, want)
    want = np.where(risk["condition"].isin(rare), np.maximum(want, 1), want)
    assert (risk["risk_level"] == want).all()
    noisy = labels.risk_label(stays, CARE, noise=0.1).toPandas()
    moved = (noisy.sort_values("id")["risk_level"].to_numpy() != risk.sort_values("id")["risk_level"].to_numpy()).mean()
    assert 0.02 < moved < 0.2


def test_segments_have_all_customers(spark, lines):
    got = models.segments(_sales(spark, lines), ROLES).report.collect()
    assert sum(r["customers"] for r in got) == len({r[0] for r in lines}) and 2 <= len(got) <= 5


def test_isolation_finds_outliers(spark):
    draw = np.random.RandomState(1)
    values = np.vstack([draw.normal(0, 1, (990, 2)), draw.normal(40, 1, (10, 2))])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(1000), "a": values[:, 0], "b": values[:, 1]}))
    scores = anomaly.isolation_scores(df, ["a", "b"], ["k"])
    lowest = scores.orderBy("score").limit(10).collect()
    assert all(r["a"] > 30 for r in lowest)
    assert scores.filter("anomaly").count() == 100 and scores.columns == ["k", "a", "b", "score", "anomaly"]
    assert {r["k"] for r in lowest} == set(range(990, 1000))
    again = anomaly.isolation_scores(df.repartition(3), ["a", "b"], ["k"])
    assert again.agg(F.round(F.sum("score"), 6)).first() == scores.agg(F.round(F.sum("score"), 6)).first()


# ---- shared folder ----


class _Cluster:
    """A session on a cluster, as far as the choice of the folder looks at it."""

    def __init__(self, named=None, current=None, warehouse="hdfs:///warehouse"):
        self.made = current
        self.conf = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": warehouse}
        self.sparkContext = self
        self.master = "spark://host:7077"

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, folder):
        self.made = folder


def test_shared_folder_of_a_cluster():
    named = _Cluster(named="hdfs:///stage")
    assert shared_folder(named) == "hdfs:///stage" and named.made == "hdfs:///stage"
    assert shared_folder(_Cluster(current="hdfs:///other")) == "hdfs:///other"
    assert shared_folder(_Cluster()) == "hdfs:///warehouse/_staging"
    for local in ("file:/home/spark/warehouse", "/home/spark/warehouse"):
        with pytest.raises(ValueError):
            shared_folder(_Cluster(warehouse=local))


def test_scratch_leaves_nothing(spark):
    with scratch(spark) as table:
        made = table(spark.range(5))
        path = made.staged_path
        assert made.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


# ---- files and stream ------------------------------------------------------------------------------------------


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,when,x\n1,2024-01-02,1.5\n2,,\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"id": 1, "t": "ü"}, {"id": 2, "t": null}]', encoding="utf-8")
    frames = files.ingest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")])
    assert frames[0].count() == 2 and dict(frames[0].dtypes) == {"id": "bigint", "when": "string", "x": "double"}
    assert [r["t"] for r in frames[1].orderBy("id").collect()] == ["ü", None]
    counts = files.file_counts(frames, ["a", "b"]).orderBy("file").collect()
    assert [(r["rows"], r["columns"]) for r in counts] == [(2, 3), (2, 2)]
    with pytest.raises(ValueError):
        files.ingest(spark, ["x"] * 11, limit=10)


def test_csv_missing_words_and_quotes(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b,c,d,e\nNA,"say ""hi"", you",True,,1\n7,n/a,False,,x\n')
    df = files.read_csv(spark, str(tmp_path / "c.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [(None, 'say "hi", you', True, None, "1"), (7, None, False, None, "x")]
    typed = files.read_csv(spark, str(tmp_path / "c.csv"), "a int, b string, c boolean, d double, e int")
    assert [r["e"] for r in typed.collect()] == [1, None]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c.csv"), "a int, b string").count()
    (tmp_path / "m.csv").write_text('a,b\n1,"two\nlines"\n')
    assert files.read_csv(spark, str(tmp_path / "m.csv")).first()["b"] == "two\nlines"


def test_json_forms_are_told_apart(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "r.json").write_text('\n [{"id": 1},\n {"id": 2}]')
    assert files.read_json(spark, str(tmp_path / "l.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "r.json")).count() == 2
    with pytest.raises(ValueError):
        files.read_json(spark, [str(tmp_path / "l.json"), str(tmp_path / "r.json")])


@pytest.mark.parametrize("gaps", [False, True])
def test_wide_tables_take_few_scans(spark, monkeypatch, gaps):
    """Two hundred columns: pairs and moments as numpy has them, in two scans each."""
    draw = np.random.RandomState(4)
    values = draw.normal(5, 2, (300, 200)) + draw.normal(0, 1, (300, 1)) * np.arange(200) / 50
    if gaps:
        values[draw.rand(300, 200) < 0.2] = np.nan
        values[:, 7] = np.nan
    frame = pd.DataFrame(values, columns=[f"c{i}" for i in range(200)])
    df = spark.createDataFrame(frame).repartition(40)
    scans = []
    added = profile._added_up
    monkeypatch.setattr(profile, "_added_up", lambda *a: scans.append(1) or added(*a))
    got = {(r["x"], r["y"]): r for r in profile.pair_statistics(df, list(combinations(frame.columns, 2)), full=True).collect()}
    assert len(scans) == 2 and len(got) == 199 * 100
    want = frame.corr().to_numpy()
    for (x, y), r in got.items():
        a, b = int(x[1:]), int(y[1:])
        if np.isnan(want[a, b]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want[a, b], abs=1e-9)
    both = frame[["c3", "c11"]].dropna()
    assert got["c3", "c11"]["points"] == len(both) and got["c3", "c11"]["y_mean"] == pytest.approx(both["c11"].mean())
    scans.clear()
    summary = {r["column"]: r for r in profile.statistical_summary(df).collect()}
    assert len(scans) == 2 and len(summary) == 200 - gaps
    assert summary["c9"]["std"] == pytest.approx(frame["c9"].std(), abs=1e-4) and summary["c9"]["skewness"] == pytest.approx(frame["c9"].skew(), abs=1e-4)
    assert summary["c9"]["min"] == pytest.approx(frame["c9"].min(), abs=1e-4) and summary["c9"]["q25"] == pytest.approx(frame["c9"].quantile(0.25), abs=1e-4)


CSV_TEXT = 'a,b,"c ""q"" d"\n1,"two\nlines, ""x""",3\n4,"",6\n\n"7\n\n\n8",9,"é,\n"\n,,\nlast,"open, ""\n""",x\n'


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Files are cut every few bytes; small tables do without files."""
    monkeypatch.setattr(ranges, "stage_table", lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_files_are_shared_by_tasks(spark, tmp_path, small_ranges, end):
    path = str(tmp_path / "r.csv")
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(CSV_TEXT.replace("\n", end))
    want = [("1", 'two\nlines, "x"', "3"), ("4", None, "6"), ("7\n\n\n8", "9", "é,\n"), ("last", 'open, "\n"', "x"), (None, None, None)]
    for size in (1, 7, 64, 10_000):
        small_ranges(size)
        assert size > 100 or spark.read.text(path).rdd.getNumPartitions() >= 40 // size
        got = files._parsed(ranges.records(spark, path, ranges.CSV), ["a", "b", "c"]).collect()
        assert sorted((tuple(x or None for x in r) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_are_shared_by_tasks(spark, tmp_path, small_ranges, indent):
    path = str(tmp_path / "r.json")
    rows = [{"a": i, "s": 'x}{[]"\\ ' + "é" * i, "n": {"k": [{"z": i}, {}]}} for i in range(5)]
    with open(path, "w", encoding="utf-8") as file:
        file.write(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    for size in (1, 16, 10_000):
        small_ranges(size)
        got = files.read_json(spark, path, "a long, s string, n struct<k: array<struct<z: long>>>", lines=False).collect()
        assert sorted((r["a"], r["s"], r["n"]["k"][0]["z"], len(r["n"]["k"])) for r in got) == [(r["a"], r["s"], r["a"], 2) for r in rows]


def test_record_borders_by_single_steps():
    """However a text is cut, the state after all its pieces is that of the whole."""
    for line, inside in (('a,"b ""c"" d",e', 0), ('a"b,c', 0), ('"open', 1), ('"a""', 1), ('"a"x,"', 1), ('a,"b', 1), ("", 0)):
        assert ranges.csv_step(line.encode(), 0) == (inside, 0)
    assert [ranges.csv_step(t, 1)[0] for t in (b"", b'"', b'""', b'x","', b'x",y,"z"', b'",')] == [1, 0, 1, 1, 0, 0]
    text = json.dumps([{"a": '}{"\\', "b": [1, {"c": "]"}]}])
    pieces = text.split("}")
    for cut in range(1, len(pieces)):
        inside = depth = 0
        for piece in (p + "}" for p in pieces[:cut]):
            inside, change = ranges.json_step(piece.encode(), inside)
            depth += change
        before = "}".join(pieces[:cut]) + "}"
        assert (inside, depth) == ranges.json_step(before.encode(), 0)


def test_torn_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "o.json").write_text('[{"a": 1}, {"a": 2, "b": [{"c": 3}')
    (tmp_path / "e.json").write_text("[]")
    for size in (2, 10_000):
        small_ranges(size)
        assert [r["a"] for r in files.read_json(spark, [str(tmp_path / "o.json"), str(tmp_path / "e.json")], "a long", lines=False).collect()] == [1]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert files.read_csv(spark, str(tmp_path / "h.csv")).count() == 0


def test_json_array_sink(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('[{"'), "id")).alias("t"))
    files.write_json_arrays(df, str(tmp_path / "a.json"))
    parts = [p for p in (tmp_path / "a.json").iterdir() if p.name.startswith("part")]
    assert sorted(r["id"] for p in parts for r in json.loads(p.read_text())) == list(range(1000))
    assert files.read_any(spark, str(tmp_path / "a.json")).exceptAll(df).isEmpty()


def test_csv_returns_what_was_written(spark, tmp_path):
    rows = [(1, 'a "quoted", text', 2.5), (2, "x", None)]
    files.write_csv(spark.createDataFrame(rows, "i long, t string, v double"), str(tmp_path / "o.csv"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "o.csv")).collect()) == rows


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    files.write_csv(spark.createDataFrame([(1, None), (2, "a,b")], "a int, b string").coalesce(1), path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    assert (tmp_path / "out.csv" / part).read_text() == 'a,b\n1,\n2,"a,b"\n'


def test_latest_prefers_transformed(spark, tmp_path):
    for name, when in (("merged_9.csv", 300), ("transformed_1.csv", 100), ("transformed_2.csv", 200), ("other.csv", 400)):
        (tmp_path / name).write_text("a\n1\n")
        os.utime(tmp_path / name, (when, when))
    assert files.latest_dataset(spark, str(tmp_path)).endswith("/transformed_2.csv")
    assert files.latest_dataset(spark, str(tmp_path), ("none_",)) is None


def test_first_rows_and_pages(spark, several_files):
    df = spark.range(100)
    assert files.first_rows(df, 7, ["id"]).agg(F.max("id")).first()[0] == 6
    assert [r["id"] for r in files.page(df, ["id"], 10, 3).collect()] == list(range(30, 40))
    pages = files.Pages(df.repartition(5), ["id"], unique=True)
    assert len(pages.files) > 3
    for size, number in ((10, 3), (1, 99), (30, 3), (7, 14), (1000, 0), (10, 10)):
        page = pages.page(size, number)
        assert [r["id"] for r in page.collect()] == list(range(size * number, min(100, size * (number + 1))))
        assert size > 10 or len(page.inputFiles()) <= 2 or number == 10
    pages.release()
    assert files.Pages(df.limit(0), ["id"]).page(10, 0).count() == 0
    sample = files.stable_sample(df, ["id"], 20)
    assert sample.exceptAll(files.stable_sample(df.repartition(4), ["id"], 20)).count() == 0


def test_sample_of_a_large_table(spark):
    df = spark.range(5000).withColumn("same", F.lit(1))
    picked = files.stable_sample(df, ["id"], 50)
    want = df.orderBy(chance([F.col("id")], 42, "sample"), "id").limit(50)
    assert picked.exceptAll(want).count() == 0 and picked.count() == 50
    assert files.stable_sample(df, ["same"], 50).count() == 50


def test_columns_of_a_kind(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a int, b string, c double")
    assert tables.of_kind(df, lambda t: isinstance(t, T.NumericType)).columns == ["a", "c"]


def test_catalogue(spark):
    df = spark.createDataFrame([("sales_Report-2024.csv", "Sales", ["retail", "shop"]), ("x.csv", "Other", [])], "filename string, name string, keywords array<string>")
    assert files.catalogue_search(df, " RETAIL ", ["filename", "name"], "keywords").count() == 1
    assert files.catalogue_search(df, "r", ["filename"]).count() == 0
    entry = files.catalogue_entry(df, "filename").first()
    assert entry["name"] == "Sales Report 2024" and entry["id"] == "sales_report_2024_csv" and entry["category"] == "business"
    assert entry["keywords"] == ["business", "sales", "report", "2024", "csv"]


def test_daily_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 10:00:00", float(d * k)) for d in range(1, 6) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "at string, amount double").withColumn("at", F.col("at").cast("timestamp"))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = daily_revenue_stream(spark.readStream.schema(df.schema).parquet(source), "at", "amount")
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["day"].isoformat(): r["revenue"] for r in spark.table("daily").collect()}
    batch = sales.daily_revenue(df, {"date": "at", "revenue": "amount"})
    assert got == {r["day"].isoformat(): r["revenue"] for r in batch.collect()}
