from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import columns as fn, grouping, ordering, quantiles
from quillstone.operators.profile import slope_p_value


@pytest.fixture(scope="module")
def numbers():
    draw = np.random.RandomState(7)
    hot = np.where(draw.rand(5000) < 0.4, 3.25, draw.normal(0, 50, 5000).round(3))
    gaps = np.where(draw.rand(5000) < 0.1, np.nan, draw.randint(0, 9, 5000).astype(float))
    return pd.DataFrame({"hot": hot, "gaps": gaps, "wide": draw.pareto(1.0, 5000) * 1e6})


@pytest.mark.parametrize("direct", [10, 200, 100_000])
def test_quantiles_are_exact(spark, numbers, direct):
    wanted = [0.0, 0.001, 0.2, 0.25, 0.5, 0.66, 0.8, 0.999, 1.0]
    df = spark.createDataFrame(numbers).repartition(5)
    found = quantiles.exact_quantiles(df, {c: wanted for c in numbers}, direct_rows=direct)
    for c in numbers:
        want = numbers[c].dropna().quantile(wanted).tolist()
        assert found[c] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantiles_do_not_depend_on_partitions(spark, numbers):
    df = spark.createDataFrame(numbers)
    results = [
        quantiles.exact_quantiles(df.repartition(n), {"hot": [0.3, 0.7], "wide": [0.1]}, direct_rows=50) for n in (1, 7)
    ]
    assert results[0] == results[1]


def test_quantiles_with_infinite_values(spark):
    values = [float("-inf")] * 30 + [float(i) for i in range(100)] + [float("inf")] * 30
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = quantiles.exact_quantiles(df, {"x": [0.0, 0.1, 0.5, 1.0]}, direct_rows=5)["x"]
    assert found == [float("-inf"), float("-inf"), 49.5, float("inf")]


def test_quantiles_of_close_values(spark):
    """Values that differ in their last bits only, large and small ones, and both zeros."""
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [np.nextafter(1.0, 2) + i * 2.0**-52 for i in range(300)] + [-1.0] * 500
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    wanted = np.linspace(0, 1, len(values)).tolist()
    got = quantiles.exact_quantiles(df, {"x": wanted}, direct_rows=3)["x"]
    assert got == pytest.approx(np.quantile(values, wanted).tolist(), rel=1e-15)


@pytest.mark.parametrize("columns,places", [(2, [0.5]), (60, [0.01, 0.2, 0.5, 0.8, 0.99])])
def test_passes_do_not_grow_with_columns(spark, monkeypatch, columns, places):
    """Whatever is asked for, a value is found by six counting passes and one for the rest at most."""
    draw = np.random.RandomState(9)
    frame = pd.DataFrame({f"c{i}": draw.normal(0, 10.0 ** (i % 7), 3000) for i in range(columns)})
    passes = []
    counted, direct = quantiles._Search._counted, quantiles._Search._direct
    monkeypatch.setattr(quantiles._Search, "_counted", lambda self, *a: passes.append("counted") or counted(self, *a))
    monkeypatch.setattr(quantiles._Search, "_direct", lambda self, *a: passes.append("direct") or direct(self, *a))
    got = quantiles.exact_quantiles(spark.createDataFrame(frame), {c: places for c in frame}, direct_rows=100)
    assert len(passes) <= 7
    assert all(got[c] == pytest.approx(frame[c].quantile(places).tolist()) for c in frame)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles.exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [1.0]}
    assert quantiles.value_at_rank(df, "a", 0) is None


def test_row_index_numbers_copies(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES_PER_TASK", 40)
    rows = [(i % 3, "x") for i in range(300)] + [(7, f"v{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b string")
    for parts in (1, 7):
        got = ordering.row_index(df.repartition(parts), ["a"]).collect()
        assert sorted(r["row_index"] for r in got) == list(range(350))
        placed = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row_index"])]
        assert placed == sorted(rows)


@pytest.mark.parametrize("forward,block", [(True, 1_000_000), (False, 1_000_000), (True, 7), (False, 7), (True, 1)])
def test_fill_matches_pandas(spark, monkeypatch, forward, block):
    monkeypatch.setattr(ordering, "FILL_BLOCK", block)
    draw = np.random.RandomState(3)
    frame = pd.DataFrame({"id": np.arange(400), "v": np.where(draw.rand(400) < 0.9, np.nan, draw.rand(400))})
    frame["s"] = [f"t{i}" if i % 37 == 5 else None for i in range(400)]
    df = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None))).repartition(6)
    got = ordering.fill_missing(df, ["id"], ["v", "s"], forward, unique=True).toPandas().sort_values("id")
    want = frame.ffill() if forward else frame.bfill()
    assert np.allclose(got["v"].to_numpy(float), want["v"].to_numpy(float), equal_nan=True)
    assert [x or None for x in got["s"]] == [None if pd.isna(x) else x for x in want["s"]]


def test_rolling_over_blocks_matches_pandas(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROLLING_BLOCK", 25)
    values = np.random.RandomState(5).rand(130)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(130), "v": values}))
    got = ordering.rolling_std(df, "v", "i").toPandas().sort_values("i")
    want = pd.Series(values).rolling(12, min_periods=1).std()
    assert np.allclose(got["rolling_std"].to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("block,least", [(256, 0), (5, 0), (1, 4), (4, 7)])
def test_pair_products_with_a_hot_owner(spark, block, least):
    draw = np.random.RandomState(1)
    rows = {(0, s): 9.0 for s in range(12)} | {(int(o), int(s)): float(n) for o, s, n in zip(draw.randint(1, 40, 150), draw.randint(0, 12, 150), draw.randint(1, 5, 150))}
    df = spark.createDataFrame([(o, s, n) for (o, s), n in rows.items()], "owner int, slot int, n double")
    got = {(r["a"], r["b"]): r["total"] for r in grouping.pair_products(df, "owner", "slot", "n", block, least).collect()}
    want: dict = {}
    for owner in {o for o, _ in rows}:
        held = sorted(s for o, s in rows if o == owner)
        for a, b in [*combinations(held, 2), *[(s, s) for s in held]]:
            want[a, b] = want.get((a, b), 0.0) + rows[owner, a] * rows[owner, b]
    assert got == {(a, b): total for (a, b), total in want.items() if b >= least}


@pytest.mark.parametrize("small", [0, 4, 100_000])
def test_codes_are_dense_and_in_order(spark, monkeypatch, small):
    monkeypatch.setattr(grouping, "SMALL_CATEGORIES", small)
    df = spark.createDataFrame([("b", 10, "x"), ("a", 9, None), (None, None, "x"), ("c", 9, "z"), ("b", -1, "x")], "t string, n int, `a b` string").withColumn("d", F.lit(1))
    values = grouping.dictionary(df, ["t", "n", "a b"])
    assert grouping.sizes_of(values, ["t", "n", "d"]) == {"t": 3, "n": 3, "d": 0}
    out = grouping.with_codes(df, values, ["t", "n", "a b"], missing={"t": -1, "n": 3, "a b": None})
    assert out.columns == ["t", "n", "a b", "d", "t_Encoded", "n_Encoded", "a b_Encoded"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([("b", 10, "x", 1, 1, 2, 0), ("a", 9, None, 1, 0, 1, None), (None, None, "x", 1, -1, 3, 0), ("c", 9, "z", 1, 2, 1, 1), ("b", -1, "x", 1, 1, 0, 0)], key=str)


def test_sketches_are_near_enough(spark):
    df = spark.range(20_000).select(*[(F.xxhash64("id", F.lit(i)) % n).alias(f"c{n}_{i}") for n in (1, 20, 100, 5_000) for i in range(5)], F.lit(None).cast("string").alias("none"))
    rows, sizes = grouping.estimated_sizes(df, df.columns)
    exact = grouping.distinct_sizes(df, df.columns)
    assert rows == 20_000 and sizes["none"] == 0
    assert all(exact[c] / grouping.SKETCH_MARGIN <= sizes[c] <= exact[c] * grouping.SKETCH_MARGIN for c in df.columns)


def test_group_value_keeps_rows_without_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    got = grouping.with_group_value(df, "k", total=F.sum("v"))
    assert sorted((r["k"] or "", r["v"], r["total"]) for r in got.collect()) == [("", 5, None), ("a", 1, 3), ("a", 2, 3)]


def _one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [("71-80", 75.5), (" 21 - 30 ", 25.5), ("65+", 65.0), ("42", 42.0), ("-5", -5.0), ("n/a", None), ("", None), (None, None), ("1-2-3", None)],
)
def test_age_texts(spark, text, want):
    assert _one(spark, fn.age_years, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a, b,c", ["a", "b", "c"]),
        ("a; b, c", ["a; b", "c"]),
        ("a|b", ["a", "b"]),
        ("a\nb", ["a", "b"]),
        ("a and b & c", ["a", "b & c"]),
        ("a & b", ["a", "b"]),
        (" Aspirin ", ["Aspirin"]),
        ("nan", []),
        ("a,,None, b", ["a", "b"]),
        ("  ", []),
        (None, []),
    ],
)
def test_medicine_texts(spark, text, want):
    assert _one(spark, fn.split_medicines, text) == want


def test_unique_keeps_first_spelling(spark):
    assert _one(spark, fn.unique_ignoring_case, ["Aa", "b", "aA", "B "], "array<string>") == ["Aa", "b"]


@pytest.mark.parametrize("text, want", [("1.5", 1.5), ("1e3", 1000.0), ("1,000", None), ("42d", None), ("NaN", None), (" 7 ", 7.0)])
def test_numbers(spark, text, want):
    assert _one(spark, fn.to_number, text) == want


@pytest.mark.parametrize("text, want", [("2024-02-30", None), ("1/31/2024", "2024-01-31"), ("31/01/2024", None), ("2024-01-31T10:11:12.5Z", "2024-01-31"), ("9-Dec-2019", "2019-12-09"), ("2019", None), ("x", None)])
def test_dates(spark, text, want):
    got = _one(spark, fn.to_time, text)
    assert (got.date().isoformat() if got else None) == want


def test_a_column_is_read_in_one_order(spark):
    df = spark.createDataFrame([("03/04/2021", "03/04/2021 8:26"), ("03/25/2021", "25/03/2021 18:26"), (None, "x")], "us string, uk string")
    got = df.select(*[fn.time_of(df, c).cast("string").alias(c) for c in df.columns]).collect()
    assert [r["us"] for r in got] == ["2021-03-04 00:00:00", "2021-03-25 00:00:00", None]
    assert [r["uk"] for r in got] == ["2021-04-03 08:26:00", "2021-03-25 18:26:00", None]


def test_noise_and_hold_out_are_independent(spark):
    key = [F.col("id")]
    drawn = spark.range(20000).select((fn.chance(key, 42, "hold-out") < 0.2).alias("held"), (fn.chance(key, 42, "noise") < 0.3).cast("double").alias("noisy"))
    shares = {r["held"]: r["share"] for r in drawn.groupBy("held").agg(F.avg("noisy").alias("share")).collect()}
    assert abs(shares[True] - 0.3) < 0.03 and abs(shares[False] - 0.3) < 0.03


def test_equal_values_share_a_bucket(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 5.0)], "x double")
    got = [r[0] for r in df.select(fn.bucket_number(F.col("x"), [1.0, 1.0, 1.4, 2.6])).collect()]
    assert got == [1, 1, 1, 4, 5]


def test_week_is_keyed_by_calendar_year(spark):
    day = F.lit("2021-01-01").cast("date")
    parts = fn.date_parts(day)
    assert tuple(spark.range(1).select(parts["year"], parts["week"], parts["weekday"]).first()) == (2021, 53, 4)


def test_noise_rate_and_repeat(spark):
    df = spark.range(20000)
    flips = df.select("id", fn.flipped(F.lit(0), [F.col("id")], 42, 0.3).alias("f"))
    share = flips.agg(F.avg("f")).first()[0]
    assert abs(share - 0.3) < 0.02
    assert flips.repartition(3).exceptAll(flips).count() == 0


def test_p_value_of_slope():
    # Student t with 10 degrees of freedom: two-sided 5 % point is 2.2281.
    t = 2.228138852
    assert slope_p_value(t * t / (t * t + 10), 12) == pytest.approx(0.05, abs=1e-8)
    assert slope_p_value(1.0, 10) == 0.0
    assert math.isnan(slope_p_value(0.5, 2))
