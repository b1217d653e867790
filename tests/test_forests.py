"""Trees over counted cells against MLlib's trees over rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from quillstone.functions import trees
from quillstone.operators import forests, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few values in b and c, one in a half of a; numbers and three classes as labels."""
    draw = np.random.RandomState(3)
    n = 12_000
    a = np.where(draw.rand(n) < 0.5, 7.0, draw.normal(0, 30, n))
    b, c = draw.randint(0, 5, n).astype(float), draw.randint(1, 13, n).astype(float)
    number = np.round(a / 10 + 3 * b + draw.normal(0, 2, n))
    kind = np.digitize(a + 10 * b + draw.normal(0, 15, n), [15, 40]).astype(float)
    frame = pd.DataFrame({"key0": np.arange(n), "a": a, "b": b, "c": c, "number": number, "kind": kind})
    return spark.createDataFrame(frame).repartition(3).cache()


def _train(rows, label):
    return rows.withColumn("label", F.col(label))


def _plan(train, classes, **changed):
    n = train.count()
    splits = forests._splits(train, FEATURES, n, 42)
    table, files = forests._entries(train, FEATURES, splits)
    plan = dict(features=3, bins=1 + max(map(len, splits)), classes=classes, chosen=3, trees=1, depth=6, seed=42, files=files)
    return table, splits, trees.Plan(**(plan | changed))


@pytest.mark.parametrize(("label", "classes", "kind"), [("number", 0, RandomForestRegressor), ("kind", 3, RandomForestClassifier)])
def test_a_tree_over_cells_is_the_tree_over_rows(rows, monkeypatch, label, classes, kind):
    """Without a bootstrap there is no chance in it: same splits, predictions and importances."""
    train = _train(rows, label)
    table, splits, plan = _plan(train, classes)
    assert table.agg(F.sum("n")).first()[0] == 12_000 and table.count() < 9_000
    monkeypatch.setattr(trees, "_poisson", lambda n, ones, draw: n.astype(float))
    made = trees.Ensemble(plan, list(trees.grown(plan, range(len(plan.files)), [0])))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    known = kind(numTrees=1, maxDepth=6, seed=42, bootstrap=False, featureSubsetStrategy="all").fit(vectors)
    want = known.transform(vectors).orderBy("key0").toPandas()
    x = trees.unpacked(trees.packed([want[c].to_numpy() for c in FEATURES], splits), 3)
    got = made.of(x)
    if classes:
        assert np.allclose(got, np.stack([v.toArray() for v in want["probability"]]))
    else:
        assert np.allclose(got[:, 0], want["prediction"])
    assert np.allclose(made.importances, known.featureImportances.toArray())


@pytest.mark.parametrize(("label", "kind"), [("number", RandomForestRegressor), ("kind", RandomForestClassifier)])
def test_forests_are_as_good_as_those_over_rows(rows, label, kind):
    train = _train(rows, label)
    classes = label == "kind"
    model = forests.Forest(classes, trees=20, depth=6, seed=42).fit(train, FEATURES)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    known = kind(numTrees=20, maxDepth=6, seed=42, featureSubsetStrategy="auto" if classes else "all").fit(vectors)
    miss = F.avg(F.expr("cast(label <> prediction as double)")) if classes else F.avg(F.expr("pow(label - prediction, 2)"))
    got, want = (m.transform(v).agg(miss).first()[0] for m, v in ((model, train), (known, vectors)))
    assert got == pytest.approx(want, rel=0.05)
    assert np.allclose(model.importances, known.featureImportances.toArray(), atol=0.1 if classes else 0.02)


@pytest.mark.parametrize("label", ["number", "kind"])
def test_slices_and_levels_do_not_matter(rows, monkeypatch, label):
    """Trees grown level by level from sums of many slices are those that one task grows."""
    monkeypatch.setattr(forests, "FILE_ROWS", 200)
    monkeypatch.setattr(forests, "PART_BYTES", 4_000)
    train = _train(rows, label)
    one, many = (forests.Forest(label == "kind", trees=4, depth=5, seed=1, slice_cells=n).fit(train, FEATURES) for n in (1 << 21, 500))
    assert np.array_equal(one.trees.feature, many.trees.feature) and np.array_equal(one.trees.cut, many.trees.cut)
    assert np.allclose(one.trees.values, many.trees.values) and np.allclose(one.importances, many.importances)


@pytest.mark.parametrize("cells", [1 << 21, 10])
def test_boosting_over_cells_is_boosting_over_rows(rows, monkeypatch, cells):
    """In one task, and by MLlib over counted entries where the cells are too many for it."""
    monkeypatch.setattr(forests, "FILE_ROWS", 1_000)
    train = rows.withColumn("label", F.expr("cast(kind > 1 as double)"))
    model = forests.Boosted(6, 4, 0.1, 42, slice_cells=cells).fit(train, FEATURES)
    assert isinstance(model, forests.TreesModel if cells > 10 else forests.BoostedModel)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    known = GBTClassifier(maxIter=6, maxDepth=4, stepSize=0.1, seed=42).fit(vectors)
    got, want = (m.transform(v).orderBy("key0").select("probability", "prediction").toPandas() for m, v in ((model, train), (known, vectors)))
    assert np.allclose(np.stack([v.toArray() for v in got["probability"]]), np.stack([v.toArray() for v in want["probability"]]))
    assert (got["prediction"] == want["prediction"]).all()
    assert np.allclose(model.importances, known.featureImportances.toArray())


def test_bootstrap_counts():
    n = np.array([1] * 200_000 + [7] * 200_000)
    w = trees._poisson(n, n == 1, np.random.Generator(np.random.SFC64(5)))
    ones, sevens = w[:200_000], w[200_000:]
    assert abs(ones.mean() - 1) < 0.01 and abs(ones.var() - 1) < 0.02
    assert abs(sevens.mean() - 7) < 0.03 and abs(sevens.var() - 7) < 0.1
    shares = np.bincount(ones.astype(int), minlength=4)[:4] / len(ones)
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.004)


def test_odd_rows(spark):
    """NaN lies above all numbers, wide rows take several numbers for a cell, one row is enough; a NaN label is none."""
    wide = spark.createDataFrame([(float(i % 2), *(float((i >> j) % 2) for j in range(12)), float("nan") if i % 2 else -1.0) for i in range(64)], ", ".join(["label double", *(f"f{j} double" for j in range(13))]))
    names = [f"f{j}" for j in range(13)]
    model = forests.Forest(False, trees=5, depth=4, seed=1).fit(wide, names)
    got = model.transform(wide).select("label", "prediction").toPandas()
    assert np.allclose(got["label"], got["prediction"]) and model.importances.sum() == pytest.approx(1)
    single = forests.Forest(True, trees=3, depth=4, seed=1).fit(wide.limit(1), names).transform(wide).select("prediction").toPandas()
    assert (single["prediction"] == 0).all()
    with pytest.raises(ValueError):
        forests.Forest(False, trees=1, depth=1, seed=1).fit(wide.withColumn("label", F.lit(float("nan"))), names)


def test_demand_takes_one_entry_for_equal_days_and_prices(spark, monkeypatch):
    """What the trees work on does not grow with the lines of a day."""
    seen = []
    entries = forests._entries
    monkeypatch.setattr(forests, "_entries", lambda *a: seen.append(entries(*a)) or seen[-1])
    monkeypatch.setattr(forests, "release", lambda table: None)
    monkeypatch.setattr(models, "TREES", 5)
    sizes = []
    for n in (1_000, 4_000):
        lines = spark.range(n).selectExpr("id", "date_add(date'2024-01-01', cast(id % 50 as int)) AS Date", "cast(id % 3 as double) AS Quantity", "cast(id % 4 as double) AS Price")
        got = models.demand(lines, {"date": "Date", "quantity": "Quantity", "price": "Price"}, ["id"])
        assert {r["section"] for r in got.report.collect()} == {"train", "test", "all", "importance"}
        sizes.append(seen[-1][0].count())
    assert sizes[0] <= 600 and sizes[1] <= 600


def _stays(spark, n):
    """Three ages, two conditions, thirty costs, however many rows."""
    return spark.range(n).selectExpr(
        "id", "concat('n', id % 500) AS name", "cast(20 + 25 * (id % 3) as int) AS age", "element_at(array('A', 'B'), cast(id % 2 as int) + 1) AS condition",
        "cast(100 * (id % 3) + id % 10 as double) AS cost", "date'2024-01-01' AS admitted", "date_add(date'2024-01-01', cast(id % 7 as int)) AS discharged",
    )


CARE = {"id": "id", "patient": "name", "age": "age", "condition": "condition", "cost": "cost", "admitted": "admitted", "discharged": "discharged"}


@pytest.mark.parametrize(("name", "most"), [("cost", 60), ("risk", 180), ("outcome", 12)])
def test_admissions_become_few_entries(spark, monkeypatch, name, most):
    """As many entries as there are kinds of rows and labels, and no fit over rows."""
    seen, entries = [], forests._entries
    monkeypatch.setattr(forests, "_entries", lambda *a: seen.append(entries(*a)) or seen[-1])
    monkeypatch.setattr(forests, "release", lambda table: None)
    monkeypatch.setattr(models, "TREES", 5)
    monkeypatch.setattr(models, "BOOST_ROUNDS", 3)
    got = models.MODELS[name](_stays(spark, 3_000), CARE).report
    assert seen[0][0].count() <= most
    total = seen[0][0].agg(F.sum("n")).first()[0]
    report = {r["key"]: r["value"] for r in got.collect()}
    assert 2_200 < total < 2_600 and (name == "cost" or report["train_rows"] == total)


def test_no_model_of_a_batch_is_fitted_over_rows(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("fitted over rows")

    monkeypatch.setattr(models, "_assembled", refused)
    monkeypatch.setattr(models, "TREES", 3)
    monkeypatch.setattr(models, "DEPTH", 3)
    names = ["readmission", "cost", "risk", "lengthofstay"]
    got = models.train(_stays(spark, 600), CARE, names)
    assert {r["model"] for r in got.filter("section = 'importance'").collect()} == set(names)
