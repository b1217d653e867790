"""Model jobs on MLlib: fit, evaluate and report as (section, key, value) rows.

The feature table is evaluated once into the shared folder. Rows are held out by a hash of
their id, so the split does not move between runs and keeps class shares in expectation.
All counts of a report come from one pass over the predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import chance, date_parts, quoted
from ..functions.grouping import dictionary, pair_products, top_per, with_codes
from ..functions.ordering import row_index
from ..session import release, shared_folder, spread_out, stage, stage_table
from . import labels
from .forests import Boosted, BoostedModel, Forest, TreesModel
from .sales import Roles, _date_of, popular_products, ranked_products

SEED = 42
TEST_SHARE = 0.2
TREES, DEPTH = 100, 10
BOOST_ROUNDS, BOOST_DEPTH = 100, 5


@dataclass(frozen=True)
class Trained:
    """A report and the scored rows it was made from."""

    report: DataFrame
    scored: DataFrame | None


def _cell(section: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.cast("double").alias("value"))


def _known(df: DataFrame, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(s, k, float(v)) for s, k, v in rows], "section string, key string, value double")


# ---- metrics ---------------------------------------------------------------------------------------


def _binary_counts(label: Column, prediction: Column, where: Column) -> dict[str, Column]:
    def counted(a: int, b: int) -> Column:
        return F.count(F.when(where & (label == a) & (prediction == b), 1))

    return {"tp": counted(1, 1), "fp": counted(0, 1), "fn": counted(1, 0), "tn": counted(0, 0)}


def _binary_metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return {
        "accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1_score": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    }


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion counts of a 0/1 label, from one aggregate."""
    counts = _binary_counts(quoted(label), quoted(prediction), F.lit(True))
    row = df.agg(*[v.alias(k) for k, v in counts.items()])
    metrics = _binary_metrics()
    names = {"tp": "true_positive", "fp": "false_positive", "fn": "false_negative", "tn": "true_negative"}
    cells = [_cell("metric", k, v) for k, v in metrics.items()] + [_cell("confusion", n, F.col(c)) for c, n in names.items()]
    return row.select(F.inline(F.array(*cells)))


def _regression_parts(label: Column, prediction: Column, where: Column) -> dict[str, Column]:
    error = F.when(where, label - prediction)
    return {
        "mse": F.avg(error * error),
        "mae": F.avg(F.abs(error)),
        "variance": F.var_pop(F.when(where, label)),
        "mean_label": F.avg(F.when(where, label)),
        "mean_prediction": F.avg(F.when(where, prediction)),
    }


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE, RMSE, MAE and R², from one aggregate."""
    parts = _regression_parts(quoted(label), quoted(prediction), F.lit(True))
    row = df.agg(*[v.alias(k) for k, v in parts.items()])
    r2 = 1 - F.try_divide("mse", "variance")
    cells = [_cell("metric", "mse", F.col("mse")), _cell("metric", "rmse", F.sqrt("mse")), _cell("metric", "mae", F.col("mae")), _cell("metric", "r2_score", r2)]
    return row.select(F.inline(F.array(*cells)))


# ---- shared steps ------------------------------------------------------------------------------------


def feature_table(
    df: DataFrame, key: Sequence[str], label: str, numbers: Mapping[str, Column], categories: Sequence[str] = (), keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Key, label, numeric features (missing is 0), category codes and the hold-out flag, staged."""
    base = df.select(
        *[quoted(k).alias(f"key{i}") for i, k in enumerate(key)],
        quoted(label).cast("double").alias("label"),
        *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in numbers.items()],
        *[quoted(c).cast("string").alias(c) for c in dict.fromkeys([*categories, *keep])],
    ).filter(F.col("label").isNotNull())
    coded = with_codes(base, dictionary(base, categories), categories, suffix="_code") if categories else base
    held = chance([F.col(f"key{i}") for i in range(len(key))], SEED, "hold-out") < TEST_SHARE
    names = [*numbers, *[c + "_code" for c in categories]]
    columns = [f"key{i}" for i in range(len(key))]
    out = coded.select(
        *columns, "label", *[quoted(n).cast("double").alias(n) for n in names], *[quoted(k) for k in keep], held.alias("held_out")
    )
    return spread_out(stage_table(out)), names


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def _too_few(table: DataFrame, min_rows: int | None) -> DataFrame | None:
    """A report in place of a fit: for fewer than ``min_rows``, where the caller set that, or for no row to learn from."""
    rows, learned = table.agg(F.count(F.lit(1)), F.count(F.when(~F.col("held_out"), 1))).first()
    return _known(table, [("status", "insufficient_data", rows)]) if not learned or rows < (min_rows or 0) else None


def _one_class(table: DataFrame) -> DataFrame | None:
    low, high = table.agg(F.min("label"), F.max("label")).first()
    return _known(table, [("status", "insufficient_classes", 1)]) if low == high else None


def _importances(table: DataFrame, model, features: Sequence[str]) -> DataFrame:
    found = model.importances if isinstance(model, (TreesModel, BoostedModel)) else model.featureImportances.toArray()
    return _known(table, [("importance", n, v) for n, v in zip(features, found)])


def _forest(classes: bool = True) -> Forest:
    return Forest(classes, trees=TREES, depth=DEPTH, seed=SEED)


def _fit(table: DataFrame, features: Sequence[str], estimator):
    shared_folder(table.sparkSession)
    if isinstance(estimator, (Forest, Boosted)):
        model = estimator.fit(table.filter(~F.col("held_out")), features)
        return model, model.transform(table)
    vectors = _assembled(table, features)
    model = estimator.fit(vectors.filter(~F.col("held_out")))
    return model, model.transform(vectors)


def _classified(
    table: DataFrame, features: Sequence[str], estimator, bands: Mapping[str, Callable[[], Column]] | None = None, binary: bool = True
) -> Trained:
    """Fit a classifier and report accuracy on both parts, test metrics, bands and importances."""
    model, scored = _fit(table, features, estimator)
    test, right = F.col("held_out"), F.col("label") == F.col("prediction")
    scored = scored.withColumn("probability_1", vector_to_array("probability")[1])
    measured = {
        "train_accuracy": F.avg(F.when(~test, right.cast("double"))),
        "test_accuracy": F.avg(F.when(test, right.cast("double"))),
        "train_rows": F.count(F.when(~test, 1)),
        "test_rows": F.count(F.when(test, 1)),
    }
    if binary:
        measured |= _binary_counts(F.col("label"), F.col("prediction"), test)
    for name, condition in (bands or {}).items():
        measured[f"band_{name}"] = F.count(F.when(condition(), 1))
    row = scored.agg(*[v.alias(k) for k, v in measured.items()])
    cells = [_cell("metric", k, F.col(k)) for k in ("train_accuracy", "test_accuracy", "train_rows", "test_rows")]
    if binary:
        cells += [_cell("metric", k, v) for k, v in _binary_metrics().items() if k != "accuracy"]
        cells += [_cell("confusion", k, F.col(k)) for k in ("tp", "fp", "fn", "tn")]
    cells += [_cell("distribution", k, F.col(f"band_{k}")) for k in (bands or {})]
    report = row.select(F.inline(F.array(*cells))).unionByName(_importances(table, model, features))
    return Trained(report, scored.drop("features", "rawPrediction"))


def _regressed(table: DataFrame, features: Sequence[str], bands: Mapping[str, Callable[[], Column]] | None = None) -> Trained:
    """Fit a forest regressor and report errors on both parts."""
    model, scored = _fit(table, features, _forest(classes=False))
    test = F.col("held_out")
    label, prediction = F.col("label"), F.col("prediction")
    parts = {}
    for tag, where in (("train", ~test), ("test", test), ("all", F.lit(True))):
        parts |= {f"{tag}_{k}": v for k, v in _regression_parts(label, prediction, where).items()}
    for name, condition in (bands or {}).items():
        parts[f"band_{name}"] = F.count(F.when(test & condition(), 1))
    row = scored.agg(*[v.alias(k) for k, v in parts.items()])
    cells = []
    for tag in ("train", "test", "all"):
        cells.append(_cell(tag, "mse", F.col(f"{tag}_mse")))
        cells.append(_cell(tag, "rmse", F.sqrt(f"{tag}_mse")))
        cells.append(_cell(tag, "mae", F.col(f"{tag}_mae")))
        cells.append(_cell(tag, "r2_score", 1 - F.try_divide(f"{tag}_mse", f"{tag}_variance")))
    cells.append(_cell("test", "mean_error_percentage", F.try_divide("test_mae", "test_mean_label") * 100))
    cells.append(_cell("all", "mean_label", F.col("all_mean_label")))
    cells.append(_cell("test", "mean_prediction", F.col("test_mean_prediction")))
    cells += [_cell("distribution", k, F.col(f"band_{k}")) for k in (bands or {})]
    report = row.select(F.inline(F.array(*cells))).unionByName(_importances(table, model, features))
    return Trained(report, scored.drop("features"))


def _risk_bands(test_only: bool = True) -> dict[str, Callable[[], Column]]:
    p = lambda: F.col("probability_1")
    inside = lambda: F.col("held_out") if test_only else F.lit(True)
    return {
        "low_risk": lambda: inside() & (p() < 0.3),
        "medium_risk": lambda: inside() & (p() >= 0.3) & (p() < 0.7),
        "high_risk": lambda: inside() & (p() >= 0.7),
    }


# ---- sales models --------------------------------------------------------------------------------------


def demand(df: DataFrame, roles: Roles, key: Sequence[str], min_rows: int | None = None) -> Trained:
    """Quantity from calendar fields and price."""
    moment = _date_of(df, roles)
    dated = df.withColumn("_date", moment).filter(F.col("_date").isNotNull())
    parts = date_parts(F.col("_date"))
    numbers = {n: parts[n] for n in ("year", "month", "day", "weekday", "quarter")}
    if "price" in roles:
        numbers["price"] = quoted(roles["price"])
    table, names = feature_table(dated, key, roles["quantity"], numbers)
    few = _too_few(table, min_rows)
    return Trained(few, None) if few is not None else _regressed(table, names)


def churn(df: DataFrame, roles: Roles, min_rows: int | None = None) -> Trained:
    """Churn from counts and sums per customer; days since the last purchase are left out, they make the label."""
    customers = labels.churn_features(df, roles)
    numbers = {n: F.col(n) for n in ("transactions", "revenue", "mean_revenue", "quantity")}
    table, names = feature_table(customers, ["customer"], "churn", numbers)
    stop = _too_few(table, min_rows)
    stop = _one_class(table) if stop is None else stop
    if stop is not None:
        return Trained(stop, None)
    p = lambda: F.col("probability_1")
    bands = {
        "low_risk": lambda: p() < 0.3,
        "medium_risk": lambda: (p() >= 0.3) & (p() <= 0.7),
        "high_risk": lambda: p() > 0.7,
        "churned": lambda: F.col("label") == 1,
        "total_customers": lambda: F.lit(True),
    }
    # One row per customer.
    rows = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=1024, cacheNodeIds=True
    )
    return _classified(table, names, rows, bands)


def segments(df: DataFrame, roles: Roles, k: int = 5) -> Trained:
    """K-means with ``k`` clusters over standardised money, frequency, quantity and recency."""
    features = stage_table(labels.segment_features(df, roles))
    names = ["monetary", "frequency", "quantity", "recency"]
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(features)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors).transform(vectors)
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(scaled)
    scored = model.transform(scaled).drop("raw", "features")
    # One row per cluster.
    sizes = scored.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        *[f(c).alias(f"{c}_{t}") for c in ("monetary", "frequency", "recency") for t, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.sum("monetary").alias("revenue"),
    )
    report = sizes.select(
        "cluster", "customers", *[F.round(c, 2).alias(c) for c in sizes.columns if c not in ("cluster", "customers")]
    )
    return Trained(report, scored)


def item_similarity(df: DataFrame, roles: Roles, k: int = 5, products: int | None = None) -> DataFrame:
    """The k most similar products of each product, by falling similarity, then by name.

    Similarity is the correlation of purchase counts over all customers who bought any product. It comes
    from sums of products of counts; the dense matrix is never built. Two products without a common
    customer correlate below zero, by a factor of each: for a product with fewer than k others
    at zero or above, those are taken from the list of all products by that factor, as many more than
    k as the product has partners, so enough are left that are none.

    ``products`` keeps that many of the most frequent products only.
    """
    facts = df.select(quoted(roles["customer"]).alias("customer"), quoted(roles["product"]).alias("product"))
    facts = facts.filter(F.col("customer").isNotNull() & F.col("product").isNotNull())
    if products is not None:
        facts = facts.join(stage(popular_products(df, roles, products)).select("product"), "product")
    counts = stage_table(facts.groupBy("customer", "product").agg(F.count(F.lit(1)).alias("n")))
    customers = F.lit(float(counts.select("customer").distinct().count()))
    names = ranked_products(counts)
    placed = stage_table(counts.join(names, "product").select("customer", "slot", "n"))
    sums = placed.groupBy("slot").agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q"))
    spread = customers * F.col("q") - F.col("s") * F.col("s")
    # A product that all customers bought equally often has no correlation.
    named = names.join(sums, "slot").select("slot", "product", "s", spread.alias("v"), (F.col("s") / F.sqrt(spread)).alias("f")).filter("v > 0")
    named = stage_table(row_index(named, ["f", "product"], "place", unique=True))
    release(counts, names)

    def side(slot: str, product: str, s: str, v: str) -> DataFrame:
        return named.select(F.col("slot").alias(slot), F.col("product").alias(product), F.col("s").alias(s), F.col("v").alias(v))

    totals = pair_products(placed, "customer", "slot", "n").filter("a < b")
    both = totals.union(totals.select("b", "a", "total"))
    mine, theirs = side("a", "product", "sa", "va"), side("b", "similar_product", "sb", "vb")

    def scored(pairs: DataFrame) -> DataFrame:
        covered = customers * F.col("total") - F.col("sa") * F.col("sb")
        return pairs.join(mine, "a").join(theirs, "b").select("a", "b", "product", "similar_product", (covered / F.sqrt(F.col("va") * F.col("vb"))).alias("raw"))

    met = stage_table(scored(both))
    release(placed)
    own = met.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.count(F.when(F.col("raw") >= 0, 1)).alias("good"))
    short = named.select(F.col("slot").alias("a")).join(own, "a", "left").filter(F.coalesce("good", F.lit(0)) < k)
    upto = F.coalesce("partners", F.lit(0)) + k
    listed = short.select("a", F.explode(F.sequence(F.lit(0).cast("long"), upto)).alias("place"))
    others = listed.join(named.select("place", F.col("slot").alias("b")), "place").filter("a <> b").select("a", "b")
    strangers = others.join(met.select("a", "b"), ["a", "b"], "left_anti").withColumn("total", F.lit(0.0))
    best = top_per(met.unionByName(scored(strangers)), ["product"], [F.desc("raw"), F.asc("similar_product")], k)
    return best.select("product", "rank", "similar_product", F.round("raw", 6).alias("similarity"))


def item_popularity(df: DataFrame, roles: Roles, k: int = 20) -> DataFrame:
    return popular_products(df, roles, k).select("product", "n")


# ---- clinical models -------------------------------------------------------------------------------------

_PROFILE = ("gender", "blood_type", "condition", "admission_type", "insurer")


def _numbers(df: DataFrame, roles: Mapping[str, str], wanted: Sequence[str]) -> dict[str, Column]:
    makers = {"age": labels.age_of, "cost": labels.cost_of}
    out = {}
    for name in wanted:
        if name in makers:
            value = makers[name](df, roles)
            if value is not None:
                out[name] = value
        elif name in roles:
            out[name] = labels._number(df, roles[name])
    return out


def _categories(roles: Mapping[str, str], wanted: Sequence[str]) -> list[str]:
    return [roles[r] for r in wanted if r in roles]


def _stopped(table: DataFrame, features: Sequence[str], min_rows: int | None, classes: bool) -> DataFrame | None:
    if not features:
        return _known(table, [("status", "insufficient_features", 0)])
    stop = _too_few(table, min_rows)
    if stop is None and classes:
        stop = _one_class(table)
    return stop


def readmission(df: DataFrame, roles: Mapping[str, str], min_rows: int | None = None) -> Trained:
    """Risk of a further admission."""
    named = "patient" in roles and "admitted" in roles
    labelled = labels.readmission_label(df, roles)
    # Without names the label is made from age, so age is no feature then.
    numbers = _numbers(df, roles, ("age", "cost", "room") if named else ("cost", "room"))
    table, names = feature_table(labelled, [roles["id"]], "readmission", numbers, _categories(roles, _PROFILE))
    stop = _stopped(table, names, min_rows, True)
    return Trained(stop, None) if stop is not None else _classified(table, names, _forest(), _risk_bands())


def cost(df: DataFrame, roles: Mapping[str, str], min_rows: int | None = None) -> Trained:
    """Cost from age, room and profile, outliers beyond three deviations left out."""
    priced = labels.without_outliers(df.withColumn("_cost", F.coalesce(labels.cost_of(df, roles), F.lit(0.0))), "_cost")
    numbers = _numbers(df, roles, ("age", "room"))
    chosen = _categories(roles, ("condition", "admission_type", "insurer", "medication"))
    table, names = feature_table(priced, [roles["id"]], "_cost", numbers, chosen)
    stop = _stopped(table, names, min_rows, False)
    return Trained(stop, None) if stop is not None else _regressed(table, names)


def risk(df: DataFrame, roles: Mapping[str, str], min_rows: int | None = None) -> Trained:
    """Risk level in three classes, from cost, age, room and profile."""
    labelled = stage_table(labels.risk_label(df, roles, noise=labels.LEVEL_NOISE))
    table, names = feature_table(labelled, [roles["id"]], "risk_level", _numbers(df, roles, ("cost", "age", "room")), _categories(roles, _PROFILE))
    stop = _stopped(table, names, min_rows, False)
    if stop is not None:
        return Trained(stop, None)
    at = lambda level: lambda: F.col("held_out") & (F.col("prediction") == level)
    bands = {"low": at(0), "medium": at(1), "high": at(2)}
    return _classified(table, names, _forest(), bands, binary=False)


def outcome(df: DataFrame, roles: Mapping[str, str], rounds: int = BOOST_ROUNDS, min_rows: int | None = None) -> Trained:
    """Treatment success by gradient boosting; the cost is left out, it makes the label."""
    labelled = labels.outcome_label(df, roles, noise=labels.OUTCOME_NOISE)
    wanted = ("age", "room") if "cost" in roles and "condition" in roles else ("age", "cost", "room")
    chosen = _categories(roles, ("gender", "condition", "admission_type", "medication", "insurer"))
    table, names = feature_table(labelled, [roles["id"]], "outcome", _numbers(df, roles, wanted), chosen)
    stop = _stopped(table, names, min_rows, True)
    if stop is not None:
        return Trained(stop, None)
    boosted = Boosted(rounds, BOOST_DEPTH, step=0.1, seed=SEED)
    at = lambda value: lambda: F.col("held_out") & (F.col("prediction") == value)
    return _classified(table, names, boosted, {"success": at(1), "failure": at(0)})


def length_of_stay(df: DataFrame, roles: Mapping[str, str], min_rows: int | None = None) -> Trained:
    """Days of stay from the whole profile, outliers left out, in three bands."""
    labelled = labels.without_outliers(labels.los_label(df, roles), "stay_days")
    numbers = _numbers(df, roles, ("age", "cost", "room"))
    table, names = feature_table(labelled, [roles["id"]], "stay_days", numbers, _categories(roles, _PROFILE))
    stop = _stopped(table, names, min_rows, False)
    if stop is not None:
        return Trained(stop, None)
    days = lambda: F.col("prediction")
    bands = {
        "short_stay": lambda: days() < 5,
        "medium_stay": lambda: (days() >= 5) & (days() < 14),
        "long_stay": lambda: days() >= 14,
    }
    return _regressed(table, names, bands)


def medication(df: DataFrame, roles: Mapping[str, str], classes: int = 10, k: int = 3, min_rows: int | None = None) -> Trained:
    """Medicine from the profile; recommendations are the mean class probabilities per condition."""
    medicine = quoted(roles["medication"])
    top = df.filter(medicine.isNotNull()).groupBy(medicine.alias("_medicine")).agg(F.count(F.lit(1)).alias("_n"))
    top = stage(top.orderBy(F.desc("_n"), "_medicine").limit(classes))
    # At most ten rows.
    numbered = top.withColumn("_class", F.row_number().over(Window.orderBy(F.desc("_n"), "_medicine")) - 1)
    labelled = df.join(F.broadcast(numbered.select("_medicine", "_class")), medicine == F.col("_medicine"))
    names_of = [r["_medicine"] for r in numbered.orderBy("_class").select("_medicine").collect()]
    chosen = _categories(roles, ("gender", "blood_type", "condition"))
    keep = [roles["condition"]] if "condition" in roles else []
    table, names = feature_table(labelled, [roles["id"]], "_class", _numbers(df, roles, ("age", "cost")), chosen, keep)
    stop = _stopped(table, names, min_rows, True)
    if stop is not None:
        return Trained(stop, None)
    trained = _classified(table, names, _forest(), binary=False)
    if not keep:
        return trained
    chances = vector_to_array("probability")
    means = trained.scored.filter(quoted(keep[0]).isNotNull()).groupBy(quoted(keep[0]).alias("condition")).agg(
        *[F.avg(chances[i]).alias(f"p{i}") for i in range(len(names_of))]
    )
    cells = [F.struct(F.col(f"p{i}").alias("p"), F.lit(m).alias("medicine")) for i, m in enumerate(names_of)]
    ordered = F.slice(F.sort_array(F.array(*cells), asc=False), 1, k)
    advice = means.select("condition", F.inline(ordered)).select(
        F.lit("recommendation").alias("section"), F.concat_ws(": ", "condition", "medicine").alias("key"), F.col("p").alias("value")
    )
    return Trained(trained.report.unionByName(advice), trained.scored)


def discharge(df: DataFrame, roles: Mapping[str, str], min_rows: int | None = None) -> Trained:
    """Care level after discharge in three classes."""
    labelled = labels.discharge_label(df, roles, noise=labels.LEVEL_NOISE)
    numbers = _numbers(df, roles, ("age", "cost", "room"))
    table, names = feature_table(labelled, [roles["id"]], "care_level", numbers, _categories(roles, _PROFILE))
    stop = _stopped(table, names, min_rows, True)
    if stop is not None:
        return Trained(stop, None)
    at = lambda level: lambda: F.col("held_out") & (F.col("label") == level)
    bands = {name.lower(): at(i) for i, name in enumerate(labels.CARE_LEVELS)}
    return _classified(table, names, _forest(), bands, binary=False)


MODELS: dict[str, Callable[..., Trained]] = {
    "readmission": readmission,
    "cost": cost,
    "risk": risk,
    "outcome": outcome,
    "lengthofstay": length_of_stay,
    "medication": medication,
    "discharge": discharge,
}


def train(df: DataFrame, roles: Mapping[str, str], names: Sequence[str] = tuple(MODELS), min_rows: int | None = None) -> DataFrame:
    """Reports of several models on one table, which is evaluated once."""
    table = stage_table(df)
    result = None
    for name in names:
        if name not in MODELS:
            raise ValueError(f"unknown model: {name}")
        part = MODELS[name](table, roles, min_rows=min_rows).report.select(F.lit(name).alias("model"), "section", "key", "value")
        result = part if result is None else result.unionByName(part)
    return result
