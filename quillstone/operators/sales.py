"""Sales jobs: revenue, trends, customer value, products, regions, dashboards.

``roles`` maps a role (date, customer, product, product_id, price, quantity, country, revenue,
profit, amount) to a column name. A role that is not given yields NULL or 0 results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    time_of,
    bucket_number,
    epoch_micros,
    first_match,
    first_word,
    quoted,
    share,
    time_literal,
    whole_days,
)
from ..functions.grouping import pair_products
from ..functions.ordering import row_index
from ..functions.quantiles import exact_quantiles, value_at_rank
from ..session import release, stage, stage_table

Roles = Mapping[str, str]

# Margin assumed when a table has no profit column.
ASSUMED_MARGIN = 0.2
DAYS_PER_MONTH = 30.44
FIRST_PRODUCTS = 256  # whose pairs are counted first

# Segment of a recency-frequency-money score; the first list that holds it wins.
SEGMENTS = (
    ("Champions", ("555", "554", "544", "545", "454", "455", "445")),
    ("Loyal Customers", ("543", "444", "433", "443")),
    ("Potential Loyalists", ("512", "511", "522", "521", "531", "532")),
    ("New Customers", ("344", "354", "355", "454", "455", "445")),
    ("Promising", ("155", "154", "144", "214", "215", "115", "114")),
    ("Need Attention", ("331", "341", "342", "332", "321", "322")),
    ("About to Sleep", ("133", "134", "143", "144", "244", "234", "225", "215")),
    ("At Risk", ("311", "312", "313", "314", "315")),
    ("Cannot Lose Them", ("111", "112", "113", "114", "115")),
    ("Hibernating", ("211", "212", "213", "214", "215")),
)
OTHER_SEGMENT = "Lost"


def revenue_of(roles: Roles) -> Column:
    """Revenue column, else price × quantity, else the amount column, else the price."""
    if "revenue" in roles:
        return quoted(roles["revenue"])
    if "price" in roles and "quantity" in roles:
        return quoted(roles["price"]) * quoted(roles["quantity"])
    if "amount" in roles:
        return quoted(roles["amount"])
    if "price" in roles:
        return quoted(roles["price"])
    raise ValueError("no revenue, price or amount role")


def with_revenue(df: DataFrame, roles: Roles, name: str = "revenue") -> DataFrame:
    return df.withColumn(name, revenue_of(roles))


def _date_of(df: DataFrame, roles: Roles) -> Column:
    return time_of(df, roles["date"])


def _facts(df: DataFrame, roles: Roles, *wanted: str) -> DataFrame:
    """The wanted roles under their role names."""
    made = {"revenue": lambda: revenue_of(roles), "date": lambda: _date_of(df, roles)}
    return df.select(*[(made[w]() if w in made else quoted(roles[w])).alias(w) for w in wanted])


def _double(column: Column) -> Column:
    return column.cast("double")


def _mean(column: Column) -> Column:
    """Mean from an exact sum, so decimals lose nothing on the way."""
    return F.try_divide(_double(F.sum(column)), F.count(column))


def _metrics(row: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """A one-row aggregate as (metric, value) rows."""
    cells = [F.struct(F.lit(k).alias("metric"), _double(v).alias("value")) for k, v in values.items()]
    return row.select(F.inline(F.array(*cells)))


# ---- revenue -------------------------------------------------------------------------------


def revenue_total(df: DataFrame, roles: Roles) -> DataFrame:
    """Headline figures as (metric, value) rows, rounded to 4 decimals."""
    optional = [r for r in ("profit", "customer", "date") if r in roles]
    facts = _facts(df, roles, "revenue", *optional)
    quarters = exact_quantiles(facts, {"revenue": [0.5, 0.75]})["revenue"]
    amount = _double(F.col("revenue"))
    profit = F.coalesce(F.sum("profit"), F.lit(0)) if "profit" in roles else F.lit(0)
    measured = {
        "rows": F.count(F.lit(1)),
        "total": F.sum("revenue"),
        "mean": _mean(F.col("revenue")),
        "std": F.stddev_samp(amount),
        "profit": profit,
        "high": F.count(F.when(amount > F.lit(quarters[1]), 1)),
        "r0": F.count(F.when((amount >= 0) & (amount <= 100), 1)),
        "r100": F.count(F.when((amount > 100) & (amount <= 500), 1)),
        "r500": F.count(F.when((amount > 500) & (amount <= 1000), 1)),
        "r1000": F.count(F.when(amount > 1000, 1)),
    }
    if "date" in roles:
        measured["first_day"], measured["last_day"] = F.min("date"), F.max("date")
    row = facts.agg(*[v.alias(k) for k, v in measured.items()])
    volatility = F.try_divide(F.col("std"), F.col("mean")) * 100
    margin = F.try_divide(_double(F.col("profit")), _double(F.col("total"))) * 100
    parts = [
        _metrics(
            row,
            {
                "total_revenue": F.col("total"),
                "total_profit": F.col("profit"),
                "average_revenue": F.col("mean"),
                "median_revenue": F.lit(quarters[0]),
                "profit_margin": margin,
                "total_transactions": F.col("rows"),
                "revenue_volatility": volatility,
                "high_value_orders": F.col("high"),
                "range_0_100": F.col("r0"),
                "range_100_500": F.col("r100"),
                "range_500_1000": F.col("r500"),
                "range_1000_up": F.col("r1000"),
            },
        )
    ]
    if "customer" in roles:
        parts.append(_customer_figures(facts, "date" in roles))
    if "date" in roles:
        monthly = period_revenue(df, roles, "month")
        parts.append(monthly.agg((F.avg("growth") * 100).alias("value")).select(F.lit("revenue_growth").alias("metric"), "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("metric", F.round("value", 4).alias("value"))


def _customer_figures(facts: DataFrame, dated: bool) -> DataFrame:
    per_customer = facts.filter(F.col("customer").isNotNull()).groupBy("customer").agg(
        F.sum("revenue").alias("spent"),
        F.count("date" if dated else F.lit(1)).alias("orders"),
        *([F.min("date").alias("first_day"), F.max("date").alias("last_day")] if dated else []),
    )
    row = per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        _mean(F.col("spent")).alias("aov"),
        F.sum("spent").alias("total"),
        F.avg("orders").alias("orders"),
        *(
            [whole_days(F.min("first_day"), F.max("last_day")).alias("days")]
            if dated
            else [F.lit(None).cast("long").alias("days")]
        ),
    )
    months = F.when(F.col("days") > 0, F.col("days") / DAYS_PER_MONTH)
    return _metrics(
        row,
        {
            "average_order_value": F.col("aov"),
            "revenue_per_customer": F.try_divide(_double(F.col("total")), F.col("customers")),
            "order_frequency": F.try_divide(F.col("orders"), months),
        },
    )


def half_trend(df: DataFrame, roles: Roles, ties: Sequence[str] = ()) -> DataFrame:
    """Mean revenue of the earlier and the later half of the rows, and the direction (±5 %).

    The date at the middle is found exactly; only rows of that one date are put in order.
    """
    tied = [f"_tie{i}" for i in range(len(ties))]
    facts = df.select(
        _date_of(df, roles).alias("date"),
        revenue_of(roles).alias("revenue"),
        *[quoted(t).alias(name) for t, name in zip(ties, tied)],
    ).filter(F.col("date").isNotNull())
    stamps = facts.withColumn("stamp", epoch_micros(F.col("date")))
    rows = facts.count()
    middle = value_at_rank(stamps, "stamp", rows // 2, size=rows)
    amount, stamp = F.col("revenue"), F.col("stamp")
    if middle is None:
        before = stamps.limit(0)
        cut = 0
    else:
        before = stamps.filter(stamp < F.lit(int(middle)))
        cut = rows // 2 - before.count()
    early = before.select("revenue")
    if cut > 0:
        same_day = stamps.filter(stamp == F.lit(int(middle))).select(*tied, "revenue")
        early = early.unionByName(row_index(same_day, tied, "place").filter(F.col("place") < cut).select("revenue"))
    # Sums of both halves in one aggregate: the later half is all rows minus the earlier ones.
    sums = early.select(amount.alias("early"), F.lit(None).cast(facts.schema["revenue"].dataType).alias("every")).unionByName(
        facts.select(F.lit(None).cast(facts.schema["revenue"].dataType).alias("early"), amount.alias("every"))
    )
    row = sums.agg(
        F.sum("early").alias("early"),
        F.count("early").alias("early_n"),
        F.sum("every").alias("every"),
        F.count("every").alias("every_n"),
    )
    first = F.try_divide(_double(F.col("early")), F.col("early_n"))
    later = _double(F.col("every")) - F.coalesce(_double(F.col("early")), F.lit(0.0))
    second = F.try_divide(later, F.col("every_n") - F.col("early_n"))
    return row.select(
        F.round(first, 4).alias("first_half"),
        F.round(second, 4).alias("second_half"),
        F.when(second > first * 1.05, "Increasing").when(second < first * 0.95, "Decreasing").otherwise("Stable").alias("trend"),
    )


def daily_revenue(df: DataFrame, roles: Roles) -> DataFrame:
    facts = _facts(df, roles, "date", "revenue").filter(F.col("date").isNotNull() & F.col("revenue").isNotNull())
    return facts.groupBy(F.to_date("date").alias("day")).agg(F.sum("revenue").alias("revenue"))


def period_revenue(df: DataFrame, roles: Roles, period: str) -> DataFrame:
    """Revenue by day, week or month with growth against the period before it.

    Weeks are (calendar year, ISO week). All three come from the daily sums, a table of one row
    per calendar day, so the base rows are shuffled once and the window is small.
    """
    keys = {
        "day": [F.date_format("day", "yyyy-MM-dd").alias("period")],
        "week": [F.concat(F.year("day"), F.lit("-W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0")).alias("period")],
        "month": [F.date_format("day", "yyyy-MM").alias("period")],
    }[period]
    table = daily_revenue(df, roles).groupBy(*keys).agg(F.sum("revenue").alias("revenue"))
    before = F.lag("revenue").over(Window.orderBy("period"))
    growth = F.try_divide(_double(F.col("revenue")) - _double(before), _double(before))
    return table.select("period", _double(F.col("revenue")).alias("revenue"), growth.alias("growth"))


def trend_figures(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean growth (%) and deviation of the daily, weekly and monthly sums."""
    result = None
    for period in ("day", "week", "month"):
        row = period_revenue(df, roles, period).agg(
            F.count(F.lit(1)).alias("periods"),
            F.round(F.coalesce(F.avg("growth") * 100, F.lit(0.0)), 4).alias("growth_rate"),
            F.round(F.stddev_samp("revenue"), 4).alias("std"),
        ).select(F.lit(period).alias("period"), "periods", "growth_rate", "std")
        result = row if result is None else result.unionByName(row)
    return result


# ---- customers -----------------------------------------------------------------------------


def rfm_scores(df: DataFrame, roles: Roles) -> DataFrame:
    """Recency, frequency, money, their quintile scores, the segment and the lifetime value.

    Quintiles follow value edges: equal values share a score. Repeated edges leave scores unused.
    """
    facts = _facts(df, roles, "customer", "date", "revenue").na.drop()
    customers = stage_table(
        facts.groupBy("customer").agg(
            F.max("date").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("revenue").alias("monetary")
        )
    )
    newest = customers.agg(F.max("last")).first()[0]
    measured = customers.select(
        "customer",
        whole_days(F.col("last"), time_literal(newest)).alias("recency"),
        "frequency",
        _double(F.col("monetary")).alias("monetary"),
    )
    fifths = [0.2, 0.4, 0.6, 0.8]
    edges = exact_quantiles(measured, {c: fifths for c in ("recency", "frequency", "monetary")})
    if edges["recency"][0] is None:
        edges = {c: [0.0] * 4 for c in edges}
    scored = measured.select(
        "*",
        (6 - bucket_number(F.col("recency"), edges["recency"])).alias("r_score"),
        bucket_number(F.col("frequency"), edges["frequency"]).alias("f_score"),
        bucket_number(F.col("monetary"), edges["monetary"]).alias("m_score"),
    )
    score = F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])
    segment = first_match([(F.col("rfm_score").isin(*codes), name) for name, codes in SEGMENTS], OTHER_SEGMENT)
    return scored.withColumn("rfm_score", score).select(
        "customer",
        "recency",
        "frequency",
        "monetary",
        "r_score",
        "f_score",
        "m_score",
        "rfm_score",
        segment.alias("segment"),
        (F.col("monetary") * F.col("frequency") * (F.lit(365.0) / (F.col("recency") + 1))).alias("clv"),
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("monetary"), 2).alias("revenue")
    )


def rfm_value(scores: DataFrame) -> DataFrame:
    """Mean and median lifetime value and the number of customers in three value bands."""
    low, mid, high = exact_quantiles(scores, {"clv": [0.4, 0.5, 0.8]})["clv"]
    clv = F.col("clv")
    return scores.agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg(clv), 2).alias("average_clv"),
        F.round(F.lit(mid), 2).alias("median_clv"),
        F.count(F.when(clv > high, 1)).alias("high_clv"),
        F.count(F.when((clv >= low) & (clv <= high), 1)).alias("medium_clv"),
        F.count(F.when(clv < low, 1)).alias("low_clv"),
    )


def rfm_top(scores: DataFrame, k: int = 10) -> DataFrame:
    top = scores.orderBy(F.desc("clv"), "customer").limit(k)
    return top.select("customer", "recency", "frequency", F.round("monetary", 2).alias("monetary"), F.round("clv", 0).alias("clv"), "segment")


def customer_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """Per customer: sum, count and mean of price, sum of quantity (rounded to 2 decimals)."""
    facts = _facts(df, roles, "customer", "price", "quantity").filter(F.col("customer").isNotNull())
    return facts.groupBy("customer").agg(
        F.round(F.sum("price"), 2).alias("price_sum"),
        F.count("price").alias("price_count"),
        F.round(F.avg("price"), 2).alias("price_mean"),
        F.round(F.sum("quantity"), 2).alias("quantity_sum"),
    )


def top_customers(df: DataFrame, roles: Roles, k: int = 10) -> DataFrame:
    return customer_summary(df, roles).orderBy(F.desc("price_sum"), "customer").limit(k)


# ---- products ------------------------------------------------------------------------------


def product_performance(df: DataFrame, roles: Roles) -> DataFrame:
    """Per (product, id): revenue sum, mean and count, quantity, mean price."""
    optional = [r for r in ("quantity", "price") if r in roles]
    facts = _facts(df, roles, "product", "product_id", "revenue", *optional)
    facts = facts.filter(F.col("product").isNotNull() & F.col("product_id").isNotNull())
    return facts.groupBy("product", "product_id").agg(
        F.round(_double(F.sum("revenue")), 2).alias("total_revenue"),
        F.round(_mean(F.col("revenue")), 2).alias("avg_revenue"),
        F.count("revenue").alias("transaction_count"),
        (F.round(F.sum("quantity"), 2) if "quantity" in roles else F.lit(0.0)).alias("total_quantity"),
        (F.round(F.avg("price"), 2) if "price" in roles else F.lit(0.0)).alias("avg_price"),
    )


def top_products(df: DataFrame, roles: Roles, k: int = 20) -> DataFrame:
    return product_performance(df, roles).orderBy(F.desc("total_revenue"), "product", "product_id").limit(k)


def product_bands(df: DataFrame, roles: Roles) -> DataFrame:
    """How many products lie above the 80 % value, between, and below the 20 % value of revenue."""
    totals = stage_table(product_performance(df, roles).select("total_revenue"))
    low, high = exact_quantiles(totals, {"total_revenue": [0.2, 0.8]})["total_revenue"]
    value = F.col("total_revenue")
    return totals.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(F.when(value > high, 1)).alias("top_band"),
        F.count(F.when((value >= low) & (value <= high), 1)).alias("middle_band"),
        F.count(F.when(value < low, 1)).alias("bottom_band"),
    )


def category_performance(df: DataFrame, roles: Roles, k: int = 10) -> DataFrame:
    """Revenue and distinct products by the first word of the product name."""
    facts = _facts(df, roles, "product", "revenue")
    # Sums per product first: the distinct count then runs on one row per product.
    products = facts.filter(F.col("product").isNotNull()).groupBy("product").agg(F.sum("revenue").alias("revenue"))
    categories = products.withColumn("category", first_word(F.col("product"))).filter(F.col("category").isNotNull())
    return (
        categories.groupBy("category")
        .agg(F.round(_double(F.sum("revenue")), 2).alias("revenue"), F.count(F.lit(1)).alias("products"))
        .orderBy(F.desc("revenue"), "category")
        .limit(k)
    )


def popular_products(df: DataFrame, roles: Roles, k: int) -> DataFrame:
    """The k most frequent products with a slot number in name order; at most k rows."""
    facts = _facts(df, roles, "product").filter(F.col("product").isNotNull())
    top = facts.groupBy("product").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product").limit(k)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("product")) - 1)


def _bought(df: DataFrame, roles: Roles) -> DataFrame:
    """Distinct (customer, product)."""
    facts = _facts(df, roles, "customer", "product").filter(F.col("customer").isNotNull() & F.col("product").isNotNull())
    return facts.select("customer", "product").distinct()


def ranked_products(bought: DataFrame) -> DataFrame:
    """(product, buyers, slot): products numbered by falling number of rows in ``bought``; staged."""
    counts = bought.groupBy("product").agg(F.count(F.lit(1)).alias("buyers"))
    return stage_table(row_index(counts, [F.desc("buyers"), "product"], "slot", unique=True))


def _named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of slots a < b as pairs of names in name order."""
    left = names.select(F.col("slot").alias("a"), F.col("product").alias("one"))
    right = names.select(F.col("slot").alias("b"), F.col("product").alias("other"))
    return pairs.join(left, "a").join(right, "b").select(
        F.least("one", "other").alias("product_a"), F.greatest("one", "other").alias("product_b"), F.col("total").cast("long").alias("co_purchases")
    )


def co_purchases(df: DataFrame, roles: Roles, products: int | None = None) -> DataFrame:
    """How many customers bought both of two products, for all pairs that anyone bought.

    ``products`` keeps the pairs of that many of the most frequent products only.
    """
    bought = _bought(df, roles)
    if products is not None:
        # ``products`` names, as the caller asked for.
        bought = bought.join(stage(popular_products(df, roles, products)).select("product"), "product")
    bought = stage_table(bought)
    names = ranked_products(bought)
    placed = bought.join(names, "product").select("customer", "slot", F.lit(1).alias("one"))
    return _named_pairs(pair_products(placed, "customer", "slot", "one").filter("a < b"), names)


def cross_sell(df: DataFrame, roles: Roles, k: int = 50, first: int = FIRST_PRODUCTS) -> DataFrame:
    """The k pairs of products that most customers bought together, of all products.

    A pair is bought together at most as often as the rarer of its two. So pairs are counted among the
    products with most buyers, twice as many each round, until the k-th best pair is more frequent than
    the next product: no pair with a product not yet seen can come before it.
    """
    bought = stage_table(_bought(df, roles))
    names = ranked_products(bought)
    placed = stage_table(bought.join(names, "product").select("customer", "slot", F.lit(1).alias("one")))
    release(bought)
    seen, upto, best = 0, first, None
    while True:
        pairs = pair_products(placed.filter(F.col("slot") < upto), "customer", "slot", "one", least=seen).filter("a < b")
        some = _named_pairs(pairs, names)
        some = some if best is None else some.unionByName(best)
        best = stage(some.orderBy(F.desc("co_purchases"), "product_a", "product_b").limit(k))
        after = names.filter(F.col("slot") == upto).select("buyers").first()
        n, least = best.agg(F.count(F.lit(1)), F.min("co_purchases")).first()
        if after is None or (n == k and least > after["buyers"]):
            release(placed, names)
            return best.orderBy(F.desc("co_purchases"), "product_a", "product_b")
        seen, upto = upto, 2 * upto


# ---- regions and dashboards ------------------------------------------------------------------


def geo_revenue(df: DataFrame, roles: Roles) -> DataFrame:
    """Per country: revenue, rows, distinct customers and their shares."""
    facts = _facts(df, roles, "country", "revenue", *(["customer"] if "customer" in roles else []))
    facts = facts.filter(F.col("country").isNotNull())
    if "customer" in roles:
        # One row per (country, customer) first, so a hot country is combined before it is shuffled.
        facts = facts.groupBy("country", "customer").agg(F.sum("revenue").alias("revenue"), F.count("revenue").alias("n"))
        customers = F.count("customer")
    else:
        facts = facts.select("country", "revenue", F.when(F.col("revenue").isNotNull(), 1).otherwise(0).alias("n"))
        customers = F.lit(0).cast("long")
    countries = stage_table(
        facts.groupBy("country").agg(
            F.sum("revenue").alias("revenue"), F.sum("n").alias("transactions"), customers.alias("customers")
        )
    )
    revenue, held = countries.agg(_double(F.sum("revenue")), _double(F.sum("customers"))).first()
    return countries.select(
        "country",
        F.round(_double(F.col("revenue")), 2).alias("total_revenue"),
        F.round(F.try_divide(_double(F.col("revenue")), F.col("transactions")), 2).alias("avg_revenue"),
        F.col("transactions").alias("transaction_count"),
        F.col("customers").alias("unique_customers"),
        share(F.col("revenue"), F.lit(revenue)).alias("market_share"),
        share(F.col("customers"), F.lit(held)).alias("customer_share"),
    )


def geo_concentration(df: DataFrame, roles: Roles) -> DataFrame:
    regions = geo_revenue(df, roles)
    return regions.agg(
        F.count(F.lit(1)).alias("total_countries"),
        F.max_by("market_share", F.struct("total_revenue", "country")).alias("market_concentration"),
    )


def dashboard_kpis(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: revenue, profit, customers, products, revenue per customer, margin."""
    facts = _facts(df, roles, "revenue", *[r for r in ("profit", "customer", "product") if r in roles])
    total = _double(F.sum("revenue"))
    profit = _double(F.sum("profit")) if "profit" in roles else total * ASSUMED_MARGIN
    held = _double(F.sum(F.when(F.col("customer").isNotNull(), F.col("revenue")))) if "customer" in roles else F.lit(0.0)
    customers = F.count_distinct("customer") if "customer" in roles else F.lit(0).cast("long")
    row = facts.agg(
        total.alias("total"),
        profit.alias("profit"),
        customers.alias("customers"),
        (F.count_distinct("product") if "product" in roles else F.lit(0).cast("long")).alias("products"),
        held.alias("held"),
    )
    return row.select(
        F.round("total", 2).alias("total_revenue"),
        F.round("profit", 2).alias("total_profit"),
        F.col("customers").alias("total_customers"),
        F.col("products").alias("total_products"),
        F.round(F.try_divide("held", "customers"), 2).alias("avg_order_value"),
        share(F.col("profit"), F.col("total"), 1).alias("profit_margin"),
    )


def dashboard_top(df: DataFrame, roles: Roles, k: int = 5) -> DataFrame:
    facts = _facts(df, roles, "product", "revenue", *(["quantity"] if "quantity" in roles else []))
    units = F.sum("quantity").cast("long") if "quantity" in roles else F.lit(0).cast("long")
    products = facts.filter(F.col("product").isNotNull()).groupBy("product").agg(
        F.round(_double(F.sum("revenue")), 2).alias("revenue"), units.alias("units")
    )
    return products.orderBy(F.desc("revenue"), "product").limit(k)


def dashboard_geo(df: DataFrame, roles: Roles) -> DataFrame:
    """Share of rows by country, one decimal."""
    counts = df.select(quoted(roles["country"]).alias("country")).filter(F.col("country").isNotNull())
    counts = stage_table(counts.groupBy("country").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("country", share(F.col("n"), F.lit(total), 1).alias("row_share"))


def dashboard_monthly(df: DataFrame, roles: Roles) -> DataFrame:
    months = period_revenue(df, roles, "month")
    return months.select(
        F.col("period").alias("month"),
        F.round("revenue", 2).alias("revenue"),
        F.round(F.col("revenue") * ASSUMED_MARGIN, 2).alias("profit"),
    )


def dashboard_segments(df: DataFrame, roles: Roles) -> DataFrame:
    """Customers split 20 / 50 / 30 per cent, each share cut to a whole number."""
    row = df.agg(F.count_distinct(quoted(roles["customer"])).alias("n"))
    shares = (("High Value", 0.2), ("Medium Value", 0.5), ("Low Value", 0.3))
    cells = [F.struct(F.lit(s).alias("segment"), (F.col("n") * p).cast("long").alias("customers")) for s, p in shares]
    return row.select(F.inline(F.array(*cells)))


def sales_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """Price × quantity in total, on average, for the top 10 products and by country."""
    facts = df.select(
        (quoted(roles["price"]) * quoted(roles["quantity"])).alias("sales"),
        quoted(roles["product"]).alias("product"),
        quoted(roles["country"]).alias("country"),
    )

    def part(section: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), "key", F.round("value", 2).alias("value"))

    overall = facts.agg(F.sum("sales").alias("total"), F.avg("sales").alias("mean")).select(
        F.inline(
            F.array(
                F.struct(F.lit("total_revenue").alias("key"), F.col("total").alias("value")),
                F.struct(F.lit("average_order_value").alias("key"), F.col("mean").alias("value")),
            )
        )
    )
    by_key = lambda c: facts.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.sum("sales").alias("value"))
    top = by_key("product").withColumn("value", F.round("value", 2)).orderBy(F.desc("value"), "key").limit(10)
    return part("overall", overall).unionByName(part("top_products", top)).unionByName(part("by_country", by_key("country")))
