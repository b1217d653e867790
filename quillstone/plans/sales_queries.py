"""Sales queries over the ``sales`` view."""

from __future__ import annotations

from ..operators import sales as job
from ..sources.views import SALES_ROLES as ROLES, sales, staged_sales
from .registry import Query, on_sales

_PERIOD = {
    "day": "strftime(Date, '%Y-%m-%d')",
    "week": "CAST(year(Date) AS VARCHAR) || '-W' || lpad(CAST(week(Date) AS VARCHAR), 2, '0')",
    "month": "strftime(Date, '%Y-%m')",
}


def _periods(period: str) -> str:
    return f"""{period}s AS (SELECT period, CAST(revenue AS DOUBLE) AS revenue,
  CAST(revenue AS DOUBLE) / lag(CAST(revenue AS DOUBLE)) OVER (ORDER BY period) - 1 AS growth
  FROM (SELECT {_PERIOD[period]} AS period, sum(Total_Revenue) AS revenue FROM sales GROUP BY 1))"""


_SEGMENT_CASE = (
    "CASE "
    + " ".join(
        "WHEN rfm_score IN (" + ",".join(f"'{c}'" for c in codes) + f") THEN '{name}'" for name, codes in job.SEGMENTS
    )
    + f" ELSE '{job.OTHER_SEGMENT}' END"
)


def _score(column: str) -> str:
    return "1 + " + " + ".join(
        f"CAST({column} > (SELECT quantile_cont({column}, {q}) FROM measured) AS INTEGER)" for q in (0.2, 0.4, 0.6, 0.8)
    )


_RFM = (
    """measured AS (SELECT CustomerNo AS customer,
  CAST(date_diff('day', max(Date), (SELECT max(Date) FROM sales)) AS BIGINT) AS recency,
  CAST(count(*) AS BIGINT) AS frequency, CAST(sum(Total_Revenue) AS DOUBLE) AS monetary FROM sales GROUP BY CustomerNo)""",
    f"""scored AS (SELECT *, 6 - ({_score('CAST(recency AS DOUBLE)')}) AS r_score,
  {_score('CAST(frequency AS DOUBLE)')} AS f_score, {_score('monetary')} AS m_score FROM measured)""",
    f"""rfm AS (SELECT *, {_SEGMENT_CASE} AS segment, monetary * frequency * (365.0::DOUBLE / (recency + 1)) AS clv
  FROM (SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score FROM scored))""",
)

_PRODUCTS = """products AS (SELECT ProductName AS product, ProductNo AS product_id,
  round(CAST(sum(Total_Revenue) AS DOUBLE), 2) AS total_revenue,
  round(CAST(sum(Total_Revenue) AS DOUBLE) / count(*), 2) AS avg_revenue, count(*) AS transaction_count,
  round(sum(Quantity), 2) AS total_quantity, round(avg(Price), 2) AS avg_price FROM sales GROUP BY 1, 2)"""

_GEO = """geo AS (SELECT Country AS country, sum(Total_Revenue) AS revenue, count(*) AS n,
  count(DISTINCT CustomerNo) AS customers FROM sales GROUP BY 1)"""

_GEO_SHARES = """shares AS (SELECT country, round(CAST(revenue AS DOUBLE), 2) AS total_revenue,
  round(CAST(revenue AS DOUBLE) / n, 2) AS avg_revenue, n AS transaction_count, customers AS unique_customers,
  round(CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100, 2) AS market_share,
  round(CAST(customers AS DOUBLE) / CAST(sum(customers) OVER () AS DOUBLE) * 100, 2) AS customer_share FROM geo)"""


_BOUGHT = "bought AS (SELECT DISTINCT CustomerNo, ProductName FROM sales)"
_PAIRS = """pairs AS (SELECT a.ProductName AS product_a, b.ProductName AS product_b, count(*) AS co_purchases
  FROM bought a JOIN bought b ON a.CustomerNo = b.CustomerNo AND a.ProductName < b.ProductName GROUP BY 1, 2)"""

_MONEY = ["TransactionNo", "LineNo", "Date", "Total_Revenue"]
_TIES = ["TransactionNo", "LineNo"]


def _figures() -> str:
    lines = {
        "total_revenue": "CAST(sum(Total_Revenue) AS DOUBLE)",
        "total_profit": "CAST(sum(Profit) AS DOUBLE)",
        "average_revenue": "CAST(sum(Total_Revenue) AS DOUBLE) / count(*)",
        "median_revenue": "quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.5)",
        "profit_margin": "CAST(sum(Profit) AS DOUBLE) / CAST(sum(Total_Revenue) AS DOUBLE) * 100",
        "total_transactions": "count(*)",
        "revenue_volatility": "stddev_samp(CAST(Total_Revenue AS DOUBLE)) / (CAST(sum(Total_Revenue) AS DOUBLE) / count(*)) * 100",
        "high_value_orders": "count(*) FILTER (CAST(Total_Revenue AS DOUBLE) > (SELECT quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.75) FROM sales))",
        "range_0_100": "count(*) FILTER (Total_Revenue BETWEEN 0 AND 100)",
        "range_100_500": "count(*) FILTER (Total_Revenue > 100 AND Total_Revenue <= 500)",
        "range_500_1000": "count(*) FILTER (Total_Revenue > 500 AND Total_Revenue <= 1000)",
        "range_1000_up": "count(*) FILTER (Total_Revenue > 1000)",
        "revenue_per_customer": "CAST(sum(Total_Revenue) AS DOUBLE) / count(DISTINCT CustomerNo)",
        "average_order_value": "CAST(sum(Total_Revenue) AS DOUBLE) / count(DISTINCT CustomerNo)",
        "order_frequency": "(count(*)::DOUBLE / count(DISTINCT CustomerNo)) / (date_diff('day', min(Date), max(Date)) / 30.44::DOUBLE)",
    }
    parts = [f"SELECT '{k}' AS metric, round(CAST({v} AS DOUBLE), 4) AS value FROM sales" for k, v in lines.items()]
    parts.append("SELECT 'revenue_growth', round(avg(growth) * 100, 4) FROM months")
    return "\nUNION ALL ".join(parts)


QUERIES = {
    "revenue_total": Query(
        lambda s, d: job.revenue_total(staged_sales(s, d, ["CustomerNo", "Date", "Total_Revenue", "Profit"]), ROLES),
        on_sales(_figures(), _periods("month")),
    ),
    "half_trend": Query(
        lambda s, d: job.half_trend(staged_sales(s, d, _MONEY), ROLES, _TIES),
        on_sales(
            """SELECT round(CAST(a AS DOUBLE) / na, 4) AS first_half, round(CAST(b AS DOUBLE) / nb, 4) AS second_half,
  CASE WHEN CAST(b AS DOUBLE) / nb > CAST(a AS DOUBLE) / na * 1.05::DOUBLE THEN 'Increasing'
       WHEN CAST(b AS DOUBLE) / nb < CAST(a AS DOUBLE) / na * 0.95::DOUBLE THEN 'Decreasing' ELSE 'Stable' END AS trend
FROM (SELECT sum(Total_Revenue) FILTER (place <= half) AS a, count(*) FILTER (place <= half) AS na,
             sum(Total_Revenue) FILTER (place > half) AS b, count(*) FILTER (place > half) AS nb FROM placed)""",
            """placed AS (SELECT Total_Revenue, row_number() OVER (ORDER BY Date, TransactionNo, LineNo, Total_Revenue) AS place,
  (SELECT count(*) // 2 FROM sales) AS half FROM sales)""",
        ),
    ),
    **{
        f"revenue_by_{p}": Query(
            lambda s, d, p=p: job.period_revenue(sales(s, d, ["Date", "Total_Revenue"]), ROLES, p).selectExpr(
                "period", "round(revenue, 2) AS revenue", "round(growth * 100, 4) AS growth"
            ),
            on_sales(f"SELECT period, round(revenue, 2) AS revenue, round(growth * 100, 4) AS growth FROM {p}s", _periods(p)),
        )
        for p in ("day", "week", "month")
    },
    "revenue_trends": Query(
        lambda s, d: job.trend_figures(staged_sales(s, d, ["Date", "Total_Revenue"]), ROLES),
        on_sales(
            " UNION ALL ".join(
                f"SELECT '{p}' AS period, count(*) AS periods, round(avg(growth) * 100, 4) AS growth_rate, "
                f"round(stddev_samp(revenue), 4) AS std FROM {p}s"
                for p in ("day", "week", "month")
            ),
            *[_periods(p) for p in ("day", "week", "month")],
        ),
    ),
    "rfm_scores": Query(
        lambda s, d: job.rfm_scores(sales(s, d, ["CustomerNo", "Date", "Total_Revenue"]), ROLES).selectExpr(
            "customer", "recency", "frequency", "round(monetary, 2) AS monetary", "rfm_score", "segment", "round(clv, 0) AS clv"
        ),
        on_sales(
            "SELECT customer, recency, frequency, round(monetary, 2) AS monetary, rfm_score, segment, round(clv, 0) AS clv FROM rfm",
            *_RFM,
        ),
    ),
    "rfm_segments": Query(
        lambda s, d: job.rfm_segments(job.rfm_scores(sales(s, d, ["CustomerNo", "Date", "Total_Revenue"]), ROLES)),
        on_sales("SELECT segment, count(*) AS customers, round(sum(monetary), 2) AS revenue FROM rfm GROUP BY 1", *_RFM),
    ),
    "rfm_value": Query(
        lambda s, d: job.rfm_value(job.rfm_scores(sales(s, d, ["CustomerNo", "Date", "Total_Revenue"]), ROLES)),
        on_sales(
            """SELECT count(*) AS customers, round(avg(clv), 2) AS average_clv, round(quantile_cont(clv, 0.5), 2) AS median_clv,
  count(*) FILTER (clv > q8) AS high_clv, count(*) FILTER (clv BETWEEN q4 AND q8) AS medium_clv, count(*) FILTER (clv < q4) AS low_clv
FROM rfm, (SELECT quantile_cont(clv, 0.4) AS q4, quantile_cont(clv, 0.8) AS q8 FROM rfm)""",
            *_RFM,
        ),
    ),
    "rfm_top": Query(
        lambda s, d: job.rfm_top(job.rfm_scores(sales(s, d, ["CustomerNo", "Date", "Total_Revenue"]), ROLES)),
        on_sales(
            """SELECT customer, recency, frequency, round(monetary, 2) AS monetary, round(clv, 0) AS clv, segment
FROM (SELECT * FROM rfm ORDER BY clv DESC, customer LIMIT 10)""",
            *_RFM,
        ),
    ),
    "top_products": Query(
        lambda s, d: job.top_products(
            sales(s, d, ["ProductName", "ProductNo", "Total_Revenue", "Quantity", "Price"]), ROLES
        ),
        on_sales("SELECT * FROM products ORDER BY total_revenue DESC, product, product_id LIMIT 20", _PRODUCTS),
    ),
    "product_bands": Query(
        lambda s, d: job.product_bands(
            sales(s, d, ["ProductName", "ProductNo", "Total_Revenue", "Quantity", "Price"]), ROLES
        ),
        on_sales(
            """SELECT count(*) AS total_products, count(*) FILTER (total_revenue > h) AS top_band,
  count(*) FILTER (total_revenue BETWEEN l AND h) AS middle_band, count(*) FILTER (total_revenue < l) AS bottom_band
FROM products, (SELECT quantile_cont(total_revenue, 0.2) AS l, quantile_cont(total_revenue, 0.8) AS h FROM products)""",
            _PRODUCTS,
        ),
    ),
    "category_performance": Query(
        lambda s, d: job.category_performance(sales(s, d, ["ProductName", "Total_Revenue"]), ROLES),
        on_sales(
            """SELECT regexp_split_to_array(trim(ProductName), '\\s+')[1] AS category,
  round(CAST(sum(Total_Revenue) AS DOUBLE), 2) AS revenue, count(DISTINCT ProductName) AS products
FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
        ),
    ),
    "cross_sell": Query(
        lambda s, d: job.cross_sell(staged_sales(s, d, ["CustomerNo", "ProductName"]), ROLES),
        on_sales("SELECT * FROM pairs ORDER BY co_purchases DESC, product_a, product_b LIMIT 50", _BOUGHT, _PAIRS),
    ),
    "co_purchases": Query(
        lambda s, d: job.co_purchases(staged_sales(s, d, ["CustomerNo", "ProductName"]), ROLES),
        on_sales("SELECT * FROM pairs", _BOUGHT, _PAIRS),
    ),
    "geo_revenue": Query(
        lambda s, d: job.geo_revenue(sales(s, d, ["Country", "CustomerNo", "Total_Revenue"]), ROLES),
        on_sales("SELECT * FROM shares", _GEO, _GEO_SHARES),
    ),
    "geo_concentration": Query(
        lambda s, d: job.geo_concentration(sales(s, d, ["Country", "CustomerNo", "Total_Revenue"]), ROLES),
        on_sales("SELECT count(*) AS total_countries, max(market_share) AS market_concentration FROM shares", _GEO, _GEO_SHARES),
    ),
    "dashboard_kpis": Query(
        lambda s, d: job.dashboard_kpis(sales(s, d, ["CustomerNo", "ProductName", "Total_Revenue", "Profit"]), ROLES),
        on_sales(
            """SELECT round(CAST(sum(Total_Revenue) AS DOUBLE), 2) AS total_revenue, round(CAST(sum(Profit) AS DOUBLE), 2) AS total_profit,
  count(DISTINCT CustomerNo) AS total_customers, count(DISTINCT ProductName) AS total_products,
  round(CAST(sum(Total_Revenue) AS DOUBLE) / count(DISTINCT CustomerNo), 2) AS avg_order_value,
  round(CAST(sum(Profit) AS DOUBLE) / CAST(sum(Total_Revenue) AS DOUBLE) * 100, 1) AS profit_margin FROM sales"""
        ),
    ),
    "dashboard_top5": Query(
        lambda s, d: job.dashboard_top(sales(s, d, ["ProductName", "Total_Revenue", "Quantity"]), ROLES),
        on_sales(
            """SELECT ProductName AS product, round(CAST(sum(Total_Revenue) AS DOUBLE), 2) AS revenue,
  CAST(sum(Quantity) AS BIGINT) AS units FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
        ),
    ),
    "dashboard_geo": Query(
        lambda s, d: job.dashboard_geo(sales(s, d, ["Country"]), ROLES),
        on_sales(
            """SELECT Country AS country, round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 1) AS row_share
FROM sales GROUP BY 1"""
        ),
    ),
    "dashboard_monthly": Query(
        lambda s, d: job.dashboard_monthly(sales(s, d, ["Date", "Total_Revenue"]), ROLES),
        on_sales(
            "SELECT period AS month, round(revenue, 2) AS revenue, round(revenue * 0.2::DOUBLE, 2) AS profit FROM months",
            _periods("month"),
        ),
    ),
    "dashboard_segments": Query(
        lambda s, d: job.dashboard_segments(sales(s, d, ["CustomerNo"]), ROLES),
        on_sales(
            """SELECT segment, CAST(floor(n * part) AS BIGINT) AS customers FROM (SELECT count(DISTINCT CustomerNo) AS n FROM sales),
  (VALUES ('High Value', 0.2), ('Medium Value', 0.5), ('Low Value', 0.3)) AS v(segment, part)"""
        ),
    ),
    "sales_summary": Query(
        lambda s, d: job.sales_summary(staged_sales(s, d, ["Price", "Quantity", "ProductName", "Country"]), ROLES),
        on_sales(
            """SELECT 'overall' AS section, 'total_revenue' AS key, round(sum(v), 2) AS value FROM t
UNION ALL SELECT 'overall', 'average_order_value', round(avg(v), 2) FROM t
UNION ALL SELECT 'by_country', Country, round(sum(v), 2) FROM t GROUP BY Country
UNION ALL (SELECT 'top_products', ProductName, round(sum(v), 2) FROM t GROUP BY ProductName ORDER BY 3 DESC, 2 LIMIT 10)""",
            "t AS (SELECT *, Price * Quantity AS v FROM sales)",
        ),
    ),
    "customer_summary": Query(
        lambda s, d: job.customer_summary(sales(s, d, ["CustomerNo", "Price", "Quantity"]), ROLES),
        on_sales(
            """SELECT CustomerNo AS customer, round(sum(Price), 2) AS price_sum, count(Price) AS price_count,
  round(avg(Price), 2) AS price_mean, round(sum(Quantity), 2) AS quantity_sum FROM sales GROUP BY 1"""
        ),
    ),
    "top_customers": Query(
        lambda s, d: job.top_customers(sales(s, d, ["CustomerNo", "Price", "Quantity"]), ROLES),
        on_sales(
            """SELECT CustomerNo AS customer, round(sum(Price), 2) AS price_sum, count(Price) AS price_count,
  round(avg(Price), 2) AS price_mean, round(sum(Quantity), 2) AS quantity_sum FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
        ),
    ),
}
