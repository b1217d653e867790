"""Daily revenue over a stream: the sums of ``operators.sales.daily_revenue`` with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted


def daily_revenue_stream(rows: DataFrame, date: str, amount: str, lateness: str = "1 day") -> DataFrame:
    """Revenue per day; a day is final once ``lateness`` has passed after its end."""
    timed = rows.select(quoted(date).cast("timestamp").alias("moment"), quoted(amount).alias("amount"))
    days = timed.withWatermark("moment", lateness).groupBy(F.window("moment", "1 day"))
    return days.agg(F.sum("amount").alias("revenue")).select(F.to_date("window.start").alias("day"), "revenue")
