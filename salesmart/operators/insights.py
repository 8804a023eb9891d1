"""Answers to common business questions, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.functions.dates import shifted_month

EXACT = "decimal(28,4)"  # sums of amounts held as double are taken in decimal


def _total(column: str) -> Column:
    """Order-independent sum of a double amount."""
    return F.coalesce(F.sum(F.col(column).cast(EXACT)).cast("double"), F.lit(0.0))


def month_report(revenue: DataFrame) -> DataFrame:
    """Monthly revenue with growth against the month before.

    Growth is 0 when that month is missing or had no revenue.  The window sees
    one tenant's months only.
    """
    index = F.col("year") * 12 + F.col("month")
    by_month = W.partitionBy("companyfn").orderBy(index)
    before = F.when(F.lag(index).over(by_month) == index - 1, F.lag("amt_local").over(by_month))
    growth = F.when(before > 0, (F.col("amt_local") - before) / before * 100).otherwise(F.lit(0.0))
    return revenue.select(
        "companyfn", F.col("year").alias("report_year"), F.col("month").alias("report_month"),
        F.col("amt_local").alias("total_revenue"), F.col("num_transactions").alias("transaction_count"),
        growth.alias("growth_pct"),
        F.try_divide("amt_local", "num_transactions").alias("avg_transaction_revenue"),
    )


def year_report(revenue: DataFrame) -> DataFrame:
    """Revenue, orders and months with data per tenant and year."""
    return revenue.groupBy("companyfn", F.col("year").alias("report_year")).agg(
        _total("amt_local").alias("total_revenue"),
        F.sum("num_transactions").alias("transaction_count"),
        F.count(F.lit(1)).alias("month_count"),
    )


def _best_per_tenant(totals: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """Top ``n`` per tenant; the filtered rank keeps n rows per task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("companyfn").orderBy(F.desc(value), F.col(name)))
    return totals.withColumn("rank", rank).where(F.col("rank") <= n)


def top_customers(facts: DataFrame, n: int = 10, month: int | None = None, year: int | None = None) -> DataFrame:
    """Customers with the highest revenue, of all time or of one month."""
    if month is not None and year is not None:
        facts = facts.where((F.col("month") == month) & (F.col("year") == year))
    totals = facts.where(F.col("customer_name").isNotNull()).groupBy("companyfn", "customer_name").agg(
        _total("line_amount").alias("revenue"))
    return _best_per_tenant(totals, "revenue", "customer_name", n)


def repeat_rate(facts: DataFrame) -> DataFrame:
    """Share of customers who bought on more than one day."""
    days = facts.where(F.col("customer_id").isNotNull()).groupBy("companyfn", "customer_id").agg(
        F.countDistinct("transaction_date").alias("days"))
    again = (F.col("days") > 1).cast("int")
    return days.groupBy("companyfn").agg(
        F.sum(again).alias("repeat_customers"), F.count(F.lit(1)).alias("customers"),
        (F.sum(again) / F.count(F.lit(1)) * 100).alias("repeat_rate"))


def segment_distribution(segments: DataFrame) -> DataFrame:
    """Customers per segment, with the largest segment marked."""
    counts = segments.where(F.col("customer_segment").isNotNull()).groupBy("companyfn", "customer_segment").agg(
        F.count(F.lit(1)).alias("customers"))
    first = F.row_number().over(W.partitionBy("companyfn").orderBy(F.desc("customers"), F.col("customer_segment")))
    return counts.withColumn("is_largest", (first == 1).cast("int"))  # four rows a tenant


def customer_overview(facts: DataFrame) -> DataFrame:
    """Number of customers, revenue, revenue per customer."""
    spent = facts.groupBy("companyfn", "customer_id").agg(F.sum(F.col("line_amount").cast(EXACT)).alias("spent"))
    named = F.when(F.col("customer_id").isNotNull(), F.col("spent"))
    return spent.groupBy("companyfn").agg(
        F.count("customer_id").alias("total_customers"),
        F.coalesce(F.sum("spent").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.try_divide(F.sum(named).cast("double"), F.count(named)).alias("avg_customer_value"))


def top_products(products: DataFrame, n: int = 10) -> DataFrame:
    """Product names with the highest revenue."""
    totals = products.where(F.col("product_name").isNotNull()).groupBy("companyfn", "product_name").agg(
        _total("revenue").alias("revenue"))
    return _best_per_tenant(totals, "revenue", "product_name", n)


def sales_by(products: DataFrame, column: str, measure: str = "revenue") -> DataFrame:
    """Total of a measure per value of one column: category, brand, month, quarter, weekday."""
    return products.where(F.col(column).isNotNull()).groupBy("companyfn", column).agg(_total(measure).alias(measure))


def product_overview(products: DataFrame) -> DataFrame:
    """Number of products, revenue and quantity."""
    each = products.groupBy("companyfn", "product_code").agg(
        F.sum(F.col("revenue").cast(EXACT)).alias("revenue"),
        F.sum(F.col("quantity_sold").cast(EXACT)).alias("quantity"))
    return each.groupBy("companyfn").agg(
        F.count("product_code").alias("total_products"),
        F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("quantity").cast("double"), F.lit(0.0)).alias("total_quantity"))


def monthly_sales(trend: DataFrame) -> DataFrame:
    """Revenue per month of the year, with the best month marked."""
    months = sales_by(trend, "month", "total_revenue")
    best = F.row_number().over(W.partitionBy("companyfn").orderBy(F.desc("total_revenue"), F.col("month")))
    return months.withColumn("is_best", (best == 1).cast("int"))  # twelve rows a tenant


def _daily(trend: DataFrame) -> DataFrame:
    return trend.groupBy("companyfn", F.col("transaction_date").cast("date").alias("day")).agg(
        F.sum(F.col("total_revenue").cast(EXACT)).alias("revenue"), F.count(F.lit(1)).alias("rows"))


def trend_overview(trend: DataFrame, summary: DataFrame) -> DataFrame:
    """Revenue, mean per trend row and per day, mean growth of the summary's slots."""
    revenue = _daily(trend).groupBy("companyfn").agg(
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.try_divide(F.sum("revenue").cast("double"), F.sum("rows")).alias("avg_row_revenue"),
        F.try_divide(F.sum("revenue").cast("double"), F.count(F.lit(1))).alias("avg_daily_revenue"))
    growth = summary.groupBy("companyfn").agg((F.avg("revenue_growth") * 100).alias("avg_growth_rate"))
    return revenue.join(growth, "companyfn", "left")


def churn_rate(retention: DataFrame) -> DataFrame:
    """Share and number of churned customers."""
    return retention.groupBy("companyfn").agg(
        F.sum("is_churned").alias("churned_customers"), F.count(F.lit(1)).alias("customers"),
        (F.sum("is_churned") / F.count(F.lit(1)) * 100).alias("churn_rate"))


def high_risk_customers(customers: DataFrame, level: str = "High") -> DataFrame:
    """Number of customers whose churn risk has the given level."""
    return customers.groupBy("companyfn").agg(
        F.sum(F.coalesce((F.col("churn_risk") == level).cast("int"), F.lit(0))).alias("at_risk_customers"))


def naive_forecast(trend: DataFrame) -> DataFrame:
    """Mean daily revenue carried 30 and 90 days ahead."""
    mean = _daily(trend).groupBy("companyfn").agg(
        F.try_divide(F.sum("revenue").cast("double"), F.count(F.lit(1))).alias("avg_daily_sales"))
    return mean.withColumns({
        "forecast_30_days": F.col("avg_daily_sales") * 30, "forecast_90_days": F.col("avg_daily_sales") * 90})


def adjacent_periods(report: DataFrame) -> DataFrame:
    """Next and previous month and previous year of every reported month."""
    year, month = F.col("report_year"), F.col("report_month")
    after, before = shifted_month(year, month, 1), shifted_month(year, month, -1)
    return report.select(
        "companyfn", "report_year", "report_month",
        after["month"].alias("next_month"), after["year"].alias("next_month_year"),
        before["month"].alias("previous_month"), before["year"].alias("previous_month_year"),
        (year - 1).alias("previous_year"))


def data_probes(headers: DataFrame, as_of: str) -> DataFrame:
    """First and last valid invoice, days since the last one, number of headers."""
    invoice = (F.col("tag_void_yn") == "n") & (F.col("tag_table_usage") == "sal_inv")
    when = F.when(invoice, F.col("date_trans"))
    return headers.agg(
        F.min(when).alias("first_invoice"), F.max(when).alias("last_invoice"),
        F.date_diff(F.lit(as_of).cast("date"), F.max(when).cast("date")).alias("days_since_last_invoice"),
        F.count(F.lit(1)).alias("row_count"))


def churn_distribution(headers: DataFrame, as_of: str, churn_days: int = 90) -> DataFrame:
    """Customers with a last valid invoice within and beyond ``churn_days``."""
    last = headers.where((F.col("tag_void_yn") == "n") & (F.col("tag_table_usage") == "sal_inv")).groupBy(
        "companyfn", "party_unique").agg(F.max("date_trans").alias("last"))
    gone = (F.date_diff(F.lit(as_of).cast("date"), F.col("last").cast("date")) > churn_days).cast("int")
    return last.groupBy("companyfn", gone.alias("is_churned")).agg(F.count(F.lit(1)).alias("customers"))
