"""Summary datasets per customer, product and calendar slot.

The order key is unique among headers, so a left join of lines with headers
neither adds nor drops lines; it is done only where a header column is used.
Groups with a null key are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.functions.cleaning import as_double_sum, exact_mean
from salesmart.functions.dates import elapsed_days
from salesmart.functions.distinct import distinct_count
from salesmart.functions.scoring import churned


def customer_summary(lines: DataFrame, approx: bool = False) -> DataFrame:
    """Revenue, order value, variety (by a sketch if ``approx``) and first/last date per customer."""
    return (
        lines.where(F.col("party_code").isNotNull())
        .groupBy("companyfn", F.col("party_code").alias("customer_id")).agg(
            as_double_sum("amount_local").alias("total_revenue"),
            exact_mean("amount_local").alias("avg_order_value"),
            F.count("amount_local").alias("total_purchases"),
            distinct_count("stkcode_code", approx).alias("unique_products"),
            F.min("date_trans").alias("first_purchase_date"),
            F.max("date_trans").alias("last_purchase_date"),
        ).withColumn("customer_name", F.concat(F.lit("Customer_"), "customer_id"))
    )


def product_summary(lines: DataFrame, approx: bool = False) -> DataFrame:
    """Revenue, quantity, reach (by a sketch if ``approx``) and first/last sale per product."""
    return (
        lines.where(F.col("stkcode_code").isNotNull())
        .groupBy("companyfn", F.col("stkcode_code").alias("product_code")).agg(
            as_double_sum("amount_local").alias("total_revenue"),
            exact_mean("amount_local").alias("avg_price"),
            F.count("amount_local").alias("total_transactions"),
            as_double_sum("qnty_total").alias("total_quantity"),
            distinct_count("party_code", approx).alias("unique_customers"),
            F.min("date_trans").alias("first_sale_date"),
            F.max("date_trans").alias("last_sale_date"),
        ).withColumn("product_name", F.concat(F.lit("Product_"), "product_code"))
    )


def trend_summary(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Revenue per month and quarter of the line and weekday of the order,
    with the change against the slot before it."""
    weekday = headers.select("companyfn", "uniquenum_pri", F.weekday("date_trans").alias("day_of_week"))
    slots = lines.select(
        "companyfn", "uniquenum_pri", F.month("date_trans").alias("month"),
        F.quarter("date_trans").alias("quarter"), "amount_local", "qnty_total",
    ).join(weekday, ["companyfn", "uniquenum_pri"], "left")
    trend = slots.where(F.col("month").isNotNull() & F.col("day_of_week").isNotNull()).groupBy(
        "companyfn", "month", "quarter", "day_of_week",
    ).agg(
        as_double_sum("amount_local").alias("total_revenue"),
        exact_mean("amount_local").alias("avg_transaction_value"),
        F.count("amount_local").alias("total_transactions"),
        as_double_sum("qnty_total").alias("total_quantity"),
    )
    by_slot = W.partitionBy("companyfn").orderBy("month", "quarter", "day_of_week")  # 84 rows a tenant
    growth = F.try_divide("total_revenue", F.lag("total_revenue").over(by_slot)) - 1
    return trend.withColumn("revenue_growth", growth)


def retention_summary(lines: DataFrame, as_of: str, churn_days: int = 90) -> DataFrame:
    """First and last purchase, count, spending and churn per customer."""
    days = elapsed_days(F.lit(as_of).cast("timestamp_ntz"), "last_purchase_date")
    return (
        lines.where(F.col("party_code").isNotNull())
        .groupBy("companyfn", F.col("party_code").alias("customer_id")).agg(
            F.min("date_trans").alias("first_purchase_date"),
            F.max("date_trans").alias("last_purchase_date"),
            F.count("date_trans").alias("total_purchases"),
            as_double_sum("amount_local").alias("total_spent"),
        )
        .withColumn("days_since_last_purchase", days)
        .withColumn("is_churned", churned(F.col("days_since_last_purchase"), churn_days))
    )


def revenue_report(revenue: DataFrame, companyfn: str | None = None) -> DataFrame:
    """Monthly revenue under report names, for one tenant when named."""
    if companyfn:
        revenue = revenue.where(F.col("companyfn") == companyfn)
    return revenue.select(
        "companyfn", F.col("month").alias("report_month"), F.col("year").alias("report_year"),
        F.col("amt_local").alias("total_revenue"), F.col("num_transactions").alias("transaction_count"))
