"""Cleaning of the sources and of the analytic datasets.

``scope`` says over what quantiles and ranks are taken: ``'tenant'`` (each
tenant on its own, the default) or ``'all'`` (all tenants pooled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.cleaning import mapped, moment_or_null, number_or, over_nonzero, product_key, text_or
from salesmart.functions.dates import calendar, cyclical
from salesmart.functions.scoring import (
    FIVE_LEVELS, THREE_LEVELS, bucket_of, labelled, rank_bucket, segment_of,
)
from salesmart.plans.lookups import attach
from salesmart.plans.ranking import INDEX, SIZE, in_order, interior, positions, quantiles
from salesmart.schemas import RATE, TRANSACTION_TYPES
from salesmart.session import cut

LINE_NUMBERS = [
    "qnty_total", "qnty_uomstk", "bal_qnty_total", "bal_qnty_uomstk", "price_unitlist_forex",
    "price_unitlist_local", "price_unitrate_forex", "price_unitrate_local", "discount_pct",
    "amount_forex", "amount_local", "amount_tax_forex", "amount_tax_local",
]


def keys_of(scope: str) -> list[str]:
    if scope not in ("tenant", "all"):
        raise ValueError(f"unknown scope: {scope}")
    return ["companyfn"] if scope == "tenant" else []


def label_by_quantile(df: DataFrame, value: Column, name: str, labels: list[str],
                      scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Label every row by the quantile bucket of ``value``; ties never fail.

    The rows are written once at build time: the edges and the labels both read
    them, and what made them (joins, groupings) is not repeated.
    """
    keys, k = keys_of(scope), len(labels)
    df = cut(df)
    edges = quantiles(df, keys, value, interior(k), "_edges", exact)
    return (
        attach(df, edges, keys)
        .withColumn(name, labelled(bucket_of(value.cast("double"), F.col("_edges"), k), labels))
        .drop("_edges")
    )


def flag_outliers(df: DataFrame, value: str, name: str = "is_outlier", fraction: float = 0.99,
                  scope: str = "tenant", exact: bool = True) -> DataFrame:
    """1 where the magnitude exceeds the quantile of the signed values; the rows are written once at build time."""
    keys, df = keys_of(scope), cut(df)
    edge = quantiles(df, keys, F.col(value), [fraction], "_edges", exact)
    above = F.abs(F.col(value).cast("double")) > F.element_at("_edges", 1)
    return (
        attach(df, edge, keys)
        .withColumn(name, F.coalesce(above, F.lit(False)).cast("int"))
        .drop("_edges")
    )


def clean_main(main: DataFrame, scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Order headers with defaults, typed values, calendar parts and an outlier flag."""
    df = main.withColumns({
        "party_desc": text_or("party_desc", "Unknown"),
        "party_code": text_or("party_code", "N/A"),
        "deptunit_desc": text_or("deptunit_desc", "N/A"),
        "staff_code": text_or("staff_code", "N/A"),
        "notes_memo": text_or("notes_memo", ""),
        "date_trans": moment_or_null("date_trans"),
        "date_due": moment_or_null("date_due"),
        "amount_local": number_or("amount_local"),
        "amount_forex": number_or("amount_forex"),
        "salestaxpct": number_or("salestaxpct"),
        "curr_rate_forex_f_calc": number_or("curr_rate_forex_f_calc", 1, RATE.simpleString()),
        "transaction_type_name": mapped("tag_table_usage", TRANSACTION_TYPES),
    })
    df = df.withColumns(calendar("date_trans", "year", "month", "quarter", "day_of_week", "day_of_month",
                                 "week_of_year", "is_weekend", "is_late_month"))
    df = df.withColumn("amount_local_log", F.log1p(F.abs(F.col("amount_local").cast("double"))))
    return flag_outliers(df, "amount_local", scope=scope, exact=exact)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Order lines with defaults, typed values, line totals and a product key."""
    numbers = {
        name: number_or(name, 0, RATE.simpleString() if "unitrate" in name else "decimal(18,4)")
        for name in LINE_NUMBERS if name in lines.columns
    }
    df = lines.withColumns({
        "stkcode_desc": text_or("stkcode_desc", "Unknown Product"),
        "stkcode_code": text_or("stkcode_code", "N/A"),
        "stkcode_unique": text_or("stkcode_unique", "0"),
        "brand_desc": text_or("brand_desc", "No Brand"),
        "stkcate_desc": text_or("stkcate_desc", "No Category"),
        "stkvendor_desc": text_or("stkvendor_desc", "No Vendor"),
        "notes_memo": text_or("notes_memo", ""),
        "date_trans": moment_or_null("date_trans"),
        **numbers,
    })
    gross = F.col("qnty_total").cast("double") * F.col("price_unitrate_local").cast("double")
    df = df.withColumn("line_total", gross)
    df = df.withColumn("discount_amount", F.col("line_total") * F.col("discount_pct").cast("double") / 100)
    df = df.withColumn("net_amount", F.col("line_total") - F.col("discount_amount"))
    return df.withColumns({
        **calendar("date_trans", "year", "month", "quarter"),
        "product_id": product_key(),
    })


def revenue_levels(revenue: DataFrame, scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Monthly revenue labelled Low, Medium or High; months without a date are dropped."""
    df = revenue.withColumns({
        "month": number_or("month", 0, "int"),
        "year": number_or("year", 0, "int"),
        "amt_local": number_or("amt_local", 0, "double"),
    }).where((F.col("month") > 0) & (F.col("year") > 0))
    return label_by_quantile(df, F.col("amt_local"), "revenue_level", THREE_LEVELS, scope, exact)


def customer_segments_by_value(facts: DataFrame, scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Customer facts with a five-level label of each line's value."""
    df = facts.withColumns({
        "customer_name": text_or("customer_name", "Unknown"),
        "product_name": text_or("product_name", "Unknown"),
        "category_name": text_or("category_name", "No Category"),
        "brand_desc": text_or("brand_desc", "No Brand"),
        "transaction_date": moment_or_null("transaction_date"),
        "quantity": number_or("quantity"),
        "unit_price": number_or("unit_price", 0, RATE.simpleString()),
        "line_amount": number_or("line_amount"),
    })
    df = df.withColumns(calendar("transaction_date", "year", "month", "quarter", "day_of_week", "is_weekend"))
    return label_by_quantile(df, F.abs("line_amount"), "transaction_value_segment", FIVE_LEVELS, scope, exact)


def product_segments_by_revenue(products: DataFrame, scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Product days with revenue per unit and a five-level revenue label."""
    df = products.withColumns({
        "product_name": text_or("product_name", "Unknown"),
        "category_name": text_or("category_name", "No Category"),
        "brand_desc": text_or("brand_desc", "No Brand"),
        "vendor_name": text_or("vendor_name", "No Vendor"),
        "transaction_date": moment_or_null("transaction_date"),
        "quantity_sold": number_or("quantity_sold", 0, "double"),
        "revenue": number_or("revenue", 0, "double"),
        "avg_price": number_or("avg_price", 0, "double"),
    })
    df = df.withColumns(calendar("transaction_date", "year", "month", "quarter"))
    df = df.withColumn("revenue_per_unit", over_nonzero(F.col("revenue"), F.col("quantity_sold")))
    return label_by_quantile(df, F.abs("revenue"), "revenue_segment", FIVE_LEVELS, scope, exact)


def _ranked_score(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return positions(rows, keys).withColumn(name, rank_bucket(F.col(INDEX), F.col(SIZE), 5)).drop(INDEX, SIZE)


def rfm_scores(df: DataFrame, recency: str, frequency: str, monetary: str, ties: list[Column],
               scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Recency, frequency and monetary scores 1..5, their mean and a segment.

    Recency is bucketed by value (recent is 5); frequency and monetary by rank,
    ties broken by ``ties``, which must make the order total.  The rows are
    written twice, once in the order of each rank; recency reads the first.
    """
    keys = keys_of(scope)
    by_frequency = in_order(df, keys, [F.col(frequency), *ties])
    edges = quantiles(by_frequency, keys, F.col(recency), interior(5), "_edges", exact)
    df = attach(_ranked_score(by_frequency, keys, "frequency_score"), edges, keys).withColumn(
        "recency_score", 6 - bucket_of(F.col(recency), F.col("_edges"), 5)).drop("_edges")
    df = _ranked_score(in_order(df, keys, [F.col(monetary), *ties]), keys, "monetary_score")
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    return df.withColumns({"rfm_score": total / 3, "customer_segment": segment_of(total)})


def retention_segments(retention: DataFrame, scope: str = "tenant", exact: bool = True) -> DataFrame:
    """Customer retention with RFM scores and a segment."""
    df = retention.withColumns({
        "customer_name": text_or("customer_name", "Unknown"),
        "first_purchase_date": moment_or_null("first_purchase_date"),
        "last_purchase_date": moment_or_null("last_purchase_date"),
        **{name: number_or(name, 0, "int") for name in
           ("days_since_last_purchase", "customer_lifetime_days")},
        "total_purchases": number_or("total_purchases", 0, "bigint"),
        **{name: number_or(name, 0, "double") for name in
           ("total_spent", "avg_purchase_value", "purchase_frequency")},
    })
    ties = [F.desc("total_spent"), F.col("companyfn"), F.col("customer_id"),
            F.col("customer_code"), F.col("customer_name")]
    return rfm_scores(df, "days_since_last_purchase", "total_purchases", "total_spent", ties, scope, exact)


def trend_calendar(trend: DataFrame) -> DataFrame:
    """Sales trend with defaults, calendar parts and cyclical features."""
    df = trend.withColumns({
        "business_unit_name": text_or("business_unit_name", "Unknown"),
        "salesperson": text_or("salesperson", "Unknown"),
        "transaction_type": text_or("transaction_type", "Unknown"),
        "transaction_date": moment_or_null("transaction_date"),
        "total_transactions": number_or("total_transactions", 0, "bigint"),
        "total_revenue": number_or("total_revenue", 0, "double"),
        "avg_transaction_value": number_or("avg_transaction_value", 0, "double"),
        "unique_customers": number_or("unique_customers", 0, "bigint"),
    })
    return df.withColumns({
        **calendar("transaction_date", "year", "month", "quarter", "day_of_week", "day_of_month",
                   "week_of_year", "is_weekend"),
        **cyclical("transaction_date"),
    })
