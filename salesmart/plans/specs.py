"""Datasets declared as data: sources, join, filters, output columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.cleaning import as_double_sum, exact_mean
from salesmart.functions.dates import calendar, elapsed_days
from salesmart.sources.readers import condition_of


@dataclass(frozen=True)
class DatasetSpec:
    """``columns`` maps output names to source columns (sources are aliased by
    table name).  With ``measures`` they are the group, and each measure is an
    aggregate's name and the SQL expression it is taken over."""

    sources: tuple[str, ...]
    columns: Mapping[str, str]
    measures: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    join: str | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)


MAIN, DATA = "scm_sal_main", "scm_sal_data"

# fixed values: the declared datasets
SPECS = {
    "customer_analysis": DatasetSpec(
        (MAIN, DATA),
        {
            "companyfn": f"{MAIN}.companyfn",
            "customer_id": f"{MAIN}.party_unique",
            "customer_name": f"{MAIN}.party_desc",
            "transaction_date": f"{MAIN}.date_trans",
            "product_code": f"{DATA}.stkcode_code",
            "product_name": f"{DATA}.stkcode_desc",
            "category": f"{DATA}.stkcate_desc",
            "brand": f"{DATA}.brand_desc",
            "quantity": f"{DATA}.qnty_total",
            "unit_price": f"{DATA}.price_unitrate_local",
            "total_amount": f"{DATA}.amount_local",
            "transaction_type": f"{MAIN}.tag_table_usage",
        },
        join=f"{MAIN}.uniquenum_pri = {DATA}.uniquenum_pri AND {MAIN}.companyfn = {DATA}.companyfn",
        filters={f"{MAIN}.tag_void_yn": "n", f"{DATA}.tag_void_yn": "n",
                 f"{MAIN}.tag_table_usage": ["sal_soe", "sal_soc", "sal_inv"]},
    ),
    "product_analysis": DatasetSpec(
        (DATA,),
        {
            "companyfn": "companyfn",
            "product_code": "stkcode_code",
            "product_name": "stkcode_desc",
            "category": "stkcate_desc",
            "brand": "brand_desc",
            "vendor": "stkvendor_desc",
            "transaction_date": "date_trans",
        },
        measures={
            "quantity_sold": ("sum", "qnty_total"),
            "revenue": ("sum", "amount_local"),
            "avg_price": ("mean", "price_unitrate_local"),
        },
        filters={"tag_void_yn": "n"},
    ),
    "sales_trend": DatasetSpec(
        (MAIN,),
        {
            "companyfn": "companyfn",
            "transaction_date": "date_trans",
            "business_unit": "deptunit_code",
            "salesperson": "staff_code",
        },
        measures={
            "total_transactions": ("count", "1"),
            "total_revenue": ("sum", "amount_local"),
            "avg_transaction_value": ("mean", "amount_local"),
        },
        filters={"tag_void_yn": "n", "tag_table_usage": ["sal_inv", "sal_soc"]},
    ),
    "customer_retention": DatasetSpec(
        (MAIN,),
        {
            "companyfn": "companyfn",
            "customer_id": "party_unique",
            "customer_name": "party_desc",
        },
        measures={
            "first_purchase_date": ("min", "date_trans"),
            "last_purchase_date": ("max", "date_trans"),
            "total_purchases": ("distinct", "uniquenum_pri"),
            "total_spent": ("sum", "amount_local"),
            "avg_purchase_value": ("mean", "amount_local"),
            "active_months": ("distinct", "year(date_trans) * 100 + month(date_trans)"),
        },
        filters={"tag_void_yn": "n", "tag_table_usage": ["sal_inv"]},
    ),
}


AGGREGATES = {
    "sum": as_double_sum, "mean": exact_mean, "min": F.min, "max": F.max, "count": F.count,
    "distinct": F.countDistinct,
}


def build_dataset(spec: DatasetSpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The DataFrame a spec declares, over tables given by name."""
    df = tables[spec.sources[0]].alias(spec.sources[0])
    for name in spec.sources[1:]:
        df = df.join(tables[name].alias(name), F.expr(spec.join), "inner")
    if spec.filters:
        df = df.where(condition_of(spec.filters))
    columns = [F.col(source).alias(name) for name, source in spec.columns.items()]
    if not spec.measures:
        return df.select(*columns)
    return df.groupBy(*columns).agg(*[
        AGGREGATES[kind](F.expr(over)).alias(name) for name, (kind, over) in spec.measures.items()])


def with_trend_calendar(trend: DataFrame) -> DataFrame:
    """The calendar parts the trend dataset declares besides its date."""
    return trend.withColumns(calendar("transaction_date", "year", "month", "quarter", "day_of_week"))


def with_retention_days(retention: DataFrame, as_of: str) -> DataFrame:
    """The day counts and the frequency the retention dataset declares."""
    return retention.withColumns({
        "days_since_last_purchase": elapsed_days(F.lit(as_of).cast("timestamp_ntz"), "last_purchase_date"),
        "customer_lifetime_days": elapsed_days("last_purchase_date", "first_purchase_date"),
        "purchase_frequency": F.try_divide("total_purchases", "active_months"),
    }).drop("active_months")
