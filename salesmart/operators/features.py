"""Features per transaction, product, customer and time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from salesmart.functions.cleaning import as_double_sum, exact_mean, over_nonzero, over_or_null
from salesmart.functions.dates import calendar, cyclical, elapsed_days
from salesmart.functions.distinct import distinct_count
from salesmart.functions.scoring import risk_of
from salesmart.operators.cleaning import keys_of, rfm_scores
from salesmart.plans.lookups import attach
from salesmart.plans.ranking import over_rows
from salesmart.session import cut

EXACT = "decimal(28,4)"


def _exact(column: str) -> Column:
    return F.col(column).cast(EXACT)


def rfm_features(facts: DataFrame, customer: str = "customer_id", scope: str = "tenant",
                 exact: bool = True) -> DataFrame:
    """Recency, frequency, monetary value and their scores per customer."""
    # written once; sales without a customer count for the latest day only
    per_customer = cut(facts.groupBy("companyfn", customer).agg(
        F.max("transaction_date").alias("_last"),
        F.countDistinct("uniquenum_pri").alias("frequency"),
        F.coalesce(F.sum(_exact("line_amount")).cast("double"), F.lit(0.0)).alias("monetary"),
    ))
    keys = keys_of(scope)
    latest = per_customer.groupBy(*keys).agg(F.max("_last").alias("_now"))
    rfm = attach(per_customer.where(F.col(customer).isNotNull()), latest, keys).select(
        "companyfn", customer, elapsed_days("_now", "_last").alias("recency"), "frequency", "monetary")
    return rfm_scores(rfm, "recency", "frequency", "monetary",
                      [F.col("companyfn"), F.col(customer)], scope, exact)


def temporal_features(df: DataFrame, date: str = "transaction_date") -> DataFrame:
    """Calendar parts, period borders and cyclical features of a date column."""
    return df.withColumns({
        **calendar(date, "year", "month", "quarter", "day_of_week", "day_of_month", "day_of_year",
                   "week_of_year", "is_weekend", "is_late_month", "is_late_quarter", "is_month_start",
                   "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end"),
        **cyclical(date),
    })


def product_features(products: DataFrame, scope: str = "tenant") -> DataFrame:
    """Quantity, revenue, price and reach per product of a tenant."""
    # written once; rows without a product count for the span of days only
    per_product = cut(products.groupBy("companyfn", "product_code").agg(
        F.min("transaction_date").alias("_from"), F.max("transaction_date").alias("_to"),
        F.coalesce(F.sum(_exact("quantity_sold")).cast("double"), F.lit(0.0)).alias("total_quantity_sold"),
        exact_mean(_exact("quantity_sold")).alias("avg_quantity_per_transaction"),
        F.stddev_samp("quantity_sold").alias("std_quantity"),
        F.coalesce(F.sum(_exact("revenue")).cast("double"), F.lit(0.0)).alias("total_revenue"),
        exact_mean(_exact("revenue")).alias("avg_revenue_per_transaction"),
        F.stddev_samp("revenue").alias("std_revenue"),
        exact_mean(F.col("avg_price").cast("decimal(28,10)")).alias("avg_selling_price"),
        F.sum("unique_customers").alias("total_unique_customers"),
        F.sum("num_transactions").alias("total_transactions"),
    ))
    keys = keys_of(scope)
    span = per_product.groupBy(*keys).agg(elapsed_days(F.max("_to"), F.min("_from")).alias("_days"))
    return attach(per_product.where(F.col("product_code").isNotNull()), span, keys).withColumns({
        "revenue_per_day": F.col("total_revenue") / F.greatest(F.col("_days"), F.lit(1)),
        "customer_reach": F.try_divide("total_unique_customers", "total_transactions"),
    }).drop("_days", "_from", "_to")


def customer_features(facts: DataFrame, scope: str = "tenant", include_lowest: bool = False,
                      approx: bool = False) -> DataFrame:
    """Spending, variety, lifetime and churn risk per customer of a tenant.

    The four distinct counts are sizes of a customer's sets: as counts of distinct
    values they would multiply every line by five before the shuffle.  With
    ``approx`` they come from sketches, in one pass.
    """
    def distinct(column: str) -> Column:
        # only customers have features; sales without one need no sets
        own = F.when(F.col("customer_id").isNotNull(), F.col(column))
        return distinct_count(column, True) if approx else F.size(F.collect_set(own)).cast("long")
    # written once; sales without a customer count for the latest day only
    per_customer = cut(facts.groupBy("companyfn", "customer_id").agg(
        F.min("transaction_date").alias("first_purchase_date"),
        F.max("transaction_date").alias("last_purchase_date"),
        distinct("transaction_date").alias("total_purchase_days"),
        as_double_sum("line_amount").alias("total_spent"),
        exact_mean("line_amount").alias("avg_order_value"),
        F.stddev_samp(F.col("line_amount").cast("double")).alias("std_order_value"),
        as_double_sum("quantity").alias("total_quantity"),
        exact_mean("quantity").alias("avg_quantity_per_order"),
        distinct("product_code").alias("unique_products"),
        distinct("category_code").alias("unique_categories"),
        distinct("brand_code").alias("unique_brands"),
    ))
    keys = keys_of(scope)
    latest = per_customer.groupBy(*keys).agg(F.max("last_purchase_date").alias("_now"))
    df = attach(per_customer.where(F.col("customer_id").isNotNull()), latest, keys).withColumns({
        "customer_lifetime_days": elapsed_days("last_purchase_date", "first_purchase_date"),
        "days_since_last_purchase": elapsed_days("_now", "last_purchase_date"),
    })
    return df.withColumns({
        "purchase_frequency": over_nonzero(F.col("total_purchase_days"), F.col("customer_lifetime_days")),
        "churn_risk": risk_of(F.col("days_since_last_purchase"), include_lowest),
    }).drop("_now")


def lag_features(df: DataFrame, value: str, date: str = "transaction_date",
                 group: Sequence[str] = (), lags: Sequence[int] = (1, 7, 30),
                 ties: Sequence[str] = (), block_rows: int = 100_000) -> DataFrame:
    """The value ``n`` rows earlier in date order; groups may be of any size."""
    def columns(window):
        return {f"{value}_lag_{n}": F.lag(value, n).over(window) for n in lags}
    order = [F.col(c) for c in (date, *ties)]
    return over_rows(df, list(group), order, max(lags), columns, block_rows)


def rolling_features(df: DataFrame, value: str, date: str = "transaction_date",
                     group: Sequence[str] = (), windows: Sequence[int] = (7, 30, 90),
                     ties: Sequence[str] = (), block_rows: int = 100_000) -> DataFrame:
    """Mean and sample deviation of the last ``n`` rows in date order.

    The mean of a decimal column is taken from its exact sum.
    """
    is_decimal = isinstance(df.schema[value].dataType, T.DecimalType)

    def columns(window):
        out = {}
        for n in windows:
            frame = window.rowsBetween(-(n - 1), 0)
            if is_decimal:
                mean = F.try_divide(F.sum(value).over(frame).cast("double"), F.count(value).over(frame))
            else:
                mean = F.avg(value).over(frame)
            out[f"{value}_rolling_mean_{n}"] = mean
            out[f"{value}_rolling_std_{n}"] = F.stddev_samp(F.col(value).cast("double")).over(frame)
        return out
    order = [F.col(c) for c in (date, *ties)]
    return over_rows(df, list(group), order, max(windows) - 1, columns, block_rows)


def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product and ratio of column pairs; pairs with a missing column are skipped."""
    new = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            new[f"{a}_div_{b}"] = over_or_null(F.col(a), F.col(b))
    return df.withColumns(new)


def favorites(facts: DataFrame) -> DataFrame:
    """Most bought category and brand per customer; ties go to the first name."""
    choices = facts.select("companyfn", "customer_id", F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category_name").alias("name")),
        F.struct(F.lit("brand").alias("kind"), F.col("brand_desc").alias("name")),
    )).alias("choice")).select("companyfn", "customer_id", "choice.kind", "choice.name")
    counted = choices.where(F.col("name").isNotNull()).groupBy("companyfn", "customer_id", "kind", "name").count()
    best_first = F.struct(-F.col("count"), F.col("name"))

    def best(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, best_first))["name"]
    return counted.groupBy("companyfn", "customer_id").agg(
        best("category").alias("favorite_category"), best("brand").alias("favorite_brand"))


def seasonality_index(products: DataFrame) -> DataFrame:
    """Mean revenue of a product's rows in a calendar month over its overall mean."""
    monthly = products.groupBy("companyfn", "product_code", "month").agg(
        F.sum(_exact("revenue")).alias("_sum"), F.count("revenue").alias("_n"))
    year = W.partitionBy("companyfn", "product_code")  # twelve rows at most
    overall = F.try_divide(F.sum("_sum").over(year).cast("double"), F.sum("_n").over(year))
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("_n"))
    return monthly.select("companyfn", "product_code", "month", mean.alias("month_mean_revenue"),
                          F.try_divide(mean, overall).alias("seasonality_index"))
