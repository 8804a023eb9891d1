"""How promising is each product: growth, momentum, stability, revenue, reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.functions.cleaning import exact_mean
from salesmart.operators.cleaning import keys_of
from salesmart.plans.lookups import attach
from salesmart.session import cut

# fixed values: score weights, recent days, customers that count as full reach
WEIGHTS = {"growth": 0.35, "momentum": 0.25, "consistency": 0.20, "volume": 0.15, "customers": 0.05}
RECENT_DAYS = 30
FULL_REACH = 50

PRODUCT = ["companyfn", "stkcode_unique"]


def recent_lines(lines: DataFrame, as_of: str, days_history: int = 90,
                 companyfn: str | None = None) -> DataFrame:
    """Valid lines of the closed window [as_of - days_history, as_of]."""
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days_history).cast("timestamp_ntz")
    df = lines.where((F.col("tag_void_yn") == "n") & (F.col("date_trans") >= start)
                     & (F.col("date_trans") <= end.cast("timestamp_ntz")))
    return df.where(F.col("companyfn") == companyfn) if companyfn else df


def product_statistics(recent: DataFrame, as_of: str, days_history: int = 90) -> DataFrame:
    """Sales figures and trend factors per product over the recent lines.

    Lines collapse to product days of a customer, which are written: the lines are
    read once, and the window below sees at most ``days_history + 1`` rows of a
    product.
    """
    day = F.col("date_trans").cast("date")
    quantity = F.coalesce(F.col("qnty_total"), F.lit(0))
    price = F.col("price_unitlist_local")
    # names as on the earliest sale, its highest line number first
    first_line = F.struct(
        F.col("date_trans"), -F.col("row_item_num"), F.col("uniquenum_uniq"),
        F.col("stkcode_code"), F.col("stkcode_desc"), F.col("brand_desc"), F.col("stkcate_desc"))
    collapsed = cut(recent.groupBy(*PRODUCT, day.alias("day"), "party_unique").agg(
        F.sum(quantity).alias("qty"),
        F.sum(quantity * F.coalesce(price, F.lit(0))).alias("revenue"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(price).alias("price_sum"), F.count(price).alias("price_count"),
        F.min("date_trans").alias("first_sale"), F.max("date_trans").alias("last_sale"),
        F.min(first_line).alias("_line"),
    ))
    sums, least = ("qty", "revenue", "rows", "price_sum", "price_count"), ("first_sale", "_line")
    daily = collapsed.groupBy(*PRODUCT, "day").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], F.max("last_sale").alias("last_sale"))
    product = W.partitionBy(*PRODUCT)
    placed = daily.select(
        "*", F.row_number().over(product.orderBy("day")).alias("rn"),
        F.count(F.lit(1)).over(product).alias("sale_days"))

    first_half = F.col("rn") <= F.floor(F.col("sale_days") / 2)
    recent_day = F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), RECENT_DAYS - 1)

    def quantity_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("qty"))).cast("double"), F.lit(0.0))

    figures = placed.groupBy(*PRODUCT).agg(
        F.sum("qty").cast("double").alias("total_quantity"),
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.sum("rows").alias("transactions_count"),
        F.min("first_sale").alias("first_sale_date"), F.max("last_sale").alias("last_sale_date"),
        F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_count")).alias("avg_price"),
        F.count(F.lit(1)).alias("sale_days"),
        quantity_where(first_half).alias("_first"), quantity_where(~first_half).alias("_second"),
        quantity_where(recent_day).alias("_recent"),
        exact_mean("qty").alias("_mean"), F.stddev_pop(F.col("qty").cast("double")).alias("_std"),
        F.min("_line").alias("_line"),
    )
    older = F.col("total_quantity") - F.col("_recent")
    before_recent = max(days_history - RECENT_DAYS, 1)
    spread = F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(F.lit(1.0))
    figures = figures.withColumns({
        "growth_rate": F.when(F.col("_first") > 0, (F.col("_second") - F.col("_first")) / F.col("_first"))
        .when(F.col("_second") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "momentum": F.when(older > 0, (F.col("_recent") / RECENT_DAYS) / (older / before_recent))
        .when(F.col("_recent") > 0, F.lit(2.0)).otherwise(F.lit(0.0)),
        "consistency": F.when(F.col("sale_days") > 1, 1 / (1 + spread)).otherwise(F.lit(0.5)),
    }).drop("_first", "_second", "_recent", "_mean", "_std")

    figures = figures.select(*[c for c in figures.columns if c != "_line"], *[
        F.col(f"_line.{c}").alias(c) for c in ("stkcode_code", "stkcode_desc", "brand_desc", "stkcate_desc")])
    buyers = collapsed.groupBy(*PRODUCT).agg(F.countDistinct("party_unique").alias("unique_customer_count"))
    return figures.join(buyers, PRODUCT)


def _share_of(value: str, top: str) -> Column:
    share = F.when(F.col(top) > 0, F.col(value) / F.col(top)).otherwise(F.lit(0.0))
    return F.least(share, F.lit(1.0))


def potential_scores(statistics: DataFrame, scope: str = "tenant") -> DataFrame:
    """Weighted score 0..100 per product with the share of every factor.

    Growth, momentum and revenue are taken relative to the best product of the
    tenant; negative growth stays negative.  The statistics are written once.
    """
    keys, statistics = keys_of(scope), cut(statistics)
    best = statistics.groupBy(*keys).agg(
        F.max("growth_rate").alias("_growth"), F.max("momentum").alias("_momentum"),
        F.max("total_revenue").alias("_revenue"))
    factors = {
        "growth": _share_of("growth_rate", "_growth"),
        "momentum": _share_of("momentum", "_momentum"),
        "consistency": F.col("consistency"),
        "volume": _share_of("total_revenue", "_revenue"),
        "customers": F.least(F.col("unique_customer_count") / FULL_REACH, F.lit(1.0)),
    }
    names = {"growth": "recent_growth", "customers": "customer_base"}
    total = sum((factors[f] * F.lit(w) for f, w in WEIGHTS.items()), F.lit(0.0))
    breakdown = F.struct(*[F.round(factors[f] * 100, 1).alias(names.get(f, f)) for f in WEIGHTS])
    scored = attach(statistics, best, keys).withColumns(
        {"potential_score": F.round(total * 100, 2), "factor_breakdown": breakdown})
    return scored.drop("_growth", "_momentum", "_revenue")


def top_potential(scores: DataFrame, top_n: int = 10, scope: str = "tenant") -> DataFrame:
    """The ``top_n`` products by score, per tenant or overall.

    Spark keeps only ``top_n`` rows per tenant in every task before it
    shuffles, because the rank is filtered right away.
    """
    order = [F.desc("potential_score"), F.col("companyfn"), F.col("stkcode_unique")]
    if scope == "all":
        return scores.orderBy(*order).limit(top_n)
    rank = F.row_number().over(W.partitionBy("companyfn").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top_n)


def market_overview(statistics: DataFrame, scope: str = "tenant") -> DataFrame:
    """Mean growth and how many products grow or decline."""
    grows = F.sum((F.col("growth_rate") > 0).cast("int"))
    return statistics.groupBy(*keys_of(scope)).agg(
        F.round(F.avg("growth_rate") * 100, 2).alias("average_product_growth"),
        grows.alias("growing_products_count"),
        F.sum((F.col("growth_rate") < 0).cast("int")).alias("declining_products_count"),
        F.count(F.lit(1)).alias("total_products"),
        F.round(F.try_divide(grows, F.count(F.lit(1))) * 100, 1).alias("market_momentum"),
    )


def analysis_status(statistics: DataFrame, as_of: str, days_history: int = 90) -> DataFrame:
    """One row: the window, the number of products, success or no_data."""
    total = F.count(F.lit(1))
    return statistics.agg(
        F.when(total > 0, F.lit("success")).otherwise(F.lit("no_data")).alias("status"),
        F.date_format(F.date_sub(F.lit(as_of).cast("date"), days_history), "yyyy-MM-dd").alias("period_from"),
        F.lit(as_of).alias("period_to"), F.lit(days_history).alias("days_analyzed"),
        total.alias("total_products_analyzed"))


def analyze_product_trends(lines: DataFrame, as_of: str, companyfn: str | None = None,
                           days_history: int = 90, top_n: int = 10) -> DataFrame:
    """The most promising products of each tenant."""
    recent = recent_lines(lines, as_of, days_history, companyfn)
    return top_potential(potential_scores(product_statistics(recent, as_of, days_history)), top_n)
