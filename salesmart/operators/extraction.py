"""Filtered, joined and aggregated views of the two source relations.

Results carry no order (a written dataset has none, and a global sort moves
every row); pass ``ordered=True`` for the order a reader would expect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.cleaning import as_double_sum, exact_mean
from salesmart.functions.dates import calendar, elapsed_days
from salesmart.functions.distinct import distinct_count
from salesmart.functions.scoring import churned
from salesmart.plans.lookups import attach
from salesmart.schemas import HEADERS, LINES
from salesmart.session import cut

# fixed values
ORDER_TYPES = ["sal_soe", "sal_soc", "sal_inv"]
TREND_TYPES = ["sal_inv", "sal_soc"]
FIRST_DATE, LAST_DATE = "2009-01-01", "2026-12-31"
INTERNAL_HEADER_COLUMNS = {"idcode", "tag_deleted_yn", "tag_closed02_yn", "entprojfn_code"}
DETAIL_HEADER_COLUMNS = [
    "tag_table_usage", "party_unique", "party_code", "party_desc", "date_trans", "amount_local",
    "amount_forex", "deptunit_code", "deptunit_desc", "staff_code", "staff_unique",
    "location_code", "notes_memo", "tag_void_yn",
]
DETAIL_SHARED_COLUMNS = [
    "uniquenum_pri", "companyfn", "dnum_auto", "curr_short_forex", "entprojfn_code",
    "creditterm_desc", "delivtype_desc", "salestaxpct",
]
DETAIL_LINE_COLUMNS = [
    "uniquenum_uniq", "row_item_num", "stkcode_code", "stkcode_unique", "stkcode_desc",
    "skucode_code", "brand_code", "brand_desc", "stkcate_code", "stkcate_desc",
    "stkvendor_code", "stkvendor_desc", "qnty_total", "qnty_uomstk", "bal_qnty_total",
    "uom_stk_code", "price_unitrate_forex", "price_unitrate_local", "discount_pct",
    "amount_tax_forex", "amount_tax_local", "gst_taxa_code", "tag_item_taxable_yn",
]


def _between(column: Column, date_from: str | None, date_to: str | None) -> Column:
    """Inclusive at both ends; a bare date as upper end stops at its midnight."""
    keep = F.lit(True)
    if date_from:
        keep = keep & (column >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        keep = keep & (column <= F.lit(date_to).cast("timestamp_ntz"))
    return keep


def _sorted(df: DataFrame, ordered: bool, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


def sales_main(headers: DataFrame, companyfn: str | None = None, date_from: str | None = None,
               date_to: str | None = None, transaction_types: Sequence[str] | None = None,
               include_void: bool = False, ordered: bool = False) -> DataFrame:
    """Order headers."""
    df = headers.where(_between(F.col("date_trans"), date_from, date_to))
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    if not include_void:
        df = df.where(F.col("tag_void_yn") == "n")
    if transaction_types:
        df = df.where(F.col("tag_table_usage").isin(list(transaction_types)))
    df = df.select(*[c for c in HEADERS.fieldNames() if c not in INTERNAL_HEADER_COLUMNS])
    return _sorted(df, ordered, F.desc("date_trans"), "uniquenum_pri")


def sales_lines(lines: DataFrame, companyfn: str | None = None, uniquenum_pri: str | None = None,
                date_from: str | None = None, date_to: str | None = None,
                product_codes: Sequence[str] | None = None, include_void: bool = False,
                ordered: bool = False) -> DataFrame:
    """Order lines."""
    df = lines.where(_between(F.col("date_trans"), date_from, date_to))
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    if uniquenum_pri:
        df = df.where(F.col("uniquenum_pri") == uniquenum_pri)
    if not include_void:
        df = df.where(F.col("tag_void_yn") == "n")
    if product_codes:
        df = df.where(F.col("stkcode_code").isin(list(product_codes)))
    return _sorted(df.select(*[c for c in LINES.fieldNames() if c in df.columns]),
                   ordered, F.desc("date_trans"), "row_item_num")


def _header_lines(headers: DataFrame, lines: DataFrame, companyfn: str | None, date_from: str | None,
                  date_to: str | None, types: Sequence[str] | None) -> DataFrame:
    """Valid lines of valid headers, joined on order and tenant.

    Lines stored without a tenant column belong to the tenant of their header.
    """
    main = headers.where((F.col("tag_void_yn") == "n") & _between(F.col("date_trans"), date_from, date_to))
    data = lines.where(F.col("tag_void_yn") == "n")
    if companyfn:
        main = main.where(F.col("companyfn") == companyfn)
    if types:
        main = main.where(F.col("tag_table_usage").isin(list(types)))
    same = F.col("main.uniquenum_pri") == F.col("data.uniquenum_pri")
    if "companyfn" in data.columns:
        same = same & (F.col("main.companyfn") == F.col("data.companyfn"))
        if companyfn:
            data = data.where(F.col("companyfn") == companyfn)
    return main.alias("main").join(data.alias("data"), same, "inner")


def sales_with_details(headers: DataFrame, lines: DataFrame, companyfn: str | None = None,
                       date_from: str | None = None, date_to: str | None = None,
                       transaction_types: Sequence[str] | None = None,
                       ordered: bool = False) -> DataFrame:
    """Headers with their lines, one row per line."""
    joined = _header_lines(headers, lines, companyfn, date_from, date_to, transaction_types)
    df = joined.select(
        *[F.col(f"main.{c}") for c in DETAIL_SHARED_COLUMNS],
        *[F.col("main." + c).alias("main_transaction_type" if c == "tag_table_usage" else f"main_{c}")
          for c in DETAIL_HEADER_COLUMNS],
        *[F.col(f"data.{c}") for c in DETAIL_LINE_COLUMNS],
        *[F.col(f"data.{c}").alias(f"line_{c}") for c in ("amount_forex", "amount_local", "notes_memo")],
    )
    return _sorted(df, ordered, F.desc("main_date_trans"), "row_item_num")


# fixed values: names of the customer facts and where they come from
CUSTOMER_FACTS = {
    "companyfn": "main.companyfn",
    "uniquenum_pri": "main.uniquenum_pri",
    "customer_id": "main.party_unique",
    "customer_code": "main.party_code",
    "customer_name": "main.party_desc",
    "transaction_date": "main.date_trans",
    "product_code": "data.stkcode_code",
    "product_name": "data.stkcode_desc",
    "category_code": "data.stkcate_code",
    "category_name": "data.stkcate_desc",
    "brand_code": "data.brand_code",
    "brand_desc": "data.brand_desc",
    "quantity": "data.qnty_total",
    "unit_price": "data.price_unitrate_local",
    "line_amount": "data.amount_local",
    "transaction_type": "main.tag_table_usage",
    "business_unit": "main.deptunit_code",
    "salesperson": "main.staff_code",
}
# fixed values: what product days are grouped by, and what is summed or counted in them
PRODUCT_DAYS = {
    "companyfn": "main.companyfn",
    "product_code": "data.stkcode_code",
    "product_name": "data.stkcode_desc",
    "category_code": "data.stkcate_code",
    "category_name": "data.stkcate_desc",
    "brand_code": "data.brand_code",
    "brand_desc": "data.brand_desc",
    "vendor_code": "data.stkvendor_code",
    "vendor_name": "data.stkvendor_desc",
    "transaction_date": "main.date_trans",
}
PRODUCT_MEASURES = ["data.qnty_total", "data.amount_local", "data.price_unitrate_local", "main.party_unique",
                    "main.uniquenum_pri"]


def order_lines(headers: DataFrame, lines: DataFrame, companyfn: str | None = None, date_from: str | None = None,
                date_to: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Valid lines of valid orders with their headers, as columns ``main_*`` and ``data_*``.

    What customer facts and product days have in common: a job that needs both
    writes it once and passes it on as ``joined``.
    """
    joined = _header_lines(headers, lines, companyfn, date_from, date_to, ORDER_TYPES)
    wanted = dict.fromkeys(columns or [*CUSTOMER_FACTS.values(), *PRODUCT_DAYS.values(), *PRODUCT_MEASURES])
    return joined.select(*[F.col(c).alias(c.replace(".", "_")) for c in wanted])


def customer_facts(headers: DataFrame | None, lines: DataFrame | None, companyfn: str | None = None,
                   date_from: str | None = None, date_to: str | None = None,
                   columns: Sequence[str] | None = None, ordered: bool = False,
                   joined: DataFrame | None = None) -> DataFrame:
    """One row per order line of a customer, with product and calendar parts.

    With ``columns`` only those are built, so the sources need not hold the rest.
    """
    names = [n for n in CUSTOMER_FACTS if columns is None or n in columns]
    if joined is None:
        joined = order_lines(headers, lines, companyfn, date_from, date_to, [CUSTOMER_FACTS[n] for n in names])
    df = joined.select(*[F.col(CUSTOMER_FACTS[n].replace(".", "_")).alias(n) for n in names])
    if "transaction_date" in names:
        df = df.withColumns(calendar("transaction_date", "year", "month", "quarter", "day_of_week"))
    return _sorted(df, ordered, F.desc("transaction_date"))


def customer_retention(headers: DataFrame, companyfn: str | None = None, churn_days: int = 365,
                       scope: str = "tenant", ordered: bool = False, approx: bool = False) -> DataFrame:
    """Purchase history per customer from valid invoices, with a churn flag.

    With ``approx`` distinct orders and months are estimated by sketches.  Days since the last purchase count back from the latest purchase of the
    tenant, or of all tenants with ``scope='all'``.
    """
    df = headers.where((F.col("tag_void_yn") == "n") & (F.col("tag_table_usage") == "sal_inv"))
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    group = ["companyfn", "customer_id", "customer_code", "customer_name"]
    named = df.select(
        "companyfn", F.col("party_unique").alias("customer_id"),
        F.col("party_code").alias("customer_code"), F.col("party_desc").alias("customer_name"),
        "date_trans", "uniquenum_pri", "amount_local", (F.year("date_trans") * 100 + F.month("date_trans")).alias("_month"))
    stats = cut(_purchases_estimated(named, group) if approx else _purchases(named, group))
    keys = [] if scope == "all" else ["companyfn"]
    # from the written aggregate: the headers are read once
    latest = stats.groupBy(*keys).agg(F.max("last_purchase_date").alias("latest_purchase"))
    days = elapsed_days("latest_purchase", "last_purchase_date")
    result = attach(stats, latest, keys).select(
        *group, "first_purchase_date", "last_purchase_date",
        days.alias("days_since_last_purchase"),
        "total_purchases", "total_spent", "avg_purchase_value",
        F.try_divide(F.col("total_purchases").cast("double"), F.col("active_months")).alias("purchase_frequency"),
        elapsed_days("last_purchase_date", "first_purchase_date").alias("customer_lifetime_days"),
        churned(days, churn_days).alias("is_churned"),
    )
    return _sorted(result, ordered, F.desc("total_spent"), "customer_id")


def _purchases(named: DataFrame, group: list[str]) -> DataFrame:
    """Figures per customer, first collapsed to orders.

    Orders are then rows and need no set; the months are few and need a small one.
    """
    orders = named.groupBy(*group, "uniquenum_pri").agg(
        F.min("date_trans").alias("_first"), F.max("date_trans").alias("_last"),
        F.sum("amount_local").alias("_amount"), F.count("amount_local").alias("_priced"),
        F.collect_set("_month").alias("_months"))
    return orders.groupBy(*group).agg(
        F.min("_first").alias("first_purchase_date"), F.max("_last").alias("last_purchase_date"),
        F.count("uniquenum_pri").alias("total_purchases"), as_double_sum("_amount").alias("total_spent"),
        F.try_divide(F.sum("_amount").cast("double"), F.sum("_priced")).alias("avg_purchase_value"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_months")))).cast("long").alias("active_months"))


def _purchases_estimated(named: DataFrame, group: list[str]) -> DataFrame:
    return named.groupBy(*group).agg(
        F.min("date_trans").alias("first_purchase_date"), F.max("date_trans").alias("last_purchase_date"),
        distinct_count("uniquenum_pri", True).alias("total_purchases"),
        as_double_sum("amount_local").alias("total_spent"), exact_mean("amount_local").alias("avg_purchase_value"),
        distinct_count("_month", True).alias("active_months"))


def product_daily(headers: DataFrame | None, lines: DataFrame | None, companyfn: str | None = None,
                  date_from: str | None = None, date_to: str | None = None,
                  ordered: bool = False, approx: bool = False, joined: DataFrame | None = None) -> DataFrame:
    """Sales per product, vendor and day; with ``approx`` customers and orders are estimated by sketches."""
    group = list(PRODUCT_DAYS)
    if joined is None:
        joined = order_lines(headers, lines, companyfn, date_from, date_to,
                             [*PRODUCT_DAYS.values(), *PRODUCT_MEASURES])
    facts = joined.select(*[F.col(c.replace(".", "_")).alias(n) for n, c in PRODUCT_DAYS.items()],
                          *[F.col(c.replace(".", "_")).alias(c.split(".")[1]) for c in PRODUCT_MEASURES])
    figures = _sales_estimated(facts, group) if approx else _sales(facts, group)
    df = figures.withColumns(calendar("transaction_date", "year", "month", "quarter"))
    return _sorted(df, ordered, F.desc("revenue"), "product_code")


def _sales(facts: DataFrame, group: list[str]) -> DataFrame:
    """Figures per product day, first collapsed to orders, in one exchange.

    All groupings contain the product and the day, so rows dealt by these stay
    where they are; a product that owns much of the lines is spread over its days.
    An order normally has one customer: the first of them carries its figures.
    """
    dealt = facts.repartition("companyfn", "product_code", "transaction_date")
    orders = dealt.groupBy(*group, "uniquenum_pri").agg(
        F.sum("qnty_total").alias("_quantity"), F.sum("amount_local").alias("_amount"),
        F.sum("price_unitrate_local").alias("_price"), F.count("price_unitrate_local").alias("_priced"),
        F.collect_set("party_unique").alias("_parties"))
    rows = orders.select(*group, "uniquenum_pri", "_quantity", "_amount", "_price", "_priced",
                         F.posexplode_outer("_parties").alias("_nth", "_party"))
    once = F.coalesce(F.col("_nth"), F.lit(0)) == 0

    def total(column: str) -> Column:
        return F.sum(F.when(once, F.col(column)))
    return rows.groupBy(*group).agg(
        F.coalesce(total("_quantity").cast("double"), F.lit(0.0)).alias("quantity_sold"),
        F.coalesce(total("_amount").cast("double"), F.lit(0.0)).alias("revenue"),
        F.try_divide(total("_price").cast("double"), total("_priced")).alias("avg_price"),
        F.countDistinct("_party").alias("unique_customers"),
        F.count(F.when(once, F.col("uniquenum_pri"))).alias("num_transactions"))


def _sales_estimated(facts: DataFrame, group: list[str]) -> DataFrame:
    return facts.groupBy(*group).agg(
        as_double_sum("qnty_total").alias("quantity_sold"), as_double_sum("amount_local").alias("revenue"),
        exact_mean("price_unitrate_local").alias("avg_price"),
        distinct_count("party_unique", True).alias("unique_customers"),
        distinct_count("uniquenum_pri", True).alias("num_transactions"))


def sales_trend(headers: DataFrame, companyfn: str | None = None, date_from: str | None = None,
                date_to: str | None = None, ordered: bool = False, approx: bool = False) -> DataFrame:
    """Sales per day, business unit, salesperson and transaction type; ``approx`` as in ``product_daily``."""
    df = headers.where(
        (F.col("tag_void_yn") == "n") & F.col("tag_table_usage").isin(TREND_TYPES)
        & _between(F.col("date_trans"), date_from, date_to))
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    df = df.select(
        "companyfn", F.col("date_trans").alias("transaction_date"),
        F.col("deptunit_code").alias("business_unit"), F.col("deptunit_desc").alias("business_unit_name"),
        F.col("staff_code").alias("salesperson"), F.col("tag_table_usage").alias("transaction_type"),
        "amount_local", "party_unique",
    ).groupBy("companyfn", "transaction_date", "business_unit", "business_unit_name", "salesperson",
              "transaction_type").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        as_double_sum("amount_local").alias("total_revenue"),
        exact_mean("amount_local").alias("avg_transaction_value"),
        distinct_count("party_unique", approx).alias("unique_customers"),
    ).withColumns(calendar("transaction_date", "year", "month", "quarter", "day_of_week",
                           "day_of_month", "week_of_year"))
    return _sorted(df, ordered, F.desc("transaction_date"))


def monthly_revenue(headers: DataFrame, companyfn: str | None = None, uniquenum_pri: str | None = None,
                    date_from: str | None = None, date_to: str | None = None,
                    product_codes: Sequence[str] | None = None, lines: DataFrame | None = None,
                    ordered: bool = False) -> DataFrame:
    """Revenue and orders per tenant and month from confirmed or open orders.

    ``product_codes`` keeps the orders that have a line with such a product.
    """
    confirmed = F.col("tag_table_usage") == "sal_soc"
    still_open = (F.col("tag_table_usage") == "sal_soe") & (F.col("tag_closed02_yn") == "n")
    df = headers.where(
        (confirmed | still_open) & (F.col("tag_deleted_yn") == "n") & (F.col("tag_void_yn") == "n")
        & _between(F.col("date_trans"), date_from, date_to))
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    if uniquenum_pri:
        df = df.where(F.col("uniquenum_pri") == uniquenum_pri)
    if product_codes:
        if lines is None:
            raise ValueError("a product filter needs the order lines")
        with_product = lines.where(F.col("stkcode_code").isin(list(product_codes)))
        df = df.join(with_product.select("uniquenum_pri", "companyfn"),
                     ["uniquenum_pri", "companyfn"], "left_semi")
    df = df.groupBy(
        "companyfn", F.month("date_trans").alias("month"), F.year("date_trans").alias("year"),
    ).agg(
        as_double_sum("amount_local").alias("amt_local"),
        F.countDistinct("uniquenum_pri").alias("num_transactions"),
    )
    return _sorted(df, ordered, F.desc("year"), F.desc("month"), "companyfn")


def date_range(headers: DataFrame, companyfn: str | None = None) -> DataFrame:
    """First and last day with a valid header, with fixed fall-backs."""
    df = headers.where(F.col("tag_void_yn") == "n")
    if companyfn:
        df = df.where(F.col("companyfn") == companyfn)
    return df.agg(
        F.coalesce(F.date_format(F.min("date_trans"), "yyyy-MM-dd"), F.lit(FIRST_DATE)).alias("min_date"),
        F.coalesce(F.date_format(F.max("date_trans"), "yyyy-MM-dd"), F.lit(LAST_DATE)).alias("max_date"),
    )
