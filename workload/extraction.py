"""Scans, extraction queries and monthly revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesmart.operators import extraction as ex
from salesmart.operators import insights
from salesmart.sources import readers
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.tables import headers, lines, table

REVENUE_COLUMNS = ["uniquenum_pri", "companyfn", "tag_table_usage", "date_trans", "amount_local",
                   "tag_void_yn", "tag_deleted_yn", "tag_closed02_yn"]
RETENTION_COLUMNS = ["uniquenum_pri", "companyfn", "tag_table_usage", "party_unique", "party_code",
                     "party_desc", "date_trans", "amount_local", "tag_void_yn"]
TREND_COLUMNS = ["companyfn", "tag_table_usage", "party_unique", "date_trans", "amount_local",
                 "deptunit_code", "deptunit_desc", "staff_code", "tag_void_yn"]
FACT_HEADER_COLUMNS = RETENTION_COLUMNS + ["deptunit_code", "staff_code"]
FACT_LINE_COLUMNS = ["uniquenum_pri", "stkcode_code", "stkcode_desc", "stkcate_code",
                     "stkcate_desc", "brand_code", "brand_desc", "qnty_total", "price_unitrate_local",
                     "amount_local", "tag_void_yn"]
# lines belong to the tenant of their header, which is not asked for a second time
DETAIL_HEADERS = [*ex.DETAIL_SHARED_COLUMNS, *ex.DETAIL_HEADER_COLUMNS]
DETAIL_LINES = ["uniquenum_pri", *ex.DETAIL_LINE_COLUMNS, "amount_forex", "amount_local", "notes_memo", "tag_void_yn"]
PRODUCT_HEADER_COLUMNS = ["uniquenum_pri", "companyfn", "tag_table_usage", "party_unique", "date_trans", "tag_void_yn"]
PRODUCT_LINE_COLUMNS = FACT_LINE_COLUMNS + ["stkvendor_code", "stkvendor_desc"]

# monthly revenue (needs HDR)
REVENUE_SQL = """revenue AS (
  SELECT companyfn, month(date_trans) AS month, year(date_trans) AS year,
    CAST(SUM(amount_local) AS DOUBLE) AS amt_local, COUNT(DISTINCT uniquenum_pri) AS num_transactions
  FROM hdr
  WHERE (tag_table_usage = 'sal_soc' OR (tag_table_usage = 'sal_soe' AND tag_closed02_yn = 'n'))
    AND tag_deleted_yn = 'n' AND tag_void_yn = 'n'
  GROUP BY ALL)"""

# one row per customer and tenant (needs HDR)
RETENTION_SQL = """stats AS (
  SELECT companyfn, party_unique AS customer_id, party_code AS customer_code,
    party_desc AS customer_name, MIN(date_trans) AS first_purchase_date,
    MAX(date_trans) AS last_purchase_date, COUNT(DISTINCT uniquenum_pri) AS total_purchases,
    CAST(SUM(amount_local) AS DOUBLE) AS total_spent,
    CAST(SUM(amount_local) AS DOUBLE) / COUNT(amount_local) AS avg_purchase_value,
    COUNT(DISTINCT year(date_trans) * 100 + month(date_trans)) AS active_months
  FROM hdr WHERE tag_void_yn = 'n' AND tag_table_usage = 'sal_inv' GROUP BY ALL),
retention AS (
  SELECT companyfn, customer_id, customer_code, customer_name, first_purchase_date, last_purchase_date,
    date_diff('day', last_purchase_date, latest) AS days_since_last_purchase,
    total_purchases, total_spent, avg_purchase_value,
    CAST(total_purchases AS DOUBLE) / NULLIF(active_months, 0) AS purchase_frequency,
    date_diff('day', first_purchase_date, last_purchase_date) AS customer_lifetime_days,
    CASE WHEN date_diff('day', last_purchase_date, latest) > 365 THEN 1 ELSE 0 END AS is_churned
  FROM (SELECT *, MAX(last_purchase_date) OVER (PARTITION BY companyfn) AS latest FROM stats))"""

# sales per product, vendor and day (needs HDR, LIN, JOINED)
PRODUCT_SQL = """product_day AS (
  SELECT companyfn, stkcode_code AS product_code, stkcode_desc AS product_name,
    stkcate_code AS category_code, stkcate_desc AS category_name, brand_code, brand_desc,
    stkvendor_code AS vendor_code, stkvendor_desc AS vendor_name, main_date AS transaction_date,
    year(main_date) AS year, month(main_date) AS month, quarter(main_date) AS quarter,
    CAST(SUM(qnty_total) AS DOUBLE) AS quantity_sold, CAST(SUM(line_amount) AS DOUBLE) AS revenue,
    CAST(SUM(price_unitrate_local) AS DOUBLE) / COUNT(price_unitrate_local) AS avg_price,
    COUNT(DISTINCT party_unique) AS unique_customers, COUNT(DISTINCT uniquenum_pri) AS num_transactions
  FROM joined GROUP BY ALL)"""

# sales per day, unit, salesperson and type (needs HDR)
TREND_SQL = """trend AS (
  SELECT companyfn, date_trans AS transaction_date, year(date_trans) AS year,
    month(date_trans) AS month, quarter(date_trans) AS quarter,
    isodow(date_trans) - 1 AS day_of_week, day(date_trans) AS day_of_month,
    week(date_trans) AS week_of_year, deptunit_code AS business_unit,
    deptunit_desc AS business_unit_name, staff_code AS salesperson,
    tag_table_usage AS transaction_type, COUNT(*) AS total_transactions,
    CAST(SUM(amount_local) AS DOUBLE) AS total_revenue,
    CAST(SUM(amount_local) AS DOUBLE) / COUNT(amount_local) AS avg_transaction_value,
    COUNT(DISTINCT party_unique) AS unique_customers
  FROM hdr WHERE tag_void_yn = 'n' AND tag_table_usage IN ('sal_inv', 'sal_soc') GROUP BY ALL)"""

# one row per line of a customer (needs HDR, LIN, JOINED)
FACTS_SQL = """facts AS (
  SELECT companyfn, uniquenum_pri, party_unique AS customer_id, party_code AS customer_code,
    party_desc AS customer_name, main_date AS transaction_date, year(main_date) AS year,
    month(main_date) AS month, quarter(main_date) AS quarter, isodow(main_date) - 1 AS day_of_week,
    stkcode_code AS product_code, stkcode_desc AS product_name, stkcate_code AS category_code,
    stkcate_desc AS category_name, brand_code, brand_desc, CAST(qnty_total AS DOUBLE) AS quantity,
    CAST(price_unitrate_local AS DOUBLE) AS unit_price, CAST(line_amount AS DOUBLE) AS line_amount,
    main_type AS transaction_type, main_unit AS business_unit, main_staff AS salesperson
  FROM joined)"""

HEADER_VALUES = """uniquenum_pri, companyfn, dnum_auto, tag_table_usage, party_unique, party_code,
  party_desc, date_trans, date_due, CAST(amount_local AS DOUBLE) AS amount_local,
  CAST(amount_forex AS DOUBLE) AS amount_forex, CAST(NULL AS VARCHAR) AS curr_short_forex,
  rate AS curr_rate_forex_f_calc, deptunit_code, deptunit_desc, staff_code,
  CAST(NULL AS VARCHAR) AS staff_unique, location_code, CAST(NULL AS VARCHAR) AS creditterm_desc,
  CAST(NULL AS VARCHAR) AS delivtype_desc, CAST(NULL AS VARCHAR) AS sendby_desc,
  CAST(NULL AS VARCHAR) AS notes_memo, tag_void_yn, salestaxpct"""


def revenue(spark, sf_dir):
    return ex.monthly_revenue(headers(spark, sf_dir, REVENUE_COLUMNS))


def retention(spark, sf_dir, **options):
    return ex.customer_retention(headers(spark, sf_dir, RETENTION_COLUMNS), **options)


def facts(spark, sf_dir, *columns):
    """Customer facts, or only some columns of them and only the tables those need."""
    sources = [ex.CUSTOMER_FACTS[c].split(".") for c in columns or ex.CUSTOMER_FACTS]
    main = {"uniquenum_pri", "companyfn", "tag_void_yn", "tag_table_usage", "date_trans"}
    data = {"uniquenum_pri", "tag_void_yn"}
    main |= {c for side, c in sources if side == "main"}
    data |= {c for side, c in sources if side == "data"}
    return ex.customer_facts(headers(spark, sf_dir, main), lines(spark, sf_dir, data), columns=columns or None)


def product_day(spark, sf_dir):
    return ex.product_daily(headers(spark, sf_dir, PRODUCT_HEADER_COLUMNS),
                            lines(spark, sf_dir, PRODUCT_LINE_COLUMNS))


def trend(spark, sf_dir):
    return ex.sales_trend(headers(spark, sf_dir, TREND_COLUMNS))


@query("revenue_month", with_tables(HDR, REVENUE_SQL) + "SELECT * FROM revenue")
def _(spark, sf_dir):
    return plain(revenue(spark, sf_dir))


@query("revenue_month_growth", with_tables(HDR, REVENUE_SQL) + """
SELECT r.companyfn, r.year AS report_year, r.month AS report_month, r.amt_local AS total_revenue,
  r.num_transactions AS transaction_count,
  CASE WHEN p.amt_local > 0 THEN (r.amt_local - p.amt_local) / p.amt_local * 100 ELSE 0 END AS growth_pct,
  CASE WHEN r.num_transactions > 0 THEN r.amt_local / r.num_transactions END AS avg_transaction_revenue
FROM revenue r LEFT JOIN revenue p ON r.companyfn = p.companyfn
  AND p.year * 12 + p.month = r.year * 12 + r.month - 1""")
def _(spark, sf_dir):
    return plain(insights.month_report(revenue(spark, sf_dir)))


@query("revenue_year", with_tables(HDR, REVENUE_SQL) + """
SELECT companyfn, year AS report_year, CAST(SUM(CAST(amt_local AS DECIMAL(28,4))) AS DOUBLE) AS total_revenue,
  CAST(SUM(num_transactions) AS BIGINT) AS transaction_count, COUNT(*) AS month_count
FROM revenue GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(insights.year_report(revenue(spark, sf_dir)))


@query("sales_main", with_tables(HDR) + f"SELECT {HEADER_VALUES} FROM hdr WHERE tag_void_yn = 'n'")
def _(spark, sf_dir):
    return plain(ex.sales_main(headers(spark, sf_dir)))


@query("sales_main_filtered", with_tables(HDR) + f"""SELECT {HEADER_VALUES} FROM hdr
WHERE companyfn = 'C1' AND tag_table_usage IN ('sal_inv', 'sal_soc')
  AND date_trans >= TIMESTAMP '1996-01-01' AND date_trans <= TIMESTAMP '1998-12-31'""")
def _(spark, sf_dir):
    return plain(ex.sales_main(headers(spark, sf_dir), companyfn="C1", date_from="1996-01-01",
                               date_to="1998-12-31", transaction_types=["sal_inv", "sal_soc"],
                               include_void=True))


@query("sales_lines", with_tables(HDR, LIN) + """
SELECT idcode, uniquenum_uniq, uniquenum_pri, companyfn, tag_table_usage,
  CAST(row_item_num AS DOUBLE) AS row_item_num, stkcode_code, stkcode_unique, stkcode_desc,
  CAST(NULL AS VARCHAR) AS skucode_code, brand_code, CAST(NULL AS VARCHAR) AS brand_unique, brand_desc,
  stkcate_code, CAST(NULL AS VARCHAR) AS stkcate_unique, stkcate_desc, stkvendor_code, stkvendor_desc,
  CAST(qnty_total AS DOUBLE) AS qnty_total, CAST(qnty_total AS DOUBLE) AS qnty_uomstk,
  CAST(qnty_total AS DOUBLE) AS bal_qnty_total, CAST(qnty_total AS DOUBLE) AS bal_qnty_uomstk,
  CAST(NULL AS VARCHAR) AS uom_stk_code, CAST(NULL AS DOUBLE) AS price_unitlist_forex,
  CAST(price_unitlist_local AS DOUBLE) AS price_unitlist_local,
  CAST(NULL AS DOUBLE) AS price_unitrate_forex, CAST(price_unitrate_local AS DOUBLE) AS price_unitrate_local,
  CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(NULL AS DOUBLE) AS amount_forex,
  CAST(amount_local AS DOUBLE) AS amount_local, CAST(NULL AS DOUBLE) AS amount_tax_forex,
  CAST(amount_tax_local AS DOUBLE) AS amount_tax_local, CAST(NULL AS VARCHAR) AS gst_taxa_code, date_trans, party_unique, party_code,
  party_desc, staff_code, CAST(NULL AS VARCHAR) AS staff_unique, deptunit_code, location_code,
  CAST(NULL AS VARCHAR) AS notes_memo, tag_void_yn, CAST(NULL AS VARCHAR) AS tag_item_taxable_yn,
  tag_closedmain_yn
FROM lin WHERE tag_void_yn = 'n'""")
def _(spark, sf_dir):
    return plain(ex.sales_lines(lines(spark, sf_dir)))


@query("sales_with_details", with_tables(HDR, LIN) + """
SELECT m.uniquenum_pri, m.companyfn, m.dnum_auto, CAST(NULL AS VARCHAR) AS curr_short_forex,
  CAST(NULL AS VARCHAR) AS entprojfn_code, CAST(NULL AS VARCHAR) AS creditterm_desc,
  CAST(NULL AS VARCHAR) AS delivtype_desc, m.salestaxpct, m.tag_table_usage AS main_transaction_type,
  m.party_unique AS main_party_unique, m.party_code AS main_party_code, m.party_desc AS main_party_desc,
  m.date_trans AS main_date_trans, CAST(m.amount_local AS DOUBLE) AS main_amount_local,
  CAST(m.amount_forex AS DOUBLE) AS main_amount_forex, m.deptunit_code AS main_deptunit_code,
  m.deptunit_desc AS main_deptunit_desc, m.staff_code AS main_staff_code,
  CAST(NULL AS VARCHAR) AS main_staff_unique, m.location_code AS main_location_code,
  CAST(NULL AS VARCHAR) AS main_notes_memo, m.tag_void_yn AS main_tag_void_yn, d.uniquenum_uniq,
  CAST(d.row_item_num AS DOUBLE) AS row_item_num, d.stkcode_code, d.stkcode_unique, d.stkcode_desc,
  CAST(NULL AS VARCHAR) AS skucode_code, d.brand_code, d.brand_desc, d.stkcate_code, d.stkcate_desc,
  d.stkvendor_code, d.stkvendor_desc, CAST(d.qnty_total AS DOUBLE) AS qnty_total,
  CAST(d.qnty_total AS DOUBLE) AS qnty_uomstk, CAST(d.qnty_total AS DOUBLE) AS bal_qnty_total,
  CAST(NULL AS VARCHAR) AS uom_stk_code, CAST(NULL AS DOUBLE) AS price_unitrate_forex,
  CAST(d.price_unitrate_local AS DOUBLE) AS price_unitrate_local,
  CAST(d.discount_pct AS DOUBLE) AS discount_pct, CAST(NULL AS DOUBLE) AS amount_tax_forex,
  CAST(d.amount_tax_local AS DOUBLE) AS amount_tax_local, CAST(NULL AS VARCHAR) AS gst_taxa_code, CAST(NULL AS VARCHAR) AS tag_item_taxable_yn,
  CAST(NULL AS DOUBLE) AS line_amount_forex, CAST(d.amount_local AS DOUBLE) AS line_amount_local,
  CAST(NULL AS VARCHAR) AS line_notes_memo
FROM hdr m JOIN lin d ON m.uniquenum_pri = d.uniquenum_pri AND m.companyfn = d.companyfn
WHERE m.tag_void_yn = 'n' AND d.tag_void_yn = 'n'
  AND m.tag_table_usage IN ('sal_soe', 'sal_soc', 'sal_inv')""")
def _(spark, sf_dir):
    return plain(ex.sales_with_details(headers(spark, sf_dir, DETAIL_HEADERS), lines(spark, sf_dir, DETAIL_LINES),
                                       transaction_types=ex.ORDER_TYPES))


@query("customer_facts", with_tables(HDR, LIN, JOINED, FACTS_SQL) + "SELECT * FROM facts")
def _(spark, sf_dir):
    return plain(facts(spark, sf_dir))


@query("customer_retention", with_tables(HDR, RETENTION_SQL) + "SELECT * FROM retention")
def _(spark, sf_dir):
    return plain(retention(spark, sf_dir))


@query("product_daily", with_tables(HDR, LIN, JOINED, PRODUCT_SQL) + "SELECT * FROM product_day")
def _(spark, sf_dir):
    return plain(product_day(spark, sf_dir))


@query("sales_trend", with_tables(HDR, TREND_SQL) + "SELECT * FROM trend")
def _(spark, sf_dir):
    return plain(trend(spark, sf_dir))


@query("revenue_for_products", with_tables(HDR, LIN) + """
SELECT companyfn, month(date_trans) AS month, year(date_trans) AS year,
  CAST(SUM(amount_local) AS DOUBLE) AS amt_local, COUNT(DISTINCT uniquenum_pri) AS num_transactions
FROM hdr
WHERE (tag_table_usage = 'sal_soc' OR (tag_table_usage = 'sal_soe' AND tag_closed02_yn = 'n'))
  AND tag_deleted_yn = 'n' AND tag_void_yn = 'n'
  AND EXISTS (SELECT 1 FROM lin d WHERE d.uniquenum_pri = hdr.uniquenum_pri
    AND d.companyfn = hdr.companyfn AND d.stkcode_code IN ('P1', 'P2', 'P3', 'P5', 'P8', 'P13'))
GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(ex.monthly_revenue(
        headers(spark, sf_dir, REVENUE_COLUMNS),
        product_codes=["P1", "P2", "P3", "P5", "P8", "P13"],
        lines=lines(spark, sf_dir, ["uniquenum_pri", "companyfn", "stkcode_code"])))


@query("sql_scan", """SELECT c_mktsegment AS segment, COUNT(*) AS customers FROM customer
WHERE c_acctbal >= 1000 GROUP BY ALL""")
def _(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("salesmart_customer")
    return plain(readers.run_sql(
        spark, "SELECT c_mktsegment AS segment, COUNT(*) AS customers FROM salesmart_customer "
               "WHERE c_acctbal >= :floor GROUP BY c_mktsegment", {"floor": 1000}))


@query("table_filter_in", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'""")
def _(spark, sf_dir):
    return plain(readers.read_table(
        table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"],
        {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": "F"}))


@query("join_on_condition", """SELECT main.o_orderkey, main.o_orderdate, data.l_partkey, data.l_quantity
FROM orders main JOIN lineitem data ON main.o_orderkey = data.l_orderkey
  AND data.l_shipdate > main.o_orderdate
WHERE main.o_orderstatus = 'O' AND data.l_returnflag IN ('A', 'N')""")
def _(spark, sf_dir):
    return plain(readers.read_joined(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
        "main.o_orderkey = data.l_orderkey AND data.l_shipdate > main.o_orderdate",
        ["main.o_orderkey", "main.o_orderdate", "data.l_partkey", "data.l_quantity"],
        {"main.o_orderstatus": "O", "data.l_returnflag": ["A", "N"]}))


@query("table_info", """SELECT column_index AS position, column_name, data_type, 'YES' AS is_nullable,
  CAST(NULL AS VARCHAR) AS column_default, row_count
FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'),
  (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string'))
  AS c(column_index, column_name, data_type), (SELECT COUNT(*) AS row_count FROM orders)""")
def _(spark, sf_dir):
    return plain(readers.describe_table(table(spark, sf_dir, "orders")))


@query("date_range", with_tables(HDR) + """
SELECT strftime(MIN(date_trans), '%Y-%m-%d') AS min_date, strftime(MAX(date_trans), '%Y-%m-%d') AS max_date
FROM hdr WHERE tag_void_yn = 'n'""")
def _(spark, sf_dir):
    return plain(ex.date_range(headers(spark, sf_dir, ["date_trans", "tag_void_yn"])))
