"""Datasets built from their declarations."""

from __future__ import annotations

from salesmart.plans import specs
from workload.catalog import HDR, LIN, plain, query, with_tables
from workload.extraction import FACT_HEADER_COLUMNS, FACT_LINE_COLUMNS, RETENTION_COLUMNS, TREND_COLUMNS
from workload.summaries import AS_OF
from workload.tables import headers, lines

PRODUCT_COLUMNS = ["companyfn", "stkcode_code", "stkcode_desc", "stkcate_desc", "brand_desc", "stkvendor_desc",
                   "date_trans", "qnty_total", "amount_local", "price_unitrate_local", "tag_void_yn"]


def build(spark, sf_dir, name, header_columns=None, line_columns=None):
    tables = {}
    if header_columns:
        tables[specs.MAIN] = headers(spark, sf_dir, header_columns)
    if line_columns:
        tables[specs.DATA] = lines(spark, sf_dir, line_columns)
    return specs.build_dataset(specs.SPECS[name], tables)


@query("declared_customer_analysis", with_tables(HDR, LIN) + """
SELECT m.companyfn, m.party_unique AS customer_id, m.party_desc AS customer_name, m.date_trans AS transaction_date,
  stkcode_code AS product_code, stkcode_desc AS product_name, stkcate_desc AS category, brand_desc AS brand,
  CAST(qnty_total AS DOUBLE) AS quantity, CAST(price_unitrate_local AS DOUBLE) AS unit_price,
  CAST(d.amount_local AS DOUBLE) AS total_amount, m.tag_table_usage AS transaction_type
FROM hdr m JOIN lin d ON m.uniquenum_pri = d.uniquenum_pri AND m.companyfn = d.companyfn
WHERE m.tag_void_yn = 'n' AND d.tag_void_yn = 'n' AND m.tag_table_usage IN ('sal_soe', 'sal_soc', 'sal_inv')""")
def _(spark, sf_dir):
    return plain(build(spark, sf_dir, "customer_analysis", FACT_HEADER_COLUMNS, ["companyfn", *FACT_LINE_COLUMNS]))


@query("declared_product_analysis", with_tables(HDR, LIN) + """
SELECT companyfn, stkcode_code AS product_code, stkcode_desc AS product_name, stkcate_desc AS category,
  brand_desc AS brand, stkvendor_desc AS vendor, date_trans AS transaction_date,
  CAST(SUM(qnty_total) AS DOUBLE) AS quantity_sold, CAST(SUM(amount_local) AS DOUBLE) AS revenue,
  CAST(SUM(price_unitrate_local) AS DOUBLE) / COUNT(*) AS avg_price
FROM lin WHERE tag_void_yn = 'n' GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(build(spark, sf_dir, "product_analysis", None, PRODUCT_COLUMNS))


@query("declared_sales_trend", with_tables(HDR) + """
SELECT companyfn, date_trans AS transaction_date, year(date_trans) AS year, month(date_trans) AS month,
  quarter(date_trans) AS quarter, isodow(date_trans) - 1 AS day_of_week, deptunit_code AS business_unit,
  staff_code AS salesperson, COUNT(*) AS total_transactions, CAST(SUM(amount_local) AS DOUBLE) AS total_revenue,
  CAST(SUM(amount_local) AS DOUBLE) / COUNT(*) AS avg_transaction_value
FROM hdr WHERE tag_void_yn = 'n' AND tag_table_usage IN ('sal_inv', 'sal_soc') GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(specs.with_trend_calendar(build(spark, sf_dir, "sales_trend", TREND_COLUMNS)))


@query("declared_customer_retention", with_tables(HDR) + f"""
SELECT companyfn, party_unique AS customer_id, party_desc AS customer_name, MIN(date_trans) AS first_purchase_date,
  MAX(date_trans) AS last_purchase_date, COUNT(DISTINCT uniquenum_pri) AS total_purchases,
  CAST(SUM(amount_local) AS DOUBLE) AS total_spent, CAST(SUM(amount_local) AS DOUBLE) / COUNT(*) AS avg_purchase_value,
  date_diff('day', MAX(date_trans), TIMESTAMP '{AS_OF}') AS days_since_last_purchase,
  date_diff('day', MIN(date_trans), MAX(date_trans)) AS customer_lifetime_days,
  CAST(COUNT(DISTINCT uniquenum_pri) AS DOUBLE)
    / COUNT(DISTINCT year(date_trans) * 100 + month(date_trans)) AS purchase_frequency
FROM hdr WHERE tag_void_yn = 'n' AND tag_table_usage = 'sal_inv' GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(specs.with_retention_days(build(spark, sf_dir, "customer_retention", RETENTION_COLUMNS), AS_OF))
