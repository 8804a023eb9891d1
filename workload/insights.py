"""Business questions."""

from __future__ import annotations

from salesmart.operators import cleaning as cl
from salesmart.operators import features as ft
from salesmart.operators import insights as ins
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.cleaning import RFM_SQL
from workload.extraction import (
    FACTS_SQL, PRODUCT_SQL, RETENTION_SQL, REVENUE_SQL, TREND_SQL, facts, product_day, retention, revenue, trend,
)
from workload.features import CUSTOMER_FEATURE_FACTS, CUSTOMER_FEATURES_SQL
from workload.summaries import AS_OF, TREND_SUMMARY_SQL, VALID, trend_slots
from workload.tables import headers

FACTS = with_tables(HDR, LIN, JOINED, FACTS_SQL)
PRODUCTS = with_tables(HDR, LIN, JOINED, PRODUCT_SQL)
TREND = with_tables(HDR, TREND_SQL)
PROBE_COLUMNS = ["companyfn", "party_unique", "tag_void_yn", "tag_table_usage", "date_trans"]


def total(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(28,4))) AS DOUBLE)"


def top_sql(source: str, name: str, value: str, where: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn ORDER BY revenue DESC, {name}) AS rank
  FROM (SELECT companyfn, {name}, {total(value)} AS revenue FROM {source} WHERE {where} GROUP BY companyfn, {name}))
WHERE rank <= 10"""


@query("top_customers", FACTS + top_sql("facts", "customer_name", "line_amount"))
def _(spark, sf_dir):
    return plain(ins.top_customers(facts(spark, sf_dir, "companyfn", "customer_name", "line_amount")))


@query("top_customers_month", FACTS + top_sql("facts", "customer_name", "line_amount", "month = 2 AND year = 1998"))
def _(spark, sf_dir):
    return plain(ins.top_customers(
        facts(spark, sf_dir, "companyfn", "customer_name", "line_amount", "transaction_date"), month=2, year=1998))


@query("repeat_rate", FACTS + """
SELECT companyfn, COUNT(*) FILTER (days > 1) AS repeat_customers, COUNT(*) AS customers,
  CAST(COUNT(*) FILTER (days > 1) AS DOUBLE) / COUNT(*) * 100 AS repeat_rate
FROM (SELECT companyfn, customer_id, COUNT(DISTINCT transaction_date) AS days FROM facts GROUP BY ALL)
GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.repeat_rate(facts(spark, sf_dir, "companyfn", "customer_id", "transaction_date")))


@query("segment_distribution", with_tables(HDR, RETENTION_SQL, RFM_SQL) + """
SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY companyfn ORDER BY customers DESC, customer_segment) = 1
  THEN 1 ELSE 0 END AS is_largest
FROM (SELECT companyfn, customer_segment, COUNT(*) AS customers FROM rfm GROUP BY ALL)""")
def _(spark, sf_dir):
    return plain(ins.segment_distribution(cl.retention_segments(retention(spark, sf_dir))))


@query("customer_overview", FACTS + f"""
SELECT companyfn, COUNT(DISTINCT customer_id) AS total_customers, {total('line_amount')} AS total_revenue,
  {total('line_amount')} / COUNT(DISTINCT customer_id) AS avg_customer_value
FROM facts GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.customer_overview(facts(spark, sf_dir, "companyfn", "customer_id", "line_amount")))


@query("top_products", PRODUCTS + top_sql("product_day", "product_name", "revenue"))
def _(spark, sf_dir):
    return plain(ins.top_products(product_day(spark, sf_dir)))


@query("category_sales", PRODUCTS + f"SELECT companyfn, category_name, {total('revenue')} AS revenue FROM product_day GROUP BY ALL")
def _(spark, sf_dir):
    return plain(ins.sales_by(product_day(spark, sf_dir), "category_name"))


@query("brand_sales", PRODUCTS + f"SELECT companyfn, brand_desc, {total('revenue')} AS revenue FROM product_day GROUP BY ALL")
def _(spark, sf_dir):
    return plain(ins.sales_by(product_day(spark, sf_dir), "brand_desc"))


@query("product_overview", PRODUCTS + f"""
SELECT companyfn, COUNT(DISTINCT product_code) AS total_products, {total('revenue')} AS total_revenue,
  {total('quantity_sold')} AS total_quantity FROM product_day GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.product_overview(product_day(spark, sf_dir)))


@query("monthly_sales", TREND + f"""
SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY companyfn ORDER BY total_revenue DESC, month) = 1
  THEN 1 ELSE 0 END AS is_best
FROM (SELECT companyfn, month, {total('total_revenue')} AS total_revenue FROM trend GROUP BY ALL)""")
def _(spark, sf_dir):
    return plain(ins.monthly_sales(trend(spark, sf_dir)))


@query("quarterly_sales", TREND + f"SELECT companyfn, quarter, {total('total_revenue')} AS total_revenue FROM trend GROUP BY ALL")
def _(spark, sf_dir):
    return plain(ins.sales_by(trend(spark, sf_dir), "quarter", "total_revenue"))


@query("weekday_sales", TREND + f"SELECT companyfn, day_of_week, {total('total_revenue')} AS total_revenue FROM trend GROUP BY ALL")
def _(spark, sf_dir):
    return plain(ins.sales_by(trend(spark, sf_dir), "day_of_week", "total_revenue"))


@query("trend_overview", with_tables(HDR, LIN, VALID, TREND_SQL, TREND_SUMMARY_SQL) + f"""
SELECT companyfn, {total('total_revenue')} AS total_revenue, {total('total_revenue')} / COUNT(*) AS avg_row_revenue,
  {total('total_revenue')} / COUNT(DISTINCT transaction_date) AS avg_daily_revenue,
  ROUND(MIN(g.growth), 6) AS avg_growth_rate
FROM trend JOIN (SELECT companyfn, AVG(revenue_growth) * 100 AS growth FROM trend_summary GROUP BY companyfn) g
  USING (companyfn) GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.trend_overview(trend(spark, sf_dir), trend_slots(spark, sf_dir)), {"avg_growth_rate": 6})


@query("churn_rate", with_tables(HDR, RETENTION_SQL) + """
SELECT companyfn, CAST(SUM(is_churned) AS BIGINT) AS churned_customers, COUNT(*) AS customers,
  CAST(SUM(is_churned) AS DOUBLE) / COUNT(*) * 100 AS churn_rate FROM retention GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.churn_rate(retention(spark, sf_dir)))


@query("high_risk_customers", with_tables(HDR, LIN, JOINED, FACTS_SQL, CUSTOMER_FEATURES_SQL) + """
SELECT companyfn, COUNT(*) FILTER (churn_risk = 'High') AS at_risk_customers FROM featured GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(ins.high_risk_customers(ft.customer_features(facts(spark, sf_dir, *CUSTOMER_FEATURE_FACTS))))


@query("naive_forecast", TREND + f"""
SELECT companyfn, mean AS avg_daily_sales, mean * 30 AS forecast_30_days, mean * 90 AS forecast_90_days
FROM (SELECT companyfn, {total('total_revenue')} / COUNT(DISTINCT transaction_date) AS mean
  FROM trend GROUP BY companyfn)""")
def _(spark, sf_dir):
    return plain(ins.naive_forecast(trend(spark, sf_dir)))


@query("followup_periods", with_tables(HDR, REVENUE_SQL) + """
SELECT companyfn, year AS report_year, month AS report_month,
  month(d + INTERVAL 1 MONTH) AS next_month, year(d + INTERVAL 1 MONTH) AS next_month_year,
  month(d - INTERVAL 1 MONTH) AS previous_month, year(d - INTERVAL 1 MONTH) AS previous_month_year,
  year(d - INTERVAL 1 YEAR) AS previous_year
FROM (SELECT *, make_date(year, month, 1) AS d FROM revenue)""")
def _(spark, sf_dir):
    return plain(ins.adjacent_periods(ins.month_report(revenue(spark, sf_dir))))


@query("data_probes", with_tables(HDR) + f"""
SELECT MIN(date_trans) FILTER (ok) AS first_invoice, MAX(date_trans) FILTER (ok) AS last_invoice,
  date_diff('day', MAX(date_trans) FILTER (ok), TIMESTAMP '{AS_OF}') AS days_since_last_invoice,
  COUNT(*) AS row_count
FROM (SELECT *, tag_void_yn = 'n' AND tag_table_usage = 'sal_inv' AS ok FROM hdr)""")
def _(spark, sf_dir):
    return plain(ins.data_probes(headers(spark, sf_dir, PROBE_COLUMNS), AS_OF))


@query("churn_distribution", with_tables(HDR) + f"""
SELECT companyfn, CASE WHEN date_diff('day', last, TIMESTAMP '{AS_OF}') > 90 THEN 1 ELSE 0 END AS is_churned,
  COUNT(*) AS customers
FROM (SELECT companyfn, party_unique, MAX(date_trans) AS last FROM hdr
  WHERE tag_void_yn = 'n' AND tag_table_usage = 'sal_inv' GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf_dir):
    return plain(ins.churn_distribution(headers(spark, sf_dir, PROBE_COLUMNS), AS_OF))
