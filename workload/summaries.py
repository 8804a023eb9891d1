"""Summary datasets and product potential."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesmart.operators import extraction as ex
from salesmart.operators import summaries as su
from salesmart.operators import trends as tr
from workload.catalog import HDR, LIN, plain, query, with_tables
from workload.extraction import REVENUE_SQL, revenue
from workload.tables import headers, lines

AS_OF = "2001-08-01"

SUMMARY_LINES = ["uniquenum_pri", "companyfn", "party_code", "stkcode_code", "qnty_total", "amount_local",
                 "date_trans", "tag_void_yn"]
RECENT_LINES = ["uniquenum_uniq", "companyfn", "party_unique", "stkcode_unique", "stkcode_code", "stkcode_desc",
                "brand_desc", "stkcate_desc", "row_item_num", "qnty_total", "price_unitlist_local", "date_trans",
                "tag_void_yn"]

VALID = "valid AS (SELECT * FROM lin WHERE tag_void_yn = 'n')"
LINES_SQL = with_tables(HDR, LIN, VALID)

TREND_SUMMARY_SQL = """slots AS (
  SELECT d.companyfn, month(d.date_trans) AS month, quarter(d.date_trans) AS quarter,
    isodow(m.date_trans) - 1 AS day_of_week, CAST(SUM(d.amount_local) AS DOUBLE) AS total_revenue,
    CAST(SUM(d.amount_local) AS DOUBLE) / COUNT(*) AS avg_transaction_value, COUNT(*) AS total_transactions,
    CAST(SUM(d.qnty_total) AS DOUBLE) AS total_quantity
  FROM valid d LEFT JOIN hdr m ON d.uniquenum_pri = m.uniquenum_pri AND d.companyfn = m.companyfn
  GROUP BY ALL),
trend_summary AS (
  SELECT *, total_revenue / LAG(total_revenue) OVER (PARTITION BY companyfn ORDER BY month, quarter, day_of_week) - 1
    AS revenue_growth FROM slots)"""

# statistics of the products sold in the 90 days up to AS_OF (needs HDR, LIN)
STATS_SQL = f"""recent AS (
  SELECT *, CAST(date_trans AS DATE) AS day FROM lin
  WHERE tag_void_yn = 'n' AND date_trans >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
    AND date_trans <= TIMESTAMP '{AS_OF}'),
daily AS (
  SELECT companyfn, stkcode_unique, day, CAST(SUM(qnty_total) AS DOUBLE) AS qty,
    ROW_NUMBER() OVER (PARTITION BY companyfn, stkcode_unique ORDER BY day) AS rn,
    COUNT(*) OVER (PARTITION BY companyfn, stkcode_unique) AS sale_days
  FROM recent GROUP BY companyfn, stkcode_unique, day),
halves AS (
  SELECT companyfn, stkcode_unique, MIN(sale_days) AS sale_days,
    COALESCE(SUM(qty) FILTER (rn <= sale_days // 2), 0) AS first_half,
    COALESCE(SUM(qty) FILTER (rn > sale_days // 2), 0) AS second_half,
    COALESCE(SUM(qty) FILTER (day >= DATE '{AS_OF}' - 29), 0) AS recent_qty,
    SUM(qty) AS total_qty, SUM(qty) / COUNT(*) AS mean_qty, STDDEV_POP(qty) AS std_qty
  FROM daily GROUP BY companyfn, stkcode_unique),
figures AS (
  SELECT companyfn, stkcode_unique, CAST(SUM(qnty_total) AS DOUBLE) AS total_quantity,
    CAST(SUM(qnty_total * price_unitlist_local) AS DOUBLE) AS total_revenue, COUNT(*) AS transactions_count,
    MIN(date_trans) AS first_sale_date, MAX(date_trans) AS last_sale_date,
    CAST(SUM(price_unitlist_local) AS DOUBLE) / COUNT(price_unitlist_local) AS avg_price,
    COUNT(DISTINCT party_unique) AS unique_customer_count
  FROM recent GROUP BY companyfn, stkcode_unique),
names AS (
  SELECT companyfn, stkcode_unique, stkcode_code, stkcode_desc, brand_desc, stkcate_desc
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn, stkcode_unique
      ORDER BY date_trans, row_item_num DESC, uniquenum_uniq) AS pos FROM recent) WHERE pos = 1),
stats AS (
  SELECT f.*, sale_days, stkcode_code, stkcode_desc, brand_desc, stkcate_desc,
    CASE WHEN first_half > 0 THEN (second_half - first_half) / first_half
      WHEN second_half > 0 THEN 1.0 ELSE 0.0 END AS growth_rate,
    CASE WHEN total_qty - recent_qty > 0 THEN (recent_qty / 30) / ((total_qty - recent_qty) / 60)
      WHEN recent_qty > 0 THEN 2.0 ELSE 0.0 END AS momentum,
    CASE WHEN sale_days > 1 THEN 1 / (1 + CASE WHEN mean_qty > 0 THEN std_qty / mean_qty ELSE 1 END)
      ELSE 0.5 END AS consistency
  FROM figures f JOIN halves USING (companyfn, stkcode_unique) JOIN names USING (companyfn, stkcode_unique))"""

SCORES_SQL = """shares AS (
  SELECT s.*, least(CASE WHEN max_growth > 0 THEN growth_rate / max_growth ELSE 0 END, 1) AS g,
    least(CASE WHEN max_momentum > 0 THEN momentum / max_momentum ELSE 0 END, 1) AS m,
    least(CASE WHEN max_revenue > 0 THEN total_revenue / max_revenue ELSE 0 END, 1) AS v,
    least(CAST(unique_customer_count AS DOUBLE) / 50, 1) AS c
  FROM stats s JOIN (SELECT companyfn, MAX(growth_rate) AS max_growth, MAX(momentum) AS max_momentum,
    MAX(total_revenue) AS max_revenue FROM stats GROUP BY companyfn) USING (companyfn)),
scores AS (
  SELECT * EXCLUDE (g, m, v, c, consistency), ROUND(consistency, 9) AS consistency,
    ROUND((g * 0.35 + m * 0.25 + consistency * 0.20 + v * 0.15 + c * 0.05) * 100, 2) AS potential_score,
    ROUND(g * 100, 1) AS factor_recent_growth, ROUND(m * 100, 1) AS factor_momentum,
    ROUND(consistency * 100, 1) AS factor_consistency, ROUND(v * 100, 1) AS factor_volume,
    ROUND(c * 100, 1) AS factor_customer_base
  FROM shares)"""


def valid_lines(spark, sf_dir):
    return ex.sales_lines(lines(spark, sf_dir, SUMMARY_LINES))


def trend_slots(spark, sf_dir):
    return su.trend_summary(headers(spark, sf_dir, ["uniquenum_pri", "companyfn", "date_trans"]),
                            valid_lines(spark, sf_dir))


def statistics(spark, sf_dir):
    return tr.product_statistics(tr.recent_lines(lines(spark, sf_dir, RECENT_LINES), AS_OF), AS_OF)


def flat(scores):
    """The factor struct as plain columns."""
    return plain(scores.select(
        *[c for c in scores.columns if c != "factor_breakdown"],
        *[F.col(f"factor_breakdown.{f}").alias(f"factor_{f}") for f in
          ("recent_growth", "momentum", "consistency", "volume", "customer_base")]), {"consistency": 9})


@query("customer_summary", LINES_SQL + """
SELECT companyfn, party_code AS customer_id, CAST(SUM(amount_local) AS DOUBLE) AS total_revenue,
  CAST(SUM(amount_local) AS DOUBLE) / COUNT(*) AS avg_order_value, COUNT(*) AS total_purchases,
  COUNT(DISTINCT stkcode_code) AS unique_products, MIN(date_trans) AS first_purchase_date,
  MAX(date_trans) AS last_purchase_date, 'Customer_' || party_code AS customer_name
FROM valid GROUP BY companyfn, party_code""")
def _(spark, sf_dir):
    return plain(su.customer_summary(valid_lines(spark, sf_dir)))


@query("product_summary", LINES_SQL + """
SELECT companyfn, stkcode_code AS product_code, CAST(SUM(amount_local) AS DOUBLE) AS total_revenue,
  CAST(SUM(amount_local) AS DOUBLE) / COUNT(*) AS avg_price, COUNT(*) AS total_transactions,
  CAST(SUM(qnty_total) AS DOUBLE) AS total_quantity, COUNT(DISTINCT party_code) AS unique_customers,
  MIN(date_trans) AS first_sale_date, MAX(date_trans) AS last_sale_date,
  'Product_' || stkcode_code AS product_name
FROM valid GROUP BY companyfn, stkcode_code""")
def _(spark, sf_dir):
    return plain(su.product_summary(valid_lines(spark, sf_dir)))


@query("trend_summary_growth", with_tables(HDR, LIN, VALID, TREND_SUMMARY_SQL) + "SELECT * FROM trend_summary")
def _(spark, sf_dir):
    return plain(trend_slots(spark, sf_dir))


@query("retention_summary", LINES_SQL + f"""
SELECT *, CASE WHEN days_since_last_purchase > 90 THEN 1 ELSE 0 END AS is_churned
FROM (SELECT companyfn, party_code AS customer_id, MIN(date_trans) AS first_purchase_date,
    MAX(date_trans) AS last_purchase_date, COUNT(*) AS total_purchases,
    CAST(SUM(amount_local) AS DOUBLE) AS total_spent,
    date_diff('day', MAX(date_trans), TIMESTAMP '{AS_OF}') AS days_since_last_purchase
  FROM valid GROUP BY companyfn, party_code)""")
def _(spark, sf_dir):
    return plain(su.retention_summary(valid_lines(spark, sf_dir), AS_OF))


@query("revenue_report", with_tables(HDR, REVENUE_SQL) + """
SELECT companyfn, month AS report_month, year AS report_year, amt_local AS total_revenue,
  num_transactions AS transaction_count FROM revenue""")
def _(spark, sf_dir):
    return plain(su.revenue_report(revenue(spark, sf_dir)))


@query("product_potential", with_tables(HDR, LIN, STATS_SQL, SCORES_SQL) + "SELECT * FROM scores")
def _(spark, sf_dir):
    return flat(tr.potential_scores(statistics(spark, sf_dir)))


@query("product_potential_top", with_tables(HDR, LIN, STATS_SQL, SCORES_SQL) + """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn
  ORDER BY potential_score DESC, stkcode_unique) AS rank FROM scores) WHERE rank <= 10""")
def _(spark, sf_dir):
    return flat(tr.analyze_product_trends(lines(spark, sf_dir, RECENT_LINES), AS_OF))


@query("market_overview", with_tables(HDR, LIN, STATS_SQL) + """
SELECT companyfn, ROUND(AVG(growth_rate) * 100, 2) AS average_product_growth,
  COUNT(*) FILTER (growth_rate > 0) AS growing_products_count,
  COUNT(*) FILTER (growth_rate < 0) AS declining_products_count, COUNT(*) AS total_products,
  ROUND(CAST(COUNT(*) FILTER (growth_rate > 0) AS DOUBLE) / COUNT(*) * 100, 1) AS market_momentum
FROM stats GROUP BY companyfn""")
def _(spark, sf_dir):
    return plain(tr.market_overview(statistics(spark, sf_dir)))


@query("analysis_status", with_tables(HDR, LIN, STATS_SQL) + f"""
SELECT CASE WHEN COUNT(*) > 0 THEN 'success' ELSE 'no_data' END AS status,
  strftime(DATE '{AS_OF}' - 90, '%Y-%m-%d') AS period_from, '{AS_OF}' AS period_to, 90 AS days_analyzed,
  COUNT(*) AS total_products_analyzed FROM stats""")
def _(spark, sf_dir):
    return plain(tr.analysis_status(statistics(spark, sf_dir), AS_OF))
