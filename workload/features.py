"""Feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesmart.operators import features as ft
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.cleaning import CIRCLE, CIRCLE_SQL, rfm_sql
from workload.extraction import FACTS_SQL, PRODUCT_SQL, facts, product_day
from workload.tables import headers

FACTS = with_tables(HDR, LIN, JOINED, FACTS_SQL)
PRODUCTS = with_tables(HDR, LIN, JOINED, PRODUCT_SQL)
# what each feature table reads
RFM_FACTS = ["companyfn", "customer_id", "uniquenum_pri", "transaction_date", "line_amount"]
CUSTOMER_FEATURE_FACTS = ["companyfn", "customer_id", "transaction_date", "line_amount", "quantity", "product_code",
                          "category_code", "brand_code"]
PAIRS = [("total_spent", "total_quantity"), ("total_purchase_days", "customer_lifetime_days"),
         ("total_spent", "no_such_column")]

CUSTOMER_FEATURES_SQL = """customers AS (
  SELECT companyfn, customer_id, MIN(transaction_date) AS first_purchase_date,
    MAX(transaction_date) AS last_purchase_date, COUNT(DISTINCT transaction_date) AS total_purchase_days,
    CAST(SUM(CAST(line_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_spent,
    CAST(SUM(CAST(line_amount AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS avg_order_value,
    ROUND(STDDEV_SAMP(line_amount), 4) AS std_order_value,
    SUM(quantity) AS total_quantity, SUM(quantity) / COUNT(*) AS avg_quantity_per_order,
    COUNT(DISTINCT product_code) AS unique_products, COUNT(DISTINCT category_code) AS unique_categories,
    COUNT(DISTINCT brand_code) AS unique_brands
  FROM facts GROUP BY companyfn, customer_id),
featured AS (
  SELECT c.*, date_diff('day', first_purchase_date, last_purchase_date) AS customer_lifetime_days,
    date_diff('day', last_purchase_date, latest) AS days_since_last_purchase,
    CAST(total_purchase_days AS DOUBLE) / CASE WHEN first_purchase_date = last_purchase_date THEN 1
      ELSE date_diff('day', first_purchase_date, last_purchase_date) END AS purchase_frequency,
    CASE WHEN date_diff('day', last_purchase_date, latest) <= 0 THEN NULL
      WHEN date_diff('day', last_purchase_date, latest) <= 30 THEN 'Low'
      WHEN date_diff('day', last_purchase_date, latest) <= 60 THEN 'Medium'
      WHEN date_diff('day', last_purchase_date, latest) <= 90 THEN 'High' ELSE 'Very High' END AS churn_risk
  FROM customers c JOIN (SELECT companyfn, MAX(transaction_date) AS latest FROM facts GROUP BY companyfn)
    USING (companyfn))"""


@query("rfm_from_facts", with_tables(HDR, LIN, JOINED, FACTS_SQL, """base AS (
  SELECT companyfn, customer_id, date_diff('day', MAX(transaction_date), MIN(latest)) AS recency,
    COUNT(DISTINCT uniquenum_pri) AS frequency,
    CAST(SUM(CAST(line_amount AS DECIMAL(18,4))) AS DOUBLE) AS monetary
  FROM facts JOIN (SELECT companyfn, MAX(transaction_date) AS latest FROM facts GROUP BY companyfn)
    USING (companyfn)
  GROUP BY companyfn, customer_id)""",
  rfm_sql("base", "recency", "frequency", "monetary", "companyfn, customer_id", "companyfn")) + "SELECT * FROM rfm")
def _(spark, sf_dir):
    return plain(ft.rfm_features(facts(spark, sf_dir, *RFM_FACTS)))


@query("temporal_features", with_tables(HDR) + f"""
SELECT *, {CIRCLE_SQL} FROM (SELECT uniquenum_pri, date_trans AS transaction_date, year(date_trans) AS year,
  month(date_trans) AS month, quarter(date_trans) AS quarter, isodow(date_trans) - 1 AS day_of_week,
  day(date_trans) AS day_of_month, dayofyear(date_trans) AS day_of_year, week(date_trans) AS week_of_year,
  CAST(isodow(date_trans) >= 6 AS INT) AS is_weekend, CAST(day(date_trans) >= 25 AS INT) AS is_late_month,
  CAST(day(date_trans) >= 25 AND month(date_trans) IN (3, 6, 9, 12) AS INT) AS is_late_quarter,
  CAST(day(date_trans) = 1 AS INT) AS is_month_start,
  CAST(CAST(date_trans AS DATE) = last_day(date_trans) AS INT) AS is_month_end,
  CAST(day(date_trans) = 1 AND month(date_trans) IN (1, 4, 7, 10) AS INT) AS is_quarter_start,
  CAST(CAST(date_trans AS DATE) = last_day(date_trans) AND month(date_trans) IN (3, 6, 9, 12) AS INT)
    AS is_quarter_end,
  CAST(day(date_trans) = 1 AND month(date_trans) = 1 AS INT) AS is_year_start,
  CAST(day(date_trans) = 31 AND month(date_trans) = 12 AS INT) AS is_year_end FROM hdr)""")
def _(spark, sf_dir):
    dated = headers(spark, sf_dir, ["uniquenum_pri", "date_trans"]).withColumnRenamed("date_trans", "transaction_date")
    return plain(ft.temporal_features(dated), CIRCLE)


@query("product_features", PRODUCTS + """
SELECT p.*, total_revenue / greatest(days, 1) AS revenue_per_day,
  CAST(total_unique_customers AS DOUBLE) / total_transactions AS customer_reach
FROM (SELECT companyfn, product_code, SUM(quantity_sold) AS total_quantity_sold,
    SUM(quantity_sold) / COUNT(*) AS avg_quantity_per_transaction,
    ROUND(STDDEV_SAMP(quantity_sold), 6) AS std_quantity,
    CAST(SUM(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) AS total_revenue,
    CAST(SUM(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / COUNT(*) AS avg_revenue_per_transaction,
    ROUND(STDDEV_SAMP(revenue), 4) AS std_revenue, 
    CAST(SUM(CAST(avg_price AS DECIMAL(28,10))) AS DOUBLE) / COUNT(avg_price) AS avg_selling_price,
    CAST(SUM(unique_customers) AS BIGINT) AS total_unique_customers,
    CAST(SUM(num_transactions) AS BIGINT) AS total_transactions
  FROM product_day GROUP BY companyfn, product_code) p
JOIN (SELECT companyfn, date_diff('day', MIN(transaction_date), MAX(transaction_date)) AS days
  FROM product_day GROUP BY companyfn) USING (companyfn)""")
def _(spark, sf_dir):
    return plain(ft.product_features(product_day(spark, sf_dir)),
                 {"std_quantity": 6, "std_revenue": 4})


@query("customer_features", with_tables(HDR, LIN, JOINED, FACTS_SQL, CUSTOMER_FEATURES_SQL) + "SELECT * FROM featured")
def _(spark, sf_dir):
    return plain(ft.customer_features(facts(spark, sf_dir, *CUSTOMER_FEATURE_FACTS)), {"std_order_value": 4})


@query("lag_features", PRODUCTS + """
SELECT companyfn, product_code, vendor_code, transaction_date, revenue,
  LAG(revenue, 1) OVER w AS revenue_lag_1, LAG(revenue, 7) OVER w AS revenue_lag_7,
  LAG(revenue, 30) OVER w AS revenue_lag_30
FROM product_day
WINDOW w AS (PARTITION BY companyfn, product_code ORDER BY transaction_date, vendor_code)""")
def _(spark, sf_dir):
    rows = product_day(spark, sf_dir).select("companyfn", "product_code", "vendor_code", "transaction_date", "revenue")
    return plain(ft.lag_features(rows, "revenue", group=["companyfn", "product_code"], ties=["vendor_code"]))


def rolling_sql(over: str) -> str:
    parts = []
    for n in (7, 30, 90):
        frame = f"({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CAST(SUM(CAST(revenue AS DECIMAL(28,4))) OVER {frame} AS DOUBLE) / COUNT(*) OVER {frame} "
                     f"AS revenue_rolling_mean_{n}, ROUND(STDDEV_SAMP(revenue) OVER {frame}, 4) AS revenue_rolling_std_{n}")
    return ", ".join(parts)


@query("rolling_features", PRODUCTS + f"""
SELECT companyfn, product_code, vendor_code, transaction_date, revenue,
  {rolling_sql('PARTITION BY companyfn, product_code ORDER BY transaction_date, vendor_code')}
FROM product_day""")
def _(spark, sf_dir):
    rows = product_day(spark, sf_dir).select("companyfn", "product_code", "vendor_code", "transaction_date",
                                             F.col("revenue").cast("decimal(18,4)").alias("revenue"))
    return plain(ft.rolling_features(rows, "revenue", group=["companyfn", "product_code"], ties=["vendor_code"]),
                 {f"revenue_rolling_std_{n}": 4 for n in (7, 30, 90)})


@query("lag_features_ungrouped", with_tables(HDR) + """
SELECT uniquenum_pri, date_trans AS transaction_date, CAST(amount_local AS DOUBLE) AS amount_local,
  LAG(CAST(amount_local AS DOUBLE), 1) OVER w AS amount_local_lag_1,
  LAG(CAST(amount_local AS DOUBLE), 7) OVER w AS amount_local_lag_7,
  LAG(CAST(amount_local AS DOUBLE), 30) OVER w AS amount_local_lag_30
FROM hdr WINDOW w AS (ORDER BY date_trans, uniquenum_pri)""")
def _(spark, sf_dir):
    rows = headers(spark, sf_dir, ["uniquenum_pri", "date_trans", "amount_local"]).withColumnRenamed(
        "date_trans", "transaction_date")
    # the whole table is one group, so it goes through in blocks
    return plain(ft.lag_features(rows, "amount_local", ties=["uniquenum_pri"], block_rows=2000))


@query("interaction_features", with_tables(HDR, LIN, JOINED, FACTS_SQL, CUSTOMER_FEATURES_SQL) + """
SELECT companyfn, customer_id, total_spent, total_quantity, total_purchase_days, customer_lifetime_days,
  total_spent * total_quantity AS total_spent_x_total_quantity,
  total_spent / NULLIF(total_quantity, 0) AS total_spent_div_total_quantity,
  total_purchase_days * customer_lifetime_days AS total_purchase_days_x_customer_lifetime_days,
  CAST(total_purchase_days AS DOUBLE) / NULLIF(customer_lifetime_days, 0)
    AS total_purchase_days_div_customer_lifetime_days
FROM featured""")
def _(spark, sf_dir):
    base = ft.customer_features(facts(spark, sf_dir, *CUSTOMER_FEATURE_FACTS)).select(
        "companyfn", "customer_id", "total_spent", "total_quantity", "total_purchase_days", "customer_lifetime_days")
    return plain(ft.interaction_features(base, PAIRS))


@query("favorite_category", FACTS + """
SELECT companyfn, customer_id, MAX(CASE WHEN kind = 'category' THEN name END) AS favorite_category,
  MAX(CASE WHEN kind = 'brand' THEN name END) AS favorite_brand
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn, customer_id, kind ORDER BY n DESC, name) AS rn
  FROM (SELECT companyfn, customer_id, 'category' AS kind, category_name AS name, COUNT(*) AS n
        FROM facts GROUP BY ALL
        UNION ALL SELECT companyfn, customer_id, 'brand', brand_desc, COUNT(*) FROM facts GROUP BY ALL))
WHERE rn = 1 GROUP BY companyfn, customer_id""")
def _(spark, sf_dir):
    return plain(ft.favorites(facts(spark, sf_dir, "companyfn", "customer_id", "category_name", "brand_desc")))


@query("seasonality_index", PRODUCTS + """
SELECT companyfn, product_code, month, month_mean_revenue, month_mean_revenue / overall AS seasonality_index
FROM (SELECT companyfn, product_code, month,
    CAST(SUM(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / COUNT(*) AS month_mean_revenue
  FROM product_day GROUP BY ALL)
JOIN (SELECT companyfn, product_code,
    CAST(SUM(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / COUNT(*) AS overall
  FROM product_day GROUP BY ALL) USING (companyfn, product_code)""")
def _(spark, sf_dir):
    return plain(ft.seasonality_index(product_day(spark, sf_dir)))
