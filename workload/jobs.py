"""Jobs, the registry, reports and ordered reads as a user runs them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from salesmart.operators import churn
from salesmart.operators import extraction as ex
from salesmart.plans import jobs
from salesmart.session import shared_folder
from salesmart.sources import readers
from salesmart.sources.colocated import store_colocated
from salesmart.sources.registry import DatasetRegistry
from salesmart.sources.sinks import save_dataset
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.extraction import PRODUCT_SQL, RETENTION_SQL, REVENUE_SQL, TREND_SQL
from workload.learning import CHURN_SQL, churn_data
from workload.summaries import AS_OF, RECENT_LINES, SCORES_SQL, STATS_SQL
from workload.tables import headers, lines

ORDER_HEADERS = ["uniquenum_pri", "companyfn", "date_trans", "tag_table_usage", "tag_void_yn"]
ORDER_LINES = ["uniquenum_pri", "brand_code", "amount_local", "tag_void_yn"]
FROM, TO = "1998-01-01", "1998-03-31"
SPAN = f"date_trans >= TIMESTAMP '{FROM}' AND date_trans <= TIMESTAMP '{TO}'"


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("extracted_datasets", with_tables(
    HDR, LIN, JOINED.replace("FROM hdr m", "FROM spanned m"), RETENTION_SQL,
    PRODUCT_SQL, REVENUE_SQL.replace("FROM hdr", "FROM spanned"), TREND_SQL.replace("FROM hdr", "FROM spanned")).replace(
    "lin AS (", f"spanned AS (SELECT * FROM hdr WHERE {SPAN}),\nlin AS (", 1) + f"""
SELECT 'sales_main' AS dataset, companyfn, COUNT(*) AS n, ROUND(CAST(SUM(amount_local) AS DOUBLE), 2) AS total
FROM spanned WHERE tag_void_yn = 'n' GROUP BY companyfn
UNION ALL SELECT 'sales_data', companyfn, COUNT(*), ROUND(CAST(SUM(amount_local) AS DOUBLE), 2)
FROM lin WHERE tag_void_yn = 'n' AND {SPAN} GROUP BY companyfn
UNION ALL SELECT 'customer_analysis', companyfn, COUNT(*), ROUND(CAST(SUM(line_amount) AS DOUBLE), 2) FROM joined GROUP BY companyfn
UNION ALL SELECT 'product_analysis', companyfn, COUNT(*), ROUND(CAST(SUM(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE), 2)
FROM product_day GROUP BY companyfn
UNION ALL SELECT 'sales_trend', companyfn, COUNT(*), ROUND(CAST(SUM(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE), 2)
FROM trend GROUP BY companyfn
UNION ALL SELECT 'customer_retention', companyfn, COUNT(*), ROUND(CAST(SUM(CAST(total_spent AS DECIMAL(28,4))) AS DOUBLE), 2)
FROM retention GROUP BY companyfn
UNION ALL SELECT 'monthly_revenue', companyfn, COUNT(*), ROUND(CAST(SUM(CAST(amt_local AS DECIMAL(28,4))) AS DOUBLE), 2)
FROM revenue GROUP BY companyfn
UNION ALL SELECT 'revenue_report_by_date', companyfn, COUNT(*), ROUND(CAST(SUM(CAST(amt_local AS DECIMAL(28,4))) AS DOUBLE), 2)
FROM revenue GROUP BY companyfn
UNION ALL SELECT 'monthly_reach', companyfn, COUNT(DISTINCT month(date_trans)), NULL FROM spanned WHERE tag_void_yn = 'n'
GROUP BY companyfn""")
def _(spark, sf_dir):
    """The full job over one quarter: rows and money of every dataset it saves."""
    out = folder(spark)
    names = jobs.extract_all(headers(spark, sf_dir), lines(spark, sf_dir), out, date_from=FROM, date_to=TO)
    money = {"sales_main": "amount_local", "sales_data": "amount_local", "customer_analysis": "line_amount",
             "product_analysis": "revenue", "sales_trend": "total_revenue", "customer_retention": "total_spent",
             "monthly_revenue": "amt_local", "revenue_report_by_date": "amt_local"}
    result = None
    for name in names:
        amount = F.sum(F.col(money[name]).cast("decimal(28,4)")) if name in money else F.lit(None)
        part = readers.load_dataset(spark, f"{out}/{name}.parquet").groupBy("companyfn").agg(
            F.count(F.lit(1)).alias("n"), F.round(amount.cast("double"), 2).alias("total"))
        part = part.select(F.lit(name).alias("dataset"), "companyfn", "n", "total")
        result = part if result is None else result.unionByName(part)
    return result


@query("colocated_order_lines", with_tables(HDR, LIN, JOINED) + """
SELECT companyfn, year(main_date) AS year, brand_code, COUNT(*) AS n, COUNT(DISTINCT uniquenum_pri) AS orders,
  CAST(SUM(line_amount) AS DOUBLE) AS revenue FROM joined GROUP BY ALL""")
def _(spark, sf_dir):
    """Headers and lines in buckets of the order key, joined bucket by bucket."""
    out, name = folder(spark), f"salesmart_{uuid.uuid4().hex}"
    main = store_colocated(headers(spark, sf_dir, ORDER_HEADERS), f"{name}_headers", f"{out}/headers", 8)
    data = store_colocated(lines(spark, sf_dir, ORDER_LINES), f"{name}_lines", f"{out}/lines", 8)
    joined = ex.order_lines(main, data, columns=[
        "main.companyfn", "main.date_trans", "main.uniquenum_pri", "data.brand_code", "data.amount_local"])
    return plain(joined.groupBy(F.col("main_companyfn").alias("companyfn"), F.year("main_date_trans").alias("year"),
                                F.col("data_brand_code").alias("brand_code")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("main_uniquenum_pri").alias("orders"),
        F.sum("data_amount_local").cast("double").alias("revenue")))


@query("trend_job_report", with_tables(HDR, LIN, STATS_SQL, SCORES_SQL) + """
SELECT companyfn, stkcode_unique, stkcode_desc, potential_score, total_quantity, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn ORDER BY potential_score DESC, stkcode_unique) AS rank FROM scores)
WHERE rank <= 10""")
def _(spark, sf_dir):
    """The trend job's report of top products, read back from its JSON."""
    out = folder(spark)
    jobs.trend_report(lines(spark, sf_dir, RECENT_LINES), out, AS_OF)
    return spark.read.schema("companyfn string, stkcode_unique string, stkcode_desc string, potential_score double, "
                             "total_quantity double, rank int").json(f"{out}/top_products")


@query("registry_tenant", with_tables(HDR) + """
SELECT stored AS tenant, COUNT(*) AS n, CAST(SUM(amount_local) AS DOUBLE) AS total, MIN(dnum_auto) AS first_code
FROM (SELECT *, CASE WHEN okey % 2 = 0 THEN '001' ELSE '1' END AS stored FROM hdr) GROUP BY ALL""")
def _(spark, sf_dir):
    """Tenants 001 and 1, each loaded by its own registry from one dataset."""
    every = headers(spark, sf_dir, ["idcode", "dnum_auto", "amount_local"])
    out = folder(spark)
    save_dataset(every.select("dnum_auto", "amount_local", F.when(F.col("idcode") % 2 == 0, "001").otherwise("1").alias(
        "companyfn")), f"{out}/documents.parquet")
    result = None
    for tenant in ("001", "1"):
        part = DatasetRegistry(spark, out, tenant).load("documents").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount_local").cast("double").alias("total"),
            F.min("dnum_auto").alias("first_code")).select(F.lit(tenant).alias("tenant"), "n", "total", "first_code")
        result = part if result is None else result.unionByName(part)
    return result


@query("latest_headers", with_tables(HDR) + """
SELECT uniquenum_pri, companyfn, date_trans, CAST(amount_local AS DOUBLE) AS amount_local FROM hdr
WHERE tag_void_yn = 'n' ORDER BY date_trans DESC, uniquenum_pri LIMIT 500""")
def _(spark, sf_dir):
    """The 500 latest headers in a total order: Spark sorts no more than each task's first 500."""
    ordered = ex.sales_main(headers(spark, sf_dir), ordered=True)
    return plain(readers.read_table(ordered, ["uniquenum_pri", "companyfn", "date_trans", "amount_local"], limit=500))


@query("rule_churn_insights", with_tables(HDR, RETENTION_SQL, CHURN_SQL) + """
SELECT COUNT(*) AS total_customers, CAST(SUM(guess) AS BIGINT) AS churned_customers, AVG(guess) AS churn_rate,
  CAST(SUM(CASE WHEN guess > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_customers
FROM (SELECT CASE WHEN total_purchases <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS guess FROM prepared)""")
def _(spark, sf_dir):
    """The figures that a model's predictions get, of a stated rule in its place."""
    guess = (F.col("total_purchases") <= 1).cast("double")
    judged = churn_data(spark, sf_dir).withColumn("churn_prediction", guess)
    return plain(churn.churn_insights(churn.with_risk(judged)))
