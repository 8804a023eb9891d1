"""Cleaned sources and labelled datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from salesmart.functions.distinct import ERROR, distinct_count
from salesmart.operators import cleaning as cl
from salesmart.operators import reach
from salesmart.plans import jobs
from salesmart.session import cut, shared_folder
from salesmart.sources.readers import load_dataset
from salesmart.sources.sinks import save_dataset
from salesmart.streaming import refresh
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.extraction import (
    FACTS_SQL, PRODUCT_SQL, RETENTION_SQL, REVENUE_SQL, TREND_SQL, facts, product_day, retention, revenue, trend,
)
from workload.tables import dirty_headers, dirty_lines, headers, lines

CIRCLE = {"month_sin": 12, "month_cos": 12, "day_of_week_sin": 12, "day_of_week_cos": 12}
CIRCLE_SQL = """ROUND(SIN(2 * PI() * month / 12), 12) AS month_sin,
  ROUND(COS(2 * PI() * month / 12), 12) AS month_cos,
  ROUND(SIN(2 * PI() * day_of_week / 7), 12) AS day_of_week_sin,
  ROUND(COS(2 * PI() * day_of_week / 7), 12) AS day_of_week_cos"""


def edges_sql(source: str, value: str, k: int, keys: str = "companyfn") -> str:
    fractions = ", ".join(str(i / k) for i in range(1, k))
    group = f"GROUP BY {keys}" if keys else ""
    return f"edges AS (SELECT {keys + ',' if keys else ''} quantile_cont({value}, [{fractions}]) AS e FROM {source} {group})"


def bucket_sql(value: str, k: int) -> str:
    return "1 + " + " + ".join(f"CASE WHEN {value} > e[{i}] THEN 1 ELSE 0 END" for i in range(1, k))


def rfm_sql(source: str, recency: str, frequency: str, monetary: str, ties: str, keys: str) -> str:
    """RFM scores of ``source``: value quintiles for recency, rank quintiles for the rest."""
    over = f"PARTITION BY {keys} " if keys else ""
    joined = f"JOIN edges USING ({keys})" if keys else "CROSS JOIN edges"
    rank = "greatest(1, CAST(ceil((CAST({r} AS DECIMAL(18,0)) - 1) * 5 / (n - 1)) AS INTEGER))"
    return f"""{edges_sql(source, recency, 5, keys)},
ranked AS (
  SELECT s.*, 6 - ({bucket_sql(recency, 5)}) AS recency_score,
    ROW_NUMBER() OVER ({over}ORDER BY {frequency}, {ties}) AS fr,
    ROW_NUMBER() OVER ({over}ORDER BY {monetary}, {ties}) AS mr,
    CAST(COUNT(*) OVER ({over}) AS DOUBLE) AS n
  FROM {source} s {joined}),
scored AS (
  SELECT * EXCLUDE (fr, mr, n), {rank.format(r='fr')} AS frequency_score,
    {rank.format(r='mr')} AS monetary_score FROM ranked),
rfm AS (
  SELECT *, (recency_score + frequency_score + monetary_score) / 3.0::DOUBLE AS rfm_score,
    CASE WHEN recency_score + frequency_score + monetary_score <= 6 THEN 'At Risk'
      WHEN recency_score + frequency_score + monetary_score <= 9 THEN 'Needs Attention'
      WHEN recency_score + frequency_score + monetary_score <= 12 THEN 'Potential Loyalist'
      ELSE 'Champion' END AS customer_segment
  FROM scored)"""


RFM_TIES = "total_spent DESC, companyfn, customer_id"
RFM_SQL = rfm_sql("retention", "days_since_last_purchase", "total_purchases", "total_spent", RFM_TIES, "companyfn")
RFM_ALL_SQL = rfm_sql("retention", "days_since_last_purchase", "total_purchases", "total_spent", RFM_TIES, "")


@query("clean_main", with_tables(HDR, """dirty AS (
  SELECT * REPLACE (
    CASE WHEN okey % 7 = 0 THEN 'Unknown' ELSE party_desc END AS party_desc,
    CASE WHEN okey % 11 = 0 THEN 'N/A' ELSE deptunit_desc END AS deptunit_desc,
    CASE WHEN okey % 13 = 0 THEN 'N/A' ELSE staff_code END AS staff_code,
    CASE WHEN okey % 17 = 0 THEN 0.0 WHEN tag_table_usage = 'sal_cn'
      THEN -CAST(amount_local AS DOUBLE) ELSE CAST(amount_local AS DOUBLE) END AS amount_local,
    CASE WHEN okey % 19 = 0 THEN NULL ELSE date_trans END AS date_trans) FROM hdr)""",
  "edge AS (SELECT companyfn, quantile_cont(amount_local, 0.99) AS q99 FROM dirty GROUP BY companyfn)") + """
SELECT okey AS idcode, uniquenum_pri, d.companyfn, dnum_auto, tag_table_usage, party_unique, party_code,
  party_desc, date_trans, date_due, amount_local, CAST(amount_forex AS DOUBLE) AS amount_forex,
  CAST(NULL AS VARCHAR) AS curr_short_forex, rate AS curr_rate_forex_f_calc, deptunit_code, deptunit_desc,
  staff_code, CAST(NULL AS VARCHAR) AS staff_unique, location_code,
  CAST(NULL AS VARCHAR) AS creditterm_desc, CAST(NULL AS VARCHAR) AS delivtype_desc,
  CAST(NULL AS VARCHAR) AS sendby_desc, '' AS notes_memo, tag_void_yn, salestaxpct, tag_deleted_yn,
  tag_closed02_yn, CAST(NULL AS VARCHAR) AS entprojfn_code,
  CASE tag_table_usage WHEN 'sal_soe' THEN 'Sales Order Entry' WHEN 'sal_soc' THEN 'Sales Order Confirmation'
    WHEN 'sal_inv' THEN 'Sales Invoice' WHEN 'sal_quo' THEN 'Sales Quotation'
    WHEN 'sal_cn' THEN 'Sales Credit Note' ELSE 'Unknown' END AS transaction_type_name,
  year(date_trans) AS year, month(date_trans) AS month, quarter(date_trans) AS quarter,
  isodow(date_trans) - 1 AS day_of_week, day(date_trans) AS day_of_month, week(date_trans) AS week_of_year,
  CASE WHEN isodow(date_trans) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN day(date_trans) >= 25 THEN 1 ELSE 0 END AS is_late_month,
  ROUND(LN(1 + ABS(amount_local)), 9) AS amount_local_log,
  CASE WHEN ABS(amount_local) > q99 THEN 1 ELSE 0 END AS is_outlier
FROM dirty d JOIN edge ON d.companyfn = edge.companyfn""")
def _(spark, sf_dir):
    return plain(cl.clean_main(dirty_headers(spark, sf_dir)), {"amount_local_log": 9})


@query("clean_lines", with_tables(HDR, LIN, """dirty AS (
  SELECT *, CAST(qnty_total AS DOUBLE) * CAST(price_unitrate_local AS DOUBLE) AS line_total FROM lin)""") + """
SELECT idcode, uniquenum_uniq, companyfn, uniquenum_pri, stkcode_code, stkcode_desc,
  CASE WHEN pkey % 23 = 0 THEN '0' ELSE stkcode_unique END AS stkcode_unique,
  CASE WHEN pkey % 10 = 0 THEN 'No Brand' ELSE brand_desc END AS brand_desc,
  CASE WHEN pkey % 15 = 0 THEN 'No Category' ELSE stkcate_desc END AS stkcate_desc,
  stkvendor_desc, '' AS notes_memo, date_trans, CAST(qnty_total AS DOUBLE) AS qnty_total,
  CAST(price_unitrate_local AS DOUBLE) AS price_unitrate_local, CAST(0 AS DOUBLE) AS price_unitlist_forex,
  CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(amount_local AS DOUBLE) AS amount_local,
  line_total, line_total * CAST(discount_pct AS DOUBLE) / 100 AS discount_amount,
  line_total - line_total * CAST(discount_pct AS DOUBLE) / 100 AS net_amount,
  row_item_num, brand_code, stkcate_code, stkvendor_code, tag_void_yn, tag_closedmain_yn,
  CAST(CASE WHEN pkey % 9 = 0 THEN 0 ELSE amount_tax_local END AS DOUBLE) AS amount_tax_local,
  CAST(CASE WHEN pkey % 8 = 0 THEN 0 ELSE price_unitlist_local END AS DOUBLE) AS price_unitlist_local,
  CAST(qnty_total AS DOUBLE) AS qnty_uomstk, CAST(qnty_total AS DOUBLE) AS bal_qnty_total,
  CAST(qnty_total AS DOUBLE) AS bal_qnty_uomstk, CAST(0 AS DOUBLE) AS price_unitrate_forex,
  CAST(0 AS DOUBLE) AS amount_forex, CAST(0 AS DOUBLE) AS amount_tax_forex,
  year(date_trans) AS year, month(date_trans) AS month, quarter(date_trans) AS quarter,
  stkcode_code || '_' || CASE WHEN pkey % 23 = 0 THEN '0' ELSE stkcode_unique END AS product_id
FROM dirty""")
def _(spark, sf_dir):
    return plain(cl.clean_lines(dirty_lines(spark, sf_dir)).select(
        "idcode", "uniquenum_uniq", "companyfn", "uniquenum_pri", "stkcode_code", "stkcode_desc", "stkcode_unique",
        "brand_desc", "stkcate_desc", "stkvendor_desc", "notes_memo", "date_trans", "qnty_total",
        "price_unitrate_local", "price_unitlist_forex", "discount_pct", "amount_local", "row_item_num", "brand_code",
        "stkcate_code", "stkvendor_code", "tag_void_yn", "tag_closedmain_yn", "amount_tax_local",
        "price_unitlist_local", "qnty_uomstk", "bal_qnty_total", "bal_qnty_uomstk", "price_unitrate_forex",
        "amount_forex", "amount_tax_forex", "line_total", "discount_amount", "net_amount", "year", "month", "quarter", "product_id"))


@query("revenue_levels", with_tables(HDR, REVENUE_SQL, edges_sql("revenue", "amt_local", 3)) + f"""
SELECT revenue.*, ['Low', 'Medium', 'High'][{bucket_sql('amt_local', 3)}] AS revenue_level
FROM revenue JOIN edges USING (companyfn)""")
def _(spark, sf_dir):
    return plain(cl.revenue_levels(revenue(spark, sf_dir)))


@query("refreshed_revenue_report", with_tables(HDR, REVENUE_SQL, edges_sql("revenue", "amt_local", 3)) + f"""
SELECT revenue.*, ['Low', 'Medium', 'High'][{bucket_sql('amt_local', 3)}] AS revenue_level
FROM revenue JOIN edges USING (companyfn)""")
def _(spark, sf_dir):
    """A full build on the older documents, then a refresh with the rest."""
    every = headers(spark, sf_dir)
    some_lines = lines(spark, sf_dir)
    out = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name in ("monthly_revenue", "sales_trend", "sales_data"):
        build = jobs.dataset_builders(every.where("date_trans < '2001-01-01'"), some_lines)[name]
        save_dataset(build(), f"{out}/{name}.parquet", "parquet", jobs.PARTITIONS[name], whole=True,
                     slices=jobs.SLICES.get(name, 1))
    refresh.refresh(every, some_lines, every.where("date_trans >= '2001-01-01'"), out,
                    names=("monthly_revenue", "sales_trend", "sales_data"))
    report = load_dataset(spark, f"{out}/revenue_report_by_date.parquet")
    return plain(report.select(*cl.revenue_levels(revenue(spark, sf_dir)).columns))


@query("streamed_revenue_report", with_tables(HDR, REVENUE_SQL.replace(
    "AND tag_void_yn = 'n'", "AND tag_void_yn = 'n' AND NOT (okey % 7 = 3 AND date_trans >= '2001-01-01')"), edges_sql("revenue", "amt_local", 3)) + f"""
SELECT revenue.*, ['Low', 'Medium', 'High'][{bucket_sql('amt_local', 3)}] AS revenue_level
FROM revenue JOIN edges USING (companyfn)""")
def _(spark, sf_dir):
    """All documents arrive, then a second day corrects a third and deletes a seventh of those from 2001 on.

    What is corrected later has at first twice the amount and lies two months earlier.
    Both days are published; the report is read as published.
    """
    every = headers(spark, sf_dir).withColumn("version", F.lit(2)).withColumn("gone", F.lit(False))
    late = F.col("date_trans") >= F.lit("2001-01-01").cast("timestamp_ntz")
    corrected, deleted = late & (F.col("idcode") % 3 == 0), late & (F.col("idcode") % 7 == 3)
    first = every.withColumns({
        "version": F.lit(1), "amount_local": F.when(corrected, F.col("amount_local") * 2).otherwise(
            F.col("amount_local")).cast(every.schema["amount_local"].dataType),
        "date_trans": F.when(corrected, F.col("date_trans") - F.expr("INTERVAL 2 MONTHS")).otherwise(F.col("date_trans"))})
    second = every.where(corrected | deleted).withColumn("gone", deleted)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    every_line = lines(spark, sf_dir)
    for day in (first, second):
        day.write.mode("append").parquet(f"{folder}/inbox")
        arriving = spark.readStream.schema(every.schema).parquet(f"{folder}/inbox")
        refresh.refresh_stream(arriving, f"{folder}/log", every_line, f"{folder}/out", f"{folder}/checkpoint",
                               version="version", deleted="gone", published=True,
                               names=["monthly_revenue"]).awaitTermination()
    report = refresh.read_dataset(spark, f"{folder}/out", "revenue_report_by_date")
    return plain(report.select(*cl.revenue_levels(revenue(spark, sf_dir)).columns))


@query("monthly_reach_by_year", with_tables(HDR) + """
SELECT companyfn, year(date_trans) AS year, COUNT(DISTINCT party_unique) AS customers,
  COUNT(DISTINCT uniquenum_pri) AS orders, 1 AS near, 1 AS merged_is_whole
FROM hdr WHERE tag_void_yn = 'n' GROUP BY ALL""")
def _(spark, sf_dir):
    """Exact numbers a year; whether the merged sketches of its months, and one of the whole year, come near them."""
    valid = headers(spark, sf_dir, ["companyfn", "date_trans", "party_unique", "uniquenum_pri", "staff_code", "tag_void_yn"])
    months = cut(reach.monthly_reach(valid))
    merged = reach.reach(months)
    year = valid.where("tag_void_yn = 'n'").groupBy("companyfn", F.year("date_trans").alias("year"))
    exact = year.agg(F.countDistinct("party_unique").alias("exact_customers"),
                     F.countDistinct("uniquenum_pri").alias("exact_orders"))
    whole = year.agg(distinct_count("party_unique", True).alias("whole_customers"),
                     distinct_count("uniquenum_pri", True).alias("whole_orders"))

    def close(a, b):
        return F.abs(F.col(a) - F.col(b)) <= F.lit(ERROR) * F.col(b)
    near = close("customers", "exact_customers") & close("orders", "exact_orders")
    same = close("customers", "whole_customers") & close("orders", "whole_orders")
    keys = ["companyfn", "year"]
    return plain(merged.join(exact, keys).join(whole, keys).select(
        *keys, F.col("exact_customers").alias("customers"), F.col("exact_orders").alias("orders"),
        near.cast("int").alias("near"), same.cast("int").alias("merged_is_whole")))


@query("saved_and_loaded", with_tables(HDR) + """
SELECT fmt, companyfn, stored, COUNT(*) AS n, MIN(dnum_auto) AS first_code
FROM (SELECT *, CASE WHEN okey % 2 = 0 THEN '001' ELSE '1' END AS stored FROM hdr)
CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS fmt) GROUP BY ALL""")
def _(spark, sf_dir):
    """Saved in each format by a tenant code that looks like a number, loaded again."""
    every = headers(spark, sf_dir, ["idcode", "companyfn", "dnum_auto"])
    coded = every.select(F.col("companyfn").alias("region"), "dnum_auto",
                         F.when(F.col("idcode") % 2 == 0, "001").otherwise("1").alias("companyfn"))
    out, result = f"{shared_folder(spark)}/{uuid.uuid4().hex}", None
    for fmt in ("parquet", "csv", "json"):
        save_dataset(coded, f"{out}/coded.{fmt}", fmt)
        part = load_dataset(spark, f"{out}/coded.{fmt}").withColumn("fmt", F.lit(fmt))
        result = part if result is None else result.unionByName(part)
    return result.groupBy("fmt", F.col("region").alias("companyfn"), F.col("companyfn").alias("stored")).agg(
        F.count("*").alias("n"), F.min("dnum_auto").alias("first_code"))


@query("customer_value_segment", with_tables(HDR, LIN, JOINED, FACTS_SQL, edges_sql("facts", "ABS(line_amount)", 5)) + f"""
SELECT facts.*, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
  ['Very Low', 'Low', 'Medium', 'High', 'Very High'][{bucket_sql('ABS(line_amount)', 5)}] AS transaction_value_segment
FROM facts JOIN edges USING (companyfn)""")
def _(spark, sf_dir):
    return plain(cl.customer_segments_by_value(facts(spark, sf_dir)))


@query("product_revenue_segment", with_tables(HDR, LIN, JOINED, PRODUCT_SQL, edges_sql("product_day", "ABS(revenue)", 5)) + f"""
SELECT product_day.*, revenue / CASE WHEN quantity_sold = 0 THEN 1 ELSE quantity_sold END AS revenue_per_unit,
  ['Very Low', 'Low', 'Medium', 'High', 'Very High'][{bucket_sql('ABS(revenue)', 5)}] AS revenue_segment
FROM product_day JOIN edges USING (companyfn)""")
def _(spark, sf_dir):
    return plain(cl.product_segments_by_revenue(product_day(spark, sf_dir)))


@query("rfm_segments", with_tables(HDR, RETENTION_SQL, RFM_SQL) + "SELECT * FROM rfm")
def _(spark, sf_dir):
    return plain(cl.retention_segments(retention(spark, sf_dir)))


@query("rfm_segments_pooled", with_tables(
    HDR, RETENTION_SQL.replace("OVER (PARTITION BY companyfn)", "OVER ()"), RFM_ALL_SQL) + "SELECT * FROM rfm")
def _(spark, sf_dir):
    return plain(cl.retention_segments(retention(spark, sf_dir, scope="all"), scope="all"))


@query("trend_calendar", with_tables(HDR, TREND_SQL) + f"""
SELECT *, CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend, {CIRCLE_SQL} FROM trend""")
def _(spark, sf_dir):
    return plain(cl.trend_calendar(trend(spark, sf_dir)), CIRCLE)
