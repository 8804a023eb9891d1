"""Churn, forecast, clusters and recommendations."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from salesmart.operators import churn, features, forecast, models, recommend
from salesmart.session import cut
from workload.catalog import HDR, JOINED, LIN, plain, query, with_tables
from workload.cleaning import CIRCLE, CIRCLE_SQL
from workload.features import RFM_FACTS
from workload.extraction import FACTS_SQL, RETENTION_SQL, TREND_SQL, facts, retention, trend

CHURN_SQL = """prepared AS (
  SELECT companyfn, customer_id, days_since_last_purchase, total_purchases, total_spent, customer_lifetime_days,
    CASE WHEN days_since_last_purchase > 90 THEN 1 ELSE 0 END AS is_churned,
    total_spent / CASE WHEN total_purchases = 0 THEN 1 ELSE total_purchases END AS avg_order_value,
    CAST(total_purchases AS DOUBLE) / CASE WHEN customer_lifetime_days = 0 THEN 1 ELSE customer_lifetime_days END
      AS purchase_frequency
  FROM retention)"""
DAILY_SQL = """daily AS (SELECT companyfn, transaction_date,
  CAST(SUM(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) AS total_revenue FROM trend GROUP BY ALL)"""
CALENDAR_SQL = """year(transaction_date) AS year, month(transaction_date) AS month,
  quarter(transaction_date) AS quarter, isodow(transaction_date) - 1 AS day_of_week,
  day(transaction_date) AS day_of_month, week(transaction_date) AS week_of_year,
  CASE WHEN isodow(transaction_date) >= 6 THEN 1 ELSE 0 END AS is_weekend"""
CHURN_COLUMNS = ["companyfn", "customer_id", "days_since_last_purchase", "total_purchases", "total_spent",
                 "customer_lifetime_days", "is_churned", "avg_order_value", "purchase_frequency"]


def churn_data(spark, sf_dir):
    return churn.prepare_churn(retention(spark, sf_dir)).select(*CHURN_COLUMNS)


def history(spark, sf_dir):
    return forecast.daily_revenue(trend(spark, sf_dir))


@lru_cache(maxsize=2)
def churn_forest(spark, sf_dir):
    """Trained once in a session, with five folds; predictions, factors and figures are all of this model."""
    return churn.train_churn(churn_data(spark, sf_dir))


@lru_cache(maxsize=2)
def written_history(spark, sf_dir):
    """Written once in a session: training, the calendar ahead and the means are all of these days."""
    return cut(history(spark, sf_dir))


@lru_cache(maxsize=2)
def forecast_forest(spark, sf_dir):
    """Trained once in a session, the tenant a feature; the folds are left to ``forecast_metrics``."""
    return forecast.train_forecast(forecast.prepare_forecast(written_history(spark, sf_dir)), categorical=["companyfn"],
                                   folds=0)


@query("churn_data", with_tables(HDR, RETENTION_SQL, CHURN_SQL) + "SELECT * FROM prepared")
def _(spark, sf_dir):
    return plain(churn_data(spark, sf_dir))


@query("standardised_features", with_tables(HDR, RETENTION_SQL, CHURN_SQL) + """
SELECT companyfn, customer_id,
  ROUND((total_spent - AVG(total_spent) OVER ()) / STDDEV_SAMP(total_spent) OVER (), 8) AS total_spent_z,
  ROUND((total_purchases - AVG(total_purchases) OVER ()) / STDDEV_SAMP(total_purchases) OVER (), 8)
    AS total_purchases_z,
  ROUND((seg - AVG(seg) OVER ()) / STDDEV_SAMP(seg) OVER (), 8) AS tenant_z
FROM (SELECT *, DENSE_RANK() OVER (ORDER BY companyfn) - 1 AS seg FROM prepared)""")
def _(spark, sf_dir):
    _, vectors = models.prepare_features(
        churn_data(spark, sf_dir), ["total_spent", "total_purchases", "companyfn"], ["companyfn"])
    z = vector_to_array("features")
    names = ["total_spent_z", "total_purchases_z", "tenant_z"]
    return plain(vectors.select("companyfn", "customer_id", *[z[i].alias(n) for i, n in enumerate(names)]),
                 {n: 8 for n in names})


@query("churn_predictions")
def _(spark, sf_dir):
    data = churn_data(spark, sf_dir)
    return plain(churn.predict_churn(churn_forest(spark, sf_dir).model, data))


@query("churn_split", with_tables(HDR, RETENTION_SQL, CHURN_SQL) + """
SELECT companyfn, customer_id, is_churned, CASE WHEN place < CEIL(size * 0.2::DOUBLE) THEN 1 ELSE 0 END AS is_test
FROM (SELECT *, COUNT(*) OVER (PARTITION BY is_churned) AS size, ROW_NUMBER() OVER (PARTITION BY is_churned
    ORDER BY md5(concat_ws('|', 42, companyfn, customer_id)), companyfn, customer_id) - 1 AS place
  FROM prepared)""")
def _(spark, sf_dir):
    parts = models.split(churn_data(spark, sf_dir), churn.KEYS, "is_churned")
    train, test = (part.select(*churn.KEYS, "is_churned", F.lit(n).alias("is_test")) for n, part in enumerate(parts))
    return train.unionByName(test)


@query("rule_churn_metrics", with_tables(HDR, RETENTION_SQL, CHURN_SQL, """judged AS (
  SELECT is_churned AS label, CASE WHEN total_purchases <= 1 THEN 1 ELSE 0 END AS guess FROM prepared),
classes AS (
  SELECT c.label, COUNT(*) FILTER (WHERE j.label = c.label) AS n, COUNT(*) FILTER (WHERE j.guess = c.label) AS said,
    COUNT(*) FILTER (WHERE j.label = c.label AND j.guess = c.label) AS hit
  FROM judged j CROSS JOIN (SELECT DISTINCT label FROM judged) c GROUP BY ALL),
shares AS (SELECT n / SUM(n) OVER () AS w, COALESCE(hit / NULLIF(said, 0), 0) AS p, hit / n AS r FROM classes)""") + """
SELECT 'accuracy' AS metric, ROUND(SUM(w * r), 8) AS value FROM shares
UNION ALL SELECT 'precision', ROUND(SUM(w * p), 8) FROM shares
UNION ALL SELECT 'recall', ROUND(SUM(w * r), 8) FROM shares
UNION ALL SELECT 'f1_score', ROUND(SUM(w * COALESCE(2 * p * r / NULLIF(p + r, 0), 0)), 8) FROM shares""")
def _(spark, sf_dir):
    guess = (F.col("total_purchases") <= 1).cast("double")
    return plain(models.class_metrics(churn_data(spark, sf_dir).select(
        F.col("is_churned").alias(models.LABEL), guess.alias("prediction"))), {"value": 8})


@query("churn_metrics")
def _(spark, sf_dir):
    return churn.train_churn(churn_data(spark, sf_dir), algorithm="logistic_regression").metrics


@query("churn_forest_metrics")
def _(spark, sf_dir):
    return churn_forest(spark, sf_dir).metrics


@query("churn_search")
def _(spark, sf_dir):
    return churn.train_churn(churn_data(spark, sf_dir), tune=True, folds=2,
                             grid={"numTrees": [20], "maxDepth": [5, 10]}).metrics


@query("churn_factors")
def _(spark, sf_dir):
    return churn.top_churn_factors(churn_forest(spark, sf_dir))


@query("churn_insights")
def _(spark, sf_dir):
    data = churn_data(spark, sf_dir)
    return plain(churn.churn_insights(churn.predict_churn(churn_forest(spark, sf_dir).model, data)))


@query("forecast_data", with_tables(HDR, TREND_SQL, DAILY_SQL) + f"""
SELECT *, {CIRCLE_SQL} FROM (SELECT *, {CALENDAR_SQL} FROM daily)""")
def _(spark, sf_dir):
    return plain(forecast.prepare_forecast(history(spark, sf_dir)), CIRCLE)


@query("forecast_calendar", with_tables(HDR, TREND_SQL, DAILY_SQL) + f"""
SELECT *, {CIRCLE_SQL} FROM (SELECT *, {CALENDAR_SQL} FROM (
  SELECT companyfn, last + to_days(CAST(i AS INTEGER)) AS transaction_date
  FROM (SELECT companyfn, MAX(transaction_date) AS last FROM daily GROUP BY companyfn), range(1, 31) AS r(i)))""")
def _(spark, sf_dir):
    return plain(forecast.future_calendar(history(spark, sf_dir)), CIRCLE)


def forecasted(spark, sf_dir):
    past = written_history(spark, sf_dir)
    return past, forecast.forecast(forecast_forest(spark, sf_dir).model, past)


@query("sales_forecast")
def _(spark, sf_dir):
    return plain(forecasted(spark, sf_dir)[1])


@query("forecast_insights")
def _(spark, sf_dir):
    return plain(forecast.forecast_insights(*forecasted(spark, sf_dir)))


@query("weekly_forecast")
def _(spark, sf_dir):
    return plain(forecast.weekly_forecast(forecasted(spark, sf_dir)[1]))


#: a rule in place of a model: the tenant's mean day, a hundredth more for each day of the month
RULE_SQL = """means AS (SELECT companyfn, AVG(total_revenue) AS mean, MAX(transaction_date) AS last FROM daily GROUP BY ALL),
ahead AS (SELECT companyfn, mean, transaction_date, mean * (1 + 0.01::DOUBLE * day(transaction_date)) AS revenue
  FROM (SELECT companyfn, mean, last + to_days(CAST(i AS INTEGER)) AS transaction_date FROM means, range(1, 31) AS r(i)))"""


def rule(past, days):
    means = past.groupBy("companyfn").agg(F.avg("total_revenue").alias("mean"))
    return days.join(means, "companyfn").withColumn(
        "forecasted_revenue", F.col("mean") * (1 + F.lit(0.01) * F.dayofmonth("transaction_date")))


@query("rule_forecast_insights", with_tables(HDR, TREND_SQL, DAILY_SQL, RULE_SQL) + """
SELECT companyfn, ROUND(MAX(mean), 4) AS historical_avg_daily_sales, ROUND(AVG(revenue), 4) AS forecasted_avg_daily_sales,
  COUNT(*) AS forecast_period_days, ROUND(SUM(revenue), 4) AS total_forecasted_revenue,
  MIN(transaction_date) AS forecast_start_date, MAX(transaction_date) AS forecast_end_date,
  ROUND((AVG(revenue) - MAX(mean)) / MAX(mean) * 100, 8) AS expected_growth_rate
FROM ahead GROUP BY companyfn""")
def _(spark, sf_dir):
    past = history(spark, sf_dir)
    money = ["historical_avg_daily_sales", "forecasted_avg_daily_sales", "total_forecasted_revenue"]
    return plain(forecast.forecast_insights(past, rule(past, forecast.future_calendar(past))),
                 {**{c: 4 for c in money}, "expected_growth_rate": 8})


@query("rule_weekly_forecast", with_tables(HDR, TREND_SQL, DAILY_SQL, RULE_SQL) + """
SELECT companyfn, week(transaction_date) AS week, ROUND(SUM(revenue), 4) AS forecasted_revenue FROM ahead GROUP BY ALL""")
def _(spark, sf_dir):
    past = history(spark, sf_dir)
    return plain(forecast.weekly_forecast(rule(past, forecast.future_calendar(past))), {"forecasted_revenue": 4})


@query("rule_forecast_metrics", with_tables(HDR, TREND_SQL, DAILY_SQL, RULE_SQL, """judged AS (
  SELECT total_revenue AS label, mean * (1 + 0.01::DOUBLE * day(transaction_date)) AS guess
  FROM daily JOIN means USING (companyfn))""") + """
SELECT 'mse' AS metric, ROUND(AVG((label - guess) ** 2) / 1e6, 4) AS value FROM judged
UNION ALL SELECT 'rmse', ROUND(SQRT(AVG((label - guess) ** 2)) / 1e6, 8) FROM judged
UNION ALL SELECT 'mae', ROUND(AVG(ABS(label - guess)) / 1e6, 8) FROM judged
UNION ALL SELECT 'r2', ROUND(1 - SUM((label - guess) ** 2) / (VAR_SAMP(label) * (COUNT(*) - 1)), 8) FROM judged""")
def _(spark, sf_dir):
    """Errors of the rule, in millions."""
    past = history(spark, sf_dir)
    found = models.number_metrics(rule(past, past).select(
        F.col("total_revenue").alias(models.LABEL), F.col("forecasted_revenue").alias("prediction")))
    scaled = F.when(F.col("metric") == "r2", F.col("value")).otherwise(F.col("value") / 1e6)
    return found.select("metric", F.when(F.col("metric") == "mse", F.round(scaled, 4)).otherwise(
        F.round(scaled, 8)).alias("value"))


@query("forecast_metrics")
def _(spark, sf_dir):
    prepared = forecast.prepare_forecast(history(spark, sf_dir))
    return forecast.train_forecast(prepared, "linear_regression", categorical=["companyfn"]).metrics


@query("forecast_forest_metrics")
def _(spark, sf_dir):
    return forecast_forest(spark, sf_dir).metrics


@query("customer_clusters")
def _(spark, sf_dir):
    return plain(recommend.customer_clusters(features.rfm_features(facts(spark, sf_dir, *RFM_FACTS)))[1])


CANDIDATE_FACTS = ["companyfn", "customer_id", "product_code", "category_name", "brand_desc"]


def candidates_sql(per_category):
    """The most bought products of the favourite category that a customer has not bought."""
    return f"""liked AS (
  SELECT companyfn, customer_id, category_name FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn, customer_id ORDER BY n DESC, category_name) AS rn
    FROM (SELECT companyfn, customer_id, category_name, COUNT(*) AS n FROM facts GROUP BY ALL)) WHERE rn = 1),
popular AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn, category_name ORDER BY buyers DESC, product_code) AS popularity
  FROM (SELECT companyfn, category_name, product_code, COUNT(DISTINCT customer_id) AS buyers FROM facts GROUP BY ALL)),
candidates AS (
  SELECT companyfn, customer_id, product_code, category_name, buyers, popularity FROM (
    SELECT l.companyfn, l.customer_id, p.product_code, l.category_name, p.buyers, p.popularity,
      ROW_NUMBER() OVER (PARTITION BY l.companyfn, l.customer_id ORDER BY p.popularity) AS place
    FROM liked l JOIN popular p ON l.companyfn = p.companyfn AND l.category_name = p.category_name
    WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.companyfn = l.companyfn AND f.customer_id = l.customer_id
      AND f.product_code = p.product_code)) WHERE place <= {per_category})"""


CANDIDATES_SQL = candidates_sql(20)


@query("recommendation_candidates", with_tables(HDR, LIN, JOINED, FACTS_SQL, CANDIDATES_SQL) + "SELECT * FROM candidates")
def _(spark, sf_dir):
    return plain(recommend.candidates(facts(spark, sf_dir, *CANDIDATE_FACTS)))


@query("popular_recommendations", with_tables(HDR, LIN, JOINED, FACTS_SQL, CANDIDATES_SQL) + """
SELECT companyfn, customer_id, product_code, CAST(buyers AS DOUBLE) AS purchase_score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY companyfn, customer_id ORDER BY buyers DESC, product_code) AS rank
  FROM candidates) WHERE rank <= 5""")
def _(spark, sf_dir):
    scores = recommend.candidates(facts(spark, sf_dir, *CANDIDATE_FACTS)).select(
        "companyfn", "customer_id", "product_code", F.col("buyers").cast("double").alias("purchase_score"))
    return plain(recommend.recommendations(scores))


@query("first_unbought_candidates", with_tables(HDR, LIN, JOINED, FACTS_SQL, candidates_sql(2)) + "SELECT * FROM candidates")
def _(spark, sf_dir):
    """Two for each customer, who may have bought the first two of the category."""
    return plain(recommend.candidates(facts(spark, sf_dir, *CANDIDATE_FACTS), 2))


@query("product_recommendations")
def _(spark, sf_dir):
    """The best scored of all products that a customer has not bought yet."""
    bought = facts(spark, sf_dir, *CANDIDATE_FACTS, "quantity")
    fitted = recommend.train_recommender(bought)
    return recommend.best_unbought(*recommend.learned_factors(fitted), bought)


@query("best_unbought_products", with_tables(HDR, LIN, JOINED, FACTS_SQL) + """,
mine AS (SELECT companyfn, customer_id, COUNT(DISTINCT product_code)::DOUBLE AS a, MAX(quantity)::DOUBLE AS b,
    MIN(quantity)::DOUBLE - 20 AS c FROM facts GROUP BY ALL),
theirs AS (SELECT companyfn, product_code, COUNT(DISTINCT customer_id)::DOUBLE AS x, MAX(quantity)::DOUBLE - 40 AS y,
    MIN(quantity)::DOUBLE AS z FROM facts GROUP BY ALL),
bought AS (SELECT DISTINCT companyfn, customer_id, product_code FROM facts)
SELECT companyfn, customer_id, product_code, purchase_score, rank FROM (
  SELECT m.companyfn, m.customer_id, t.product_code, a * x + b * y + c * z AS purchase_score, ROW_NUMBER() OVER (
    PARTITION BY m.companyfn, m.customer_id ORDER BY a * x + b * y + c * z DESC, t.product_code) AS rank
  FROM mine m JOIN theirs t ON m.companyfn = t.companyfn
  WHERE NOT EXISTS (SELECT 1 FROM bought k WHERE k.companyfn = m.companyfn AND k.customer_id = m.customer_id
    AND k.product_code = t.product_code)) WHERE rank <= 5""")
def _(spark, sf_dir):
    """Exact best products by given factors: counts and quantities, so that scores are whole numbers."""
    known = facts(spark, sf_dir, *CANDIDATE_FACTS, "quantity").select(
        "companyfn", "customer_id", "product_code", F.col("quantity").cast("double").alias("quantity"))
    pairs = cut(known.groupBy("companyfn", "customer_id", "product_code").agg(
        F.max("quantity").alias("most"), F.min("quantity").alias("least")))
    customers = pairs.groupBy("companyfn", "customer_id").agg(F.array(
        F.count(F.lit(1)).cast("double"), F.max("most"), F.min("least") - 20).alias("factors"))
    products = pairs.groupBy("companyfn", "product_code").agg(F.array(
        F.count(F.lit(1)).cast("double"), F.max("most") - 40, F.min("least")).alias("factors"))
    return recommend.best_unbought(customers, products, pairs)
