"""Models: metrics within bounds, repeatable splits, saved models predict alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.operators import churn, forecast, models, recommend


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(1)
    rows = [("A", f"{i:04d}", int(d), int(n), float(n * 100 + rng.normal(0, 5)), int(rng.integers(0, 400)))
            for i, (d, n) in enumerate((rng.integers(0, 60), rng.integers(6, 20)) if i % 2 else
                                       (rng.integers(100, 300), rng.integers(1, 5)) for i in range(400))]
    return churn.prepare_churn(spark.createDataFrame(
        rows, "companyfn string, customer_id string, days_since_last_purchase int, total_purchases int, "
              "total_spent double, customer_lifetime_days int")).persist()


def figures(trained):
    return {r["metric"]: r["value"] for r in trained.metrics.collect()}


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    train, test = models.split(df, ["id"], "y")
    assert (train.count(), test.count(), test.where("y = 1").count()) == (800, 200, 20)
    again = models.split(df.repartition(5), ["id"], "y")[1]
    assert {r["id"] for r in test.collect()} == {r["id"] for r in again.collect()}


def test_churn_model(spark, customers, tmp_path):
    trained = churn.train_churn(customers, folds=2, num_trees=10)
    assert "days_since_last_purchase" not in trained.features
    got = figures(trained)
    assert got["f1_score"] > 0.95 and got["cv_mean"] > 0.95 and got["churn_rate"] == pytest.approx(0.5)
    assert churn.top_churn_factors(trained, 2).count() == 2
    models.save_model(trained.model, f"{tmp_path}/m")
    first = churn.predict_churn(trained.model, customers)
    second = churn.predict_churn(models.load_model(f"{tmp_path}/m"), customers)
    assert first.exceptAll(second).count() == 0
    row = churn.churn_insights(first).first()
    assert row["total_customers"] == 400 and row["high_risk_customers"] == row["churned_customers"]


def test_churn_search_and_logistic(customers):
    grid = {"numTrees": [3, 5], "maxDepth": [3]}
    searched = figures(churn.train_churn(customers, tune=True, grid=grid, folds=2))
    assert searched["accuracy"] > 0.9 and searched["cv_mean"] > 0.9 and searched["cv_std"] >= 0
    assert figures(churn.train_churn(customers, "logistic_regression", folds=0))["accuracy"] > 0.9
    with pytest.raises(ValueError):
        churn.train_churn(customers, "perceptron")


def test_folds_hold_each_class(spark):
    df = spark.range(40).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    placed = models._dealt(df, ["id"], "y", models.SEED)
    folds = placed.groupBy(F.col(models.INDEX) % 5).agg(F.count("*"), F.sum("y")).collect()
    assert [(r[1], r[2]) for r in folds] == [(8, 2)] * 5
    assert models._fold_scores(df, F.lit(0), None, None, 2) == []


def test_features_are_finite(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (float("inf"), "b"), (None, "a")], "x double, k string")
    _, vectors = models.prepare_features(df, ["x", "k", "absent"], ["k"])
    values = np.array([r["features"].toArray() for r in vectors.collect()])
    assert np.isfinite(values).all() and np.allclose(values.mean(axis=0), 0)
    assert values[0][1] > values[1][1]  # labels are numbered alphabetically


def test_forecast(spark):
    days = spark.range(200).select(
        F.lit("A").alias("companyfn"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("transaction_date"))
    history = days.withColumn("total_revenue", F.when(F.weekday("transaction_date") >= 5, 10.0).otherwise(100.0))
    trained = forecast.train_forecast(forecast.prepare_forecast(history), num_trees=10, folds=0)
    assert figures(trained)["r2"] > 0.8
    ahead = forecast.forecast(trained.model, history, 14)
    assert ahead.count() == 14 and str(ahead.agg(F.min("transaction_date")).first()[0]) == "2024-07-19 00:00:00"
    weekend = ahead.groupBy("is_weekend").agg(F.avg("forecasted_revenue").alias("v")).orderBy("is_weekend").collect()
    assert weekend[0]["v"] > 70 > 40 > weekend[1]["v"]
    row = forecast.forecast_insights(history, ahead).first()
    assert row["forecast_period_days"] == 14
    total = forecast.weekly_forecast(ahead).agg(F.sum("forecasted_revenue")).first()[0]
    assert total == pytest.approx(row["total_forecasted_revenue"])


def test_clusters(spark):
    rows = [("A", f"{c}-{i}", c * 100.0 + i % 3, c * 10.0, c * 1000.0) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "companyfn string, customer_id string, recency double, frequency double, monetary double")
    trained, assigned = recommend.customer_clusters(df, k=3, starts=3)
    groups = assigned.groupBy(F.substring("customer_id", 1, 1)).agg(F.countDistinct("cluster").alias("n")).collect()
    assert {r["n"] for r in groups} == {1} and figures(trained)["n_samples"] == 60
    assert models.cluster_centers(trained, spark).count() == 3


def test_recommendations(spark):
    rows = [("A", f"c{i}", f"p{j}", 5.0) for i in range(20) for j in range(10) if (i < 10) == (j < 5) and (i + j) % 4]
    facts = spark.createDataFrame(rows, "companyfn string, customer_id string, product_code string, quantity double")
    fitted = recommend.train_recommender(facts)
    pairs = spark.createDataFrame([("A", "c0", "p0"), ("A", "c0", "p9"), ("A", "c9", "p1")],
                                  "companyfn string, customer_id string, product_code string")
    score = {(r["customer_id"], r["product_code"]): r["purchase_score"] for r in recommend.purchase_scores(fitted, pairs).collect()}
    assert score["c0", "p0"] > score["c0", "p9"]
    assert recommend.recommendations(recommend.purchase_scores(fitted, pairs), 1).count() == 2


def test_only_new_products_are_recommended(spark):
    rows = [("A", "c1", "p1", "x"), ("A", "c1", "p1", "x"), ("A", "c1", "q1", "y"), ("A", "c2", "p2", "x"),
            ("A", "c3", "p2", "x"), ("A", "c3", "p3", "x"), ("A", None, "p9", "x"), ("B", "c1", "p7", "x")]
    facts = spark.createDataFrame(rows, "companyfn string, customer_id string, product_code string, category_name string") \
        .withColumn("brand_desc", F.lit("b"))
    got = sorted((r.companyfn, r.customer_id, r.product_code, r.popularity) for r in recommend.candidates(facts, 2).collect())
    # two for each who has two left, however many of the first they have bought
    assert got == [("A", "c1", "p2", 1), ("A", "c1", "p3", 3), ("A", "c2", "p1", 2), ("A", "c2", "p3", 3),
                   ("A", "c3", "p1", 2)]
