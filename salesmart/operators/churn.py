"""Which customers are about to leave."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.cleaning import over_nonzero
from salesmart.functions.scoring import churned
from salesmart.operators import models
from salesmart.operators.models import Trained

# fixed values: candidate features; those present are used
CANDIDATES = ["recency", "frequency", "monetary", "avg_order_value", "days_since_last_purchase",
              "total_purchases", "total_spent", "unique_products", "unique_categories"]
GIVES_AWAY_TARGET = {"recency", "days_since_last_purchase"}
KEYS = ["companyfn", "customer_id"]


def prepare_churn(customers: DataFrame, threshold: int = 90) -> DataFrame:
    """Target, filled features, order value and purchase frequency."""
    has = set(customers.columns)
    df = customers
    if "days_since_last_purchase" in has:
        df = df.withColumn("is_churned", F.coalesce(churned(F.col("days_since_last_purchase"), threshold), F.lit(0)))
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in CANDIDATES if c in has})
    if {"total_spent", "total_purchases"} <= has:
        df = df.withColumn("avg_order_value", over_nonzero(F.col("total_spent"), F.col("total_purchases")))
    if {"total_purchases", "customer_lifetime_days"} <= has:
        df = df.withColumn("purchase_frequency",
                           over_nonzero(F.col("total_purchases"), F.col("customer_lifetime_days")))
    return df


def train_churn(customers: DataFrame, algorithm: str = "random_forest", tune: bool = False,
                with_recency: bool = False, **options) -> Trained:
    """Churn classifier.  Recency defines the target and is left out unless asked for."""
    if "is_churned" not in customers.columns:
        raise ValueError("Target column 'is_churned' does not exist")
    features = [c for c in CANDIDATES if c in customers.columns
                and (with_recency or c not in GIVES_AWAY_TARGET)]
    trained = models.train_classifier(customers, features, "is_churned", KEYS, algorithm, tune=tune, **options)
    rate = customers.agg(F.avg("is_churned").alias("value")).select(F.lit("churn_rate").alias("metric"), "value")
    trained.metrics = trained.metrics.unionByName(rate)
    return trained


def predict_churn(model: PipelineModel, customers: DataFrame) -> DataFrame:
    """Customers with a predicted class and a Low/High risk."""
    return with_risk(models.predict(model, customers, "churn_prediction"))


def with_risk(scored: DataFrame) -> DataFrame:
    """The Low/High risk that a predicted class stands for."""
    return scored.withColumn("churn_risk", F.when(F.col("churn_prediction") > 0.5, "High").otherwise("Low"))


def churn_insights(predicted: DataFrame) -> DataFrame:
    """Customers, predicted churn and its rate, customers at high risk."""
    return predicted.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum("churn_prediction").cast("long"), F.lit(0)).alias("churned_customers"),
        F.coalesce(F.avg("churn_prediction"), F.lit(0.0)).alias("churn_rate"),
        F.coalesce(F.sum((F.col("churn_risk") == "High").cast("int")), F.lit(0)).alias("high_risk_customers"))


def top_churn_factors(trained: Trained, n: int = 5) -> DataFrame:
    """The features that weigh most."""
    return trained.importances.orderBy(F.desc("importance"), "feature").limit(n)
