"""Revenue forecast from calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import calendar, cyclical
from salesmart.operators import models
from salesmart.operators.models import Trained

# fixed values
FEATURES = ["year", "month", "quarter", "day_of_week", "day_of_month", "week_of_year", "is_weekend",
            "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos"]
TARGET = "total_revenue"


def daily_revenue(trend: DataFrame) -> DataFrame:
    """Trend rows (per day, unit, salesperson, type) summed to days."""
    return trend.groupBy("companyfn", "transaction_date").agg(
        F.sum(F.col(TARGET).cast("decimal(28,4)")).cast("double").alias(TARGET))


def prepare_forecast(df: DataFrame, date: str = "transaction_date") -> DataFrame:
    """Calendar and cyclical features, gaps filled with 0."""
    parts = {**calendar(date, "year", "month", "quarter", "day_of_week", "day_of_month", "week_of_year",
                        "is_weekend"), **cyclical(date)}
    df = df.withColumns({name: F.coalesce(part, F.lit(0)) for name, part in parts.items()})
    return df.withColumn(TARGET, F.coalesce(F.col(TARGET), F.lit(0.0))) if TARGET in df.columns else df


def train_forecast(prepared: DataFrame, algorithm: str = "random_forest", keys: Sequence[str] = ("companyfn", "transaction_date"),
                   categorical: Sequence[str] = (), **options) -> Trained:
    """Revenue regressor on the calendar features (and, if named, categories such as the tenant)."""
    if TARGET not in prepared.columns:
        raise ValueError(f"Target column '{TARGET}' does not exist")
    features = [*[c for c in FEATURES if c in prepared.columns], *categorical]
    trained = models.train_regressor(prepared, features, TARGET, keys, algorithm, categorical, **options)
    mean = prepared.agg(F.avg(TARGET).alias("value")).select(F.lit("avg_daily_sales").alias("metric"), "value")
    trained.metrics = trained.metrics.unionByName(mean)
    return trained


def future_calendar(history: DataFrame, days: int = 30) -> DataFrame:
    """The next ``days`` dates after each tenant's last one, with features."""
    last = history.groupBy("companyfn").agg(F.max("transaction_date").cast("date").alias("last"))
    dates = last.select("companyfn", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days))).alias("day"))
    return prepare_forecast(dates.select("companyfn", F.col("day").cast("timestamp_ntz").alias("transaction_date")))


def forecast(model: PipelineModel, history: DataFrame, days: int = 30) -> DataFrame:
    """Forecast revenue for the days after the history."""
    return models.predict(model, future_calendar(history, days), "forecasted_revenue").withColumn(
        "forecast_type", F.lit("daily"))


def forecast_insights(history: DataFrame, forecasted: DataFrame) -> DataFrame:
    """Historical and forecast means, total, period and expected growth per tenant."""
    past = history.groupBy("companyfn").agg(F.avg(TARGET).alias("historical_avg_daily_sales"))
    ahead = forecasted.groupBy("companyfn").agg(
        F.avg("forecasted_revenue").alias("forecasted_avg_daily_sales"),
        F.count(F.lit(1)).alias("forecast_period_days"),
        F.sum("forecasted_revenue").alias("total_forecasted_revenue"),
        F.min("transaction_date").alias("forecast_start_date"),
        F.max("transaction_date").alias("forecast_end_date"))
    was, will = F.col("historical_avg_daily_sales"), F.col("forecasted_avg_daily_sales")
    return past.join(ahead, "companyfn").withColumn(
        "expected_growth_rate", F.when(was > 0, (will - was) / was * 100).otherwise(F.lit(0.0)))


def weekly_forecast(forecasted: DataFrame) -> DataFrame:
    """Forecast revenue per ISO week."""
    return forecasted.groupBy("companyfn", F.weekofyear("transaction_date").alias("week")).agg(
        F.sum("forecasted_revenue").alias("forecasted_revenue"))
