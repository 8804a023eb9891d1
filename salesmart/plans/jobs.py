"""Batch jobs: build all datasets, analyse trends, train models.

    python -m salesmart.plans.jobs extract --headers H --lines L --out DIR [--companyfn C]
        [--date-from D] [--date-to D]
    python -m salesmart.plans.jobs trend --lines L --out DIR --as-of D [--days 90] [--top 10]
    python -m salesmart.plans.jobs train --datasets DIR --out MODELS [--model churn|forecast|all] [--tune]

Any scheduler can call these; ``salesmart.streaming.refresh`` holds the daily
incremental job.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.operators import churn, cleaning, extraction, forecast, models, reach, trends
from salesmart.schemas import HEADERS, LINES
from salesmart.session import build_session, cut, drop_cuts
from salesmart.sources.readers import load_dataset
from salesmart.sources.sinks import save_dataset, save_report


def dataset_builders(headers: DataFrame, lines: DataFrame, companyfn: str | None = None,
                     date_from: str | None = None, date_to: str | None = None,
                     scope: str = "tenant", exact: bool = True) -> dict[str, Callable[[], DataFrame]]:
    """The datasets of the full job by name, built when called.

    Headers and lines are joined once: the first dataset that needs the join
    writes it, column-pruned, and the other reads that.
    """
    window = {"companyfn": companyfn, "date_from": date_from, "date_to": date_to}
    options = {"scope": scope, "exact": exact}

    @cache
    def joined() -> DataFrame:
        return cut(extraction.order_lines(headers, lines, **window))
    return {
        "sales_main": lambda: cleaning.clean_main(extraction.sales_main(headers, **window), **options),
        "sales_data": lambda: cleaning.clean_lines(extraction.sales_lines(lines, **window)),
        "customer_analysis": lambda: cleaning.customer_segments_by_value(
            extraction.customer_facts(None, None, joined=joined()), **options),
        "product_analysis": lambda: cleaning.product_segments_by_revenue(
            extraction.product_daily(None, None, joined=joined()), **options),
        "sales_trend": lambda: cleaning.trend_calendar(extraction.sales_trend(headers, **window)),
        "customer_retention": lambda: cleaning.retention_segments(
            extraction.customer_retention(headers, companyfn, scope=scope), **options),
        "monthly_revenue": lambda: extraction.monthly_revenue(headers, **window),
        "monthly_reach": lambda: reach.monthly_reach(extraction.sales_main(headers, **window)),
        "revenue_report_by_date": lambda: cleaning.revenue_levels(
            extraction.monthly_revenue(headers, **window), **options),
    }


# datasets with a date are also partitioned by month, so that a refresh can
# replace single months
PARTITIONS = {
    "sales_main": ["companyfn", "year", "month"],
    "sales_data": ["companyfn", "year", "month"],
    "customer_analysis": ["companyfn", "year", "month"],
    "product_analysis": ["companyfn", "year", "month"],
    "sales_trend": ["companyfn", "year", "month"],
    "customer_retention": ["companyfn"],
    "monthly_revenue": ["companyfn", "year", "month"],
    "monthly_reach": ["companyfn", "year", "month"],
    "revenue_report_by_date": ["companyfn"],     # renewed as a whole, a row a month
}
# datasets with a wide row per document or line are written in so many passes where they are large
SLICES = {"sales_data": 4}


def extract_all(headers: DataFrame, lines: DataFrame, out: str, fmt: str = "parquet", **options) -> list[str]:
    """Build and save all datasets; returns their names.

    The labelled revenue report is made from the saved monthly revenue, as a
    refresh does it, so the two never differ.
    """
    builders = dataset_builders(headers, lines, **options)
    for name, build in builders.items():
        df = build()
        if name == "revenue_report_by_date":
            months = load_dataset(headers.sparkSession, f"{out}/monthly_revenue.{fmt}")
            df = cleaning.revenue_levels(months, **{k: v for k, v in options.items() if k in ("scope", "exact")})
        save_dataset(df, f"{out}/{name}.{fmt}", fmt, PARTITIONS[name], whole=True, slices=SLICES.get(name, 1))
    return list(builders)


def trend_report(lines: DataFrame, out: str, as_of: str, companyfn: str | None = None,
                 days: int = 90, top: int = 10) -> None:
    """Save the top products, the market overview and the analysis status as JSON."""
    recent = trends.recent_lines(lines, as_of, days, companyfn)
    statistics = cut(trends.product_statistics(recent, as_of, days))  # three reports read it
    save_report(trends.top_potential(trends.potential_scores(statistics), top), f"{out}/top_products")
    save_report(trends.market_overview(statistics), f"{out}/market")
    save_report(trends.analysis_status(statistics, as_of, days), f"{out}/status")


def train_models(retention: DataFrame, trend: DataFrame, out: str, model: str = "all", tune: bool = False,
                 minimum: dict[str, int] | None = None, **options) -> dict[str, models.Trained]:
    """Train and save the churn and forecast models.

    ``minimum`` holds the rows a model needs; one with no more is left as it is.
    """
    minimum = minimum or {}
    trained = {}
    if model in ("churn", "all"):
        data = cut(churn.prepare_churn(retention))
        if data.count() > minimum.get("churn", 0):
            trained["churn"] = churn.train_churn(data, tune=tune, **options)
    if model in ("forecast", "all"):
        data = cut(forecast.prepare_forecast(forecast.daily_revenue(trend)))
        if data.count() > minimum.get("forecast", 0):
            trained["forecast"] = forecast.train_forecast(data, categorical=["companyfn"], **options)
    for name, fitted in trained.items():
        models.save_model(fitted.model, f"{out}/{name}")
        save_report(fitted.metrics, f"{out}/{name}_metrics")
    return trained


def weekly_rebuild(headers: DataFrame, lines: DataFrame, out: str, model_dir: str, tune: bool = True,
                   **options) -> dict[str, models.Trained]:
    """Rebuild every dataset from the full history and retrain with a search."""
    extract_all(headers, lines, out)
    spark = headers.sparkSession
    return train_models(load_dataset(spark, f"{out}/customer_retention.parquet"),
                        load_dataset(spark, f"{out}/sales_trend.parquet"), model_dir, tune=tune, **options)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return load_dataset(spark, path, "parquet", schema)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="salesmart")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract")
    trend = commands.add_parser("trend")
    train = commands.add_parser("train")
    for command in (extract, trend, train):
        command.add_argument("--out", required=True)
        command.add_argument("--companyfn")
    extract.add_argument("--headers", required=True)
    extract.add_argument("--lines", required=True)
    extract.add_argument("--date-from")
    extract.add_argument("--date-to")
    extract.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    trend.add_argument("--lines", required=True)
    trend.add_argument("--as-of", required=True)
    trend.add_argument("--days", type=int, default=90)
    trend.add_argument("--top", type=int, default=10)
    train.add_argument("--datasets", required=True)
    train.add_argument("--model", default="all", choices=["churn", "forecast", "all"])
    train.add_argument("--tune", action="store_true")
    args = parser.parse_args(argv)

    spark = build_session(f"salesmart {args.command}")
    if args.command == "extract":
        extract_all(_read(spark, args.headers, HEADERS), _read(spark, args.lines, LINES), args.out, args.format,
                    companyfn=args.companyfn, date_from=args.date_from, date_to=args.date_to)
    elif args.command == "trend":
        trend_report(_read(spark, args.lines, LINES), args.out, args.as_of, args.companyfn, args.days, args.top)
    else:
        retention = load_dataset(spark, f"{args.datasets}/customer_retention.parquet")
        history = load_dataset(spark, f"{args.datasets}/sales_trend.parquet")
        if args.companyfn:
            retention = retention.where(F.col("companyfn") == args.companyfn)
            history = history.where(F.col("companyfn") == args.companyfn)
        train_models(retention, history, args.out, args.model, args.tune)
    drop_cuts(spark)


if __name__ == "__main__":
    main()
