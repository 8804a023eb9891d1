"""Routing and answering a table of prompts.

Everything is a column expression over the prompt text, so tagging a table of
prompts is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.operators.insights import month_report, year_report
from salesmart.plans.lookups import attach

# fixed values: keywords and patterns that decide where a prompt goes
PRODUCT_TREND_WORDS = [
    "triển vọng", "xu hướng", "tương lai", "sắp tới", "tiềm năng", "top 10", "trend", "potential",
    "forecast", "potential products", "top products", "top 10 products",
]
CUSTOMER_WORDS = [
    "customer", "purchase", "repurchase", "churn", "retention", "active customers", "average order",
    "repeat customer", "order value",
]
PRODUCT_WORDS = [
    "product", "item", "goods", "bestseller", "potential products", "top products", "best selling",
]
TREND_WORDS = [
    "trend", "over time", "monthly", "yearly", "growth", "sales trends", "monthly sales",
]
FORECAST_WORDS = [
    "forecast", "predict", "future", "projection", "plan", "next 30 days", "sales forecast",
]
REVENUE_WORDS = [
    "revenue report", "revenue by date", "revenue date", "revenue by month", "show me revenue",
    "revenue for",
]
DATA_WORDS = [
    "customer", "product", "sales", "trend", "forecast", "churn", "analysis", "top", "bestseller",
    "revenue", "order", "month", "year", "date", "daily", "monthly", "yearly", "period", "january",
    "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december", "triển vọng", "xu hướng", "phổ biến", "nổi bật", "tương lai",
    "sắp tới", "hot trend", "tiềm năng",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NUMERIC_PERIOD = r"(\d{1,2})[./-](\d{4})"
NAMED_PERIOD = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s*(\d{4})")
MONTH_THEN_YEAR = r"(?s)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec).*\d{4}"
LAST_YEAR = r"(?s).*\b(20\d{2})\b"
DATED = (
    r"\d{1,2}[/.-]\d{4}|(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s*\d{4}|year\s*\d{4}|\d{4}\s+year|revenue\s+\d{4}")
FOUR_DIGIT_WORD = r"(^|\s)\d{4}(\s|$)"


def _has(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def tag_prompts(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Add ``route``, ``targets`` and the view each target would show.

    ``route`` is ``product_trend_analysis`` when a trend word short-cuts the
    prompt, else ``insights``; ``targets`` lists the matching datasets whatever
    the route, or only ``general``.
    """
    low = F.lower(F.col(text))
    # each keyword list is matched once, into a flag of its own
    matches = {
        "revenue_report_by_date": low.rlike(DATED) | _has(low, REVENUE_WORDS) | low.rlike(FOUR_DIGIT_WORD),
        "customer_analysis": _has(low, CUSTOMER_WORDS),
        "product_analysis": _has(low, PRODUCT_WORDS),
        "sales_trend": _has(low, TREND_WORDS),
        "sales_forecast": _has(low, FORECAST_WORDS),
    }
    flagged = prompts.withColumns({f"_{name}": match for name, match in matches.items()})
    found = F.array_compact(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in matches]))
    nothing = ~reduce(Column.__or__, [F.col(f"_{name}") for name in matches])

    def view(target: str, cases: list[tuple[str, list[str]]]) -> Column:
        chosen = F.lit("overview")
        for name, words in reversed(cases):
            chosen = F.when(_has(low, words), F.lit(name)).otherwise(chosen)
        return F.when(F.col(f"_{target}"), chosen)

    return flagged.withColumns({
        "route": F.when(_has(low, PRODUCT_TREND_WORDS), F.lit("product_trend_analysis")).otherwise(F.lit("insights")),
        "targets": F.when(nothing, F.array(F.lit("general"))).otherwise(found),
        "customer_view": view("customer_analysis", [
            ("top", ["top", "most", "best"]), ("repeat", ["repeat", "return"]), ("segment", ["segment"])]),
        "product_view": view("product_analysis", [
            ("top", ["bestseller", "top"]), ("category", ["category"]), ("brand", ["brand"])]),
        "trend_view": view("sales_trend", [
            ("monthly", ["monthly"]), ("quarterly", ["quarter"]), ("weekday", ["day"])]),
        "is_data_question": _has(low, DATA_WORDS).cast("int"),
    }).drop(*[f"_{name}" for name in matches])


def extract_periods(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Add ``period_kind`` (month, year or null), ``period_year``, ``period_month``.

    A year alone counts only from 2000 on and when no month is named; of
    several the last one wins, wherever in the prompt it stands.
    A numeric month goes before a named one.
    """
    low = F.lower(F.col(text))
    numeric, named = low.rlike(NUMERIC_PERIOD), low.rlike(NAMED_PERIOD)
    year_only = ~numeric & ~low.rlike(MONTH_THEN_YEAR) & low.rlike(LAST_YEAR)
    number = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    month_name = F.substring(F.regexp_extract(low, NAMED_PERIOD, 1), 1, 3)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(low, pattern, group).try_cast("int")

    return prompts.withColumns({
        "period_kind": F.when(year_only, F.lit("year")).when(numeric | named, F.lit("month")),
        "period_year": F.when(year_only, F.regexp_extract(low, LAST_YEAR, 1).try_cast("int")).when(numeric, part(NUMERIC_PERIOD, 2))
        .when(named, part(NAMED_PERIOD, 2)),
        "period_month": F.when(year_only, F.lit(None).cast("int")).when(numeric, part(NUMERIC_PERIOD, 1))
        .when(named, F.try_element_at(number, month_name)),
    })


def answer_revenue(prompts: DataFrame, revenue: DataFrame, text: str = "prompt") -> DataFrame:
    """Every dated prompt with the figures of its tenant's month or year.

    Months and years form one report keyed by (tenant, year, month or 0), so a
    single join answers the whole table.
    """
    months = month_report(revenue).select(
        "companyfn", F.col("report_year").alias("period_year"), F.col("report_month").alias("_slot"),
        "total_revenue", "transaction_count", "growth_pct", F.lit(None).cast("bigint").alias("month_count"))
    years = year_report(revenue).select(
        "companyfn", F.col("report_year").alias("period_year"), F.lit(0).alias("_slot"),
        "total_revenue", "transaction_count", F.lit(None).cast("double").alias("growth_pct"), "month_count")
    dated = extract_periods(prompts, text).withColumn("_slot", F.coalesce("period_month", F.lit(0)))
    return attach(dated, months.unionByName(years), ["companyfn", "period_year", "_slot"]).drop("_slot")


def log_prompts(tagged: DataFrame, path: str) -> None:
    """Append tagged prompts to the prompt log."""
    tagged.write.mode("append").partitionBy("companyfn").parquet(path)


def prompt_statistics(tagged: DataFrame) -> DataFrame:
    """Number of prompts and the last one's time per tenant and target."""
    return tagged.select("companyfn", "asked_at", F.explode("targets").alias("target")).groupBy(
        "companyfn", "target").agg(
        F.count(F.lit(1)).alias("prompts"), F.max("asked_at").alias("last_asked"))
