"""Hand-made tables with expected values written out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesmart.functions import cleaning as fc
from salesmart.functions import dates as fd
from salesmart.operators import cleaning, extraction, features, insights, prompts, summaries, trends
from salesmart.schemas import HEADERS, LINES, TRANSACTION_TYPES, columns_with_role


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def day(text):
    return F.lit(text).cast("timestamp_ntz")


def header(**given):
    row = {"uniquenum_pri": "1", "companyfn": "A", "tag_table_usage": "sal_soc", "party_unique": "c", "party_code": "c",
           "party_desc": "C", "date_trans": dt.datetime(2024, 1, 5), "amount_local": 10, "tag_void_yn": "n",
           "tag_deleted_yn": "n", "tag_closed02_yn": "n"} | given
    return tuple(_decimal(row.get(f.name), f) for f in HEADERS.fields)


def line(**given):
    row = {"uniquenum_uniq": "u", "uniquenum_pri": "1", "companyfn": "A", "stkcode_unique": "p", "stkcode_code": "P",
           "party_unique": "c", "party_code": "c", "row_item_num": 1, "qnty_total": 1, "price_unitlist_local": 2,
           "price_unitrate_local": 2, "discount_pct": 0, "amount_local": 2, "date_trans": dt.datetime(2024, 1, 5),
           "tag_void_yn": "n"} | given
    return tuple(_decimal(row.get(f.name), f) for f in LINES.fields)


def _decimal(item, f):
    from decimal import Decimal
    return Decimal(str(item)) if item is not None and "decimal" in f.dataType.simpleString() else item


def test_calendar(spark):
    assert value(spark, F.weekday(day("2024-01-07"))) == 6 and value(spark, fd.weekend(day("2024-01-07"))) == 1
    week = fd.calendar(day("2024-12-30"), "week_of_year")["week_of_year"]
    assert value(spark, week) == 1
    assert value(spark, fd.calendar(day("2021-01-01"), "week_of_year")["week_of_year"]) == 53
    null = F.lit(None).cast("timestamp_ntz")
    assert value(spark, fd.weekend(null)) == 0 and value(spark, F.month(null)) is None
    assert [value(spark, fd.late_month(day(d))) for d in ("2024-02-24", "2024-02-25")] == [0, 1]
    assert [value(spark, fd.late_quarter(day(d))) for d in ("2024-02-25", "2024-03-25", "2024-03-24")] == [0, 1, 0]
    assert value(spark, fd.is_last_day(day("2024-02-29"), "month")) == 1
    assert value(spark, fd.is_last_day(day("2023-12-31"), "quarter")) == 1
    assert value(spark, fd.is_last_day(day("2024-06-30"), "year")) == 0
    assert value(spark, fd.is_first_day(day("2024-04-01"), "quarter")) == 1


def test_elapsed_days_round_down(spark):
    assert value(spark, fd.elapsed_days(day("2024-01-03 01:00"), day("2024-01-01 23:00"))) == 1
    assert value(spark, fd.elapsed_days(day("2024-01-01 00:00"), day("2024-01-01 12:00"))) == -1


def test_coercion_and_division(spark):
    assert value(spark, fc.number_or(F.lit("abc"))) == 0
    assert value(spark, fc.number_or(F.lit("NaN"), 0, "double")) == 0
    assert value(spark, fc.number_or(F.lit(None).cast("string"), 1)) == 1
    assert float(value(spark, fc.number_or(F.lit(" 2.5 ")))) == 2.5
    assert value(spark, fc.moment_or_null(F.lit("bad"))) is None
    assert value(spark, fc.mapped(F.lit("stk_do"), TRANSACTION_TYPES)) == "Delivery Order"
    assert value(spark, fc.mapped(F.lit(None).cast("string"), TRANSACTION_TYPES)) == "Unknown"
    assert value(spark, fc.over_nonzero(F.lit(6.0), F.lit(0))) == 6.0
    assert value(spark, fc.over_or_null(F.lit(6.0), F.lit(0))) is None
    shifted = fd.shifted_month(F.lit(2023), F.lit(12), 1)
    assert (value(spark, shifted["year"]), value(spark, shifted["month"])) == (2024, 1)


def test_roles():
    assert columns_with_role(HEADERS, "target_variable") == ["amount_local", "amount_forex"]


def test_revenue_predicate(spark):
    rows = [
        header(uniquenum_pri="1"),
        header(uniquenum_pri="2", tag_table_usage="sal_soe"),
        header(uniquenum_pri="3", tag_table_usage="sal_soe", tag_closed02_yn="y"),
        header(uniquenum_pri="4", tag_table_usage="sal_inv"),
        header(uniquenum_pri="5", tag_deleted_yn="y"),
        header(uniquenum_pri="6", tag_void_yn="y"),
        header(uniquenum_pri="7", date_trans=dt.datetime(2024, 2, 1, 12)),
    ]
    df = spark.createDataFrame(rows, HEADERS)
    got = {(r["year"], r["month"]): (r["amt_local"], r["num_transactions"]) for r in extraction.monthly_revenue(df).collect()}
    assert got == {(2024, 1): (20.0, 2), (2024, 2): (10.0, 1)}
    # an upper end without a time stops at midnight
    assert extraction.monthly_revenue(df, date_to="2024-02-01").count() == 1
    assert extraction.date_range(df.where("companyfn = 'none'")).first() == ("2009-01-01", "2026-12-31")


def test_lines_join_headers_of_their_own_tenant(spark):
    headers = spark.createDataFrame([header(), header(companyfn="B")], HEADERS)
    lines = spark.createDataFrame([line(), line(companyfn="B", amount_local=3), line(tag_void_yn="y")], LINES)
    got = extraction.customer_facts(headers, lines).collect()
    assert sorted((r["companyfn"], float(r["line_amount"])) for r in got) == [("A", 2.0), ("B", 3.0)]
    one = extraction.customer_facts(headers, lines, companyfn="B").collect()
    assert [r["companyfn"] for r in one] == ["B"]
    unowned = extraction.customer_facts(headers.where("companyfn = 'A'"), lines.where("companyfn = 'B'").drop("companyfn"))
    assert [r["companyfn"] for r in unowned.collect()] == ["A"]


def month_rows(spark, rows):
    return spark.createDataFrame(rows, "companyfn string, month int, year int, amt_local double, num_transactions long")


def test_growth_against_the_month_before(spark):
    rows = [("A", 12, 2023, 50.0, 1), ("A", 1, 2024, 100.0, 2), ("A", 3, 2024, 10.0, 1),
            ("B", 1, 2024, 0.0, 1), ("B", 2, 2024, 9.0, 1)]
    got = {(r["companyfn"], r["report_month"]): r["growth_pct"]
           for r in insights.month_report(month_rows(spark, rows)).collect()}
    assert got == {("A", 12): 0.0, ("A", 1): 100.0, ("A", 3): 0.0, ("B", 1): 0.0, ("B", 2): 0.0}


def test_months_without_date_are_dropped(spark):
    rows = spark.createDataFrame([("A", "x", 2024, 1.0), ("A", "2", 2024, 3.0)],
                                 "companyfn string, month string, year int, amt_local double")
    assert [r["month"] for r in cleaning.revenue_levels(rows).collect()] == [2]


def test_single_row_group(spark):
    df = spark.createDataFrame([("A", 1, 5.0)], "g string, day int, v double")
    row = features.rolling_features(df, "v", "day", ["g"], [7]).first()
    assert row["v_rolling_mean_7"] == 5.0 and row["v_rolling_std_7"] is None


def test_one_sale_day(spark):
    lines = spark.createDataFrame([line(date_trans=dt.datetime(2024, 3, 1))], LINES)
    got = trends.product_statistics(trends.recent_lines(lines, "2024-03-10"), "2024-03-10").first()
    assert (got["consistency"], got["growth_rate"], got["momentum"]) == (0.5, 1.0, 2.0)


def test_product_statistics(spark):
    """Days 1, 11 and 61 before the anchor: quantities 4, 2 and 3."""
    def sale(days_ago, qty, **given):
        return line(date_trans=dt.datetime(2024, 3, 31) - dt.timedelta(days_ago), qnty_total=qty, **given)
    rows = [sale(1, 4, party_unique="x", stkcode_desc="new"), sale(11, 2),
            sale(61, 1, row_item_num=1, stkcode_desc="low"), sale(61, 2, row_item_num=2, stkcode_desc="old"),
            sale(90, 1, stkcode_unique="edge"), sale(91, 1, stkcode_unique="outside")]
    recent = trends.recent_lines(spark.createDataFrame(rows, LINES), "2024-03-31")
    stats = {r["stkcode_unique"]: r for r in trends.product_statistics(recent, "2024-03-31").collect()}
    assert set(stats) == {"p", "edge"}
    p = stats["p"]
    assert p["stkcode_desc"] == "old" and p["unique_customer_count"] == 2 and p["transactions_count"] == 4
    assert p["growth_rate"] == pytest.approx((6 - 3) / 3)
    assert p["momentum"] == pytest.approx((6 / 30) / (3 / 60))
    assert p["consistency"] == pytest.approx(1 / (1 + (2 / 3) ** 0.5 / 3))
    scored = {r["stkcode_unique"]: r for r in trends.potential_scores(trends.product_statistics(recent, "2024-03-31")).collect()}
    # growth 1 of 1, momentum 4 of 4, revenue 18 of 18, two of fifty customers
    want = 100 * (0.35 + 0.25 + 0.2 * p["consistency"] + 0.15 + 0.05 * 2 / 50)
    assert scored["p"]["potential_score"] == pytest.approx(want, abs=0.005)
    assert scored["p"]["factor_breakdown"]["customer_base"] == 4.0
    assert scored["edge"]["momentum"] == 0.0


def test_negative_growth_is_kept(spark):
    stats = spark.createDataFrame(
        [("A", "1", 2.0, 1.0, 10.0, 0.5, 100), ("A", "2", -0.5, 0.0, 0.0, 0.5, 0)],
        "companyfn string, stkcode_unique string, growth_rate double, momentum double, total_revenue double, "
        "consistency double, unique_customer_count long")
    low = trends.potential_scores(stats).where("stkcode_unique = '2'").first()
    assert low["factor_breakdown"]["recent_growth"] == -25.0 and low["potential_score"] == pytest.approx(1.25)
    assert trends.market_overview(stats).first()["market_momentum"] == 50.0


def test_no_recent_sales(spark):
    empty = trends.product_statistics(trends.recent_lines(spark.createDataFrame([line()], LINES), "2030-01-01"), "2030-01-01")
    assert trends.analysis_status(empty, "2030-01-01").first()["status"] == "no_data"


def test_null_keys_are_dropped_from_summaries(spark):
    lines = spark.createDataFrame([line(), line(party_code=None)], LINES)
    assert [r["customer_id"] for r in summaries.customer_summary(lines).collect()] == ["c"]


PROMPTS = {
    # prompt: (route, targets, period)
    "Show me revenue for February 2010": ("insights", ["revenue_report_by_date"], ("month", 2010, 2)),
    "compare 2010 and 2011": ("insights", ["revenue_report_by_date"], ("year", 2011, None)),
    "revenue 1998": ("insights", ["revenue_report_by_date"], (None, None, None)),
    "Top customers 7/2012": ("insights", ["revenue_report_by_date", "customer_analysis"], ("month", 2012, 7)),
    "top 10 products": ("product_trend_analysis", ["product_analysis"], (None, None, None)),
    "churn and monthly growth": ("insights", ["customer_analysis", "sales_trend"], (None, None, None)),
    "sản phẩm tiềm năng": ("product_trend_analysis", ["general"], (None, None, None)),
    "hello": ("insights", ["general"], (None, None, None)),
    "report 13.2020 or may2021": ("insights", ["revenue_report_by_date"], ("month", 2020, 13)),
    "sept 2020": ("insights", ["revenue_report_by_date"], (None, None, None)),
}


def test_prompts(spark):
    df = spark.createDataFrame([(p,) for p in PROMPTS], "prompt string")
    rows = {r["prompt"]: r for r in prompts.extract_periods(prompts.tag_prompts(df)).collect()}
    for prompt, (route, targets, period) in PROMPTS.items():
        got = rows[prompt]
        assert (got["route"], got["targets"]) == (route, targets), prompt
        assert (got["period_kind"], got["period_year"], got["period_month"]) == period, prompt


def test_prompt_answers_keep_every_prompt(spark):
    revenue = month_rows(spark, [("A", 1, 2010, 5.0, 1), ("A", 2, 2010, 10.0, 2), ("B", 2, 2010, 7.0, 1)])
    asked = spark.createDataFrame([("A", "revenue 2/2010"), ("A", "revenue 2010"), ("B", "revenue 1/2010"), ("B", "hi")],
                                  "companyfn string, prompt string")
    got = {(r["companyfn"], r["prompt"]): r for r in prompts.answer_revenue(asked, revenue).collect()}
    assert len(got) == 4
    assert got["A", "revenue 2/2010"]["growth_pct"] == 100.0 and got["A", "revenue 2/2010"]["month_count"] is None
    assert got["A", "revenue 2010"]["total_revenue"] == 15.0 and got["A", "revenue 2010"]["month_count"] == 2
    assert got["B", "revenue 1/2010"]["total_revenue"] is None and got["B", "hi"]["total_revenue"] is None
