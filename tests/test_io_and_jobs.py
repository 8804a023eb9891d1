"""Sources, sinks, registry, jobs and the incremental refresh."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.operators import extraction
from salesmart.plans import jobs
from salesmart.schemas import HEADERS
from salesmart.sources import readers, sinks
from salesmart.sources.registry import DatasetRegistry
from salesmart.streaming import refresh
from workload.tables import headers, lines

AS_OF = "2001-08-01"


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    h, l = headers(spark, sf_dir), lines(spark, sf_dir)
    return h.persist(), l.persist()


@pytest.fixture(scope="module")
def half_year(source):
    """Documents of six months, so that the tests write few folders."""
    span = "date_trans >= '1999-01-01' AND date_trans < '1999-07-01'"
    return source[0].where(span), source[1].where(span)


@pytest.mark.parametrize("fmt", readers.FORMATS)
def test_save_and_load(spark, tmp_path, fmt):
    df = spark.createDataFrame([("A", 1, 2.5), ("B", 2, None)], "companyfn string, n int, v double")
    path = f"{tmp_path}/data.{fmt}"
    sinks.save_dataset(df, path, fmt)
    back = readers.load_dataset(spark, path)
    assert sorted(back.select("companyfn", "n", "v").collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        sinks.save_dataset(df, path, "xml")
    with pytest.raises(ValueError):
        readers.load_dataset(spark, f"{tmp_path}/data.xml")


def test_registry_reads_one_tenant(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "companyfn string, n int")
    sinks.save_dataset(df, f"{tmp_path}/facts.csv", "csv")
    sinks.save_dataset(df.drop("companyfn"), f"{tmp_path}/shared.parquet")
    registry = DatasetRegistry(spark, str(tmp_path), "A")
    assert [r["n"] for r in registry.load("facts").collect()] == [1]
    assert registry.load("shared", shared=True).count() == 2
    with pytest.raises(ValueError):
        registry.load("shared")
    with pytest.raises(FileNotFoundError):
        registry.load("nothing")


def test_table_reads(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, k string")
    assert readers.read_table(df, ["k"], {"id": [1, 3], "k": "z"}).collect() == [("z",)]
    assert readers.read_table(df, limit=2).count() == 2
    joined = readers.read_joined(df, df, "main.id < data.id", ["main.k", "data.id"], {"data.k": "z"})
    assert sorted(joined.collect()) == [("x", 3), ("y", 3)]
    info = readers.describe_table(df).orderBy("position").collect()
    assert [(r["column_name"], r["data_type"], r["row_count"]) for r in info] == [("id", "int", 3), ("k", "string", 3)]


def test_full_job_then_training(spark, source, tmp_path):
    names = jobs.extract_all(*source, f"{tmp_path}/out", date_from="2000-09-01")
    for name in names:
        assert readers.load_dataset(spark, f"{tmp_path}/out/{name}.parquet").count() > 0, name
    retention = readers.load_dataset(spark, f"{tmp_path}/out/customer_retention.parquet")
    trend = readers.load_dataset(spark, f"{tmp_path}/out/sales_trend.parquet")
    trained = jobs.train_models(retention, trend, f"{tmp_path}/models", folds=0, num_trees=5)
    assert set(trained) == {"churn", "forecast"}
    assert jobs.train_models(retention, trend, f"{tmp_path}/none", minimum={"churn": 10**9, "forecast": 10**9}) == {}


def test_trend_job(spark, source, tmp_path):
    jobs.trend_report(source[1], str(tmp_path), AS_OF)
    top = spark.read.json(f"{tmp_path}/top_products")
    assert top.where("rank = 1").count() == top.select("companyfn").distinct().count() > 0
    assert spark.read.json(f"{tmp_path}/status").first()["status"] == "success"


def report(spark, path):
    df = readers.load_dataset(spark, f"{path}/revenue_report_by_date.parquet")
    return {(r["companyfn"], r["year"], r["month"]): (r["amt_local"], r["num_transactions"]) for r in df.collect()}


def test_refresh_touches_only_its_months(spark, half_year, tmp_path):
    h, l = half_year
    out = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        refresh.refresh(h, l, h, out)
    jobs.extract_all(h, l, out)
    before = report(spark, out)
    due = h.where("companyfn = 'C1' AND date_trans >= '1999-03-01' AND date_trans < '1999-04-01'")
    assert due.count() > 0
    # all of March 1999 of one tenant is voided, one other month changes
    voided = h.withColumn("tag_void_yn", F.when(
        (F.col("companyfn") == "C1") & (F.date_trunc("month", "date_trans") == F.lit(dt.datetime(1999, 3, 1)).cast("timestamp_ntz")),
        "y").otherwise(F.col("tag_void_yn")))
    for _ in range(2):  # a second run changes nothing
        refresh.refresh(voided, l, due, out)
        after = report(spark, out)
        assert ("C1", 1999, 3) not in after
        assert {k: v for k, v in before.items() if k != ("C1", 1999, 3)} == after


def test_rebuild_and_refresh_in_turn_keep_the_history(spark, half_year, tmp_path):
    h, l = half_year
    out, day = str(tmp_path), "1999-05-01"
    old, new = h.where(f"date_trans < '{day}'"), h.where(f"date_trans >= '{day}'")

    def want(df):
        return {(r["companyfn"], r["year"], r["month"]): (r["amt_local"], r["num_transactions"])
                for r in extraction.monthly_revenue(df).collect()}
    for _ in range(2):
        jobs.extract_all(old, l, out)
        assert report(spark, out) == want(old)
        refresh.refresh(h, l, new, out)
        assert report(spark, out) == want(h)


def test_moved_document_leaves_its_old_month(spark, half_year, tmp_path):
    h, l = half_year
    h = h.withColumn("companyfn", F.concat(F.lit("a/b=%"), "companyfn"))
    l = l.withColumn("companyfn", F.concat(F.lit("a/b=%"), "companyfn"))
    out = str(tmp_path)
    march = (F.col("companyfn") == "a/b=%C1") & (F.date_trunc("month", "date_trans")
                                               == F.lit(dt.datetime(1999, 3, 1)).cast("timestamp_ntz"))
    jobs.extract_all(h, l, out)
    moved = h.withColumn("date_trans", F.when(march, F.lit(dt.datetime(1999, 4, 2)).cast("timestamp_ntz")).otherwise(
        F.col("date_trans")))
    refresh.refresh(moved, l, moved.where("companyfn = 'a/b=%C1' AND date_trans = timestamp_ntz'1999-04-02'"), out,
                    previous_headers=h.where(march))
    got = report(spark, out)
    assert ("a/b=%C1", 1999, 3) not in got and ("a/b=%C1", 1999, 4) in got
    assert got == {(r["companyfn"], r["year"], r["month"]): (r["amt_local"], r["num_transactions"])
                   for r in extraction.monthly_revenue(moved).collect()}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_tenants_stay_apart(spark, tmp_path, fmt):
    df = spark.createDataFrame([("001", "007", 1.5), ("1", "7", 2.5)], "companyfn string, code string, x double")
    sinks.save_dataset(df, f"{tmp_path}/d.{fmt}", fmt)
    assert sorted(tuple(r) for r in readers.load_dataset(spark, f"{tmp_path}/d.{fmt}").select(df.columns).collect()) == [
        ("001", "007", 1.5), ("1", "7", 2.5)]
    assert DatasetRegistry(spark, str(tmp_path), "001").load("d").count() == 1
    df.write.partitionBy("companyfn").parquet(f"{tmp_path}/plain.parquet")
    assert {r[0] for r in readers.load_dataset(spark, f"{tmp_path}/plain.parquet").select("companyfn").collect()} == {"001", "1"}


def test_daily_job(spark, source, tmp_path):
    jobs.extract_all(*source, f"{tmp_path}/out", date_from="2001-05-01")
    result = refresh.daily(*source, AS_OF, f"{tmp_path}/out", f"{tmp_path}/models", days=60, folds=0, num_trees=3)
    latest = readers.load_dataset(spark, f"{tmp_path}/out/sales_main_latest.parquet")
    assert latest.agg(F.min("date_trans")).first()[0] >= dt.datetime(2001, 6, 2)
    assert set(result) <= {"churn", "forecast"}


def test_stream_of_headers(spark, half_year, tmp_path):
    h, l = half_year
    inbox, table, out = f"{tmp_path}/inbox", f"{tmp_path}/headers", f"{tmp_path}/out"
    early, late = h.where("date_trans < '1999-04-15'"), h.where("date_trans >= '1999-04-15'")
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(HEADERS).parquet(inbox)
        refresh.refresh_stream(arriving, table, l, out, f"{tmp_path}/check").awaitTermination()
    want = {(r["companyfn"], r["year"], r["month"]): (r["amt_local"], r["num_transactions"])
            for r in extraction.monthly_revenue(h).collect()}
    assert report(spark, out) == want


def test_amounts_stay_decimal(source):
    assert isinstance(source[0].select("amount_local").first()[0], Decimal)
