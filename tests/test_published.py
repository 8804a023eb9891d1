"""Versions of documents, published refreshes, mergeable sketches, exact recommendations."""

import random

import pytest
from pyspark.sql import functions as F

from salesmart.functions.distinct import ERROR, distinct_count, distinct_sketch, estimate, merged_sketch
from salesmart.operators import extraction, features, reach, recommend, summaries
from salesmart.plans import jobs
from salesmart.sources import colocated, snapshots
from salesmart.streaming import refresh
from workload.tables import headers, lines


@pytest.fixture(scope="module")
def quarter(spark, sf_dir):
    """Documents and lines of two months and two tenants, so that the tests write few folders."""
    span = "date_trans >= '1999-01-01' AND date_trans < '1999-03-01' AND companyfn <= 'C1'"
    return headers(spark, sf_dir).where(span).persist(), lines(spark, sf_dir).where(span).persist()


def revenue(df):
    return {(r.companyfn, r.year, r.month): (r.amt_local, r.num_transactions) for r in df.collect()}


def published(spark, out):
    return revenue(refresh.read_dataset(spark, out, "revenue_report_by_date"))


# -- versions ------------------------------------------------------------------

LOG = "companyfn string, uniquenum_pri string, amount int, version int, gone boolean, batch long"


def test_latest_versions(spark):
    log = spark.createDataFrame([
        ("A", "1", 10, 1, False, 0), ("A", "1", 11, 3, False, 1), ("A", "1", 12, 2, False, 2),     # an older one came late
        ("A", "2", 20, 1, False, 0), ("A", "2", 21, 1, False, 1),                                  # one version twice
        ("A", "3", 30, 1, False, 0), ("A", "3", None, 2, True, 1),                                 # deleted
        ("A", "4", 40, 1, True, 0), ("A", "4", 41, 2, None, 1),                                    # deleted and back
        ("B", "1", 50, 1, False, 0), ("B", "1", 50, 1, False, 0)], LOG)

    def amounts(*how):
        return sorted((r.companyfn, r.uniquenum_pri, r.amount) for r in refresh.latest_versions(log, *how).collect())
    assert amounts("version", "gone") == [("A", "1", 11), ("A", "2", 21), ("A", "4", 41), ("B", "1", 50)]
    assert amounts(None, "gone") == [("A", "1", 12), ("A", "2", 21), ("A", "4", 41), ("B", "1", 50)]
    assert len(amounts("version")) == 5
    plan = refresh.latest_versions(log, "version")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("as_snapshots", [False, True])
def test_stream_of_versions(spark, quarter, tmp_path, as_snapshots):
    """Moved, changed, deleted and late documents, in four days; the old month of a moved one is refreshed."""
    h, l = quarter
    h = h.withColumns({"version": F.lit(2), "gone": F.lit(False)})
    key, money = F.col("idcode"), h.schema["amount_local"].dataType
    first = h.withColumns({"version": F.lit(1), "date_trans": F.when(key % 3 == 0, F.add_months("date_trans", 1).cast(
        "timestamp_ntz")).otherwise(F.col("date_trans"))})
    second = h.where(key % 3 == 0).withColumn("amount_local", (F.col("amount_local") + 1).cast(money))
    late = h.where(key % 6 == 0).withColumns({"version": F.lit(0), "date_trans": F.lit(None).cast("timestamp_ntz")})
    gone = h.where(key % 5 == 0).withColumns({"version": F.lit(9), "gone": F.lit(True)})
    folder = str(tmp_path)
    for day in (first, second, late, gone):
        day.coalesce(1).write.mode("append").parquet(f"{folder}/inbox")
        arriving = spark.readStream.schema(h.schema).parquet(f"{folder}/inbox")
        refresh.refresh_stream(arriving, f"{folder}/log", l, f"{folder}/out", f"{folder}/check", "version", "gone",
                               as_snapshots, ["monthly_revenue", "monthly_reach"]).awaitTermination()
    last = h.where(key % 5 != 0).withColumn("amount_local", F.when(key % 3 == 0, F.col("amount_local") + 1).otherwise(
        F.col("amount_local")).cast(money))
    if as_snapshots:
        got = published(spark, f"{folder}/out")
        sketches = refresh.read_dataset(spark, f"{folder}/out", "monthly_reach")
    else:
        got = revenue(spark.read.parquet(f"{folder}/out/revenue_report_by_date.parquet"))
        sketches = spark.read.parquet(f"{folder}/out/monthly_reach.parquet")
    assert got == revenue(extraction.monthly_revenue(last))
    orders = {r.companyfn: r.n for r in last.where("tag_void_yn = 'n'").groupBy("companyfn").agg(
        F.countDistinct("uniquenum_pri").alias("n")).collect()}
    merged = {r.companyfn: r.orders for r in reach.reach(sketches, ["companyfn"]).collect()}
    assert merged == orders     # small sets are exact


# -- snapshots -------------------------------------------------------------------

def test_a_failed_refresh_is_never_seen(spark, quarter, tmp_path, monkeypatch):
    h, l = quarter
    out = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        refresh.refresh(h, l, h, out, published=True)
    refresh.refresh(h, l, h, out, create=True, published=True)
    names = ["sales_trend", "sales_data", "monthly_revenue", "monthly_reach", "revenue_report_by_date"]

    def everything():
        return {n: sorted(map(str, refresh.read_dataset(spark, out, n).collect())) for n in names}
    before, reader = everything(), refresh.read_dataset(spark, out, "monthly_revenue")
    old = snapshots.current_name(spark, out)
    assert published(spark, out) == revenue(extraction.monthly_revenue(h))
    due = h.where("companyfn = 'C1' AND date_trans < '1999-02-01'")
    voided = h.withColumn("tag_void_yn", F.when(
        (F.col("companyfn") == "C1") & (F.col("date_trans") < "1999-02-01"), "y").otherwise(F.col("tag_void_yn")))
    write = snapshots.Publication.write
    for victim in names:
        def fails(self, name, *rest, victim=victim):
            if name == victim:
                raise OSError("killed")
            write(self, name, *rest)
        monkeypatch.setattr(snapshots.Publication, "write", fails)
        with pytest.raises(OSError):
            refresh.refresh(voided, l, due, out, published=True)
        assert snapshots.current_name(spark, out) == old and everything() == before
    monkeypatch.setattr(snapshots.Publication, "write", write)
    refresh.refresh(voided, l, due, out, published=True)
    want = revenue(extraction.monthly_revenue(voided))
    assert published(spark, out) == want and ("C1", 1999, 1) not in want
    # a reader that was there before, and one that asks for the old manifest, see the old set
    assert sorted(map(str, reader.collect())) == before["monthly_revenue"]
    past = snapshots.read_published(spark, out, "monthly_revenue", ["companyfn", "year", "month"], old)
    assert sorted(map(str, past.collect())) == before["monthly_revenue"]
    snapshots.drop_old_runs(spark, out, names, keep=[old])
    assert sorted(map(str, past.collect())) == before["monthly_revenue"]
    after = everything()
    snapshots.drop_old_runs(spark, out, names)
    assert everything() == after


def test_two_runs_at_once_do_not_mix(spark, tmp_path):
    df = spark.createDataFrame([("a/b=%", 1, 1), (None, 2, 2)], "companyfn string, month int, n int")
    one, two = (snapshots.Publication(spark, str(tmp_path)) for _ in range(2))
    for run in (one, two):
        run.write("d", df, ["companyfn", "month"])
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    rows = snapshots.read_published(spark, str(tmp_path), "d", ["companyfn", "month"])
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.collect()))
    three = snapshots.Publication(spark, str(tmp_path))
    three.write("d", df.where("n = 2").withColumn("n", F.lit(7)), ["companyfn", "month"], df.select("companyfn", "month"))
    three.commit()
    rows = snapshots.read_published(spark, str(tmp_path), "d", ["companyfn", "month"])
    assert [tuple(r) for r in rows.collect()] == [(None, 2, 7)]


# -- sketches ----------------------------------------------------------------------

def test_sketches_merge_and_estimate(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 90_000).cast("string").alias("x"))
    whole = df.agg(distinct_count("x", True)).first()[0]
    parts = df.groupBy("part").agg(distinct_sketch("x").alias("s"))
    merged = parts.agg(estimate(merged_sketch("s"))).first()[0]
    for got in (whole, merged):
        assert abs(got - 90_000) <= ERROR * 90_000
    assert df.agg(distinct_count("x")).first()[0] == 90_000
    assert spark.createDataFrame([(None,)], "x string").agg(distinct_count("x", True)).first()[0] == 0


def test_approximate_switches(spark, quarter):
    """Groups of a few values are counted exactly, in one pass without Expand."""
    h, l = quarter
    facts = extraction.customer_facts(h, l)
    for build in (lambda **o: extraction.customer_retention(h, **o), lambda **o: extraction.product_daily(h, l, **o),
                  lambda **o: extraction.sales_trend(h, **o), lambda **o: features.customer_features(facts, **o),
                  lambda **o: summaries.customer_summary(l, **o), lambda **o: summaries.product_summary(l, **o)):
        approx = build(approx=True)
        assert sorted(map(str, approx.collect())) == sorted(map(str, build().collect()))
        assert "Expand" not in approx._jdf.queryExecution().executedPlan().toString()


# -- recommendations ---------------------------------------------------------------

@pytest.mark.parametrize("block_rows", [3, 1000])
def test_best_unbought_equals_brute_force(spark, block_rows):
    draw = random.Random(block_rows)

    def factors(scale):
        return [float(draw.randint(-3, 3)) * scale for _ in range(4)]
    customers = [("A", f"c{i}", factors(1)) for i in range(25)] + [("B", "c1", factors(1)), ("C", "none", factors(1))]
    customers.append(("A", "zero", [0.0] * 4))
    products = [("A", f"p{i:02}", factors(draw.choice([1, 1, 5]))) for i in range(60)] + [
        ("B", f"p{i}", factors(1)) for i in range(4)]
    bought = [("A", f"c{draw.randrange(25)}", f"p{draw.randrange(60):02}") for _ in range(200)] + [
        ("A", "c0", f"p{i:02}") for i in range(58)] + [("B", "c1", "p2"), ("B", "c1", "gone")]
    got = {(r.companyfn, r.customer_id, r["rank"]): (r.product_code, r.purchase_score) for r in recommend.best_unbought(
        spark.createDataFrame(customers, "companyfn string, customer_id string, factors array<double>"),
        spark.createDataFrame(products, "companyfn string, product_code string, factors array<float>"),
        spark.createDataFrame(bought * 2, "companyfn string, customer_id string, product_code string"),
        5, block_rows).collect()}
    want = {}
    for tenant, customer, mine in customers:
        scores = sorted((-sum(a * b for a, b in zip(mine, f)), p) for t, p, f in products
                        if t == tenant and (tenant, customer, p) not in bought)
        want |= {(tenant, customer, i + 1): (p, -lost) for i, (lost, p) in enumerate(scores[:5])}
    assert got == want
    assert 1 <= sum(k[1] == "c0" for k in got) <= 2      # all but two at most are bought


def test_blocks_out_of_reach_are_skipped(spark, monkeypatch):
    """One long product for everyone: later blocks are not joined with any customer."""
    rounds = []
    best_of_blocks = recommend._best_of_blocks
    monkeypatch.setattr(recommend, "_best_of_blocks", lambda *a: rounds.append(a[3:5]) or best_of_blocks(*a))
    products = [("A", f"p{i:03}", [10.0 if i < 5 else 0.1, 0.0]) for i in range(200)]
    df = recommend.best_unbought(
        spark.createDataFrame([("A", "c", [1.0, 0.5])], "companyfn string, customer_id string, factors array<double>"),
        spark.createDataFrame(products, "companyfn string, product_code string, factors array<double>"),
        spark.createDataFrame([], "companyfn string, customer_id string, product_code string"), 3, 8)
    assert [r.product_code for r in df.orderBy("rank").collect()] == ["p000", "p001", "p002"] and rounds == [(0, 1)]
    nobody = recommend.best_unbought(*(spark.createDataFrame([], s) for s in (
        "companyfn string, customer_id string, factors array<double>",
        "companyfn string, product_code string, factors array<double>",
        "companyfn string, customer_id string, product_code string")))
    assert nobody.count() == 0


def test_who_has_bought_the_top_gets_the_next(spark):
    rows = [("A", f"c{i}", f"p{j}", "x") for i in range(6) for j in range(i + 1)]
    facts = spark.createDataFrame(rows, "companyfn string, customer_id string, product_code string, category_name string") \
        .withColumn("brand_desc", F.lit("b"))
    got = sorted((r.customer_id, r.product_code) for r in recommend.candidates(facts, 2).collect())
    assert got == [(f"c{i}", f"p{j}") for i in range(6) for j in range(i + 1, min(i + 3, 6))]


# -- co-located sources ----------------------------------------------------------

def test_colocated_sources_join_without_exchange(spark, quarter, tmp_path):
    h, l = quarter
    l = l.drop("companyfn")
    main = colocated.store_colocated(h, "test_headers", f"{tmp_path}/h", 8)
    data = colocated.store_colocated(l, "test_lines", f"{tmp_path}/l", 8, [*extraction.DETAIL_LINE_COLUMNS,
                                     "uniquenum_pri", "amount_local", "amount_forex", "notes_memo", "tag_void_yn"])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = extraction.customer_facts(main, data)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(str, df.collect())) == sorted(map(str, extraction.customer_facts(h, l).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        colocated.drop_colocated(spark, "test_headers", "test_lines")
    assert [colocated.buckets_for(n, 100) for n in (0, 801, 100_000)] == [8, 16, 1024]


def test_a_job_joins_once(spark, quarter, monkeypatch):
    h, l = quarter
    joins = []
    header_lines = extraction._header_lines
    monkeypatch.setattr(extraction, "_header_lines", lambda *a: joins.append(1) or header_lines(*a))
    builders = jobs.dataset_builders(h, l)
    facts, products = builders["customer_analysis"](), builders["product_analysis"]()
    assert len(joins) == 1
    assert facts.count() == extraction.customer_facts(h, l).count()
    assert products.count() == extraction.product_daily(h, l).count()
