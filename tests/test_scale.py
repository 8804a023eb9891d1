"""Steps whose disk, memory or time must not run away on larger tables."""

import glob
import random
import time
import uuid
from functools import reduce

from pyspark.sql import functions as F

from salesmart.operators import features, models, recommend
from salesmart.sources import sinks
from salesmart.sources.readers import load_dataset
from workload import learning

PAIR = "companyfn string, customer_id string, product_code string"


def _exact(customers, products, bought, n):
    want = set()
    for tenant, customer, mine in customers:
        scores = sorted((-reduce(lambda total, pair: total + pair[0] * pair[1], zip(mine, f), 0.0), p) for t, p, f in products
                        if t == tenant and (tenant, customer, p) not in bought)
        want |= {(tenant, customer, i + 1, p, -lost) for i, (lost, p) in enumerate(scores[:n])}
    return want


def _best(spark, customers, products, bought, *options):
    return recommend.best_unbought(
        spark.createDataFrame(customers, "companyfn string, customer_id string, factors array<double>"),
        spark.createDataFrame(products, "companyfn string, product_code string, factors array<double>"),
        spark.createDataFrame(bought, PAIR), *options).select(
        "companyfn", "customer_id", "rank", "product_code", "purchase_score")


def test_chunks_of_customers_meet_blocks_of_products(spark, monkeypatch):
    """a meeting of a chunk and a block is one group; meetings of purchases alone give nothing."""
    monkeypatch.setattr(recommend, "CHUNK_ROWS", 7)
    draw = random.Random(1)
    customers = [("A", f"c{i}", [draw.gauss(0, 1) * 10 ** draw.randint(-30, 30) for _ in range(3)]) for i in range(40)]
    products = [("A", f"p{i:02}", [draw.gauss(0, 1) * 10 ** draw.randint(0, 3) for _ in range(3)]) for i in range(50)]
    bought = [("A", f"c{draw.randrange(40)}", f"p{draw.randrange(50):02}") for _ in range(300)]
    meetings = []
    original = recommend._scorer
    monkeypatch.setattr(recommend, "_scorer", lambda n: meetings.append(n) or original(n))
    got = {tuple(r) for r in _best(spark, customers, products, bought, 4, 6).collect()}
    assert got == _exact(customers, products, bought, 4) and meetings


def test_a_customer_is_dealt_out_once_a_block(spark):
    """no row holds a block's products, so that none is handed around with the customers or broadcast."""
    rows = [("A", f"c{i}", [1.0, float(i)]) for i in range(5)]
    mine = spark.createDataFrame(rows, "companyfn string, customer_id string, _mine array<double>").withColumns({
        "_chunk": F.lit(0).cast("long"), "_reach": F.lit(5.0), "_least": F.lit(None).cast("double")})
    products = spark.createDataFrame([("A", f"p{i}", [float(i), 1.0], i // 2) for i in range(6)],
                                     "companyfn string, product_code string, factors array<double>, _block long")
    limits = products.groupBy("companyfn", "_block").agg(F.lit(9.0).alias("_longest"))
    skipped = spark.createDataFrame([("A", "c1", "p5", 2, 0)], PAIR + ", _block long, _chunk long")
    found = recommend._best_of_blocks(mine, (products, limits), skipped, 0, 3, 1)
    got = {r.customer_id: r.product_code for r in found.orderBy("purchase_score").collect()}
    assert got == {"c0": "p5", "c1": "p4", "c2": "p5", "c3": "p5", "c4": "p5"}
    assert "array<struct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_scores_and_null_customers(spark):
    """ties go to the smaller code across blocks; a customer without an identifier has bought nothing."""
    customers = [("A", None, [1.0, 0.0]), ("A", "c1", [1.0, 0.0]), ("A", "zero", [0.0, 0.0])]
    products = [("A", f"p{i}", [2.0, float(i % 3)]) for i in range(9)]
    bought = [("A", "c1", "p0"), ("A", None, "p1")]
    got = {tuple(r) for r in _best(spark, customers, products, bought, 2, 2).collect()}
    assert got == {("A", None, 1, "p0", 2.0), ("A", None, 2, "p1", 2.0), ("A", "c1", 1, "p1", 2.0),
                   ("A", "c1", 2, "p2", 2.0), ("A", "zero", 1, "p0", 0.0), ("A", "zero", 2, "p1", 0.0)}


def test_customer_features_read_a_line_once(spark, monkeypatch):
    """four distinct counts without a row for each of them; sales without a customer give no row."""
    rows = [("A", c, f"2024-01-{d:02}", 2.0, 1.0, p, g, b) for c, d, p, g, b in [
        ("c1", 1, "p1", "g1", "b1"), ("c1", 1, "p1", "g1", "b1"), ("c1", 2, "p2", "g1", None), ("c2", 3, None, None, None),
        (None, 9, "p9", "g9", "b9")]]
    facts = spark.createDataFrame(rows, "companyfn string, customer_id string, day string, line_amount double, "
                                  "quantity double, product_code string, category_code string, brand_code string")
    facts = facts.select("*", F.col("day").cast("timestamp_ntz").alias("transaction_date")).drop("day").withColumns(
        {c: F.col(c).cast("decimal(18,4)") for c in ("line_amount", "quantity")})
    plans = []
    monkeypatch.setattr(features, "cut", lambda df: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or df)
    got = {r.customer_id: (r.total_purchase_days, r.unique_products, r.unique_categories, r.unique_brands,
                           r.days_since_last_purchase) for r in features.customer_features(facts).collect()}
    assert got == {"c1": (2, 2, 1, 1, 7), "c2": (1, 0, 0, 0, 6)}
    assert plans and not any("Expand" in plan for plan in plans)


def test_forests_keep_the_node_of_a_row(spark):
    """a row's node in each tree is kept, not looked up from the root at every level."""
    rows = spark.range(60).select(F.lit("A").alias("k"), F.col("id").alias("n"), (F.col("id") % 2).alias("y"), F.rand(1).alias("x"))
    options = {"keys": ["k", "n"], "folds": 0, "num_trees": 2, "max_depth": 3}
    for trained in (models.train_classifier(rows, ["x"], "y", **options), models.train_regressor(rows, ["x"], "x", **options)):
        assert trained.model.stages[-1].getCacheNodeIds()


def test_the_history_is_written_once(spark, sf_dir):
    """training, means and the calendar ahead read one written table, not the orders each."""
    past = learning.written_history(spark, sf_dir)
    assert past is learning.written_history(spark, sf_dir)
    assert "Join" not in past._jdf.queryExecution().optimizedPlan().toString()
    assert past.exceptAll(learning.history(spark, sf_dir)).isEmpty() and past.count() == learning.history(spark, sf_dir).count()


def test_missing_factors_make_missing_scores(spark):
    """they come last, by code, and take no place from the others."""
    customers = [("A", "c1", [1.0, 1.0]), ("A", "c2", [None, 1.0]), ("A", "c3", [-1.0, 0.0])]
    products = [("A", f"p{i}", [float(i) if i % 4 else None, 2.0]) for i in range(7)]
    bought = [("A", "c1", "p6"), ("A", "c1", "p5"), ("A", "c1", "p0"), ("A", "c2", "p1")]
    got = {tuple(r) for r in _best(spark, customers, products, bought, 4, 3).collect()}
    assert got == {("A", "c1", 1, "p3", 5.0), ("A", "c1", 2, "p2", 4.0), ("A", "c1", 3, "p1", 3.0), ("A", "c1", 4, "p4", None),
                   ("A", "c2", 1, "p0", None), ("A", "c2", 2, "p2", None), ("A", "c2", 3, "p3", None), ("A", "c2", 4, "p4", None),
                   ("A", "c3", 1, "p1", -1.0), ("A", "c3", 2, "p2", -2.0), ("A", "c3", 3, "p3", -3.0), ("A", "c3", 4, "p5", -5.0)}


def test_long_products_of_no_use_are_not_scored(spark, monkeypatch, tmp_path):
    """what a block promises depends on where its products point, not on their length alone; a null customer is done as others are."""
    draw, folder, original = random.Random(4), str(tmp_path), recommend._scorer

    def counted(n):
        best_of_meeting = original(n)

        def count(products, rows):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(products) * int(rows["_mine"].notna().sum())))
            return best_of_meeting(products, rows)
        return count
    monkeypatch.setattr(recommend, "_scorer", counted)
    customers = [("A", f"c{i}" if i else None, [draw.randint(3, 20), draw.randint(30, 50), draw.randint(-19, 5)]) for i in range(20)]
    products = [("A", f"p{i:04}", [draw.randint(1, 15), draw.randint(-39, 10), draw.randint(1, 50)]) for i in range(1500)]
    customers, products = ([(*row[:2], [float(x) for x in row[2]]) for row in rows] for rows in (customers, products))
    bought = [("A", f"c{draw.randrange(20)}", f"p{draw.randrange(1500):04}") for _ in range(900)]
    got = {tuple(r) for r in _best(spark, customers, products, bought, 5, 25).collect()}
    assert got == _exact(customers, products, bought, 5)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 20 * 1500 / 4


def test_wide_rows_are_written_in_passes_that_leave_no_shuffle(spark, monkeypatch, tmp_path):
    """months are dealt to passes, whole or by month, and what a pass has shuffled goes when it ends."""
    monkeypatch.setattr(sinks, "SLICED_FROM", -1)
    folders = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    rows = [(t, y, m, f"{t}{y}{m}{i}") for t in ("A", "b/c", None) for y in (2000, 2001, None) for m in (1, 2, 11, None)
            for i in range(3)]
    spark.createDataFrame(rows, "companyfn string, year int, month int, n string").write.parquet(f"{tmp_path}/rows")
    df, path, keys = spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/d.parquet", ["companyfn", "year", "month"]

    def saved():
        return sorted(load_dataset(spark, path).select(*df.columns).collect(), key=str)
    sinks.save_dataset(df.limit(5).withColumn("month", F.lit(12)), path, "parquet", keys, whole=True)
    before, passes, tidy = shuffled(), [], sinks.tidy_writes
    monkeypatch.setattr(sinks, "tidy_writes", lambda s: passes.append(s) or tidy(s))
    sinks.save_dataset(df, path, "parquet", keys, whole=True, slices=3)
    assert len(passes) == 3 and saved() == sorted(df.collect(), key=str)
    sinks.save_dataset(df.where("month = 1").withColumn("n", F.lit("new")), path, "parquet", keys, slices=3)
    assert saved() == sorted(df.withColumn("n", F.when(F.col("month") == 1, "new").otherwise(F.col("n"))).collect(), key=str)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:     # files are deleted in the background
        time.sleep(0.2)
    assert not shuffled() - before
