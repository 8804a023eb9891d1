"""Buckets, quantiles and row windows against pandas, on random and skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.functions.scoring import RISK_EDGES, bucket_of, churned, rank_bucket, risk_of, segment_of
from salesmart.operators.cleaning import flag_outliers, label_by_quantile, rfm_scores
from salesmart.operators.features import lag_features, rolling_features
from salesmart.plans.lookups import attach
from salesmart.plans.ranking import INDEX, SIZE, exact_quantiles, interior, with_position


def skewed(n=4000, seed=7):
    """One tenant holds a third of the rows, one value a third of those."""
    rng = np.random.default_rng(seed)
    tenant = np.where(rng.random(n) < 0.34, "hot", np.char.add("t", rng.integers(0, 40, n).astype(str)))
    value = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(100, 40, n), 2))
    return pd.DataFrame({"companyfn": tenant, "id": np.arange(n), "value": value})


def test_position_equals_window(spark):
    df = spark.createDataFrame(skewed()).repartition(8)
    placed = with_position(df, ["companyfn"], [F.col("value"), F.col("id")])
    w = W.partitionBy("companyfn")
    wanted = df.select("id", (F.row_number().over(w.orderBy("value", "id")) - 1).alias("want"),
                       F.count("id").over(w).alias("n"))
    wrong = placed.join(wanted, "id").where((F.col(INDEX) != F.col("want")) | (F.col(SIZE) != F.col("n")))
    assert placed.count() == 4000 and wrong.count() == 0


def test_position_without_groups_and_with_null_keys(spark):
    rows = [(None if i % 3 else "a", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, id int").repartition(8)
    assert [r["id"] for r in with_position(df, [], [F.col("id")]).orderBy(INDEX).collect()] == list(range(100))
    sizes = {r["k"]: r[SIZE] for r in with_position(df, ["k"], [F.col("id")]).select("k", SIZE).distinct().collect()}
    assert sizes == {"a": 34, None: 66}


@pytest.mark.parametrize("fractions", [[0.2, 0.4, 0.6, 0.8], [0.99], [0.0, 0.5, 1.0]])
def test_quantiles_equal_numpy(spark, fractions):
    data = skewed()
    got = exact_quantiles(spark.createDataFrame(data).repartition(8), ["companyfn"], F.col("value"), fractions, "q")
    for row in got.collect():
        values = data[data.companyfn == row["companyfn"]].value
        assert np.allclose(row["q"], np.quantile(values, fractions), rtol=0, atol=1e-9)


@pytest.mark.parametrize("k,labels", [(5, ["Very Low", "Low", "Medium", "High", "Very High"]), (3, ["Low", "Medium", "High"])])
def test_labels_equal_qcut(spark, k, labels):
    rng = np.random.default_rng(k)
    data = pd.DataFrame({"companyfn": "t", "value": rng.normal(0, 50, 1005)})  # no edge falls on a value
    got = label_by_quantile(spark.createDataFrame(data), F.col("value"), "label", labels).toPandas()
    want = pd.qcut(got.value, k, labels=labels).astype(str)
    assert (got.label == want).all()


def test_labels_with_repeated_edges_do_not_fail(spark):
    df = spark.createDataFrame([("t", float(x)) for x in (0, 0, 0, 0, 0, 1, 2)], "companyfn string, value double")
    got = label_by_quantile(df, F.col("value"), "label", ["1", "2", "3", "4", "5"])
    # edges at 0, 0, 0, 0.8: everything above an edge moves up
    assert sorted(r["label"] for r in got.collect()) == ["1"] * 5 + ["5"] * 2


@pytest.mark.parametrize("size", [5, 7, 11, 96, 101, 1494])
def test_rank_bucket_equals_qcut(spark, size):
    got = spark.range(size).select(rank_bucket(F.col("id"), F.lit(size), 5).alias("b")).toPandas().b.tolist()
    want = pd.qcut(pd.Series(range(1, size + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert got == want
    if size == 7:
        assert got == [1, 1, 2, 3, 4, 5, 5]


def test_rank_bucket_of_a_single_row(spark):
    assert spark.range(1).select(rank_bucket(F.col("id"), F.lit(1), 5)).first()[0] == 1


def test_outlier_flag_uses_signed_quantile(spark):
    data = skewed()
    data["value"] = np.where(data.id % 50 == 0, -data.value * 10, data.value)
    got = flag_outliers(spark.createDataFrame(data), "value", scope="all").toPandas()
    assert (got.is_outlier == (got.value.abs() > got.value.quantile(0.99)).astype(int)).all()


def test_rfm_equals_pandas(spark):
    rng = np.random.default_rng(3)
    n = 611
    data = pd.DataFrame({"companyfn": "t", "customer_id": [f"{i:04d}" for i in range(n)],
                         "recency": rng.permutation(n * 3)[:n], "frequency": rng.integers(1, 6, n),
                         "monetary": np.round(rng.gamma(2, 500, n), 2)})
    ties = [F.col("companyfn"), F.col("customer_id")]
    got = rfm_scores(spark.createDataFrame(data), "recency", "frequency", "monetary", ties).toPandas()
    got = got.sort_values("customer_id").reset_index(drop=True)
    r = pd.qcut(data.recency, 5, labels=[5, 4, 3, 2, 1]).astype(int)
    f = pd.qcut(data.frequency.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    m = pd.qcut(data.monetary.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got.recency_score == r).all() and (got.frequency_score == f).all() and (got.monetary_score == m).all()
    segment = pd.cut((r + f + m) / 3, [0, 2, 3, 4, 5],
                     labels=["At Risk", "Needs Attention", "Potential Loyalist", "Champion"]).astype(str)
    assert (got.customer_segment == segment).all()


def test_fixed_bins(spark):
    days = [0, 30, 31, 90, 91]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    assert [r[0] for r in df.orderBy("d").select(risk_of(F.col("d"))).collect()] == [None, "Low", "Medium", "High", "Very High"]
    assert df.where("d = 0").select(risk_of(F.col("d"), include_lowest=True)).first()[0] == "Low"
    want = pd.cut(pd.Series(range(1, 200)), [*RISK_EDGES, np.inf], labels=["Low", "Medium", "High", "Very High"])
    got = spark.range(1, 200).select(risk_of(F.col("id")).alias("r")).toPandas().r
    assert (got == want.astype(str)).all()
    scores = spark.createDataFrame([(s,) for s in (3, 6, 7, 9, 12, 15)], "s int").orderBy("s")
    assert [r[0] for r in scores.select(segment_of(F.col("s"))).collect()] == [
        "At Risk", "At Risk", "Needs Attention", "Needs Attention", "Potential Loyalist", "Champion"]
    assert [r[0] for r in df.orderBy("d").select(churned(F.col("d"), 90)).collect()] == [0, 0, 0, 0, 1]
    assert spark.range(1).select(bucket_of(F.lit(None).cast("double"), F.array(F.lit(1.0)), 2)).first()[0] is None


@pytest.mark.parametrize("limit", [1000, 40])
def test_lag_and_rolling_equal_pandas(spark, limit):
    """In a few blocks, and in blocks far smaller than the hot group."""
    data = skewed(1500).rename(columns={"companyfn": "g", "id": "day"})
    options = {"date": "day", "group": ["g"], "block_rows": limit}
    df = spark.createDataFrame(data).repartition(8)
    lagged = lag_features(df, "value", lags=[1, 7, 30], **options)
    both = rolling_features(lagged, "value", windows=[7, 30], **options).toPandas()
    both = both.sort_values("day").reset_index(drop=True)
    by = data.sort_values("day").groupby("g").value
    for n in (1, 7, 30):
        assert np.allclose(both[f"value_lag_{n}"], by.shift(n), equal_nan=True)
    for n in (7, 30):
        roll = by.transform(lambda x: x.rolling(n, min_periods=1).mean())
        std = by.transform(lambda x: x.rolling(n, min_periods=1).std())
        assert np.allclose(both[f"value_rolling_mean_{n}"], roll)
        assert np.allclose(both[f"value_rolling_std_{n}"], std, equal_nan=True, atol=1e-5)


def test_attach(spark):
    data = skewed()
    fact = spark.createDataFrame(data)
    figures = fact.groupBy("companyfn").agg(F.max("value").alias("top")).where("companyfn <> 't3'")
    got = attach(fact, figures, ["companyfn"]).toPandas().sort_values("id")
    want = data.groupby("companyfn").value.max().drop("t3")
    assert len(got) == len(data)
    assert np.allclose(got.top, got.companyfn.map(want), equal_nan=True)


def test_interior():
    assert interior(5) == [0.2, 0.4, 0.6, 0.8]


@pytest.mark.parametrize("margin,small", [(0.02, 20), (0.01, 1_000_000), (0.3, 5)])
def test_bracketed_quantiles_equal_numpy(spark, margin, small):
    """Large groups are bracketed, crowded brackets cut, narrow ones widened; small groups and nulls as before."""
    rng = np.random.default_rng(11)
    data = pd.concat([skewed(), pd.DataFrame({"companyfn": "smooth", "id": np.arange(3000), "value": rng.lognormal(0, 9, 3000)}),
                      pd.DataFrame({"companyfn": "two", "id": [1, 2], "value": [3.0, 4.0]})])
    fractions = [0.99, 0.2, 0.5, 0.0, 1.0]
    rows = spark.createDataFrame(data).repartition(8).unionByName(
        spark.createDataFrame([("two", 3, None), (None, 1, 7.5)], "companyfn string, id long, value double"))
    got = exact_quantiles(rows, ["companyfn"], F.col("value"), fractions, "q", margin, small).collect()
    assert len(got) == data.companyfn.nunique() + 1
    for row in got:
        values = data[data.companyfn == row["companyfn"]].value if row["companyfn"] else [7.5]
        assert np.allclose(row["q"], np.quantile(values, fractions), rtol=1e-12, atol=1e-9), row
    pooled = exact_quantiles(rows, [], F.col("value"), fractions, "q", margin, small).first()["q"]
    assert np.allclose(pooled, np.quantile([*data.value, 7.5], fractions), rtol=1e-12, atol=1e-9)
    empty = exact_quantiles(rows.limit(0), ["companyfn"], F.col("value"), fractions, "q", margin, small)
    assert empty.count() == 0


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """A sketch is only a guess: were it wrong, exact counts notice."""
    from salesmart.plans import ranking
    made = []
    bracketed = ranking._bracketed

    def wrong_at_first(values, keys, fractions, margin):
        made.append(margin)
        return bracketed(values, keys, [0.0 * f for f in fractions] if len(made) == 1 else fractions, margin)
    monkeypatch.setattr(ranking, "_bracketed", wrong_at_first)
    df = spark.range(5000).select(F.lit("t").alias("companyfn"), F.col("id").cast("double").alias("value"))
    assert exact_quantiles(df, ["companyfn"], F.col("value"), [0.5], "q", 0.01).first()["q"] == [2499.5]
    assert len(made) == 2


def test_quantiles_and_ranks_sort_once(spark):
    """No quantile sorts its values, and a rank is one exchange."""
    df = spark.createDataFrame(skewed())
    labelled = label_by_quantile(df, F.col("value"), "label", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in labelled
    placed = with_position(df, ["companyfn"], [F.col("value"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in placed and "hashpartitioning" not in placed
