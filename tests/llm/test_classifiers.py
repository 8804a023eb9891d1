"""Ids of any type, repeated ids, bounds and priors of the two classifiers."""

import pytest
from pyspark.sql import functions as F

from salesmart.llm import quality, toxicity
from salesmart.llm.common import one_row_an_id

TEXTS = [(i, ("you scum moron trash " if i % 4 == 0 else "a calm and pleasant day ") + f"word{i % 17} word{i % 5}")
         for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(0, 200, 3)],
                                 "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_ids_of_any_type(spark, docs, labels, kind):
    d, l = (x.withColumn("doc_id", F.col("doc_id").cast(kind)) for x in (docs, labels))
    toxic = toxicity.score_toxicity(d, toxicity.train_toxicity(d, l), ["doc_id"])
    good = quality.score_quality(d, quality.train_quality(d, l), ["doc_id"])
    for scored, wanted in ((toxic, lambda i: i % 4 == 0), (good, lambda i: i % 4 != 0)):
        assert all(r.predicted == wanted(int(r.doc_id)) for r in scored.collect())
        assert scored.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)


def test_repeated_ids_count_once(spark, docs, labels, monkeypatch):
    """A third of all rows under one id send one row to the fit."""
    hot = docs.unionByName(spark.range(100).select(F.lit(0).cast("long").alias("doc_id"), F.concat(
        F.lit("scum "), F.col("id")).alias("text")))
    assert one_row_an_id(hot).count() == 200 and one_row_an_id(hot.limit(0)).count() == 0
    taken = []
    for module in (toxicity, quality):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, fit=fit: taken.append(a) or fit(*a))
    toxicity.train_toxicity(hot, labels, max_positive=10, max_unlabelled=30)
    quality.train_quality(hot, labels, max_labelled=40)
    assert (len(taken[0][0]), len(taken[0][1]), len(taken[1][0])) == (10, 30, 40)
    again = toxicity.train_toxicity(hot.repartition(7), labels, max_positive=10, max_unlabelled=30)
    assert again.bias == toxicity.train_toxicity(hot, labels, max_positive=10, max_unlabelled=30).bias


def test_priors(docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: seen.append(prior))
    toxicity.train_toxicity(docs, labels)
    toxicity.train_toxicity(docs, labels, prior=1e-6)
    toxicity.train_toxicity(docs, labels.limit(0))
    assert seen == [17.05 / 68, 1e-6, 0.05]
    for prior in (0, 1, -1.0):
        with pytest.raises(ValueError):
            toxicity.train_toxicity(docs, labels, prior=prior)
