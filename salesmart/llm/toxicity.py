"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labelled examples; all others are unlabelled,
whatever a label table says about them.  With the class prior p the risk of a
classifier g is

    p * E_pos[l(g)]  +  max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

The second term estimates the loss on true negatives; whenever it turns
negative the model has begun to learn the positives by heart, and the step
goes the other way.  g is linear in the presence of hashed words.

Null and empty texts have no words and get the score of the intercept.  With
no toxic example at all every score is the prior.  Repeated rows are scored
alike.  Extra columns are ignored by the fit and kept by ``score_toxicity``; those
kept must not be called ``score``, ``predicted`` or ``__text``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import NO_LETTER, arrow_text, one_row_an_id, ship, slices, words

DIMS = 1 << 20
#: bounds of the training sample (rows taken by the order of a hash of the id)
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
STEPS, SPARSITY = 200, 5e-4


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, feature = features(texts)
        margin = np.bincount(doc, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed word) for every word that a text holds, once each."""
    h, firsts = words(texts, NO_LETTER)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    keys = np.unique(doc * DIMS + (h & np.uint64(DIMS - 1)).astype(np.int64))
    return keys // DIMS, keys % DIMS


def _feature_rows(batches):
    for part in slices(batches):
        doc, feature = features(arrow_text(part.column("text")))
        bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [part.column("positive"), pa.array([feature[a:b].astype(np.uint32).tobytes()
                                                for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
            names=["positive", "features"])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicModel:
    """Minimise the non-negative risk plus a sparsity term by accelerated proximal steps."""
    weights = np.zeros(DIMS)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return ToxicModel(weights, start)
    texts = positive + unlabelled
    n_pos, n_unl = len(positive), len(unlabelled)
    feature = np.concatenate(texts).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    held = np.bincount(feature, minlength=DIMS)
    used, column = np.unique(feature, return_inverse=True)
    rarity = np.log((len(texts) + 1) / held[used])       # words that all texts hold say little
    value = rarity[column]
    is_pos = np.arange(len(texts)) < n_pos
    share = np.where(is_pos, prior / n_pos, 1 / n_unl)   # of each text in the risk

    def times(v):
        return np.bincount(doc, weights=value * v[column], minlength=len(texts))

    def back(slope):
        return np.bincount(column, weights=value * slope[doc], minlength=len(used))

    v, top = np.ones(len(used)), 1.0
    for _ in range(10):                                  # the largest curvature bounds the step
        v = back(share * times(v)).astype(np.float64)
        top = max(float(np.linalg.norm(v)), 1e-9)
        v /= top
    rate = 1 / (0.5 * top + 1)
    w = ahead = np.zeros(len(used))
    b = ahead_b = start
    pace = 1.0
    for _ in range(STEPS):
        margin = times(ahead) + ahead_b
        prob = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        as_negative = np.logaddexp(0, margin)
        rest = as_negative[~is_pos].mean() - prior * as_negative[is_pos].mean()
        up = np.where(is_pos, -share * (1 - prob), 0)                 # slope of p E_pos[l(g)]
        down = np.where(is_pos, -share * prob, share * prob)          # slope of the second term
        slope = up + down if rest >= 0 else -down
        new = ahead - rate * back(slope)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * SPARSITY, 0)
        new_b = ahead_b - rate * slope.sum()
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_b = new + (pace - 1) / next_pace * (new - w), new_b + (pace - 1) / next_pace * (new_b - b)
        w, b, pace = new, new_b, next_pace
    weights[used] = w * rarity
    return ToxicModel(weights, float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None,
                   max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicModel:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic).

    Runs at once: one small job for the prior and one that returns the hashed
    words of at most ``max_positive + max_unlabelled`` texts, one for an id; of
    several rows with one id, that whose text's hash is least.  Ids may be of any
    type.  ``prior``, above 0 and below 1, is taken from the label table when not
    given: the share of toxic ones among the labels, which count beside one label
    of 0.05, so that it is never 0 or 1: (k + 0.05) / (n + 1) for k of n.
    """
    ship(docs.sparkSession)
    known = (labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    if prior is None:
        toxic, total = known.agg(F.count_if(F.col("toxic") == 1), F.count(F.lit(1))).first()
        prior = (toxic + 0.05) / (total + 1)
    if not 0 < prior < 1:
        raise ValueError(f"a prior lies between 0 and 1: {prior}")
    order = F.xxhash64("doc_id")
    toxic = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive)
    # the ids first, so that texts of rows not taken are never moved
    others = (docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
              .join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
              .orderBy(order, "doc_id").limit(max_unlabelled))
    chosen = toxic.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    rows = one_row_an_id(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "positive")  # 12,000 ids
    rows = rows.select("text", "positive").mapInArrow(_feature_rows, "positive boolean, features binary").collect()
    both = {side: sorted(bytes(r.features) for r in rows if r.positive is side) for side in (True, False)}
    arrays = {side: [np.frombuffer(x, np.uint32) for x in found] for side, found in both.items()}
    return fit(arrays[True], arrays[False], prior)


def score_toxicity(docs: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, its score and the predicted class."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.bias))   # DIMS numbers, whatever the corpus

    def score(batches):
        fitted = ToxicModel(*shared.value)
        for part in slices(batches, "__text"):
            scores = fitted.scores(arrow_text(part.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")
    return chosen.mapInArrow(score, schema)
