"""Text quality: logistic regression on hashed word n-grams, fitted by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dots.

A text is described by hashed words and word pairs, by the same for word
*shapes* (case, digits and signs of a word, runs collapsed, so that an unseen
word of a known kind is recognised), and by how often a word follows itself,
counts on a logarithmic scale.

Null and empty texts have no features and get the score of the intercept;
without labels every score is 0.5.  Repeated rows are scored alike.  Kept columns
must not be called ``score``, ``predicted`` or ``__text``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import SPACE, arrow_text, flat, mix, one_row_an_id, ship, slices, span_hashes, word_spans

DIMS = 1 << 20
MAX_LABELLED = 16000   # bound of the training sample, taken by the order of a hash of the id
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.3, 1.0

_byte = np.arange(256)
#: a byte's kind: upper 1, lower 2, digit 3, non-ASCII 4, each other sign its own
KIND = np.select([(_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122), (_byte >= 48) & (_byte <= 57),
                  _byte >= 128], [1, 2, 3, 2], 100 + (_byte % 128)).astype(np.uint8)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, feature, value = features(texts)
        margin = np.bincount(doc, weights=self.weights[feature] * value, minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), values scaled to length one in each text."""
    buf, offs = flat(texts)
    begin, end, firsts = word_spans(buf, offs, SPACE)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    word = span_hashes(buf, begin, end)
    kind = KIND[buf]
    kept = np.ones(len(buf), bool)
    kept[1:] = kind[1:] != kind[:-1]     # runs of one kind count once
    kept[begin] = True
    position = np.concatenate([[0], np.cumsum(kept)])
    shape = mix(span_hashes(kind[kept], position[begin], position[end]) + np.uint64(1))
    same_doc = doc[1:] == doc[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same_doc]
    shape_pair = mix(shape[:-1] * np.uint64(5) + shape[1:] + np.uint64(2))[same_doc]
    again = ((word[1:] == word[:-1]) & same_doc)
    repeat = np.full(int(again.sum()), 77, np.uint64)
    where = np.concatenate([doc, doc[1:][same_doc], doc, doc[1:][same_doc], doc[1:][again]])
    what = np.concatenate([word, pair, shape, shape_pair, repeat])
    keys, counts = np.unique(where.astype(np.int64) * DIMS + (what & np.uint64(DIMS - 1)).astype(np.int64),
                             return_counts=True)
    doc, feature = keys // DIMS, keys % DIMS
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=len(texts)))
    return doc, feature, value / norm[doc]


def _feature_rows(batches):
    for part in slices(batches):
        doc, feature, value = features(arrow_text(part.column("text")))
        bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
        spans = list(zip(bounds[:-1], bounds[1:]))
        yield pa.RecordBatch.from_arrays(
            [part.column("place"), part.column("label"),
             pa.array([feature[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
             pa.array([value[a:b].astype(np.float32).tobytes() for a, b in spans], pa.binary())],
            names=["place", "label", "features", "vals"])


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> QualityModel:
    """FTRL-proximal over the examples in the given order; feature DIMS is the intercept."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def leader(i):
        out = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where((np.abs(z[i]) <= L1) & (i < DIMS), 0, out)

    for _ in range(epochs):
        for index, value, label in examples:
            index, value = np.append(index.astype(np.int64), DIMS), np.append(value, 1.0)
            w = leader(index)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -40, 40))) - label) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    w = leader(np.arange(DIMS + 1))
    return QualityModel(w[:DIMS], float(w[DIMS]))


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on documents (doc_id, text) with labels (doc_id, quality).

    Runs at once: one job that returns the hashed n-grams of at most
    ``max_labelled`` labelled texts, one for an id; of several rows with one id,
    that whose text's hash is least.  Ids may be of any type.  The examples are
    taken in the order of a hash of the id.
    """
    ship(docs.sparkSession)
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
              .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = one_row_an_id(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "label")
    rows = (rows.select(F.xxhash64("doc_id").alias("place"), "text", "label")
            .mapInArrow(_feature_rows, "place long, label int, features binary, vals binary").collect())
    rows.sort(key=lambda r: (r.place, bytes(r.features)))
    return fit([(np.frombuffer(r.features, np.uint32), np.frombuffer(r.vals, np.float32), r.label) for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, its score and the predicted class."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32), model.bias))   # DIMS numbers, whatever the corpus

    def score(batches):
        fitted = QualityModel(*shared.value)
        for part in slices(batches, "__text"):
            scores = fitted.scores(arrow_text(part.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")
    return chosen.mapInArrow(score, schema)
