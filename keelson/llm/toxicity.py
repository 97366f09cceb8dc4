"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning rates are kept per coordinate; the L1 term leaves most weights at exactly zero, so what
is broadcast for scoring is a short list of buckets and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import (
    byte_view,
    fold_of,
    hash_spans,
    mix,
    replace_columns,
    small_batches,
    text_slices,
    texts_at,
    texts_of,
    word_spans,
)
from keelson.llm.labelled import labelled_texts

#: Labelled rows that the model is fitted on at most.
TRAINING_ROWS = 12_000
BUCKET_BITS = 20
#: Pairs of words (i, i + gap) beside the single words: n-grams of two and skip-grams.
GAPS = (1, 2)
#: Longer words also count by their first bytes, so that rare endings of a word are recognised.
STEMS = (5, 7)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


@dataclass(frozen=True)
class ToxicityModel:
    """The buckets whose weight is not zero, their weights, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def dense(self) -> np.ndarray:
        """All weights by bucket: made once in each Python process that scores."""
        table = np.zeros(1 << BUCKET_BITS, np.float64)
        table[self.buckets] = self.weights
        return table


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs of all texts, sorted: text numbers and buckets."""
    lowered = pa.array([t.lower() for t in texts], pa.large_string())
    data, offsets = byte_view(lowered)
    starts, ends = word_spans(_LETTER[data], offsets)
    words, owner = hash_spans(data, starts, ends), texts_at(starts, offsets)
    pairs = [(words, owner)]
    for size in STEMS:
        longer = ends - starts > size
        stems = hash_spans(data, starts[longer], starts[longer] + size)
        pairs.append((stems + np.uint64(size), owner[longer]))
    for gap in GAPS:
        same = owner[:-gap] == owner[gap:]
        pair = words[:-gap] * np.uint64(2 * gap + 1) + mix(words[gap:] + np.uint64(gap))
        pairs.append((pair[same], owner[:-gap][same]))
    hashed = np.concatenate([mix(h) >> np.uint64(64 - BUCKET_BITS) for h, _ in pairs]).astype(np.int64)
    keys = np.unique((np.concatenate([o for _, o in pairs]) << BUCKET_BITS) | hashed)
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def _train(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the examples in the given order; the last coordinate is the bias."""
    size = (1 << BUCKET_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    share = min(max(sum(y for _, y in examples) / max(len(examples), 1), 1e-3), 1 - 1e-3)
    offset = float(np.log(share / (1 - share)))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        shrunk = np.sign(own) * L1 - own
        return np.where(np.abs(own) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, y in examples:
            at = np.append(at, size - 1)
            now = weights(at)
            p = 1 / (1 + np.exp(-np.clip(now.sum() + offset, -30, 30)))
            gradient = p - y
            before = np.sqrt(n[at])
            n[at] += gradient * gradient
            z[at] += gradient - (np.sqrt(n[at]) - before) / ALPHA * now
    found = weights(np.arange(size))
    buckets = np.flatnonzero(found[:-1])
    return buckets, found[buckets], float(found[-1] + offset)


def fit_toxicity_model(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label: str = "toxic"
) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents, in one task that reads just these.

    Null texts count as empty ones, null labels teach nothing, a document that is labelled twice
    is two examples. Without any example every score is one half.
    """
    small_batches(docs.sparkSession)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            ys, at = batch.column(1).to_pylist(), 0
            for part in text_slices(batch.column(0)):
                owner, hashed = _features(texts_of(part))
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(len(part)):
                    examples.append((hashed[cuts[i] : cuts[i + 1]].astype(np.int32), ys[at + i]))
                at += len(part)
        buckets, weights, bias = _train(examples) if examples else (np.zeros(0, int), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(buckets, -1).astype(np.int32)),
                pa.array(np.append(weights, bias)),
            ],
            ["bucket", "weight"],
        )

    chosen = labelled_texts(docs, labels, label, rows)
    table = (
        chosen.repartition(1)
        .sortWithinPartitions("order", "text", "label")
        .select("text", "label")
        .mapInArrow(fitted, "bucket int, weight double")
        .toArrow()
    )
    buckets, weights = table["bucket"].to_numpy(), table["weight"].to_numpy()
    bias = weights[buckets < 0].sum() if len(buckets) else 0.0
    return ToxicityModel(buckets[buckets >= 0], weights[buckets >= 0], float(bias))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """All columns plus ``score`` in [0, 1] and ``predicted`` (1 from ``threshold`` on).

    Whole texts are scored; a null or empty text has the score of the bias. Equal texts get equal
    scores. Input columns named like the results are replaced; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def toxic(array: pa.Array) -> pa.Array:
        table = shared.value.dense
        scores = [np.zeros(0)]
        for part in text_slices(array):
            owner, hashed = _features(texts_of(part))
            sums = np.bincount(owner, table[hashed], minlength=len(part)) + shared.value.bias
            scores.append(1 / (1 + np.exp(-np.clip(sums, -50, 50))))
        return pa.array(np.concatenate(scores))

    scored = docs.select("*", arrow_udf(toxic, "double").asNondeterministic()(F.col(text)).alias("_score"))
    return replace_columns(
        scored,
        score=F.col("_score"),
        predicted=(F.col("_score") >= threshold).cast("int"),
    ).drop("_score")


def held_out_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from three of four folds of ``doc_id`` and score every document."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_toxicity_model(documents, labels.where(fold_of(F.col("doc_id"), 4) != 2))
    return score_toxicity(
        documents.select("doc_id", held_out.alias("held_out"), "text"), model
    ).select("doc_id", "held_out", "score", "predicted")
