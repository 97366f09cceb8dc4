"""Quality: votes of the nearest labelled documents in a latent-semantic space.

A text is a bag of hashed terms: the shapes of its words (case, digits and signs, with runs
collapsed), pairs of neighbouring shapes, returning words, line shapes and common words. A
truncated singular value decomposition of the weighted term counts of bounded labelled rows gives
the latent space. Their unit vectors are broadcast; every document is compared with all of them by
blocked matrix products, and its nearest labels vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import (
    _BLANK,
    byte_view,
    fold_of,
    hash_spans,
    hashed_words,
    mix,
    replace_columns,
    small_batches,
    text_slices,
    texts_at,
    word_spans,
)
from keelson.llm.labelled import labelled_texts

#: Labelled documents that vote at most: their vectors are what is broadcast (1 MB).
TRAINING_ROWS = 4_096
#: Hashed terms, latent dimensions, voting neighbours, and the power that sharpens a cosine.
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2_048, 64, 32, 8
THRESHOLD = 0.7
#: Labelled rows that the driver unpacks at once while fitting.
ROWS_AT_ONCE = 256
#: How far back a word is looked for to count as returning.
LOOK_BACK = 8

# Byte classes of word shapes: capitals, small letters, digits; other signs stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x80:] = 0x61
_CLASS[0x30:0x3A] = 0x39


@dataclass(frozen=True)
class QualityModel:
    """Term weights, the projection to the latent space, and the labelled unit vectors."""

    term_weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shape of every word, and the text it belongs to."""
    starts, _ = word_spans(~_BLANK[data], offsets)
    owner = texts_at(starts, offsets)
    kinds = _CLASS[data]
    kinds[_BLANK[data]] = 0x20
    # Keep one byte of each run of a class; the word starts move with it.
    keep = np.concatenate(([True], kinds[1:] != kinds[:-1])) if len(kinds) else np.zeros(0, bool)
    keep[starts] = True
    short = kinds[keep]
    place = np.cumsum(keep) - 1
    begin = place[starts]
    blank = np.flatnonzero(short == 0x20)
    nearest = np.searchsorted(blank, begin)
    ends = np.where(nearest < len(blank), blank[np.minimum(nearest, max(len(blank) - 1, 0))], len(short)) if len(blank) else np.full(len(begin), len(short))
    ends = np.minimum(ends, np.append(begin[1:], len(short)))
    return hash_spans(short, begin, ends), owner


def term_counts(array: pa.Array) -> np.ndarray:
    """Counts of the hashed terms, one row per text (null is the empty text)."""
    data, offsets = byte_view(array)
    texts = len(offsets) - 1
    words, owner = hashed_words(data, offsets)
    shapes, _ = _shapes(data, offsets)
    terms = [(owner, mix(shapes + np.uint64(1))), (owner, mix(words + np.uint64(2)))]
    same = owner[1:] == owner[:-1]
    pair = mix(shapes[:-1] * np.uint64(31) + shapes[1:] + np.uint64(3))
    terms.append((owner[1:][same], pair[same]))
    # Distance to the nearest earlier equal word among the last few.
    back = np.zeros(len(words), np.uint64)
    for gap in range(LOOK_BACK, 0, -1):
        equal = (words[gap:] == words[:-gap]) & (owner[gap:] == owner[:-gap])
        back[gap:][equal] = gap
    terms.append((owner, mix(back + np.uint64(1_000))))
    # Whole lines that occurred before in their text.
    starts, ends = word_spans(data != 0x0A, offsets)
    lines, at = hash_spans(data, starts, ends), texts_at(starts, offsets)
    order = np.lexsort((lines, at))
    again = np.zeros(len(lines), bool)
    again[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    terms.append((at, mix(again.astype(np.uint64) + np.uint64(2_000))))
    size = np.bincount(owner, minlength=texts)
    terms.append((np.arange(texts), mix(np.log2(size + 1.0).astype(np.uint64) + np.uint64(3_000))))
    rows = np.concatenate([o for o, _ in terms])
    columns = (np.concatenate([h for _, h in terms]) % np.uint64(TERMS)).astype(np.int64)
    return np.bincount(rows * TERMS + columns, minlength=texts * TERMS).reshape(texts, TERMS)


def _weighted(counts: np.ndarray, term_weights: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    weighted = np.sqrt(share) * term_weights
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_quality_model(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label: str = "quality"
) -> QualityModel:
    """Fit on at most ``rows`` labelled documents; their term weights and vectors are the model.

    Null texts count as empty ones, null labels teach nothing. Without any label every score is
    one half.
    """
    small_batches(docs.sparkSession)
    chosen = labelled_texts(docs, labels, label, rows)

    def count(array: pa.Array) -> pa.Array:
        found = [term_counts(part) for part in text_slices(array)]
        counts = np.concatenate(found) if found else np.zeros((0, TERMS), np.int64)
        packed = [row.astype("<u4").tobytes() for row in counts]
        return pa.array(packed, pa.binary())

    # TERMS counts of four bytes per row: 32 MB for 4,096 rows.
    table = (
        chosen.select("order", "label", arrow_udf(count, "binary")("text").alias("counts"))
        .toArrow()
        .sort_by([("order", "ascending"), ("label", "ascending"), ("counts", "ascending")])
    )
    if not len(table):
        empty = np.zeros((0, DIMENSIONS))
        return QualityModel(np.ones(TERMS), np.zeros((TERMS, DIMENSIONS)), empty, np.zeros(0))
    labels_of = table["label"].to_numpy().astype(np.float64)

    def blocks() -> Iterator[np.ndarray]:
        # The driver never holds more than one block of counts beside the packed rows.
        for at in range(0, len(table), ROWS_AT_ONCE):
            raw = b"".join(table["counts"].slice(at, ROWS_AT_ONCE).to_pylist())
            yield np.frombuffer(raw, "<u4").reshape(-1, TERMS)

    held_by = sum((counts > 0).sum(0) for counts in blocks())
    term_weights = np.log((1 + len(table)) / (1 + held_by)) + 1
    products = np.zeros((TERMS, TERMS))
    for counts in blocks():
        weighted = _weighted(counts, term_weights)
        products += weighted.T @ weighted
    # The right singular vectors are the eigenvectors of the term-by-term product.
    _, vectors = np.linalg.eigh(products)
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS])
    latent = [_unit(_weighted(counts, term_weights) @ projection) for counts in blocks()]
    model = QualityModel(term_weights, projection, np.concatenate(latent), labels_of)
    del table
    pa.default_memory_pool().release_unused()
    return model


def _votes(rows: np.ndarray, model: QualityModel) -> np.ndarray:
    """Share of the nearest labels' weight that says 1, for each row of latent unit vectors.

    Cosines are rounded far above the error of the products, and the first labels win ties, so a
    row's votes do not depend on the rows scored with it.
    """
    if not len(model.labels):
        return np.full(len(rows), 0.5)
    cosines = np.round(rows @ model.vectors.T, 9)
    most = min(NEIGHBOURS, len(model.labels))
    least = -np.partition(-cosines, most - 1, axis=1)[:, most - 1 : most]
    nearer, ties = cosines > least, cosines == least
    ties &= np.cumsum(ties, axis=1) <= most - nearer.sum(1, keepdims=True)
    near = np.nonzero(nearer | ties)[1].reshape(len(rows), most)
    weight = np.clip(np.take_along_axis(cosines, near, 1), 1e-6, 1) ** SHARPNESS
    return ((weight * model.labels[near]).sum(1) / weight.sum(1)).clip(0, 1)


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """All columns plus ``score`` in [0, 1] and ``predicted`` (1 from ``threshold`` on).

    Whole texts are scored; null and empty texts are scored alike, as texts without terms. Equal
    texts get equal scores. Input columns named like the results are replaced; an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def quality(array: pa.Array) -> pa.Array:
        model = shared.value
        scores = [np.zeros(0)]
        for part in text_slices(array):
            latent = _unit(_weighted(term_counts(part), model.term_weights) @ model.projection)
            scores.append(_votes(latent, model))
        return pa.array(np.concatenate(scores).astype(np.float64))

    scored = docs.select("*", arrow_udf(quality, "double").asNondeterministic()(F.col(text)).alias("_score"))
    return replace_columns(
        scored,
        score=F.col("_score"),
        predicted=(F.col("_score") >= threshold).cast("int"),
    ).drop("_score")


def held_out_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from three of four folds of ``doc_id`` and score every document."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_quality_model(documents, labels.where(fold_of(F.col("doc_id"), 4) != 2))
    return score_quality(
        documents.select("doc_id", held_out.alias("held_out"), "text"), model
    ).select("doc_id", "held_out", "score", "predicted")
