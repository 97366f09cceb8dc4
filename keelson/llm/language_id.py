"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (n-gram bucket x language) is broadcast; texts are scored in Arrow
batches, each as the sum of the matrix rows of its n-grams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import (
    fold_of,
    mix,
    replace_columns,
    small_batches,
    store,
    text_slices,
    texts_of,
)
from keelson.operators.quantiles import order_statistics

#: Rows per language that the model is fitted on (on average; chosen by a hash of the text).
ROWS_PER_LANGUAGE = 2_000
BUCKET_BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.05
UNKNOWN = "und"
#: The matrix has 2 ** BUCKET_BITS rows of four bytes per language: 256 MB at this many.
MOST_LANGUAGES = 1_000

#: Fewer labelled rows of a language teach no bound on how unusual its texts may be.
LEAST_ROWS_FOR_BOUND = 20
#: Languages whose bounds are looked for in one pass.
LANGUAGES_AT_ONCE = 50
#: The bound leaves out at most this share of them, the least usual.
SHARE_OUT = 0.001
#: From so many n-grams on the mean over a text is steady; shorter texts may stray further.
STEADY_NGRAMS = 300

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CELLS_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket, k]`` is log P(n-gram bucket | language k); ``prior[k]`` is log P(k).

    ``totals[k]`` counts the n-grams learned from, ``usual[k]`` is their mean log-likelihood, and
    ``allowed[k]`` how far below it a text's mean may be (see ``learn_bounds``).
    """

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    totals: np.ndarray
    usual: np.ndarray
    allowed: np.ndarray

    def shortfall(self, mean: np.ndarray, ngrams: np.ndarray, language) -> np.ndarray:
        """How far mean log-likelihoods of so many n-grams are below the usual one."""
        return (self.usual[language] - mean) * np.sqrt(np.minimum(ngrams / STEADY_NGRAMS, 1.0))


def _ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the n-grams of all texts, and the start of each text's run."""
    cleaned = [f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} " for text in texts]
    lengths = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
    raw = "".join(cleaned).encode("utf-32-le", "surrogatepass")
    codes = mix(np.frombuffer(raw, "<u4").astype(np.uint64) + np.uint64(1))
    starts = np.cumsum(lengths) - lengths
    rolled = codes
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :]
        if order not in ORDERS:
            continue
        # Text i has lengths[i] - order + 1 n-grams; those that run into the next text go.
        inside = np.ones(len(rolled), bool)
        for cut in range(1, order):
            ends = starts[1:] - cut
            inside[ends[ends >= 0]] = False
        runs = np.maximum(lengths - order + 1, 0)
        hashed = mix(rolled[inside] + np.uint64(order)) >> np.uint64(64 - BUCKET_BITS)
        yield hashed.astype(np.int64), np.cumsum(runs) - runs


def _labelled(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Rows with text and language, and of each language how many rows and distinct texts."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text is not null and lang is not null"
    )
    counted = (
        rows.groupBy("lang", F.xxhash64("text").alias("text"))
        .agg(F.count("*").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    return rows, {row["lang"]: (row["n"], row["texts"]) for row in counted}


def _chosen(
    rows: DataFrame, sizes: dict[str, tuple[int, int]], rows_per_language: int
) -> DataFrame:
    """About so many distinct texts of each language, by text hash; all of them if there are fewer."""
    return rows.where(_is_chosen(sizes, rows_per_language)).distinct()


def _is_chosen(sizes: dict[str, tuple[int, int]], rows_per_language: int) -> Column:
    share = F.lit(None).cast("double")
    for name in sorted(sizes):
        share = F.when(F.col("lang") == name, rows_per_language / sizes[name][1]).otherwise(share)
    # The upper hash bits as a number in [0, 1): a fixed choice, whatever the partitions are.
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    return draw < share


def fit_language_model(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on at most about ``rows_per_language`` texts of each language, chosen by text hash.

    Each distinct text counts once, so copies neither fill the choice nor keep a language out. Priors are counted over all rows. Rows without text or language teach nothing. A table with
    nothing to learn from gives a model that answers ``und``. More than MOST_LANGUAGES distinct
    languages are refused, as the matrix would outgrow a broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, sizes = _labelled(docs, text, lang)
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"More than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    buckets = 1 << BUCKET_BITS
    counts = np.zeros((buckets, len(languages)), np.float64)
    if languages:
        number = {name: i for i, name in enumerate(languages)}
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                names = batch.column(1).to_pylist()
                at = 0
                for part in text_slices(batch.column(0)):
                    texts = texts_of(part)
                    owner = [number[x] for x in names[at : at + len(texts)]]
                    at += len(texts)
                    for k in set(owner):
                        own = [t for t, o in zip(texts, owner, strict=True) if o == k]
                        for hashed, _ in _ngrams(own):
                            found = np.bincount(hashed, minlength=buckets)
                            seen[k] = seen[k] + found if k in seen else found
            for k, found in seen.items():
                bucket = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(bucket), k, np.int32)),
                        pa.array(bucket.astype(np.int32)),
                        pa.array(found[bucket].astype(np.int64)),
                    ],
                    ["k", "bucket", "n"],
                )

        totals = (
            _chosen(rows, sizes, rows_per_language)
            .mapInArrow(count, "k int, bucket int, n long")
            .groupBy("k", "bucket")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        counts[totals["bucket"].to_numpy(), totals["k"].to_numpy()] = totals["n"].to_numpy()
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * buckets)
    usual = (counts * weights).sum(0) / np.maximum(counts.sum(0), 1)
    total = max(sum(n for n, _ in sizes.values()), 1)
    prior = np.log(np.array([sizes[x][0] / total for x in languages], np.float64))
    no_bound = np.full(len(languages), np.inf)
    return LanguageModel(languages, weights.astype(np.float32), prior, counts.sum(0), usual, no_bound)


def learn_bounds(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """The model with ``allowed``: how unusual the labelled rows are, all of them.

    ``docs`` and ``rows_per_language`` are those of the fit. Each distinct text is judged once, by
    the counts of all others: what the model learned from it is taken out.
    """
    rows, sizes = _labelled(docs, text, lang)
    if not model.languages:
        return model
    spread = docs.sparkSession.sparkContext.broadcast(model)
    number = {name: i for i, name in enumerate(model.languages)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        buckets = len(model.weights)
        for batch in batches:
            ks, keys, shortfalls = [], [], []
            rest = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for value, name, learned, key in zip(texts_of(batch.column(0)), *rest, strict=True):
                if not any(map(str.isalpha, value)):
                    continue
                k = number[name]
                hashed = np.concatenate([own for own, _ in _ngrams([value])])
                bucket, times = np.unique(hashed, return_counts=True)
                whole = model.totals[k] + SMOOTHING * buckets
                own = times if learned else 0
                others = np.exp(model.weights[bucket, k].astype(np.float64)) * whole - own
                logs = np.log(np.maximum(others, SMOOTHING)) - np.log(whole - (len(hashed) if learned else 0))
                ks.append(k)
                keys.append(key)
                shortfalls.append(float(model.shortfall(logs @ times / len(hashed), len(hashed), k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int32()), pa.array(keys, pa.int64()), pa.array(shortfalls, pa.float64())],
                ["k", "key", "shortfall"],
            )

    learned = F.coalesce(_is_chosen(sizes, rows_per_language), F.lit(False))
    judged = rows.select("text", "lang", learned.alias("learned"), F.xxhash64("text").alias("key"))
    found = store(
        judged.mapInArrow(judge, "k int, key long, shortfall double")
        .groupBy("k", "key")
        .agg(F.min("shortfall").alias("shortfall"))
    )
    known = found.groupBy("k").agg(F.count("*").alias("n"), F.min("shortfall").alias("a"), F.max("shortfall").alias("z"))
    enough = [row for row in known.collect() if row["n"] >= LEAST_ROWS_FOR_BOUND]
    allowed = model.allowed.copy()
    for start in range(0, len(enough), LANGUAGES_AT_ONCE):
        part = {f"k{row['k']}": row for row in enough[start : start + LANGUAGES_AT_ONCE]}
        columns = found.select(*[F.when(F.col("k") == row["k"], F.col("shortfall")).alias(c) for c, row in part.items()])
        ranks = {c: [math.ceil((row["n"] - 1) * (1 - SHARE_OUT))] for c, row in part.items()}
        values = order_statistics(columns, ranks, {c: (row["a"], row["z"]) for c, row in part.items()})
        for c, row in part.items():
            allowed[row["k"]] = max(values[c][ranks[c][0]], 0.0)
    return replace(model, allowed=allowed)


def predicted_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct (lang_pred, score, usual) for each whole text; see ``identify_languages``.

    ``usual`` says whether the text's mean log-likelihood per n-gram is within the bound of its
    best language.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def annotated(array: pa.Array) -> pa.Array:
        model = shared.value
        names, scores, usual = [], [], []
        wide = max(len(model.languages), 1)
        # Gathering a row per n-gram is the largest array: bound its cells.
        for part in text_slices(array, max(_CELLS_AT_ONCE // wide, 1)):
            texts = texts_of(part)
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(model.languages)
            sums = np.tile(model.prior, (len(texts), 1))
            ngrams = np.zeros(len(texts), np.int64)
            own = [t for t, k in zip(texts, known, strict=True) if k]
            for hashed, starts in _ngrams(own) if own else ():
                # A text has at least one letter and a blank on either side: no run is empty.
                rows = model.weights[hashed].astype(np.float64)
                sums[known] += np.add.reduceat(rows, starts, axis=0)
                ngrams[known] += np.diff(starts, append=len(hashed))
            for total, n, found in zip(sums, ngrams, known, strict=True):
                if found:
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                    mean = (total[best] - model.prior[best]) / n
                    usual.append(bool(model.shortfall(mean, n, best) <= model.allowed[best]))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    usual.append(False)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(usual, pa.bool_())],
            ["lang_pred", "score", "usual"],
        )

    return arrow_udf(annotated, "lang_pred string, score double, usual boolean").asNondeterministic()(F.col(text))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (the posterior probability).

    A text that is null, empty or without a letter gets ``und`` and score 0. Equal posteriors go
    to the language that sorts first. Repeated rows are scored each; an empty table stays empty.
    Input columns named like the results are replaced.
    """
    scored = docs.select("*", predicted_language(docs, model, text).alias("_language"))
    return replace_columns(
        scored, lang_pred=F.col("_language.lang_pred"), score=F.col("_language.score")
    ).drop("_language")


def held_out_languages(documents: DataFrame) -> DataFrame:
    """Learn from two of three folds of ``doc_id`` and score every document."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_language_model(
        documents.where(fold_of(F.col("doc_id"), 3) != 1).select("text", "lang")
    )
    return identify_languages(
        documents.select("doc_id", held_out.alias("held_out"), "text"), model
    ).select("doc_id", "held_out", "lang_pred", "score")
