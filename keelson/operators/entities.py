"""Entity resolution: score, decide, tune the threshold, evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import (
    blank,
    exact_round,
    location_overlap,
    matching_ratios,
    name_variants,
    normalized_name,
)
from keelson.operators.evaluation import count_above, f1
from keelson.operators.quality import require_splits

# --- fixed values -----------------------------------------------------------------------------
THRESHOLDS = (0.68, 0.72, 0.76, 0.80, 0.84, 0.88, 0.92)
BASELINE, RESOLVER = "Exact-name baseline", "Alias + fuzzy + location"


def best_name(mention: Column, candidate_name: Column, aliases: Column) -> Column:
    """``struct<similarity, name>`` of the most similar name; ties go to the largest name."""
    names = name_variants(candidate_name, aliases)
    wanted = normalized_name(blank(mention))
    ratios = matching_ratios(
        F.transform(names, lambda _: wanted), F.transform(names, lambda n: normalized_name(n))
    )
    scored = F.arrays_zip(ratios.alias("similarity"), names.alias("name"))
    return F.array_max(scored)


def score_entities(pairs: DataFrame) -> DataFrame:
    """Add ``resolver_score`` and ``best_alias`` to mention/candidate pairs."""
    optional = {
        c: F.lit("")
        for c in ("aliases", "candidate_location", "context_location")
        if c not in pairs.columns
    }
    scored = pairs.withColumns(optional) if optional else pairs
    scored = scored.withColumn(
        "_best", best_name(F.col("mention"), F.col("candidate_name"), F.col("aliases"))
    )
    overlap = location_overlap(F.col("candidate_location"), F.col("context_location"))
    return scored.withColumns(
        {
            "resolver_score": exact_round(0.85 * F.col("_best.similarity") + 0.15 * overlap, 4),
            "best_alias": F.col("_best.name"),
        }
    ).drop("_best", *optional)


def resolve_entities(pairs: DataFrame, threshold: float = 0.78) -> DataFrame:
    """Scores, and ``matched`` where the rounded score reaches the threshold."""
    return score_entities(pairs).withColumn("matched", F.col("resolver_score") >= threshold)


def exact_match(mention: Column, candidate_name: Column) -> Column:
    return normalized_name(mention) == normalized_name(candidate_name)


def threshold_scores(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """F1 and precision on the validation rows at each threshold; one pass over the rows."""
    counts = count_above(
        scored.filter(F.col("split") == "validation"),
        "resolver_score",
        list(thresholds),
        actual="expected_match",
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(F.col("positives"), F.lit(1))
    return counts.select(
        "threshold", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1")
    )


def tune_threshold(scored: DataFrame, thresholds=THRESHOLDS) -> float:
    """Best F1, then precision, then the larger threshold."""
    require_splits(scored, "split", ["validation"], "Entity threshold tuning")
    best = threshold_scores(scored, thresholds).agg(
        F.max(F.struct("f1", "precision", "threshold")).alias("best")
    )
    return best.select("best.threshold").first()[0]


def entity_predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumns(
        {
            "baseline_prediction": exact_match(F.col("mention"), F.col("candidate_name")).cast("int"),
            "resolver_prediction": (F.col("resolver_score") >= threshold).cast("int"),
        }
    )


def entity_metrics(predictions: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and errors of both methods on the test rows."""
    methods = F.array(
        F.struct(F.lit(BASELINE).alias("method"), F.col("baseline_prediction").alias("predicted")),
        F.struct(F.lit(RESOLVER).alias("method"), F.col("resolver_prediction").alias("predicted")),
    )
    rows = predictions.filter(F.col("split") == "test").select("expected_match", F.inline(methods))
    said, true = F.col("predicted") == 1, F.col("expected_match") == 1
    tp = F.count_if(said & true)
    precision = tp / F.greatest(F.count_if(said), F.lit(1))
    recall = tp / F.greatest(F.count_if(true), F.lit(1))
    return rows.groupBy("method").agg(
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        F.count_if(F.col("predicted") != F.col("expected_match")).alias("errors"),
        F.count("*").alias("test_rows"),
        F.first(F.when(F.col("method") == RESOLVER, F.lit(threshold))).alias("selected_threshold"),
    )


def evaluate_entity_resolution(
    benchmark: DataFrame, threshold: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(metrics, predictions)``; names are compared once, also when tuning."""
    scored = score_entities(benchmark)
    require_splits(scored, "split", ["test"], "Entity evaluation")
    if threshold is None:
        threshold = tune_threshold(scored)
    predictions = entity_predictions(scored, threshold)
    return entity_metrics(predictions, threshold), predictions
