"""Error analysis, threshold choice, ranking metrics, calibration, class metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import exact_round
from keelson.operators.prefix import running_totals
from keelson.operators.quantiles import exact_quantiles
from keelson.session import require_columns

# --- fixed values -----------------------------------------------------------------------------
FIRST_THRESHOLD, PAST_THRESHOLD, THRESHOLD_STEP = 0.15, 0.86, 0.05
CONFIDENCE_BANDS = ((0.5, "low"), (0.75, "medium"), (1.0, "high"))
PROBABILITY_BANDS = (
    (0.2, "0–20%"),
    (0.4, "20–40%"),
    (0.6, "40–60%"),
    (0.8, "60–80%"),
    (1.0, "80–100%"),
)
SMALLEST_PROBABILITY = 2.220446049250313e-16


def _band(value: Column, bands) -> Column:
    """Bands closed on the right; outside of (-0.01, 1] there is none."""
    chosen = F.lit(None).cast("string")
    for upper, name in reversed(bands):
        chosen = F.when(value <= upper, F.lit(name)).otherwise(chosen)
    return F.when(value > -0.01, chosen)


def sweep_thresholds() -> list[float]:
    """0.15, 0.20, … 0.85 with the rounding errors of repeated stepping from the second value."""
    step = (FIRST_THRESHOLD + THRESHOLD_STEP) - FIRST_THRESHOLD
    count = -int(-(PAST_THRESHOLD - FIRST_THRESHOLD) // THRESHOLD_STEP)
    return [FIRST_THRESHOLD + i * step for i in range(count)]


def classification_errors(predictions: DataFrame) -> DataFrame:
    """Wrong rows with ``error_type`` and ``confidence_band``, most confident first."""
    require_columns(predictions, ("actual", "predicted", "confidence"), "prediction")
    return (
        predictions.filter(F.col("actual") != F.col("predicted"))
        .withColumns(
            {
                "error_type": F.concat(
                    F.col("actual").cast("string"), F.lit(" → "), F.col("predicted").cast("string")
                ),
                "confidence_band": _band(F.col("confidence"), CONFIDENCE_BANDS),
            }
        )
        .orderBy(F.desc("confidence"))
    )


def risk_outcomes(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    require_columns(predictions, ("actual", "probability"), "risk")
    alert = F.col("probability") >= threshold
    return predictions.withColumns(
        {
            "predicted": alert.cast("int"),
            "error_type": F.when((F.col("actual") == 0) & alert, "False positive")
            .when((F.col("actual") == 1) & ~alert, "False negative")
            .otherwise("Correct"),
            "probability_band": _band(F.col("probability"), PROBABILITY_BANDS),
        }
    )


def risk_prediction_errors(
    predictions: DataFrame, threshold: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Counts per band and outcome; the errors, farthest from the threshold first."""
    detailed = risk_outcomes(predictions, threshold)
    summary = (
        detailed.filter(F.col("probability_band").isNotNull())
        .groupBy("probability_band", "error_type")
        .count()
    )
    errors = (
        detailed.filter(F.col("error_type") != "Correct")
        .withColumn("distance_from_threshold", F.abs(F.col("probability") - threshold))
        .orderBy(F.desc("distance_from_threshold"))
    )
    return summary, errors


def count_above(
    predictions: DataFrame,
    score: str,
    thresholds: list[float],
    actual: str = "actual",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per threshold (and group): true and false positives, and all positives.

    Rows are counted once by how many thresholds they reach; the thresholds are then sums over
    that table of at most ``2 * (len(thresholds) + 1)`` rows. No grid is joined to the rows.
    """
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t))
    positive = F.col(actual).cast("int") == 1
    counted = predictions.groupBy(*by, reached.alias("reached"), positive.alias("positive")).agg(
        F.count("*").alias("n")
    )

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    cells = [
        F.struct(
            F.lit(t).alias("threshold"),
            total((F.col("reached") > i) & F.col("positive")).alias("true_positives"),
            total((F.col("reached") > i) & ~F.col("positive")).alias("false_positives"),
            total(F.col("positive")).alias("positives"),
        )
        for i, t in enumerate(thresholds)
    ]
    return counted.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def threshold_sweep(
    predictions: DataFrame,
    false_negative_cost: float = 5.0,
    false_positive_cost: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, misses, false alerts and their cost at each alert threshold.

    Of all rows, or of each group of ``by``, such as each model.
    """
    tp, fp, positives = F.col("true_positives"), F.col("false_positives"), F.col("positives")
    misses = positives - tp
    return count_above(predictions, "probability", sweep_thresholds(), by=by).select(
        *by,
        exact_round(F.col("threshold"), 2).alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, positives).alias("recall"),
        fp.alias("false_positives"),
        misses.alias("false_negatives"),
        (misses * false_negative_cost + fp * false_positive_cost).alias("relative_decision_cost"),
    )


def lowest_cost_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row of the lowest cost (of each group of ``by``), ties to the smaller threshold."""
    rest = [c for c in sweep.columns if c not in (*by, "relative_decision_cost", "threshold")]
    row = F.min(F.struct("relative_decision_cost", "threshold", *rest)).alias("row")
    best = sweep.groupBy(*by).agg(row).filter(F.col("row").isNotNull())
    return best.select(*by, "row.*").select(*sweep.columns)


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def probability_metrics(predictions: DataFrame) -> DataFrame:
    """ROC-AUC, average precision, Brier, log loss and the metrics at 0.5, per ``model``.

    Rows are first counted per distinct score, so ties and hot scores cost nothing; the running
    counts over the scores are two-level (``running_totals``).
    """
    p, y = F.col("probability"), F.col("actual").cast("double")
    alert, positive = p >= 0.5, F.col("actual") == 1
    safe = F.greatest(F.lit(SMALLEST_PROBABILITY), F.least(F.lit(1 - SMALLEST_PROBABILITY), p))
    tp = F.count_if(alert & positive)
    precision = _ratio(tp, F.count_if(alert))
    recall = _ratio(tp, F.count_if(positive))
    pointwise = predictions.groupBy("model").agg(
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(-F.when(positive, F.log(safe)).otherwise(F.log1p(-safe))).alias("log_loss"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        F.count("*").alias("test_rows"),
    )
    scores = predictions.groupBy("model", "probability").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_totals(
        scores, [F.desc("probability")], {"tp": "pos", "fp": "neg"}, keys=["model"]
    )
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    positives, negatives = F.sum("pos"), F.sum("neg")
    ranking = ranked.groupBy("model").agg(
        F.when((positives > 0) & (negatives > 0), area / F.greatest(positives * negatives, F.lit(1)))
        .alias("roc_auc"),
        _ratio(step, positives).alias("pr_auc"),
    )
    return ranking.join(pointwise, "model").select(
        "model", "roc_auc", "pr_auc", "brier_score", "log_loss", "precision", "recall", "f1", "test_rows"
    )


def reliability_curve(
    predictions: DataFrame, bins: int = 5, models: Sequence[str] | None = None
) -> DataFrame:
    """Mean predicted and observed rate in quantile bins of one model's probabilities.

    With ``models``, of each of these, in a column ``model``; all quantiles are found together.
    """
    inner = [i / bins for i in range(1, bins)]
    p = F.col("probability")
    if models is None:
        by, given = [], predictions.select("actual", p, p.alias("_p0"))
    else:
        by = ["model"]
        own = [F.when(F.col("model") == m, p).alias(f"_p{i}") for i, m in enumerate(models)]
        given = predictions.filter(F.col("model").isin(*models)).select("model", "actual", p, *own)
    parts = [c for c in given.columns if c.startswith("_p")]
    edges = exact_quantiles(given, {c: inner for c in parts})
    below = [
        F.size(F.filter(F.array(*[F.lit(e) for e in edges[c]]), lambda e: e < p)) for c in parts
    ]
    bin_ = F.coalesce(*[F.when(F.col(c).isNotNull(), b) for c, b in zip(parts, below)])
    return (
        given.groupBy(*by, bin_.alias("bin"))
        .agg(
            F.avg("probability").alias("mean_predicted_probability"),
            F.avg(F.col("actual").cast("double")).alias("observed_rate"),
            F.count("*").alias("rows"),
        )
        .orderBy(*by, "bin")
    )


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 per ``model``, over labels seen on either side."""
    confusion = predictions.groupBy("model", "actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("chosen"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hits")),
    )
    per_label = (
        confusion.select("model", F.inline(sides))
        .groupBy("model", "label")
        .agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits"))
        .withColumn("f1", 2 * F.col("hits") / (F.col("support") + F.col("chosen")))
    )
    rows = F.sum("support")
    return per_label.groupBy("model").agg(
        (F.sum("hits") / rows).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / rows).alias("weighted_f1"),
        rows.alias("test_articles"),
    )


def confusion_matrix(predictions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Rows ``actual``, one column per predicted label, counts."""
    grouped = predictions.groupBy("actual")
    pivoted = grouped.pivot("predicted", labels) if labels else grouped.pivot("predicted")
    return pivoted.count().na.fill(0)


def models_seen(predictions: DataFrame) -> DataFrame:
    return predictions.select("model").distinct()


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").count().orderBy(F.desc("count"), "error_type")


def risk_error_listing(errors: DataFrame) -> DataFrame:
    return errors.select(
        "supplier_name", "observation_date", "actual", "probability", "error_type", "probability_band"
    )


def news_error_listing(errors: DataFrame, n: int | None = None) -> DataFrame:
    listed = errors.select("model", "title", "actual", "predicted", "confidence", "confidence_band")
    return listed if n is None else listed.orderBy(F.desc("confidence"), "title").limit(n)


def entity_error_listing(predictions: DataFrame) -> DataFrame:
    wrong = F.col("resolver_prediction") != F.col("expected_match")
    return predictions.filter((F.col("split") == "test") & wrong).select(
        "mention",
        "candidate_name",
        "context_location",
        "expected_match",
        "resolver_prediction",
        "resolver_score",
        "challenge",
    )


def best_calibrated_model(metrics: DataFrame) -> DataFrame:
    """Name of the calibrated model with the lowest Brier score (on the held-out rows)."""
    return metrics.filter(F.contains(F.col("model"), F.lit("calibration"))).agg(
        F.min_by("model", F.struct("brier_score", "model")).alias("model")
    )


def class_balance(
    labeled: DataFrame, splits: list[str], label: str = "event_type", split: str = "split"
) -> DataFrame:
    return labeled.groupBy(label).pivot(split, splits).count().na.fill(0)
