import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import entities, evaluation, features, models, quality, text_models
from tests.brute import normalize, similarity


def test_class_errors(spark):
    df = spark.createDataFrame(
        [("weather", "weather", 0.9), ("strike", "weather", 0.8), ("a", "b", 0.5)],
        "actual string, predicted string, confidence double",
    )
    rows = evaluation.classification_errors(df).collect()
    assert [(r.error_type, r.confidence_band) for r in rows] == [
        ("strike → weather", "high"),
        ("a → b", "low"),
    ]
    with pytest.raises(ValueError, match="confidence"):
        evaluation.classification_errors(df.drop("confidence"))


def test_risk_errors_and_band_limits(spark):
    df = spark.createDataFrame(
        [(0, 0.8), (1, 0.2), (1, 0.9), (0, 0.2000001)], "actual int, probability double"
    )
    summary, errors = evaluation.risk_prediction_errors(df)
    assert {r.error_type for r in errors.collect()} == {"False positive", "False negative"}
    counts = {(r.probability_band, r.error_type): r["count"] for r in summary.collect()}
    assert counts[("0–20%", "False negative")] == 1 and counts[("60–80%", "False positive")] == 1
    assert counts[("20–40%", "Correct")] == 1


def test_threshold_sweep(spark):
    df = spark.createDataFrame(
        [(0, 0.1), (0, 0.7), (1, 0.30000000000000004), (1, 0.3)], "actual int, probability double"
    )
    rows = evaluation.threshold_sweep(df, 10, 1).collect()
    thresholds = [r.threshold for r in rows]
    assert thresholds == sorted(thresholds) and len(rows) == 15
    # 0.3 lies just below the fourth threshold, 0.30000000000000004 reaches it.
    assert rows[3].threshold == 0.3 and rows[3].false_negatives == 1
    assert rows[3].relative_decision_cost == 11
    best = evaluation.lowest_cost_threshold(evaluation.threshold_sweep(df, 10, 1)).first()
    assert best.threshold == 0.15


def test_sweep_and_curve_of_each_model_equal_those_of_one(spark):
    rows = [(m, int((i * k) % 7 < 3), ((i * i * k) % 23) / 23) for m, k in (("a", 1), ("b", 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "model string, actual int, probability double")
    sweep = evaluation.threshold_sweep(df, by=["model"])
    best = evaluation.lowest_cost_threshold(sweep, by=["model"])
    curve = evaluation.reliability_curve(df, models=["a", "b"])
    for model in "ab":
        alone = df.filter(f"model = '{model}'")
        of = f"model = '{model}'"
        want = evaluation.threshold_sweep(alone)
        assert sorted(sweep.filter(of).drop("model").collect()) == sorted(want.collect())
        assert best.filter(of).drop("model").collect() == evaluation.lowest_cost_threshold(want).collect()
        assert curve.filter(of).drop("model").collect() == evaluation.reliability_curve(alone).collect()
    nothing = evaluation.threshold_sweep(df.limit(0), by=["model"])
    assert evaluation.lowest_cost_threshold(nothing, by=["model"]).collect() == []


def test_class_metrics_by_hand(spark):
    rows = [("m", "a", "a"), ("m", "a", "b"), ("m", "b", "b"), ("m", "b", "c")]
    df = spark.createDataFrame(rows, "model string, actual string, predicted string")
    got = evaluation.class_metrics(df).first()
    assert got.accuracy == 0.5 and got.test_articles == 4
    assert got.macro_f1 == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    assert got.weighted_f1 == pytest.approx((2 * 2 / 3 + 2 * 1 / 2) / 4)


HISTORY = "supplier_id string, observation_date string, avg_delay_days double, risk_score double, on_time_delivery_rate double, quality_defect_rate double, external_event_severity double"


def four_months(last):
    rows = [
        ("S1", "2025-01-01", 1.0, 20.0, 0.95, 0.01, 0.0),
        ("S1", "2025-02-01", 2.0, 30.0, 0.90, 0.02, 0.0),
        ("S1", "2025-03-01", 3.0, 40.0, 0.85, 0.03, 0.3),
        ("S1", "2025-04-01", last, 99.0, 0.10, 0.50, 1.0),
    ]
    return rows


def test_features_look_back_only(spark):
    def april(last):
        df = spark.createDataFrame(four_months(last), HISTORY)
        return features.add_time_aware_features(df).filter("month(observation_date) = 4").first()

    row, changed = april(100.0), april(9999.0)
    assert (row.delay_lag_1m, row.delay_rolling_mean_3m, row.risk_rolling_mean_3m) == (3.0, 2.0, 30.0)
    assert row.delay_rolling_std_3m == 1.0 and row.external_event_max_3m == 0.3
    assert row.delay_trend_3m == 2.0 and math.isclose(row.month_cos, math.cos(2 * math.pi * 4 / 12))
    assert changed.delay_rolling_mean_3m == row.delay_rolling_mean_3m
    assert "delay_lag_3m" not in row.asDict()


def test_features_reject_bad_input(spark):
    df = spark.createDataFrame(four_months(1.0), HISTORY)
    with pytest.raises(ValueError, match="risk_score"):
        features.add_time_aware_features(df.drop("risk_score"))
    broken = df.withColumn("observation_date", F.lit("not a date"))
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID"):
        features.add_time_aware_features(broken).collect()


PAIRS = [
    ("Orion Componentz", "Orion Components", "Orion Electronics|Orion Components Ltd", "Shenzhen, China", "Shenzhen", 1, "validation"),
    ("NSM", "NorthStar Metals", "North Star Metals|NSM", "Hamburg, Germany", "Germany", 1, "validation"),
    ("Delta Airlines", "Delta Chemicals", "Delta Chem", "Houston, USA", "Atlanta", 0, "validation"),
    ("Acme Ltd", "Acme", "", "Rome", "", 1, "test"),
    ("Delta Chemicals", "Delta Chemicals", None, "Houston, USA", "Dallas", 0, "test"),
    ("Nile Industrial Group", "Nile Industrial", "Nile Industries", "Cairo, Egypt", "Cairo", 1, "test"),
]
PAIR_SCHEMA = "mention string, candidate_name string, aliases string, candidate_location string, context_location string, expected_match int, split string"


def test_entity_scores_equal_brute_force(spark):
    scored = entities.score_entities(spark.createDataFrame(PAIRS, PAIR_SCHEMA)).collect()
    for r in scored:
        names = [r.candidate_name] + [a.strip() for a in (r.aliases or "").split("|") if a.strip()]
        best, name = max((similarity(r.mention, n), n) for n in names)
        wanted = set(normalize(r.context_location).split())
        have = set(normalize(r.candidate_location).split())
        overlap = len(have & wanted) / len(wanted) if wanted else 0.0
        assert r.resolver_score == round(0.85 * best + 0.15 * overlap, 4) and r.best_alias == name


def test_entity_threshold_and_metrics(spark):
    df = spark.createDataFrame(PAIRS, PAIR_SCHEMA)
    metrics, predictions = entities.evaluate_entity_resolution(df)
    by_method = {r.method: r for r in metrics.collect()}
    resolver = by_method[entities.RESOLVER]
    # Every threshold up to 0.92 separates the validation rows; the largest wins.
    assert resolver.selected_threshold == 0.92 and resolver.test_rows == 3
    assert by_method[entities.BASELINE].errors == 2 and predictions.count() == len(PAIRS)
    with pytest.raises(ValueError, match="validation"):
        entities.evaluate_entity_resolution(df.filter("split <> 'validation'"))


def test_char_and_word_grams(spark):
    df = spark.createDataFrame([(1, "A flood, a FLOOD"), (2, "")], "id int, body string")
    vocabulary = text_models.fit_vocabulary(df, "body")
    hits = text_models.term_counts(df, "id", "body", vocabulary).join(vocabulary.terms, "index")
    counts = {(r.block, r.term): r.tf for r in hits.collect()}
    totals = text_models.term_totals(df, "body").collect()
    assert {(r.block, r.term): r.total for r in totals} == counts
    assert counts[("word", "flood")] == 2 and counts[("word", "flood flood")] == 1
    assert ("word", "a") not in counts
    assert counts[("char", " a ")] == 2 and counts[("char", " fl")] == 2 and counts[("char", "lood,")] == 1
    assert counts[("char", "ood ")] == 1


def labeled_texts(spark):
    words = {"x": ["flood", "storm", "rain"], "y": ["strike", "port", "ship"], "z": ["court", "debt", "loan"]}
    rows, at = [], 0
    for split, n in (("train", 6), ("validation", 2), ("test", 2)):
        for label, terms in words.items():
            for i in range(n):
                rows.append((at, f"{terms[i % 3]} report", f"{terms[(i + 1) % 3]} news {i}", label, split))
                at += 1
    return spark.createDataFrame(rows, "article_id int, title string, text string, event_type string, split string")


def test_text_model_is_judged_on_test_rows_only(spark):
    data = labeled_texts(spark)
    result = text_models.run_news_benchmark(data, penalties=(1.0, 4.0))
    row = result.metrics.first()
    assert row.test_articles == 6 and row.macro_f1 == 1.0
    assert {r.article_id for r in result.predictions.collect()} == {
        r.article_id for r in data.filter("split = 'test'").collect()
    }
    assert result.selected_c == 1.0  # equal scores: the smaller one
    with pytest.raises(ValueError, match="test"):
        text_models.run_news_benchmark(data.filter("split <> 'test'"))


def synthetic_history(spark, months=20):
    rows = []
    for s in range(12):
        for m in range(months):
            delay = (s * 7 + m * 5) % 13 + 0.5
            rows.append(
                (f"S{s}", f"20{20 + m // 12}-{m % 12 + 1:02d}-01", delay, float((s * 11 + m) % 100),
                 0.9 - (m % 5) / 20, 0.01 * (s % 4), (m % 3) / 3, int(delay + (s * m) % 5 > 9))
            )
    return spark.createDataFrame(rows, HISTORY + ", disruption_next_30d int")


def test_risk_benchmark_splits_by_time_and_calibrates(spark):
    result = models.run_risk_model_benchmark(synthetic_history(spark), rounds=3)
    splits = {r["split"]: r for r in result.split_summary.collect()}
    assert [splits[s]["rows"] for s in models.SPLITS] == [144, 48, 48]
    assert splits["Train"]["end"] < splits["Calibration"]["start"]
    assert splits["Calibration"]["end"] < splits["Test"]["start"]
    metrics = {r.model: r for r in result.metrics.collect()}
    assert set(metrics) == {"Logistic regression", "Logistic regression + calibration", "Boosted trees", "Boosted trees + calibration"}
    assert all(0 <= r.brier_score <= 1 and r.test_rows == 48 for r in metrics.values())
    assert result.error_model.endswith("calibration") and result.calibration.count() > 4
    assert result.feature_importance.count() == len(features.TIME_FEATURES)
    # The gradient of the penalised loss vanishes at the fitted coefficients.
    scaling, model = result.models["scaling"], result.models["Logistic regression"]
    labeled = models.temporal_split(features.add_time_aware_features(synthetic_history(spark)))
    scaled = F.array(*[scaling.scaled(c) for c in features.TIME_FEATURES]).alias("scaled")
    train = labeled.filter("split = 'Train'").select("*", scaled)
    train = train.withColumn("w", models.balanced_weight(train, models.TARGET)[0])
    rows = train.select("scaled", "w", models.TARGET).collect()
    b = np.array(model.coefficients)
    gradient = b.copy()
    for r in rows:
        x = np.array(r.scaled)
        p = 1 / (1 + math.exp(-(x @ b + model.intercept)))
        gradient += r.w * (p - r[models.TARGET]) * x
    assert abs(gradient).max() < 1e-8
    trees = result.models["Boosted trees"]
    shuffled = models.permutation_importance(result.test, trees)
    assert shuffled.count() == len(features.TIME_FEATURES)
    for r in models.explained_margins(result.test, trees).collect():
        parts = [r[f"{c}_contribution"] for c in features.TIME_FEATURES]
        assert abs(r.base_margin + sum(parts) - r.margin) < 1e-9


def test_temporal_split_needs_ten_dates(spark):
    with pytest.raises(ValueError, match="10"):
        models.temporal_split(synthetic_history(spark, months=9))


def test_both_classes_are_required(spark):
    df = spark.createDataFrame([("Train", 1), ("Train", 1)], "split string, y int")
    with pytest.raises(ValueError, match="Train"):
        quality.require_both_classes(df, "split", "y", ["Train"])
    with pytest.raises(ValueError, match="Late and None"):
        quality.require_splits(df, "split", ["Train", "Late", "None"], "It")


def test_refusals_as_rows(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 0), ("a", None), ("b", 1), ("b", None), (None, 0)], "split string, y int"
    )
    got = quality.group_problems(df, "split", ["b", "a", "c"], "y").collect()
    assert [tuple(r) for r in got] == [("b", 2, 1, "one class"), ("a", 3, 2, None), ("c", 0, 0, "missing")]
    got = quality.group_problems(df, "split", ["c", "a"]).collect()
    assert [tuple(r) for r in got] == [("c", 0, None, "missing"), ("a", 3, None, None)]
    got = quality.table_problems(df, ["z", "split", "x"]).collect()
    assert [tuple(r) for r in got] == [("missing_column", "x"), ("missing_column", "z")]
    got = quality.table_problems(df.limit(0), ["split"]).collect()
    assert [tuple(r) for r in got] == [("empty", None)]
