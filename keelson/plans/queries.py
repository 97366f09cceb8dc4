
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions import events, risk, text
from keelson.operators import (
    boosting,
    candidates,
    entities,
    evaluation,
    features,
    matching,
    models,
    news,
    quality,
    scoring,
    similarity,
    text_models,
)
from keelson.plans.risk_queue import PipelineResult, run_risk_pipeline
from keelson.session import cut_lineage, shared_scratch
from keelson.sources import driver_tables as given
from keelson.sources import tables
from keelson.streaming import news_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Doubles are compared rounded, because sums of doubles depend on the order of the rows.
DIGITS = {
    "raw_loss": 4,
    "expected_loss": 2,
    "total_loss": 2,
    "daily_revenue_exposure": 4,
    "value": 7,
    "relative_decision_cost": 7,
    "avg_delay_days": 7,
    "risk_score": 7,
    "expected_delay_days": 7,
    "delay_lag_1m": 7,
    "delay_rolling_mean_3m": 7,
    "delay_rolling_std_3m": 7,
    "delay_trend_3m": 7,
    "risk_rolling_mean_3m": 7,
}


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(
        *[
            F.round(c, DIGITS.get(c, digits)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- sources and sinks ------------------------------------------------------------------------


@query
def csv_suppliers(spark, sf_dir):
    """Write a report as CSV and read it as a supplier table.

    The file has its columns in another order and line feeds in its cells.
    """
    path = shared_scratch(spark)
    out = given.dirty_suppliers(spark, sf_dir).withColumn(
        "supplier_name", F.concat("supplier_name", F.lit("\n(supplier)"))
    )
    tables.write_report(out.select(*reversed(out.columns)), path, fmt="csv")
    names = [c for c in out.columns if c != "row_pos"]
    return tables.read_csv_table(spark, path, names, multi_line=True).select(
        "supplier_id",
        "supplier_name",
        "location",
        F.col("avg_delay_days").isNull().alias("no_delay"),
        F.col("risk_score").isNull().alias("no_risk"),
        F.col("on_time_delivery_rate").isNull().alias("no_rate"),
        F.round(quality.to_number(F.col("risk_score")), 7).alias("risk_score"),
    )


@query
def parquet_report(spark, sf_dir):
    """The default sink."""
    path = shared_scratch(spark)
    kept = ["supplier_id", "observation_date", "raw_internal", "raw_loss", "priority"]
    tables.write_report(_scored(spark, sf_dir).select(kept), path)
    return _rounded(spark.read.parquet(path))


@query
def json_news(spark, sf_dir):
    """JSON array files, one array per source document."""
    path = shared_scratch(spark)
    articles = given.news(spark, sf_dir)
    # A file holds a hundred articles as one array.
    days = articles.groupBy(F.floor(F.col("article_pos") / 100).alias("day")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("article_pos", *tables.ARTICLE_FIELDS)))).alias("value")
    )
    days.write.partitionBy("day").text(path)
    parsed = tables.read_news_json(spark, path)
    by_file = Window.partitionBy("article_pos.file").orderBy("article_pos")
    return parsed.select(
        (F.row_number().over(by_file) - 1).alias("at"), "title", "url", "published_at"
    )


@query
def json_line_news(spark, sf_dir):
    """S2 for feeds with one article per line."""
    path = shared_scratch(spark)
    given.news(spark, sf_dir).select(*tables.ARTICLE_FIELDS).write.json(path)
    return tables.read_news_lines(spark, path).drop("article_pos")


@query
def payload_articles(spark, sf_dir):
    """Answers to articles, the first five of each."""
    return tables.flatten_payloads(given.payloads(spark, sf_dir))


@query
def payload_stream(spark, sf_dir):
    """S4 as a stream over landed files."""
    landing, out = shared_scratch(spark), shared_scratch(spark)
    answers = given.payloads(spark, sf_dir)
    answers.write.json(landing)
    stream = news_stream.stream_articles(spark, landing, schema=answers.schema)
    news_stream.land_articles(stream, out, shared_scratch(spark)).awaitTermination()
    landed = spark.read.parquet(out)
    return landed.withColumn("at", F.col("article_pos.at")).drop("article_pos")


@query
def streamed_titles(spark, sf_dir):
    """S4, N4, N5, S5 as a stream: first-kept titles over four triggers."""
    landing, out = shared_scratch(spark), shared_scratch(spark)
    news = given.news(spark, sf_dir).select("article_pos", "title", "source", "published_at")
    end = news.agg(F.max("article_pos")).first()[0]
    share = F.floor((F.col("article_pos") + 1) * 4 / (0 if end is None else end + 1) - 1e-9)
    for part in range(4):  # one after the other, as answers land
        news.where(share == part).coalesce(1).write.json(f"{landing}/{part}")
    stream = spark.readStream.schema(news.schema).option("maxFilesPerTrigger", 1).json(f"{landing}/*")
    news_stream.land_first_titles(stream, out, shared_scratch(spark)).awaitTermination()
    return spark.read.parquet(out).select("article_pos", "source")


# --- supplier checks --------------------------------------------------------------------------


@query
def supplier_quality(spark, sf_dir):
    """V1-V7: the cleaned table."""
    return _rounded(quality.validate_suppliers(given.dirty_suppliers(spark, sf_dir)).data)


@query
def supplier_quality_report(spark, sf_dir):
    """V3-V6: what was changed."""
    return _rounded(quality.validate_suppliers(given.dirty_suppliers(spark, sf_dir)).report)


@query
def supplier_quality_warnings(spark, sf_dir):
    """V1: the report as sentences."""
    report = quality.validate_suppliers(given.dirty_suppliers(spark, sf_dir)).report
    return quality.warning_texts(report)


@query
def latest_suppliers(spark, sf_dir):
    """V3: last row per supplier and the number of copies."""
    last = quality.keep_last(given.dirty_suppliers(spark, sf_dir), "supplier_id", "row_pos")
    return last.select("supplier_id", "row_pos", F.col("_copies").alias("copies"))


#: Tables that are checked, and the columns that the operators on them ask for.
CHECKED_TABLES = {
    "supplier": quality.REQUIRED,
    "lineitem": features.REQUIRED,
    "documents": ("title", "text", "event_type", "split"),
    "labels": ("doc_id", "quality", "toxic"),
}


@query
def table_problems(spark, sf_dir):
    """V2, V8: what the guards would refuse in the tables as they are, and in one without rows."""
    found = [(name, given.table(spark, sf_dir, name)) for name in CHECKED_TABLES]
    problems = [
        quality.table_problems(frame, CHECKED_TABLES[name]).withColumn("table", F.lit(name))
        for name, frame in found
    ]
    late = given.table(spark, sf_dir, "orders").filter("o_orderdate > DATE '2100-01-01'")
    problems.append(
        quality.table_problems(late, ["o_orderkey"]).withColumn("table", F.lit("late orders"))
    )
    return functools.reduce(DataFrame.unionByName, problems)


@query
def group_problems(spark, sf_dir):
    """V8: rows and classes of the splits of the history, and of one that nothing falls into."""
    labeled = models.temporal_split(given.history(spark, sf_dir))
    return quality.group_problems(labeled, "split", [*models.SPLITS, "Holdout"], models.TARGET)


# --- text -------------------------------------------------------------------------------------


def _docs(spark, sf_dir, *columns):
    return given.documents(spark, sf_dir).select("doc_id", *columns)


@query
def token_sets(spark, sf_dir):
    """T1."""
    tokens = F.array_join(F.array_sort(text.token_set(F.col("text"))), " ")
    return _docs(spark, sf_dir, F.md5(tokens).alias("tokens"))


@query
def article_texts(spark, sf_dir):
    """T2."""
    return given.news(spark, sf_dir).select(
        "article_pos", F.md5(news.text_of_article()).alias("article_text")
    )


@query
def risk_signals(spark, sf_dir):
    """T3."""
    signal = text.has_risk_signal(F.col("text"), given.DOC_TERMS, given.DOC_NEGATIONS)
    return _docs(spark, sf_dir, signal.alias("risk_signal"))


@query
def published_instants(spark, sf_dir):
    """T4."""
    return given.news(spark, sf_dir).select(
        "article_pos", F.unix_micros(text.parse_instant(F.col("published_at"))).alias("micros")
    )


@query
def normalized_names(spark, sf_dir):
    """T5."""
    return given.suppliers(spark, sf_dir).select(
        "supplier_id", text.normalized_name(F.col("supplier_name")).alias("name")
    )


@query
def supplier_name_variants(spark, sf_dir):
    """T7."""
    variants = text.name_variants(F.col("supplier_name"), F.col("aliases"))
    return given.suppliers(spark, sf_dir).select(
        "supplier_id", F.posexplode(variants).alias("at", "variant")
    )


@query
def leading_title_words(spark, sf_dir):
    """T8."""
    return _docs(
        spark, sf_dir, text.leading_words(text.name_tokens(F.col("text"))).alias("opening")
    )


@query
def location_overlaps(spark, sf_dir):
    """T9."""
    return given.entity_pairs(spark, sf_dir).select(
        "case_id",
        F.round(
            text.location_overlap(F.col("candidate_location"), F.col("context_location")), 9
        ).alias("overlap"),
    )


@query
def name_similarities(spark, sf_dir):
    """T6."""
    return given.entity_pairs(spark, sf_dir).select(
        "case_id",
        text.name_similarity(F.col("mention"), F.col("candidate_name")).alias("similarity"),
    )


def _neighbours(spark, sf_dir):
    """Every article with the supplier of its number's tens."""
    return given.news(spark, sf_dir).join(
        given.suppliers(spark, sf_dir).withColumnRenamed("row_pos", "key"),
        F.floor(F.col("article_pos") / 10) == F.col("key"),
    )


@query
def locations_contained(spark, sf_dir):
    """T10."""
    return _neighbours(spark, sf_dir).select(
        "article_pos",
        text.contains_all(
            F.array_distinct(text.name_tokens(F.col("location"))),
            text.name_tokens(F.col("full_text")),
        ).alias("located"),
    )


@query
def title_similarities(spark, sf_dir):
    """Each title against the next document's."""
    titles = given.news(spark, sf_dir).select("article_pos", "title")
    following = titles.select(
        (F.col("article_pos") - 1).alias("article_pos"), F.col("title").alias("other")
    )
    return titles.join(following, "article_pos").select(
        "article_pos",
        F.round(
            text.jaccard(text.token_set(F.col("title")), text.token_set(F.col("other"))), 9
        ).alias("similarity"),
    )


@query
def durations(spark, sf_dir):
    """T12, on order texts that name a duration."""
    unit = F.get(F.array(F.lit("days"), F.lit("Week"), F.lit(" months"), F.lit("hours")), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    note = F.concat(
        F.lit("Order "), "o_orderstatus", F.lit(" late by "), F.day("o_orderdate").cast("string"), unit
    )
    return given.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(text.duration_share(F.lower(note)), 9).alias("share")
    )


@query
def model_texts(spark, sf_dir):
    """T13."""
    return given.labeled_news(spark, sf_dir).select(
        "article_id", F.md5(text.model_text(F.col("title"), F.col("text"))).alias("model_text")
    )


@query
def order_amounts(spark, sf_dir):
    """T14."""
    return given.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.dollars(F.col("o_totalprice")).alias("amount")
    )


# --- news -------------------------------------------------------------------------------------


@query
def recent_articles(spark, sf_dir):
    """N1."""
    return news.recent_news(given.news(spark, sf_dir), given.AS_OF).select("article_pos")


@query
def risk_articles(spark, sf_dir):
    """N2."""
    articles = given.news(spark, sf_dir)
    return news.risk_news(articles, given.DOC_TERMS, given.DOC_NEGATIONS).select("article_pos")


def _recent_risk(spark, sf_dir):
    return news.filter_recent_risk_news(
        given.news(spark, sf_dir), given.AS_OF, 60, given.DOC_TERMS, given.DOC_NEGATIONS
    )


@query
def recent_risk_articles(spark, sf_dir):
    """N3."""
    return _recent_risk(spark, sf_dir).select("article_pos", "url")


@query
def near_duplicate_titles(spark, sf_dir):
    """Every repeated title with the kept one it repeats."""
    return _rounded(similarity.near_duplicates(given.news(spark, sf_dir)))


@query
def deduplicated_articles(spark, sf_dir):
    """N5."""
    return similarity.deduplicate_news(given.news(spark, sf_dir)).select("article_pos", "source")


@query
def relevance_scores(spark, sf_dir):
    """N6, N7."""
    tokens = text.token_set(news.text_of_article())
    score = news.relevance(
        tokens,
        text.token_set(F.col("supplier_name")),
        text.token_set(F.col("location")),
        news.risk_share(tokens, given.DOC_TERMS),
    )
    scored = _neighbours(spark, sf_dir).select("article_pos", score.alias("relevance_score"))
    return scored.filter(F.col("relevance_score") > matching.GATE)


@query
def top_articles(spark, sf_dir):
    """Every supplier against every article, the best three of each."""
    return matching.rank_for_suppliers(
        given.suppliers(spark, sf_dir), given.news(spark, sf_dir), terms=given.DOC_TERMS
    )


@query
def identity_matches(spark, sf_dir):
    """Name, alias, location or a similar opening."""
    pairs = _neighbours(spark, sf_dir)
    return matching.with_supplier_match(pairs, news.text_of_article()).select(
        "article_pos", "matches"
    )


# --- events -----------------------------------------------------------------------------------


@query
def event_types(spark, sf_dir):
    """C1."""
    event = events.classify_event(F.col("text"), given.DOC_EVENTS, given.DOC_SEVERITY)
    return _docs(
        spark,
        sf_dir,
        event["event_type"].alias("event_type"),
        F.round(event["confidence"], 9).alias("confidence"),
    )


@query
def event_severities(spark, sf_dir):
    """C2."""
    return _docs(
        spark, sf_dir, F.round(events.severity(F.col("text"), given.DOC_SEVERITY), 9).alias("severity")
    )


@query
def events_per_class(spark, sf_dir):
    """C3 over all documents, counted."""
    event = events.classify_event(F.col("text"), given.DOC_EVENTS, given.DOC_SEVERITY)
    return _rounded(
        _docs(spark, sf_dir, event.alias("event"))
        .groupBy("event.event_type", "event.backend")
        .agg(F.count("*").alias("n"), F.avg("event.severity").alias("mean_severity"))
    )


# --- risk -------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    """Supplier months scored with their own severity as the event."""
    return scoring.score_suppliers(
        given.history(spark, sf_dir), F.col("external_event_severity"), F.lit(0.8), keep_raw=True
    )


@query
def internal_risks(spark, sf_dir):
    """R1."""
    months = given.history(spark, sf_dir)
    return _rounded(
        months.select(
            "supplier_id", "observation_date", risk.internal_risk(months.columns).alias("internal")
        )
    )


@query
def supplier_month_risk(spark, sf_dir):
    """Unrounded scores, loss and priority."""
    return _rounded(
        _scored(spark, sf_dir).select(
            "supplier_id", "observation_date", *scoring.RAW, "priority", "recommended_action"
        )
    )


@query
def supplier_risk_table(spark, sf_dir):
    """V1, W-free slice: cleaned suppliers scored without events, by priority."""
    clean = quality.validate_suppliers(given.suppliers(spark, sf_dir)).data
    scored = scoring.score_suppliers(clean, keep_raw=True)
    return _rounded(
        scoring.by_priority(scored).select("supplier_id", "priority", "raw_probability", "raw_loss")
    )


def _queue(spark, sf_dir) -> PipelineResult:
    return run_risk_pipeline(
        given.suppliers(spark, sf_dir),
        given.news(spark, sf_dir).drop("lang"),
        as_of=given.AS_OF,
        classifier=lambda body: events.classify_event(body, given.DOC_EVENTS, given.DOC_SEVERITY),
        terms=given.DOC_TERMS,
        negations=given.DOC_NEGATIONS,
    )


@query
def risk_queue(spark, sf_dir):
    """R10 with J3, R5, R7-R9: the whole job, its rounded numbers as they are shown."""
    return _queue(spark, sf_dir).suppliers.select(
        "supplier_id",
        "priority",
        "recommended_action",
        "top_event_type",
        "top_event_url",
        "event_confidence",
        "matched_articles",
        "internal_risk",
        "external_risk",
        "risk_score_calculated",
        "disruption_probability",
        "expected_loss",
    )


@query
def risk_evidence(spark, sf_dir):
    """R6."""
    return _rounded(
        _queue(spark, sf_dir).evidence.select(
            "supplier_id",
            "url",
            "published_at",
            "event_type",
            "event_confidence",
            "event_severity",
            "relevance_score",
            "classifier_backend",
        )
    )


@query
def news_counts(spark, sf_dir):
    """Articles received and kept."""
    return _queue(spark, sf_dir).counts


@query
def executive_summary(spark, sf_dir):
    """R11."""
    months = _scored(spark, sf_dir).withColumn("top_event_type", F.lit("Late Deliveries"))
    return scoring.executive_summary(months)


@query
def risk_snapshot(spark, sf_dir):
    """R12."""
    return _rounded(scoring.snapshot(_scored(spark, sf_dir).withColumn("expected_loss", F.col("raw_loss"))))


@query
def action_center(spark, sf_dir):
    """R13."""
    months = _scored(spark, sf_dir).withColumns(
        {"location": F.lit("unknown"), "top_event_type": F.lit("none")}
    )
    return scoring.action_center(months)


@query
def highest_losses(spark, sf_dir):
    """R14."""
    clean = given.suppliers(spark, sf_dir)
    scored = scoring.score_suppliers(clean, keep_raw=True).withColumn("expected_loss", F.col("raw_loss"))
    return _rounded(scoring.highest_losses(scored).select("supplier_id", "expected_loss"))


@query
def supplier_detail(spark, sf_dir):
    """One supplier's rows."""
    months = _scored(spark, sf_dir).withColumns(
        {"internal_risk": F.col("raw_internal"), "top_event_type": F.lit("none")}
    )
    return _rounded(scoring.supplier_detail(months, "Supplier 7"))


@query
def supplier_evidence(spark, sf_dir):
    """The matched articles of the suppliers of one name."""
    evidence = _queue(spark, sf_dir).evidence
    # Ten names for all suppliers: the operator selects, nothing before it.
    name = F.concat(F.lit("Group "), F.pmod(F.col("supplier_id").cast("long"), F.lit(10)))
    return _rounded(scoring.supplier_evidence(evidence.withColumn("supplier_name", name), "Group 3"))


# --- features ---------------------------------------------------------------------------------


@query
def time_features(spark, sf_dir):
    """W1-W7."""
    featured = features.add_time_aware_features(given.history(spark, sf_dir))
    return _rounded(featured.select("supplier_id", "observation_date", *features.TIME_FEATURES))


# --- evaluation -------------------------------------------------------------------------------


@query
def class_errors(spark, sf_dir):
    """E1."""
    errors = evaluation.classification_errors(given.class_predictions(spark, sf_dir))
    return errors.select("article_id", "error_type", "confidence_band", "confidence")


@query
def risk_error_summary(spark, sf_dir):
    """Counts."""
    summary, _ = evaluation.risk_prediction_errors(given.binary_predictions(spark, sf_dir))
    return summary.withColumnRenamed("count", "n")


@query
def risk_errors(spark, sf_dir):
    """Rows, E10 listing."""
    _, errors = evaluation.risk_prediction_errors(given.binary_predictions(spark, sf_dir))
    return _rounded(evaluation.risk_error_listing(errors))


@query
def threshold_sweep(spark, sf_dir):
    """E3, J6, of every model."""
    predictions = given.binary_predictions(spark, sf_dir)
    return _rounded(evaluation.threshold_sweep(predictions, by=["model"]))


@query
def lowest_cost_threshold(spark, sf_dir):
    """E4, of every model."""
    predictions = given.binary_predictions(spark, sf_dir)
    sweep = evaluation.threshold_sweep(predictions, 1.0, 1.0, by=["model"])
    return _rounded(evaluation.lowest_cost_threshold(sweep, by=["model"]))


@query
def probability_metrics(spark, sf_dir):
    """E5."""
    return _rounded(evaluation.probability_metrics(given.binary_predictions(spark, sf_dir)))


@query
def reliability_curve(spark, sf_dir):
    """E6, of every model."""
    predictions = given.binary_predictions(spark, sf_dir)
    models = [r["model"] for r in evaluation.models_seen(predictions).collect()]
    return _rounded(evaluation.reliability_curve(predictions, models=models))


@query
def class_metrics(spark, sf_dir):
    """E7."""
    return _rounded(evaluation.class_metrics(given.class_predictions(spark, sf_dir)))


@query
def confusion_matrix(spark, sf_dir):
    """E8."""
    predictions = given.class_predictions(spark, sf_dir)
    return evaluation.confusion_matrix(predictions, ["de", "en", "es", "fr"])


@query
def models_seen(spark, sf_dir):
    """The list of models."""
    return evaluation.models_seen(given.binary_predictions(spark, sf_dir))


@query
def error_counts(spark, sf_dir):
    """E9."""
    errors = evaluation.classification_errors(given.class_predictions(spark, sf_dir))
    return evaluation.error_counts(errors).withColumnRenamed("count", "n")


@query
def news_error_listing(spark, sf_dir):
    """E10."""
    errors = evaluation.classification_errors(given.class_predictions(spark, sf_dir))
    return evaluation.news_error_listing(errors).drop("title")


@query
def best_calibrated_model(spark, sf_dir):
    """E11."""
    metrics = evaluation.probability_metrics(given.binary_predictions(spark, sf_dir))
    return evaluation.best_calibrated_model(metrics)


@query
def class_balance(spark, sf_dir):
    """E12."""
    return evaluation.class_balance(
        given.labeled_news(spark, sf_dir), ["train", "validation", "test"]
    )


# --- entities ---------------------------------------------------------------------------------


@query
def resolved_entities(spark, sf_dir):
    """M1, M2."""
    resolved = entities.resolve_entities(given.entity_pairs(spark, sf_dir))
    return resolved.select("case_id", "matched", "resolver_score", "best_alias")


@query
def exact_name_matches(spark, sf_dir):
    """M3."""
    same = entities.exact_match(F.col("mention"), F.col("candidate_name"))
    return given.entity_pairs(spark, sf_dir).select("case_id", same.alias("same"))


@query
def name_candidates(spark, sf_dir):
    """M6: all pairs of similar part names, with how many parts have them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    found = candidates.similar_names(
        parts, parts, mention="p_name", candidate="p_name", mention_key="p_partkey", candidate_key="p_partkey"
    )
    return candidates.candidate_links(found)


@query
def entity_thresholds(spark, sf_dir):
    """M4, J5."""
    return entities.threshold_scores(entities.score_entities(given.entity_pairs(spark, sf_dir)))


@query
def entity_evaluation(spark, sf_dir):
    """M5."""
    metrics, _ = entities.evaluate_entity_resolution(given.entity_pairs(spark, sf_dir))
    return metrics


@query
def entity_errors(spark, sf_dir):
    """M5, E10."""
    _, predictions = entities.evaluate_entity_resolution(given.entity_pairs(spark, sf_dir))
    return evaluation.entity_error_listing(predictions)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).suppliers


# --- models -----------------------------------------------------------------------------------


def _split_history(spark, sf_dir):
    return models.temporal_split(features.add_time_aware_features(given.history(spark, sf_dir)))


@query
def temporal_splits(spark, sf_dir):
    """L1, J4."""
    return models.temporal_split(given.history(spark, sf_dir)).select(
        "supplier_id", "observation_date", "split"
    )


@query
def split_summary(spark, sf_dir):
    """L7."""
    return _rounded(models.split_summary(models.temporal_split(given.history(spark, sf_dir))))


@query
def scaled_features(spark, sf_dir):
    """L2: learned on the training rows, applied to all."""
    labeled = cut_lineage(_split_history(spark, sf_dir))
    scaling = models.fit_scaling(labeled.filter(F.col("split") == "Train"))
    return _rounded(
        labeled.select(
            "supplier_id",
            "observation_date",
            *[scaling.scaled(c).alias(f"z_{c}") for c in features.TIME_FEATURES],
        ),
        7,
    )


def _logistic(spark, sf_dir):
    labeled = cut_lineage(_split_history(spark, sf_dir))
    train = labeled.filter(F.col("split") == "Train")
    scaling = models.fit_scaling(train)
    return labeled, scaling, models.fit_logistic(train, scaling)


@query
def calibrated_logistic(spark, sf_dir):
    """Margin, probability and calibrated probability of the test rows."""
    labeled, scaling, model = _logistic(spark, sf_dir)
    scored = labeled.withColumn("margin", models.linear_margin(model, scaling))
    fit = models.fit_sigmoid(scored.filter(F.col("split") == "Calibration"), "margin")
    return _rounded(
        scored.filter(F.col("split") == "Test").select(
            "supplier_id",
            "observation_date",
            "margin",
            models.sigmoid(F.col("margin"), 1.0, 0.0).alias("probability"),
            models.sigmoid(F.col("margin"), *fit).alias("calibrated"),
        ),
        6,
    )


@query
def linear_contributions(spark, sf_dir):
    """L9 for the linear model."""
    labeled, scaling, model = _logistic(spark, sf_dir)
    return _rounded(
        models.linear_contributions(labeled.filter(F.col("split") == "Test"), model, scaling), 7
    )


def _boosted(spark, sf_dir):
    labeled = cut_lineage(_split_history(spark, sf_dir))
    trees = models.fit_trees(labeled.filter(F.col("split") == "Train"))
    return labeled.filter(F.col("split") == "Test"), trees


@query
def tree_importances(spark, sf_dir):
    """Gain and permutation importance of the boosted trees."""
    test, trees = _boosted(spark, sf_dir)
    return models.feature_importance(trees, spark).unionByName(
        models.permutation_importance(test, trees).withColumnRenamed("brier_increase", "importance")
    )


@query
def tree_contributions(spark, sf_dir):
    """L9 for the trees: mean absolute and mean signed Shapley values on the held-out months."""
    test, trees = _boosted(spark, sf_dir)
    return boosting.mean_contributions(test, trees)


@query
def explained_margins(spark, sf_dir):
    """L9 for the trees, row by row: what each feature adds to a held-out row's margin."""
    test, trees = _boosted(spark, sf_dir)
    return models.explained_margins(test, trees)


@query
def risk_model_metrics(spark, sf_dir):
    """Four models on the held-out months."""
    return models.run_risk_model_benchmark(given.history(spark, sf_dir)).metrics


@query
def tfidf_weights(spark, sf_dir):
    """L10 over all documents, whole texts."""
    docs = given.labeled_news(spark, sf_dir).select(
        "article_id", text.model_text(F.col("title"), F.col("text")).alias("body")
    )
    bare = text_models.fit_vocabulary(docs, "body")
    counts = text_models.packed_counts(docs, "article_id", "body", bare)
    vocabulary = text_models.with_idf(bare, counts, docs.count())
    weights = text_models.tfidf(counts, vocabulary, "article_id")
    return _rounded(
        weights.groupBy("block", "term").agg(
            F.count("*").alias("documents"),
            F.max("weight").alias("largest"),
            F.min("weight").alias("smallest"),
        )
    )


@query
def news_model_metrics(spark, sf_dir):
    """Language of the documents, learned from their texts."""
    return text_models.run_news_benchmark(given.labeled_news(spark, sf_dir)).metrics
