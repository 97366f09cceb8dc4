"""The engine's tables, derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.text import normalized_name, text_array
from keelson.session import READ_PARTITIONS

AS_OF = "2026-09-10T00:00:00+00:00"

# Word lists for the invented prose, in which no English risk words occur.
DOC_TERMS = ("worthless", "license", "pathetic", "than", "que", "ther", "mentier")
DOC_NEGATIONS = ("of (?:the )?than", "la que", "de que", "the ther")
DOC_EVENTS = {
    "French prose": ("le", "la", "les", "des", "que", "pour par"),
    "German prose": ("der", "die", "und", "von mit", "nicht", "ein"),
    "Spanish prose": ("el", "los", "que", "una", "por", "de la"),
    "English prose": ("the", "of", "and", "with", "is the", "that"),
    "Junk": ("token", "license", "worthless", "pathetic"),
}
DOC_SEVERITY = {"worthless": 1.0, "tion": 0.45, "eaux": 0.55, "ción": 0.8, "ung": 0.85, "token": 0.9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts; dealt to as many partitions as the session asks for, as they are if it does not."""
    docs = table(spark, sf_dir, "documents")
    partitions = spark.conf.get(READ_PARTITIONS, None)
    return docs.repartition(int(partitions)) if partitions else docs


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier months out of ``lineitem``; the target looks one row ahead."""
    line = table(spark, sf_dir, "lineitem")
    returned = F.avg((F.col("l_returnflag") == "R").cast("double"))
    months = line.groupBy(
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("observation_date"),
    ).agg(
        (F.avg("l_quantity") / 5).alias("avg_delay_days"),
        (1000 * F.avg("l_discount")).alias("risk_score"),
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("on_time_delivery_rate"),
        (0.1 * returned).alias("quality_defect_rate"),
        (10 * F.max("l_tax")).alias("external_event_severity"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 30).alias(
            "daily_revenue_exposure"
        ),
        (F.avg("l_quantity") / 5 + 5).alias("expected_delay_days"),
        (100 * F.avg((F.col("l_returnflag") == "A").cast("double"))).alias("backup_capacity_pct"),
        returned.alias("_returned"),
    )
    # One row per supplier and month here, so a supplier's rows are as few as its months.
    coming = F.lead("_returned").over(
        Window.partitionBy("supplier_id").orderBy("observation_date")
    )
    return months.select(
        "supplier_id",
        F.concat(F.lit("Supplier "), "supplier_id").alias("supplier_name"),
        *[c for c in months.columns if c not in ("supplier_id", "_returned")],
        F.coalesce((coming > 0.4).cast("int"), F.lit(0)).alias("disruption_next_30d"),
    )


MEASURES = [
    "avg_delay_days",
    "risk_score",
    "on_time_delivery_rate",
    "quality_defect_rate",
    "daily_revenue_exposure",
    "expected_delay_days",
    "backup_capacity_pct",
]


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: first line as title, dates in several notations."""
    docs = documents(spark, sf_dir)
    day = F.date_format(
        F.date_sub(F.lit("2026-09-10").cast("date"), F.pmod("doc_id", F.lit(120)).cast("int")),
        "yyyy-MM-dd",
    )
    published = (
        F.when(F.col("doc_id") % 13 == 0, F.lit(""))
        .when(F.col("doc_id") % 17 == 0, F.lit("2 days ago"))
        .when(F.col("doc_id") % 3 == 0, day)
        .when(F.col("doc_id") % 3 == 1, F.concat(day, F.lit("T01:00:00+02:00")))
        .otherwise(F.concat(day, F.lit("T01:00:00Z")))
    )
    return docs.select(
        F.col("doc_id").alias("article_pos"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.lit("").alias("snippet"),
        F.col("text").alias("full_text"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        published.alias("published_at"),
        "lang",
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with its measures and a trade name out of the document of its number."""
    means = (
        history(spark, sf_dir)
        .groupBy("supplier_id")
        .agg(*[F.avg(c).alias(c) for c in MEASURES])
    )
    words = F.regexp_extract_all(
        F.lower(F.substring_index("text", "\n", 1)), F.lit("[a-z0-9]+"), F.lit(0)
    )
    word = [F.coalesce(F.get(words, i), F.lit("")) for i in range(5)]
    named = documents(spark, sf_dir).select(
        F.col("doc_id").alias("s_suppkey"),
        F.concat(word[0], F.lit(" "), word[1], F.lit(" Ltd.")).alias("supplier_name"),
        F.concat(word[2], F.lit("|"), word[3]).alias("aliases"),
        word[4].alias("location"),
    )
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    return (
        keys.join(named, "s_suppkey", "left")
        .withColumn("supplier_id", F.col("s_suppkey").cast("string"))
        .join(means, "supplier_id", "left")
        .select(
            "supplier_id",
            "supplier_name",
            "aliases",
            "location",
            *MEASURES,
            F.col("s_suppkey").alias("row_pos"),
        )
    )


def dirty_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier table as a careless export: texts, repeats, bad and missing numbers."""
    clean = suppliers(spark, sf_dir)
    key = F.col("row_pos")
    texts = clean.select(
        "supplier_id",
        "supplier_name",
        "location",
        F.when(key % 7 == 3, F.lit("unknown"))
        .otherwise(F.col("avg_delay_days").cast("string"))
        .alias("avg_delay_days"),
        F.when(key % 5 == 2, F.lit(None))
        .when(key % 11 == 4, F.lit("140.5"))
        .otherwise(F.col("risk_score").cast("string"))
        .alias("risk_score"),
        F.when(key % 6 == 1, F.lit("nan"))
        .otherwise(F.col("on_time_delivery_rate").cast("string"))
        .alias("on_time_delivery_rate"),
        F.col("daily_revenue_exposure").cast("string").alias("daily_revenue_exposure"),
        (key * 2).alias("row_pos"),
    )
    again = texts.filter(key % 9 == 0).withColumns(
        {"risk_score": F.lit("61.25"), "row_pos": key + 1}
    )
    return texts.unionByName(again)


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents scored by length, and a second, flatter model."""
    scored = (
        table(spark, sf_dir, "labels")
        .select("doc_id", F.col("quality").cast("int").alias("actual"))
        .join(documents(spark, sf_dir).select("doc_id", "n_chars", "source"), "doc_id")
    )
    length = F.col("n_chars")
    return scored.select(
        "doc_id",
        F.col("source").alias("supplier_name"),
        "actual",
        F.inline(
            F.array(
                F.struct(
                    F.lit("Length").alias("model"), (length / (length + 500.0)).alias("probability")
                ),
                F.struct(
                    F.lit("Length + calibration").alias("model"),
                    (0.2 + 0.6 * (length / (length + 2000.0))).alias("probability"),
                ),
                F.struct(
                    F.lit("Steps + calibration").alias("model"),
                    (F.floor(length / 400.0) % 10 / 10.0).alias("probability"),
                ),
            )
        ),
    ).withColumn("observation_date", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(200)).cast("int")))


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, guessed from stop-words."""
    stop_words = {
        "de": ("der", "die", "und", "von"),
        "en": ("the", "of", "and", "that"),
        "es": ("el", "los", "una", "por"),
        "fr": ("le", "la", "les", "des"),
    }
    words = F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    )
    docs = documents(spark, sf_dir).withColumn("_words", words)
    hits = F.array(
        *[
            F.struct(
                F.size(F.array_intersect("_words", text_array(terms))).alias("hits"),
                F.lit(lang).alias("lang"),
            )
            for lang, terms in stop_words.items()
        ]
    )
    best = F.array_max(hits)
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("actual"),
        best["lang"].alias("predicted"),
        (best["hits"] / 4.0).alias("confidence"),
        F.lit("Stop words").alias("model"),
    )


def labeled_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as class and a split by number."""
    slot = F.pmod("doc_id", F.lit(8))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.col("lang").alias("event_type"),
        F.when(slot < 5, "train").when(slot == 5, "validation").otherwise("test").alias("split"),
    )


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the previous part of its number range: names, types, sizes."""
    part = table(spark, sf_dir, "part")
    mention = part.select(
        F.col("p_partkey").alias("key"),
        F.concat("p_name", F.lit(" Co.")).alias("mention"),
        F.concat_ws(", ", "p_type", "p_brand").alias("context_location"),
    )
    candidate = part.select(
        (F.col("p_partkey") + 1).alias("key"),
        F.initcap("p_name").alias("candidate_name"),
        F.concat(F.col("p_brand"), F.lit("| |"), F.col("p_name"), F.lit(" Inc")).alias("aliases"),
        F.concat_ws(", ", "p_type", F.lit("depot")).alias("candidate_location"),
    )
    slot = F.pmod("key", F.lit(3))
    same = normalized_name(F.col("mention")) == normalized_name(F.col("candidate_name"))
    located = F.split("context_location", ",")[0] == F.split("candidate_location", ",")[0]
    return mention.join(candidate, "key").select(
        F.col("key").alias("case_id"),
        "mention",
        "candidate_name",
        "aliases",
        "candidate_location",
        "context_location",
        (same | located).cast("int").alias("expected_match"),
        F.when(slot == 0, "train").when(slot == 1, "validation").otherwise("test").alias("split"),
        F.when(same, "same name").otherwise("other name").alias("challenge"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers: one per document, its lines as items, some fields missing."""
    lines = F.split("text", "\n")
    item = F.transform(
        lines,
        lambda line, i: F.struct(
            line.alias("title"),
            F.when(i % 2 == 0, F.substring(line, 1, 20)).alias("snippet"),
            F.concat(F.lit("https://example.org/"), i.cast("string")).alias("link"),
            F.when(i % 3 != 0, F.col("source")).alias("source"),
            F.when(i > 0, F.lit("2026-09-01")).alias("date"),
        ),
    )
    return documents(spark, sf_dir).select("doc_id", item.alias("news"))
