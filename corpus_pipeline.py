"""From raw documents to packed training sequences, in stages that are each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontamination, language_id, near_duplicates, packing, quality
from keelson.llm.common import store

#: A document stays from this posterior of its best language on.
LANGUAGE_SCORE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of all labelled documents call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality_model(docs, labels)
    if not len(model.labels):  # nothing to judge by
        return docs
    scored = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    return (
        quality.score_quality(scored, model, text="_text").where("predicted = 1").select("row.*")
    )


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without a letter go.

    The posterior only chooses among the learned languages. A text in none of them is known by its
    mean log-likelihood, against the labelled rows of its best language.
    """
    model = language_id.learn_bounds(docs, language_id.fit_language_model(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    found = F.col("_language")
    return (
        scored.select("row", language_id.predicted_language(scored, model, "_text").alias("_language"))
        .where(found["usual"] & (found["score"] >= LANGUAGE_SCORE))
        .select("row.*")
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item appears, not even with a few words changed."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.packed_digest(packing.pack_documents(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

#: The classifiers and the hashed stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
