"""Search answers that land as files, read as a stream: the same projection, then first-kept titles.

What has been kept is the state: every trigger compares its articles with the kept titles of the
triggers before it and writes its own kept articles into a folder of its own number, so a trigger
that is repeated after a failure overwrites what it wrote and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelson.functions.text import parse_instant
from keelson.operators.similarity import deduplicate_after
from keelson.session import cut_lineage, scratch_tables
from keelson.sources.tables import PAYLOAD_SCHEMA, positioned_articles

#: The column of a target's folders: the number of the trigger that kept an article.
TRIGGER = "kept_in"


def stream_articles(
    spark: SparkSession,
    path: str,
    limit: int = 5,
    files_per_trigger: int = 1_000,
    schema=None,
    multi_line: bool = False,
) -> DataFrame:
    """Articles of every answer file under ``path``, with ``article_pos``.

    One JSON answer per line, or per file if ``multi_line``, as in ``read_payloads``.
    """
    answers = (
        spark.readStream.schema(schema or PAYLOAD_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("multiLine", multi_line)
        .json(path)
    )
    return positioned_articles(answers, limit)


def land_articles(articles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived so far as Parquet, exactly once, and stop."""
    return (
        articles.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _written(spark: SparkSession, path: str, schema, trigger: int) -> DataFrame:
    """What the triggers before ``trigger`` wrote."""
    if not trigger:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField(TRIGGER, T.LongType())])
    written = spark.read.schema(whole).parquet(path)
    return written.where(F.col(TRIGGER) < trigger).drop(TRIGGER)


def _in_time(published: Column, newest, days: int) -> Column:
    """Undated articles are never too late."""
    at = parse_instant(published)
    if newest is None:
        return F.lit(True)
    return F.coalesce(at >= F.lit(newest) - F.make_dt_interval(F.lit(days)), F.lit(True))


def keep_first_titles(
    news: DataFrame,
    trigger: int,
    target: str,
    days: int | None = None,
    threshold: float = 0.72,
    title: str = "title",
    order: str = "article_pos",
    published: str = "published_at",
    **tuning,
) -> None:
    """One trigger: write those of ``news`` whose title is similar to no title kept before.

    With ``days`` the state has an end: titles published more than so many days before the newest
    article of earlier triggers are no longer compared with, and articles that old come too late
    and are left out, as behind a watermark. Undated articles are never too old. The newest time
    of each trigger is written beside the target.
    """
    spark, seen = news.sparkSession, f"{target}.seen"
    with scratch_tables(spark):
        news = cut_lineage(news)
        times = news.agg(F.max(parse_instant(F.col(published))).alias("newest"))
        kept = _written(spark, target, news.schema, trigger).select(title, published)
        if days is not None:
            newest = _written(spark, seen, times.schema, trigger).agg(F.max("newest")).first()[0]
            kept = kept.where(_in_time(F.col(published), newest, days))
            news = news.where(_in_time(F.col(published), newest, days))
        first = deduplicate_after(kept, news, threshold, title, order, **tuning)
        first.write.mode("overwrite").parquet(f"{target}/{TRIGGER}={trigger}")
        times.write.mode("overwrite").parquet(f"{seen}/{TRIGGER}={trigger}")


def land_first_titles(
    articles: DataFrame, target: str, checkpoint: str, **options
) -> StreamingQuery:
    """Keep the first of similar titles of all that has arrived so far, trigger by trigger, and stop.

    Read in the order in which they arrive, and in ``article_pos`` within a trigger, the kept
    articles are those of ``deduplicate_news`` over all articles, however they are cut into
    triggers. ``options`` are those of ``keep_first_titles``.
    """
    return (
        articles.writeStream.foreachBatch(
            lambda news, trigger: keep_first_titles(news, trigger, target, **options)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
