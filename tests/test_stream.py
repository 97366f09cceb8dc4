"""First-kept titles as a stream: the same as the batch, however it is cut, repeated or late."""

import random

from pyspark.sql import functions as F

from keelson.operators.similarity import deduplicate_news
from keelson.session import shared_scratch
from keelson.streaming.news_stream import TRIGGER, keep_first_titles, land_first_titles

SCHEMA = "article_pos long, title string, published_at string"


def titles(seed, n):
    draw = random.Random(seed)
    words = ["port", "strike", "flood", "closes", "opens", "again", "today", "factory", "fire"]
    rows = []
    for i in range(n):
        own = [draw.choice(words) for _ in range(draw.randint(1, 6))]
        rows.append((i, draw.choice([" ".join(own), " ".join(own).title(), "", None]), f"2026-09-{1 + i % 28:02d}"))
    return rows


def written(spark, target):
    return sorted(r["article_pos"] for r in spark.read.parquet(target).collect())


def batch(spark, rows):
    kept = deduplicate_news(spark.createDataFrame(rows, SCHEMA))
    return sorted(r["article_pos"] for r in kept.collect())


def test_any_cut_into_triggers_equals_the_batch(spark):
    rows = titles(1, 60)
    for cuts in ([0, 1, 30, 60], [0, 20, 20, 60]):
        target = shared_scratch(spark)
        for trigger, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            keep_first_titles(spark.createDataFrame(rows[a:b], SCHEMA), trigger, target, window=4, crowd=8)
        assert written(spark, target) == batch(spark, rows)


def test_repeated_triggers_and_answers_change_nothing(spark):
    rows = titles(2, 40)
    target = shared_scratch(spark)
    parts = [rows[:20], rows[20:], [(100 + i, t, p) for i, t, p in rows[:20]]]
    for trigger in (0, 1, 1, 2, 1, 2):  # a trigger that failed runs again
        keep_first_titles(spark.createDataFrame(parts[trigger], SCHEMA), trigger, target)
    assert written(spark, target) == batch(spark, rows)


def test_late_articles_and_expired_titles(spark):
    target = shared_scratch(spark)
    first = [(0, "flood closes port", "2026-09-01"), (1, "old strike", "2026-08-01"), (2, "no date flood", "")]
    second = [
        (3, "flood closes port", "2026-09-20"),  # its like is within 30 days
        (4, "old strike", "2026-09-02"),  # its like has expired
        (5, "late news of long ago", "2026-07-01"),  # behind the watermark
        (6, "no date flood", "someday"),  # undated titles never expire
    ]
    for trigger, rows in enumerate((first, second)):
        keep_first_titles(spark.createDataFrame(rows, SCHEMA), trigger, target, days=20)
    assert written(spark, target) == [0, 1, 2, 4]
    assert spark.read.parquet(target).where(F.col(TRIGGER) == 1).count() == 1


def test_the_stream_itself(spark):
    rows = titles(3, 30)
    landing, target = shared_scratch(spark), shared_scratch(spark)
    for part in range(3):
        frame = spark.createDataFrame(rows[part * 10 : part * 10 + 10], SCHEMA)
        frame.coalesce(1).write.json(f"{landing}/{part}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{landing}/*")
    land_first_titles(stream, target, shared_scratch(spark)).awaitTermination()
    assert written(spark, target) == batch(spark, rows)
    assert spark.read.parquet(target).select(TRIGGER).distinct().count() == 3
