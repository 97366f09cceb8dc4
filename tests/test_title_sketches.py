"""What the search for similar titles writes: few rows, few bytes, and nothing lost by sketches."""

import itertools
import os

from pyspark.sql import functions as F

from keelson.operators import similarity
from keelson.session import cut_lineage


def test_titles_without_a_partner_are_filed_nowhere(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(20)]
    news = spark.createDataFrame(rows, "article_pos long, title string")
    *_, filed = similarity.duplicate_titles(news)
    assert filed.count() == 0
    assert similarity.deduplicate_news(news).count() == 20


def test_sketches_never_refuse_a_similar_pair(spark):
    words = [f"w{i}" for i in range(400)]
    sets = [words[a : a + n] for n in (1, 2, 5, 40, 150) for a in range(0, 60, 7)]
    titles = spark.createDataFrame(list(enumerate(sets)), "pos long, tokens array<string>")
    sketched = {r["pos"]: r for r in similarity._rare_first(titles).collect()}
    pairs = []
    for a, b in itertools.combinations(sketched, 2):
        both, either = set(sets[a]) & set(sets[b]), set(sets[a]) | set(sets[b])
        pairs.append((len(both) / len(either), *[sketched[x][c] for x in (a, b) for c in similarity.SKETCH]))
    frame = spark.createDataFrame(
        pairs, "similarity double, size int, low long, high long, size_ int, low_ long, high_ long"
    )
    open_ = similarity._may_be_similar(F.col, lambda c: F.col(f"{c}_"), 0.72)
    counts = frame.agg(
        F.count_if((F.col("similarity") >= 0.72) & ~open_), F.count_if(~open_), F.count("*")
    ).first()
    assert counts[0] == 0
    assert counts[1] > counts[2] / 2


def test_a_cut_keeps_no_shuffle_and_few_bytes(spark):
    stored = cut_lineage(
        spark.range(200_000).groupBy((F.col("id") % 100_000).alias("k")).agg(F.lit("the same text").alias("t"))
    )
    (path,) = {os.path.dirname(f).removeprefix("file:") for f in stored.inputFiles()}
    assert sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) < 1_500_000
    assert stored.count() == 100_000
    assert cut_lineage(spark.range(0)).count() == 0
