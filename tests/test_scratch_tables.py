"""What a search for similar titles leaves behind, and what its rows carry."""

import os

import pytest

from keelson import session
from keelson.operators import similarity
from keelson.streaming.news_stream import keep_first_titles

SCHEMA = "article_pos long, title string, published_at string"


def folder(spark):
    session.shared_scratch(spark)
    path = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def rows(first, n):
    return [(i, f"flood {i % 5} closes the port of town {i % 7}", "2026-09-01") for i in range(first, first + n)]


def test_a_trigger_leaves_no_table_and_files_no_title_text(spark, monkeypatch):
    types, search = [], similarity.duplicate_titles

    def looked_at(news, threshold, title, order, **tuning):
        types.append(dict(news.dtypes)[order])
        return search(news, threshold, title, order, **tuning)

    monkeypatch.setattr(similarity, "duplicate_titles", looked_at)
    target = session.shared_scratch(spark)
    for trigger in range(2):
        news = spark.createDataFrame(rows(40 * trigger, 40), SCHEMA)
        before = set(os.listdir(folder(spark)))
        keep_first_titles(news, trigger, target, window=4, crowd=8)
        own = {os.path.basename(target), f"{os.path.basename(target)}.seen"}
        assert set(os.listdir(folder(spark))) - before <= own
    assert types == ["bigint", "bigint"]


def test_a_block_removes_its_tables_but_those_kept(spark):
    before = set(os.listdir(folder(spark)))
    with session.scratch_tables(spark) as outer:
        with session.scratch_tables(spark) as inner:
            first, second = session.stored(spark.range(3)), session.cut_lineage(spark.range(4))
            inner.append(second)
        assert second.count() == 4
        outer.append(second)
    left = set(os.listdir(folder(spark))) - before
    assert left == {os.path.basename(second.scratch_path)} and second.count() == 4
    assert not os.path.exists(first.scratch_path.removeprefix("file:"))
    with pytest.raises(ValueError), session.scratch_tables(spark):
        session.stored(spark.range(3))
        raise ValueError
    assert set(os.listdir(folder(spark))) - before == left


def test_a_search_leaves_only_what_its_result_reads(spark):
    news = spark.createDataFrame(rows(0, 40), SCHEMA)
    before = set(os.listdir(folder(spark)))
    found = similarity.near_duplicates(news, window=4, crowd=8)
    assert len(set(os.listdir(folder(spark))) - before) == 2
    assert found.count() > 0
