"""The pipeline stage by stage, against what each stage's operator is tested to give."""

import corpus_pipeline
import pytest

from keelson.llm import decontamination, packing
from tests.llm import helpers
from tests.llm.test_near_duplicates import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    good = [(i, f"{helpers.ENGLISH}Document {i} tells {'more ' * (i % 5)}about case {i * 7}.", "en") for i in range(40)]
    good += [(40 + i, f"{helpers.GERMAN}Der Fall {i} ist neu: {i * 31}.", "de") for i in range(40)]
    junk = [(200 + i, good[i][1].upper().replace(" ", "!!! "), "en") for i in range(20)]
    copies = [(100 + i, good[i][1], good[i][2]) for i in range(10)]
    leak = [(300, "Before it. " + "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2 + "After.", "en")]
    odd = [(400, None, None), (401, "", None), (402, "123 456", None), (None, good[3][1], "en")]
    docs = helpers.documents(spark, good + junk + copies + leak + odd)
    docs.selectExpr("*", "1 as score", "'x' as row").write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk]
    helpers.labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, tables))
        assert docs.columns == columns
        seen[name] = docs.collect()
    keys = {name: [r["doc_id"] for r in rows] for name, rows in seen.items()}
    assert not set(range(200, 220)) & set(keys["quality classifier"])
    assert set(range(80)) <= set(keys["quality classifier"])
    assert not {400, 401, 402} & set(keys["language ID"]) and set(range(80)) <= set(keys["language ID"])
    rows = [(r["doc_id"], r["text"]) for r in seen["language ID"]]
    want = {k for k, c in brute(rows).items() if k == c}
    kept = keys["near duplicates"]
    assert len(kept) == len(set(kept)) and set(kept) - {None} == want
    assert 300 not in keys["benchmark decontamination"]
    assert set(kept) - set(keys["benchmark decontamination"]) == {300}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r["doc_id"] for r in last.collect()} == set(keys["benchmark decontamination"])


def test_run_packs_what_is_kept(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in rows} >= set(range(10, 40)) - {300}
    assert all(r["length"] <= packing.SEQUENCE_TOKENS for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_to_judge_by_keeps_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == docs.count()
    unnamed = docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr(
        *(c if c != "lang" else "cast(null as string) as lang" for c in docs.columns)
    )
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, unnamed, tables).collect()}
    assert {0, 50} <= kept and not {400, 401, 402} & kept
    assert decontamination.WORDS_PER_EDIT > 1


def test_unlearned_languages_go(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 100")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. "
    noise = "qxzv wjkq zzxq vvkj xqqz jjwx kqvz zqxj wvkq xxjz "
    known = docs.where("doc_id = 3").first()["text"]
    more = helpers.documents(spark, [(900, finnish * 3, None), (901, noise * 3, None), (902, known, None)])
    more = more.selectExpr("*", "1 as score", "'x' as row")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, docs.unionByName(more), tables).collect()}
    assert not {900, 901} & kept
    assert {902, *range(80)} <= kept


def test_other_texts_of_a_repeated_id_stay(spark, tables):
    english, german = helpers.ENGLISH * 3, helpers.GERMAN * 3
    rows = [(1, english, "en"), (1, german, "de"), (1, english + "More.", "en"), (2, german, "de"), (1, german, "de")]
    rows += [(3, None, None), (3, None, None), (3, "Another one.", "en"), (None, german, "de")]
    want = [(1, german), (3, None), (3, "Another one."), (None, german)]
    for given in (rows, rows[::-1]):
        docs = helpers.documents(spark, given)
        kept = corpus_pipeline.keep_one_of_each(spark, docs, tables)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        copies = [x for x in got if x[0] == 1 and x[1].startswith(english)]
        assert len(copies) == 1
        assert sorted(map(repr, got)) == sorted(map(repr, want + copies))
