"""Hot keys: the ways round them give the same results as the plain ways and as brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import features, matching, prefix, quantiles, similarity
from keelson.operators.evaluation import probability_metrics, reliability_curve
from keelson.session import spread_join
from tests.brute import greedy, jaccard, tokens, top_articles


def titles_frame(spark, titles):
    return spark.createDataFrame(titles, "article_pos long, title string")


def template_titles(seed, n, vocabulary, spread):
    """Many variants of a few templates, exact copies, empty titles."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    bases = [rng.sample(words, rng.randint(3, 12)) for _ in range(spread)]
    out = []
    for at in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rng.shuffle(base)
        out.append((at, "" if rng.random() < 0.02 else " ".join(base)))
    return out


@pytest.mark.parametrize(
    ("seed", "threshold", "tuning"),
    [
        (1, 0.72, {}),
        (2, 0.72, {"window": 2, "crowd": 10_000}),
        (3, 0.5, {"window": 3, "crowd": 4}),
        (4, 0.72, {"window": 1, "crowd": 2}),
        (5, 0.9, {"window": 64, "crowd": 3}),
    ],
)
def test_dedup_equals_reading_in_order(spark, seed, threshold, tuning):
    titles = template_titles(seed, 160, 30, 4)
    df = titles_frame(spark, titles).repartition(5)
    kept = similarity.deduplicate_news(df, threshold, **tuning)
    assert sorted(r.article_pos for r in kept.collect()) == greedy(titles, threshold)


@pytest.mark.parametrize("tuning", [{}, {"window": 1}, {"window": 2, "crowd": 3}])
def test_every_drop_repeats_the_first_kept_similar_title(spark, tuning):
    titles = template_titles(9, 120, 25, 3)
    of = dict(titles)
    found = similarity.near_duplicates(titles_frame(spark, titles), **tuning).collect()
    kept = greedy(titles, 0.72)
    assert sorted(set(of) - set(kept)) == sorted(r.article_pos for r in found)
    for r in found:
        bag = tokens(of[r.article_pos])
        first = next(k for k in kept if jaccard(bag, tokens(of[k])) >= 0.72)
        assert r.kept_article_pos == first < r.article_pos


def test_first_partners_in_a_crowded_bucket_without_the_product(spark, monkeypatch):
    # One bucket: all titles share k1..k9. Kept ones differ in two more words, each dropped one
    # repeats one of the first kept titles.
    stem = " ".join(f"k{i}" for i in range(1, 10))
    kept = [(i, f"{stem} a{i} b{i} c{i} d{i}") for i in range(150)]
    dropped = [(1_000 + i, f"{stem} a{i % 5} b{i % 5} c{i % 5} d{i % 5} e{i}") for i in range(300)]
    titles = kept + dropped
    emitted = []
    joined = similarity.salted_join

    def counted(many, few, on, *args, **kwargs):
        found = joined(many, few, on, *args, **kwargs)
        if "block" in few.columns:
            emitted.append(found.where("earlier < best").count())
        return found

    monkeypatch.setattr(similarity, "salted_join", counted)
    df = titles_frame(spark, titles)
    got = {r.article_pos: r.kept_article_pos for r in similarity.near_duplicates(df, 0.85, window=4, crowd=8).collect()}
    assert got == {1_000 + i: i % 5 for i in range(300)}
    assert sum(emitted) < 300 * 150 / 4


@pytest.mark.parametrize("scan", [2_000_000, 40])
def test_long_chains_take_few_rounds(spark, monkeypatch, scan):
    # Each title is similar to the next one only: every second one stays.
    chain = [(i, " ".join(f"c{j}" for j in range(i, i + 8))) for i in range(120)]
    other = [(1_000 + i, t) for i, (_, t) in enumerate(template_titles(21, 80, 20, 3))]
    rounds = []
    front = similarity._front_drops
    monkeypatch.setattr(similarity, "SCAN_PAIRS", scan)
    monkeypatch.setattr(similarity, "FRONT_ROUNDS", 2)
    monkeypatch.setattr(similarity, "_front_drops", lambda *args: rounds.append(1) or front(*args))
    titles = chain + other
    kept = similarity.deduplicate_news(titles_frame(spark, titles), 0.72, window=8)
    assert sorted(r.article_pos for r in kept.collect()) == greedy(titles, 0.72)
    if scan > 1_000:
        assert len(rounds) <= 20


def test_dedup_chain_and_copies(spark):
    # a-b and b-c are similar, a-c are not: c stays.
    a, b, c = "k1 k2 k3 k4 k5 k6", "k1 k2 k3 k4 k5 k6 k7", "k2 k3 k4 k5 k6 k7 k8"
    titles = [(0, a), (1, b), (2, c), (3, ""), (4, ""), *[(5 + i, a) for i in range(50)]]
    kept = similarity.deduplicate_news(titles_frame(spark, titles), 0.72)
    assert sorted(r.article_pos for r in kept.collect()) == greedy(titles, 0.72) == [0, 2, 3]


@pytest.mark.parametrize("tuning", [{}, {"pairs_per_token": 3}, {"pairs_per_token": 0}])
def test_ranking_equals_all_pairs(spark, tuning):
    rng = random.Random(11)
    words = ["global", "china", "port", "steel", "alpha", "beta", "gamma", "delta"]
    terms = ["strike", "flood", "fire"]
    suppliers = [
        (f"S{i}", " ".join(rng.sample(words, 2)), " ".join(rng.sample(words, rng.randint(0, 2))))
        for i in range(40)
    ]
    articles = [
        (i, " ".join(rng.sample(words, rng.randint(1, 4)) + rng.sample(terms, rng.randint(0, 3))))
        for i in range(60)
    ]
    ranked = matching.rank_for_suppliers(
        spark.createDataFrame(suppliers, "supplier_id string, supplier_name string, location string"),
        spark.createDataFrame(articles, "article_pos long, title string"),
        terms=terms,
        **tuning,
    ).collect()
    got = {s[0]: [] for s in suppliers}
    for r in sorted(ranked, key=lambda r: r.article_rank):
        got[r.supplier_id].append((r.article_pos, r.relevance_score))
    assert got == top_articles(suppliers, articles, terms, 3)


def test_ranking_by_many_frequent_tokens_without_the_product(spark, monkeypatch):
    # Every supplier holds ten or more tokens that a large part of all articles holds.
    rng = random.Random(12)
    words = [f"hot{i}" for i in range(14)]
    terms = ["strike", "flood", "fire"]
    suppliers = [
        (f"S{i}", " ".join(rng.sample(words, rng.randint(8, 12))), " ".join(rng.sample(words, 2)))
        for i in range(12)
    ]
    suppliers += [(f"T{i}", *suppliers[i % 3][1:]) for i in range(200)]
    articles = [
        (i, " ".join(rng.sample(words, rng.randint(1, 8)) + rng.sample(terms, rng.randint(0, 2))))
        for i in range(400)
    ]
    asked, shown = [], []
    search, offers = matching._best_holders, matching._offers
    monkeypatch.setattr(
        matching,
        "_best_holders",
        lambda holders, combinations, limit: asked.append(combinations.distinct().count())
        or search(holders, combinations, limit),
    )
    monkeypatch.setattr(
        matching, "_offers", lambda reached: shown.append(offers(reached).count()) or offers(reached)
    )
    ranked = matching.rank_for_suppliers(
        spark.createDataFrame(suppliers, "supplier_id string, supplier_name string, location string"),
        spark.createDataFrame(articles, "article_pos long, title string"),
        terms=terms,
        pairs_per_token=0,
    ).collect()
    got = {s[0]: [] for s in suppliers}
    for r in sorted(ranked, key=lambda r: r.article_rank):
        got[r.supplier_id].append((r.article_pos, r.relevance_score))
    assert got == top_articles(suppliers, articles, terms, 3)
    # Fewer rows than the 84,800 pairs, and few of the 2 ** 12 combinations of each profile.
    assert sum(shown) < len(suppliers) * len(articles) / 4
    assert sum(asked) < 2**12


def test_wide_rows_are_copied_where_they_are_needed(spark):
    many = spark.range(500).selectExpr("if(id < 400, 0, id) AS article_pos", "id AS supplier_id")
    few = spark.range(2_000).selectExpr("id AS article_pos", "concat('text ', id) AS body")
    spread = spread_join(many, few, ["article_pos"], ["supplier_id"])
    assert sorted(spread.columns) == ["article_pos", "body", "supplier_id"]
    plain = many.join(few, "article_pos").select(*spread.columns)
    assert sorted(spread.collect()) == sorted(plain.collect()) and spread.count() == 500
    assert spread_join(many, few.limit(0), ["article_pos"], ["supplier_id"]).collect() == []


def history(spark, months=40, suppliers=3):
    rng = random.Random(5)
    rows = []
    for s in range(suppliers):
        for m in range(months if s == 0 else 7):
            if rng.random() < 0.2:
                continue
            value = None if rng.random() < 0.1 else round(rng.uniform(0, 20), 3)
            rows.append((f"S{s}", f"20{10 + m // 12}-{m % 12 + 1:02d}-01", value, *[rng.random() for _ in range(4)]))
    return spark.createDataFrame(
        rows,
        "supplier_id string, observation_date string, avg_delay_days double, risk_score double, "
        "on_time_delivery_rate double, quality_defect_rate double, external_event_severity double",
    )


def test_sliced_windows_equal_plain_windows(spark):
    df = history(spark)
    plain = features.add_time_aware_features(df.coalesce(1))
    # Many ranges, so that one supplier's rows are in several of them.
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    plain = plain.sparkSession.createDataFrame(plain.collect(), plain.schema)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sliced = features.add_time_aware_features(df)
    sliced = spark.createDataFrame(sliced.collect(), sliced.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    key = ["supplier_id", "observation_date"]
    a, b = (sorted(map(tuple, x.select(*key, *features.TIME_FEATURES).collect()), key=repr) for x in (plain, sliced))
    assert len(a) == len(b)
    for left, right in zip(a, b, strict=True):
        assert left[:2] == right[:2]
        assert [v is None for v in left] == [v is None for v in right]
        numbers = [(x, y) for x, y in zip(left[2:], right[2:], strict=True) if x is not None]
        assert [x for x, _ in numbers] == pytest.approx([y for _, y in numbers])


def test_equal_dates_follow_the_row_order(spark):
    rows = [("S", "2020-01-01", float(v), 1.0, 1.0, 1.0, 1.0, v) for v in (5, 3, 9, 1, 7)]
    df = spark.createDataFrame(rows, history(spark).schema.add("at", T.IntegerType())).repartition(3)
    for _ in range(2):
        got = features.add_time_aware_features(df, order="at").orderBy("at").collect()
        assert [r.delay_lag_1m for r in got] == [None, 1.0, 3.0, 5.0, 7.0]
        assert [r.delay_rolling_mean_3m for r in got] == [None, None, 2.0, 3.0, 5.0]
    first, again = (
        sorted((r.at, r.delay_lag_1m) for r in features.add_time_aware_features(x).collect())
        for x in (df, df.coalesce(1))
    )
    assert [lag for _, lag in first] == [lag for _, lag in again]


def test_quantiles_by_narrowing_equal_percentile(spark):
    rng = random.Random(3)
    values = [(rng.choice([0.0, 1.0, rng.random() * 1e6, -rng.random()]), float(i % 7)) for i in range(3000)]
    values += [(None, 3.0), (1e-300, 1e9)]
    df = spark.createDataFrame(values, "a double, b double")
    wanted = {"a": [0.0, 0.2, 0.5, 0.77, 1.0], "b": [0.5, 0.9]}
    found = quantiles.exact_quantiles(df, wanted)
    for c, shares in wanted.items():
        exact = df.agg(F.percentile(c, F.array(*[F.lit(q) for q in shares]))).first()[0]
        assert found[c] == pytest.approx(exact, rel=1e-12)
    assert quantiles.exact_quantiles(df.filter("b > 1e12"), {"a": [0.5]}) == {"a": [None]}


def test_running_totals_over_ranges(spark):
    rows = [(i % 2, float(i * 37 % 101), 1) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v double, n long").repartition(6)
    got = prefix.running_totals(df, [F.desc("v")], {"total": "n"}, keys=["k"]).collect()
    for k in (0, 1):
        ordered = sorted((r for r in got if r.k == k), key=lambda r: -r.v)
        assert [r.total for r in ordered] == list(range(1, len(ordered) + 1))
    numbered = prefix.with_row_index(df, [F.asc("v")], "at").collect()
    assert [r.at for r in sorted(numbered, key=lambda r: r.v)] == list(range(101))


def test_metrics_with_one_hot_score(spark):
    rows = [("m", i % 3 == 0, 0.5 if i % 2 else (i % 10) / 10) for i in range(400)]
    rows = [(m, int(y), p) for m, y, p in rows]
    df = spark.createDataFrame(rows, "model string, actual int, probability double")
    got = probability_metrics(df).first()
    pos = [p for _, y, p in rows if y]
    neg = [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    step = 0.0
    for s in sorted({p for _, _, p in rows}):
        hits = sum(p >= s for p in pos)
        step += sum(p == s for p in pos) / len(pos) * hits / sum(p >= s for _, _, p in rows)
    assert got.roc_auc == pytest.approx(auc) and got.pr_auc == pytest.approx(step)
    assert sum(r.rows for r in reliability_curve(df).collect()) == len(rows)


def test_quantiles_of_any_range_take_few_passes(spark, monkeypatch):
    values = [float(s * 10.0**e) for e in range(-300, 301, 7) for s in (-1, 1)] + [0.0, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    passes = []
    monkeypatch.setattr(quantiles, "_is_wide", lambda low, high, real=quantiles._is_wide: passes.append(1) or real(low, high))
    got = quantiles.exact_quantiles(df, {"a": [0.0, 0.25, 0.5, 0.75, 1.0]})["a"]
    assert got == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]).tolist(), rel=1e-12)
    assert len(passes) <= 6 * 8
