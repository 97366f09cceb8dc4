"""Boosted trees against a plain version, and attributions against all coalitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import boosting

FEATURES = ["a", "b", "c", "d"]


def table(spark, n=600, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), draw.randint(0, 3), draw.choice([None, draw.random(), float("nan")])
        y = int(a + 0.5 * b + (1.5 if c is None else 0) + draw.gauss(0, 0.7) > 1)
        rows.append((i, a, b, c, 7.0, y))
    return spark.createDataFrame(rows, "id long, a double, b int, c double, d double, y int")


def plain_fit(rows, edges, rounds, depth, seed=42, bins=64):
    """The same trees, one row after the other."""
    share = sum(r["y"] for r in rows) / len(rows)
    base = math.log(share / (1 - share))
    margins = [base] * len(rows)
    values = [[math.nan if r[f] is None else float(r[f]) for f in FEATURES] for r in rows]
    hashes = np.array([r["hash"] for r in rows])
    for number in range(rounds):
        used = boosting.chosen_features(len(FEATURES), 0.85, seed, number)
        seen = boosting.sampled(hashes, seed, number, 0.85)
        grads = []
        for m, r in zip(margins, rows, strict=True):
            p = 1 / (1 + math.exp(-m))
            grads.append((round((p - r["y"]) * boosting.GRAIN), round(p * (1 - p) * boosting.GRAIN)))

        def leaf(part):
            g, h = (sum(grads[i][k] for i in part) / boosting.GRAIN for k in (0, 1))
            return g, h, -0.045 * g / (h + 2.0)

        def grow(learn, level, used=used, leaf=leaf):
            g, h, value = leaf(learn)
            best = None
            if level < depth:
                for f in used:
                    for cut in edges[f]:
                        for left in (False, True):
                            side = [i for i in learn if (left if math.isnan(values[i][f]) else values[i][f] < cut)]
                            other = set(learn) - set(side)
                            (a, b, _), (c, d, _) = leaf(side), leaf(other)
                            if b < 3 or d < 3:
                                continue
                            gain = a * a / (b + 2) + c * c / (d + 2) - g * g / (h + 2)
                            if gain > boosting.LEAST_GAIN and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, cut, left, side, sorted(other))
            if best is None:
                return value
            _, f, cut, left, side, other = best
            return (f, cut, left, grow(side, level + 1), grow(other, level + 1))

        def value_of(node, x):
            while isinstance(node, tuple):
                f, cut, left, low, high = node
                node = low if (left if math.isnan(x[f]) else x[f] < cut) else high
            return node

        tree = grow([i for i in range(len(rows)) if seen[i]], 0)
        margins = [m + value_of(tree, x) for m, x in zip(margins, values, strict=True)]
    return margins


def test_margins_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS_AT_ONCE", 2)
    train = table(spark, 240)
    model = boosting.fit_boosted_trees(train.repartition(3), FEATURES, "y", ["id"], rounds=5, bins=8)
    edges = boosting.bin_edges(train, FEATURES, 8)
    rows = train.select("*", F.xxhash64("id").alias("hash"), boosting.margin(model).alias("margin")).collect()
    want = plain_fit(rows, edges, 5, 3)
    assert max(abs(r["margin"] - w) for r, w in zip(rows, want, strict=True)) < 1e-9
    assert [len(e) > 0 for e in edges] == [True, True, True, False]


def test_trees_do_not_depend_on_partitions(spark):
    train = table(spark)
    one = boosting.fit_boosted_trees(train.coalesce(1), FEATURES, "y", ["id"], rounds=4)
    two = boosting.fit_boosted_trees(train.repartition(5, "a"), FEATURES, "y", ["id"], rounds=4)
    for a, b in zip(one.trees, two.trees, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    gains = boosting.gain_importance(one)
    assert abs(sum(gains.values()) - 1) < 1e-12 and gains["a"] > gains["d"] == 0


def game(tree, known, x):
    """Expected value of a tree where the features outside ``known`` follow both branches."""

    def walk(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        low, high = 2 * node + 1, 2 * node + 2
        if f in known:
            left = tree.missing_left[node] if math.isnan(x[f]) else x[f] < tree.threshold[node]
            return walk(low if left else high)
        return (tree.cover[low] * walk(low) + tree.cover[high] * walk(high)) / tree.cover[node]

    return walk(0)


def test_contributions_equal_all_coalitions(spark):
    train = table(spark)
    model = boosting.fit_boosted_trees(train, FEATURES, "y", ["id"], rounds=6, depth=4, bins=16)
    base = boosting.expected_margin(model)
    rows = train.select(
        *FEATURES, boosting.contributions(model).alias("parts"), boosting.margin(model).alias("margin")
    ).collect()
    for r in rows:
        assert abs(base + sum(r["parts"]) - r["margin"]) < 1e-9
    m = len(FEATURES)
    for r in rows[:25]:
        x = [math.nan if r[f] is None else float(r[f]) for f in FEATURES]
        for j in range(m):
            want = 0.0
            for size in range(m):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                for known in itertools.combinations([k for k in range(m) if k != j], size):
                    for tree in model.trees:
                        want += weight * (game(tree, {*known, j}, x) - game(tree, set(known), x))
            assert abs(r["parts"][j] - want) < 1e-9
    means = {r["feature"]: r for r in boosting.mean_contributions(train, model).collect()}
    for j, name in enumerate(FEATURES):
        parts = [r["parts"][j] for r in rows]
        assert means[name]["mean_abs_contribution"] == pytest.approx(np.mean(np.abs(parts)), abs=1e-12)
        assert means[name]["directional_mean_contribution"] == pytest.approx(np.mean(parts), abs=1e-12)


def test_few_rows_and_one_class(spark):
    train = table(spark, 30).withColumn("y", F.lit(1))
    model = boosting.fit_boosted_trees(train, FEATURES, "y", ["id"], rounds=2)
    assert all((t.feature < 0).all() for t in model.trees)
    empty = boosting.fit_boosted_trees(train.limit(0), FEATURES, "y", ["id"], rounds=1)
    assert train.select(boosting.margin(empty).alias("m")).distinct().count() == 1
    assert boosting.mean_contributions(train.limit(0), empty).collect() == []


def test_rounds_write_nothing_and_leave_nothing_behind(spark, monkeypatch):
    cuts = []
    cut = boosting.cut_lineage
    monkeypatch.setattr(boosting, "ROUNDS_AT_ONCE", 2)
    monkeypatch.setattr(boosting, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    boosting.fit_boosted_trees(table(spark, 120), FEATURES, "y", ["id"], rounds=6, bins=8)
    assert len(cuts) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
