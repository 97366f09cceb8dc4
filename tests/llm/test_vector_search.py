"""Vector search: recall against brute force, exact scores, awkward vectors."""

import numpy as np
import pytest

from keelson.llm import vector_search as search


def table(spark, rows):
    rows = [(key, None if v is None else [None if x is None else float(x) for x in v], 0) for key, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, key, nearest):
    vectors = {k: np.array(v, np.float32).astype(float) for k, v in rows}
    scores = sorted((-(vectors[key] * v).sum(), k) for k, v in vectors.items() if k != key)
    return [(k, -s) for s, k in scores[:nearest]]


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, monkeypatch, unit):
    monkeypatch.setattr(search, "SHARD_ROWS", 500)
    monkeypatch.setattr(search, "QUERY_ROWS", 30)
    draw = np.random.default_rng(1)
    points = draw.normal(size=(1_500, 24)) * (1 if unit else draw.uniform(0.5, 2, (1_500, 1)))
    if unit:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = list(enumerate(points.tolist()))
    vectors = table(spark, rows)
    found = search.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == set(range(0, 1_500, 20))
    hit = 0
    for key, own in by_query.items():
        want = brute(rows, key, 20)
        assert [r["rank"] for r in own] == list(range(1, 21))
        exact = dict(brute(rows, key, 1_499))
        for r in own:
            assert r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-12)
        order = [(-r["score"], r["vec_id"]) for r in own]
        assert order == sorted(order)
        hit += len({k for k, _ in want} & {r["vec_id"] for r in own})
    assert hit >= 0.9 * 20 * len(by_query)


def test_equal_vectors_and_awkward_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, [0.5, i / 10, 0.1]) for i in range(5)]
    odd = [(900, None), (901, [0, 0, 0]), (902, [1, None, 0]), (903, [float("nan"), 0, 1]),
           (904, [float("inf"), 0, 1]), (905, [1.0, 2.0]), (906, []), (None, same)]
    vectors = table(spark, rows + odd + [(0, same)]).selectExpr("*", "1 as shard", "2 as id", "3 as rank")
    found = search.nearest_neighbours(vectors, vectors).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {k for k, _ in rows}
    for key in got:
        want = brute(rows, key, 20)
        assert [k for k, _ in got[key]] == [k for k, _ in want]


def test_few_and_no_rows(spark):
    vectors = table(spark, [(1, [1, 0]), (2, [0, 1]), (3, [1, 1])])
    found = search.nearest_neighbours(vectors, vectors.where("vec_id = 3")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert search.nearest_neighbours(vectors.limit(0), vectors.limit(0)).collect() == []
    assert search.nearest_neighbours(vectors, vectors.limit(0)).collect() == []
    assert search.nearest_neighbours(vectors.limit(0), vectors).collect() == []


def test_graph_keeps_its_degree_and_reaches_all():
    points = np.random.default_rng(3).normal(size=(700, 8)).astype(np.float32)
    graph, entries = search.build_graph(points, degree=12, beam=24)
    assert ((graph >= -1) & (graph < 700)).all() and graph.shape == (700, 12)
    assert not (graph == np.arange(700)[:, None]).any()
    seen, new = set(entries.tolist()), set(entries.tolist())
    while new:
        new = {int(x) for n in new for x in graph[n] if x >= 0} - seen
        seen |= new
    assert len(seen) == 700


def test_queries_of_another_length_take_no_part(spark):
    rows = spark.createDataFrame(
        [(i, [float(i), 1.0, 0.0, -1.0]) for i in range(10)], "vec_id long, embedding array<double>"
    )
    asked = spark.createDataFrame(
        [(i, [1.0, 2.0, 3.0]) for i in range(20, 25)] + [(3, [3.0, 1.0, 0.0, -1.0])], rows.schema
    )
    found = search.nearest_neighbours(rows, asked).collect()
    assert {r["query_id"] for r in found} == {3} and len(found) == 9
    assert search.nearest_neighbours(rows.limit(0), asked).collect() == []
