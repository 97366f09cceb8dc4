"""Registered queries against their SQL, and all of them over the smallest given tables."""

from pathlib import Path

import pytest

from keelson.llm.oracles import ORACLES
from keelson.llm.queries import QUERIES
from tests.oracle_check import connect, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    got = rows(frame.columns, frame.collect())
    result = connect(SF).execute(ORACLES[name])
    assert got == rows([d[0] for d in result.description], result.fetchall())


def test_there_is_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_search_finds_the_nearest_vectors(spark):
    import numpy as np

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toArrow()
    keys = vectors["vec_id"].to_numpy()
    points = np.stack(vectors["embedding"].to_pylist()).astype(float)
    found = {}
    for r in QUERIES["op8_vector_search"](spark, SF).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for key, own in found.items():
        scores = points @ points[keys == key][0]
        order = [k for k in keys[np.lexsort((keys, -scores))].tolist() if k != key][:20]
        hits += len(own & set(order))
        total += 20
    assert set(found) == {k for k in keys.tolist() if k % 20 == 0}
    assert hits >= 0.95 * total
