"""Candidate search: nothing is missed, whatever the lengths, thresholds and crowds."""

import random

import pytest

from keelson.functions.text import block_ratios
from keelson.operators.candidates import candidate_links, similar_names


def names(seed, n):
    draw = random.Random(seed)
    words = ["acme", "acne", "zinc", "north", "northern", "steel", "steal", "global", "a", "b1", "ok", "parts"]
    found = []
    for _ in range(n):
        letters = list(" ".join(draw.choices(words, k=draw.randint(1, 4))))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(letters))
            letters[at : at + draw.randint(0, 2)] = draw.choices("abcxyz 019", k=draw.randint(0, 2))
            letters = letters or ["q"]
        found.append("".join(letters))
    return found


def tables(spark, left, right):
    a = spark.createDataFrame(list(enumerate(left)), "case_id int, mention string")
    b = spark.createDataFrame(list(enumerate(right)), "supplier_id int, candidate_name string")
    return a, b


def all_pairs(found, threshold):
    left = sorted({r["spelling"] for r in found.mentions.collect()})
    right = sorted({r["spelling"] for r in found.candidates.collect()})
    a, b = [x for x in left for _ in right], [y for _ in left for y in right]
    return {(x, y): r for x, y, r in zip(a, b, block_ratios(a, b), strict=True) if r >= threshold}


@pytest.mark.parametrize("threshold, crowd", [(0.78, 4_096), (0.78, 4), (0.5, 16), (0.95, 4), (1.0, 1)])
def test_no_pair_is_missed(spark, threshold, crowd):
    left = [*names(1, 150), "", None, "Acme Ltd.", "x", "the aaaa aaaa aaaa aaaa"]
    right = [*names(2, 150), " ", "acme", "xx", "aaaa aaaa aaaa", "x" * 60]
    found = similar_names(*tables(spark, left, right), threshold, crowd=crowd)
    rows = [(r["mention"], r["candidate"], r["similarity"]) for r in found.pairs.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    assert {r[:2]: r[2] for r in rows} == all_pairs(found, threshold)


def test_a_name_of_a_third_of_all_rows_is_compared_once(spark):
    left = ["Northern Steel"] * 400 + names(3, 40)
    right = ["northern steal"] * 500 + names(4, 40)
    found = similar_names(*tables(spark, left, right), 0.9)
    links = {(r["mention"], r["candidate"]): r for r in candidate_links(found).collect()}
    hot = links["northern steel", "northern steal"]
    assert hot["n_mentions"] >= 400 and hot["n_candidates"] >= 500
    assert set(links) == set(all_pairs(found, 0.9))


def test_one_crowded_stem_does_not_become_all_pairs(spark):
    # All names share a stem and differ in the rest: letters in common, but no similar pair.
    left = [f"plant {a}{b} {c * 12}" for a in "cdfghjkl" for b in "mnpqrstv" for c in "wxz"]
    found = similar_names(*tables(spark, left, left), 0.97, crowd=8)
    assert {(r["mention"], r["candidate"]) for r in found.pairs.collect()} == {(x, x) for x in left}


def test_empty_tables_and_bad_thresholds(spark):
    a, b = tables(spark, ["x"], ["x"])
    assert similar_names(a.limit(0), b).pairs.collect() == []
    assert similar_names(a.limit(0), b.limit(0)).pairs.collect() == []
    for threshold in (0, 1.5):
        with pytest.raises(ValueError):
            similar_names(a, b, threshold)
