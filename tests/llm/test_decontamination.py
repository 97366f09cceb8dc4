"""Decontamination against a plain edit-distance search."""

import random

import pytest

from keelson.llm import decontamination as decon
from tests.llm import helpers


def brute(pattern, words):
    best, before = None, list(range(len(pattern) + 1))
    for end, word in enumerate(words, 1):
        now = [0]
        for i, own in enumerate(pattern, 1):
            now.append(min(before[i] + 1, now[i - 1] + 1, before[i - 1] + (own != word)))
        before = now
        if best is None or now[-1] < best[0]:
            best = (now[-1], end)
    return best


def test_bit_parallel_distance():
    draw = random.Random(1)
    for _ in range(500):
        pattern = [draw.choice("abcd") for _ in range(draw.randint(1, 80))]
        words = [draw.choice("abcde") for _ in range(draw.randint(1, 90))]
        masks = {}
        for i, word in enumerate(pattern):
            masks[word] = masks.get(word, 0) | 1 << i
        assert decon.bit_parallel_search(masks, len(pattern), words) == brute(pattern, words)


def test_pieces_hold_all_words_in_order():
    words = [str(i) for i in range(23)]
    pieces = decon.pieces_of(words, 4)
    assert len(pieces) == 5 and [w for _, own in pieces for w in own] == words
    assert all(words[at] == own[0] for at, own in pieces)


@pytest.mark.parametrize("per_block", [100_000, 40])
def test_rows_equal_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(decon, "WORDS_PER_BLOCK", per_block)
    draw = random.Random(per_block)
    some = [f"w{i}" for i in range(15)]
    items = [[draw.choice(some) for _ in range(draw.randint(1, 30))] for _ in range(8)]
    docs = []
    for key in range(60):
        words = [draw.choice(some) for _ in range(draw.randint(0, 70))]
        if key % 2:
            own = draw.choice(items)[:]
            for _ in range(draw.randint(0, len(own) // 5 + 1)):
                at = draw.randrange(len(own))
                own[at : at + draw.randint(0, 1)] = ["new"] if draw.random() < 0.5 else []
            at = draw.randint(0, len(words))
            words[at:at] = own
        docs.append((key, ", ".join(words).upper()))
    table = helpers.with_clashes(helpers.documents(spark, docs), "item", "hits", "distance")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decon.contaminations(table, tests).collect()}
    want = {}
    for key, text in docs:
        for i, own in enumerate(items):
            found = brute(own, decon.normalized_words(text))
            if found and found[0] <= len(own) // decon.WORDS_PER_EDIT:
                want[key, i] = found[0]
    assert got == want
    kept = {r["doc_id"] for r in decon.decontaminated(table, tests).collect()}
    assert kept == {key for key, _ in docs} - {key for key, _ in want}


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    tests = spark.createDataFrame(
        [(1, None), (2, ""), (3, "?!"), (4, helpers.GERMAN), (4, helpers.GERMAN), (None, "dog sleeps in the sun")],
        "item_id long, text string",
    )
    rows = decon.contaminations(docs, tests).collect()
    assert {r["item_id"] for r in rows} == {4, None}
    assert sum(r["item_id"] == 4 for r in rows) == 40
    clean = decon.decontaminated(docs, tests)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {100, 101, 102, 103, 106}
    assert decon.contaminations(docs, tests.limit(0)).collect() == []
    assert decon.contaminations(docs.limit(0), tests).collect() == []
    assert decon.decontaminated(docs, tests.limit(0)).count() == docs.count()
