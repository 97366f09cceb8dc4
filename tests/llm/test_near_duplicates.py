"""Near duplicates against exact components of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import near_duplicates as near
from keelson.llm.common import hash_spans
from keelson.llm.components import connected_components
from tests.llm import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(key, shingles(text)) for key, text in rows if key is not None]
    parent = {key: key for key, _ in sets}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for i, (a, own) in enumerate(sets):
        for b, other in sets[:i]:
            both = len(own & other)
            if a == b or own and other and 100 * both >= 75 * (len(own) + len(other) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {key: root(key) for key in parent}


def corpus(seed):
    """Chains of edited copies, exact copies, a crowd of near copies, texts sharing a passage."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    write = lambda n: [draw.choice(words) for _ in range(n)]
    rows, passage = [], write(60)
    base = write(80)
    for key in range(70):  # a crowd around one text
        own = base[:]
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((key, " ".join(own)))
    own = write(90)
    for key in range(100, 120):  # a chain: neighbours are near, the ends are not
        rows.append((key, " ".join(own)))
        own = own[:]
        own[draw.randrange(len(own))] = draw.choice(words)
    rows += [(200 + i, "  Exactly THE same text as the others here ") for i in range(30)]
    rows += [(300 + i, " ".join(passage + write(60))) for i in range(40)]
    rows += [(400 + i, " ".join(write(draw.randint(1, 9)))) for i in range(40)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [near.BLOCK, 16])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus(block)
    docs = helpers.with_clashes(helpers.documents(spark, rows), "id", "node", "kept", "component", "bucket")
    want = brute(rows)
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert r["n_shingles"] == len(shingles(text[r["doc_id"]]))
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    extra = helpers.documents(spark, [(1, "one two"), (500, "ONE  two"), (501, "one two three")])
    rows = near.near_duplicates(docs.union(extra)).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["doc_id"], []).append(r)
    for key in (100, 101, 102):
        assert (by_key[key][0]["n_shingles"], by_key[key][0]["component_id"], by_key[key][0]["kept"]) == (0, key, True)
    # Rows of one key are one document: both texts of 1 link.
    assert by_key[500][0]["component_id"] == by_key[1][0]["component_id"] == by_key[1][1]["component_id"]
    assert by_key[501][0]["component_id"] == 501
    assert by_key[None][0]["component_id"] is None and by_key[None][0]["kept"]
    assert [r["component_id"] for r in by_key[105]] == [by_key[105][0]["component_id"]] * 2
    assert near.near_duplicates(docs.limit(0)).collect() == []


def test_estimate_is_near_the_similarity():
    draw = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.75, 0.9, 1.0):
        both = draw.integers(0, 1 << 63, 2_000, np.uint64)
        own = int(2_000 * share)
        rest = (2_000 - own) // 2
        a, b = both[: own + rest], np.concatenate((both[:own], both[own + rest : own + 2 * rest]))
        packed = [near.pack_low_bits(near.minima(x, np.array([0])))[0] for x in (a, b)]
        got = near.estimated_similarity(packed[0], packed[1])
        assert got == pytest.approx(own / (own + 2 * rest), abs=0.16)


def test_sets_are_the_same_in_any_batch():
    texts = ["a b c d e f", "", None, "A B", "a b c d e f", "x"]
    hashed, cuts = near.shingle_sets(pa.array(texts))
    sets = [hashed[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    alone = [near.shingle_sets(pa.array([t]))[0].tolist() for t in texts]
    assert sets == alone and sets[0] == sets[4] and [len(s) for s in sets] == [2, 0, 0, 1, 2, 1]


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (70, 50), (80, 80), (None, 3)]
    links = spark.createDataFrame(edges, "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = {i: 1 for i in range(2, 41)} | {60: 50, 70: 50}
    assert {k: v for k, v in found.items() if k != v} == want
    assert connected_components(links.limit(0)).collect() == []


def test_alternating_long_words_are_told_apart(spark):
    # Thue-Morse words: any polynomial modulo a power of two gives both one hash.
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2_048))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    first, second = hash_spans(data, np.array([0, 2_048]), np.array([2_048, 4_096]))
    assert first != second
    rows = [(1, f"{word} one two three four"), (2, f"{other} one two three four")]
    found = near.near_duplicates(helpers.documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2}
