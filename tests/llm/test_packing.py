"""Packing: exact round trips, equality with the tokenizer, no overlap and little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelson.llm import packing
from tests.llm import helpers


def naive_first_fit(lengths, capacity):
    room, bins, offsets = [], [0] * len(lengths), [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for place, left in enumerate(room):
            if left >= lengths[item]:
                break
        else:
            place = len(room)
            room.append(capacity)
        bins[item], offsets[item] = place, capacity - room[place]
        room[place] -= lengths[item]
    return bins, offsets


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=100, deadline=None)
def test_tree_equals_naive_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    assert (bins.tolist(), offsets.tolist()) == naive_first_fit(lengths, 64)


@pytest.fixture(scope="module")
def words():
    return packing.word_tokens(packing.tokenizer_path())


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(text):
    words = packing.word_tokens(packing.tokenizer_path())
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(text), "<u4").tolist() == want


def test_ids_of_usual_words_equal_the_tokenizer(words):
    for text in [
        "It's 3¼ Ünï-x's'll ª² don'T İstanbul ΣΑΣ <|endoftext|> a\x1cb c",
        "!!''s's (well,done) e-mail@x.org #1,234.5; ¿Qué? «Ça» €9 ŉ ǅ ß ÀÉ",
        helpers.GERMAN * 3,
        "",
    ]:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want


def test_added_tokens_in_a_text_are_tokens(spark):
    fresh = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.WordTokens(packing.tokenizer_path())
    texts = [
        "One text<|endoftext|>and another.",
        "<|startoftext|> It's a start, ¿no? <|endoftext|>",
        "<|ENDOFTEXT|> <|endoftext |> <|other|> | <| |>",
        helpers.GERMAN,
    ]
    for text in texts:
        want = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), "<u4").tolist() == want
    docs = helpers.documents(spark, list(enumerate(texts)))
    for row in packing.pack_documents(docs).collect():
        want = fresh.encode(texts[row["doc_id"]], add_special_tokens=False).ids + [1]
        assert np.frombuffer(row["ids"], "<u4").tolist() == want
        assert row["doc_id"] > 1 or {49406, 49407} & set(want)


def test_unmarked_vocabularies_are_encoded_as_a_whole():
    import public_tokenizers

    other = packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Two  words, and more."
    assert not other.by_word
    want = other.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(other.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("group_bytes", [2_000, 8 << 20])
def test_every_id_lies_in_one_place(spark, words, group_bytes):
    docs = helpers.with_clashes(helpers.awkward(spark), "ids", "slot", "draw", "key", "start")
    packed = packing.pack_documents(docs, group_bytes=group_bytes).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= packing.SEQUENCE_TOKENS
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for row in docs.collect():
        want = words.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[row["doc_id"]])
        copies = 2 if row["doc_id"] == 105 else 1
        assert all(n == len(want) for _, _, n in own)
        got = [i for _, ids, _ in own[::copies] for i in ids]
        assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE_TOKENS
    used = sum(len(ids) for own in pieces.values() for _, ids, _ in own)
    if group_bytes > 1 << 20:
        assert len(sequences) <= used // packing.SEQUENCE_TOKENS + 2


def test_digest_and_empty_table(spark):
    row = packing.packed_digest(packing.pack_documents(helpers.documents(spark, [(7, None)]))).first()
    assert row["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
    assert (row["doc_id"], row["start"], row["length"], row["offset"]) == (7, 0, 1, 0)
    assert packing.pack_documents(helpers.documents(spark, [])).collect() == []


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 7, f"text {i % 11} " * (1 + i % 5)) for i in range(120)]
    docs = helpers.documents(spark, rows).coalesce(1)

    def draws(ordered):
        pieces = packing.token_pieces(ordered.coalesce(1), sequence_tokens=8)
        return sorted((r["key"], bytes(r["ids"]), r["start"], r["draw"]) for r in pieces.collect())

    first = draws(docs.sort("n_chars", "doc_id"))
    assert draws(docs.sort(F.desc("text"), "doc_id")) == first
    assert len({r[3] for r in first}) == len(first)
