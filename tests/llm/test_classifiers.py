"""Language ID, toxicity and quality: held-out accuracy and awkward inputs."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import language_id, quality, toxicity
from keelson.llm.common import hash_spans, mix
from tests.llm import helpers


def fold(key, folds):
    return zlib.crc32(str(key).encode()) % folds


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean texts, shouting junk (quality 0) and texts with a bad word (toxic 1)."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows, marks = [], []
    for i in range(240):
        text = [draw.choice(words).replace("0", "o") for _ in range(60)]
        good, toxic = i % 4 != 0, i % 3 == 0
        if toxic:
            text[draw.randrange(60)] = draw.choice(["scoundrel", "nitwit"])
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        marks.append((i, int(good), int(toxic)))
    return helpers.documents(spark, rows), helpers.labels(spark, marks)


def test_language_on_held_out_rows(spark):
    docs = helpers.awkward(spark)
    rows = {r["doc_id"]: r for r in language_id.held_out_languages(docs).collect()}
    assert len(rows) == len({r["doc_id"] for r in docs.collect()})
    for key in range(40):
        assert rows[key]["held_out"] == (fold(key, 3) == 1)
        assert rows[key]["lang_pred"] == ("en" if key < 20 else "de")
        assert 0.9 < rows[key]["score"] <= 1
    for key in (100, 101, 102, 103):
        assert (rows[key]["lang_pred"], rows[key]["score"]) == ("und", 0.0)
    assert rows[104]["lang_pred"] == "en"
    assert rows[None]["held_out"] is False


def test_language_without_rows_or_languages(spark):
    empty = helpers.documents(spark, [])
    assert language_id.held_out_languages(empty).collect() == []
    model = language_id.fit_language_model(helpers.documents(spark, [(1, "text", None)]))
    row = language_id.identify_languages(helpers.documents(spark, [(1, "text")]), model).first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_language_scores_equal_a_plain_sum(spark):
    docs = helpers.documents(spark, [(1, helpers.ENGLISH, "en"), (2, helpers.GERMAN, "de")])
    model = language_id.fit_language_model(docs)
    text = "the fox und der Hund"
    sums = model.prior.copy()
    for hashed, _ in language_id._ngrams([text]):
        sums += model.weights[hashed].astype(float).sum(0)
    want = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
    row = language_id.identify_languages(helpers.documents(spark, [(9, text)]), model).first()
    assert row["score"] == pytest.approx(want.max(), rel=1e-9)
    # Texts scored together do not touch each other.
    together = list(language_id._ngrams([text, "", "a", text]))
    for (hashed, starts), (alone, _) in zip(together, language_id._ngrams([text]), strict=True):
        assert hashed[: len(alone)].tolist() == alone.tolist() == hashed[starts[3] :].tolist()


def test_extra_columns_give_way(spark):
    docs = helpers.with_clashes(helpers.awkward(spark), "LANG_pred", "score", "_language", "k")
    docs = docs.drop("_language")
    model = language_id.fit_language_model(docs)
    found = language_id.identify_languages(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.columns.count("k") == 1
    assert found.count() == docs.count()


@pytest.mark.parametrize("which", ["toxicity", "quality"])
def test_labels_on_held_out_rows(spark, labelled, which):
    docs, marks = labelled
    run = toxicity.held_out_toxicity if which == "toxicity" else quality.held_out_quality
    column = "toxic" if which == "toxicity" else "quality"
    truth = {r["doc_id"]: r[column] for r in marks.collect()}
    rows = run(docs, marks).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in truth if fold(k, 4) == 2}
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held)
    limit = toxicity.THRESHOLD if which == "toxicity" else quality.THRESHOLD
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in rows)


@pytest.mark.parametrize("run", [toxicity.held_out_toxicity, quality.held_out_quality])
def test_labels_with_awkward_rows(spark, run):
    docs = helpers.with_clashes(helpers.awkward(spark), "score", "order", "label", "counts")
    marks = helpers.labels(spark, [(0, 1, 0), (0, 0, 1), (1, None, None), (None, 1, 1), (100, 1, 0), (105, 1, 1)])
    rows = run(docs, marks).collect()
    assert len(rows) == docs.count()
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    twice = [r["score"] for r in rows if r["doc_id"] == 105]
    assert len(twice) == 2 and twice[0] == twice[1]
    none = helpers.labels(spark, [])
    assert {r["score"] for r in run(docs, none).collect()} == {0.5}
    assert run(helpers.documents(spark, []), marks).collect() == []


def test_toxicity_weights_are_sparse(spark, labelled):
    model = toxicity.fit_toxicity_model(*labelled)
    assert 0 < len(model.buckets) < 2_000
    assert np.count_nonzero(model.dense) == len(model.buckets)


def test_quality_votes_equal_brute_force():
    draw = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = unit(draw.normal(size=(100, 8)))
    model = quality.QualityModel(np.ones(1), np.zeros((1, 8)), vectors, draw.integers(0, 2, 100).astype(float))
    rows = unit(draw.normal(size=(7, 8)))
    for row, vote in zip(rows, quality._votes(rows, model), strict=True):
        cosines = vectors @ row
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.clip(cosines[near], 1e-6, 1) ** quality.SHARPNESS
        assert vote == pytest.approx((weight * model.labels[near]).sum() / weight.sum())


def test_quality_scores_do_not_depend_on_the_batch(spark, labelled):
    docs, marks = labelled
    model = quality.fit_quality_model(docs, marks)
    texts = [r["text"] for r in docs.collect()]
    same = quality.QualityModel(
        model.term_weights,
        model.projection,
        np.repeat(model.vectors[:1], 100, axis=0),
        np.arange(100) % 2.0,
    )
    for own in (model, same):
        def votes(part, own=own):
            counts = quality.term_counts(pa.array(part))
            return quality._votes(quality._unit(quality._weighted(counts, own.term_weights) @ own.projection), own)

        whole = votes(texts * 2)
        assert [votes([t])[0] for t in texts[:40]] == whole[:40].tolist()
        assert whole[: len(texts)].tolist() == whole[len(texts) :].tolist()


def test_a_language_of_copies_is_learned_once(spark, monkeypatch):
    for text in ("Texto igual de siempre", "otro texto repetido", "la misma cosa otra vez", "uno mas"):
        rows = [(i, text, "es") for i in range(500)] + [(1_000 + i, f"english text number {i}", "en") for i in range(40)]
        model = language_id.fit_language_model(helpers.documents(spark, rows), rows_per_language=30)
        k = model.languages.index("es")
        grams = sum(len(own) for own, _ in language_id._ngrams([text]))
        assert model.totals[k] == grams


def plain_features(text):
    """Distinct buckets of a text by a dictionary of byte strings."""
    words = [m[0] for m in re.finditer(rb"[a-z\x80-\xff]+", text.lower().encode())]

    def number(word):
        data = np.frombuffer(word, np.uint8)
        return int(hash_spans(data, np.array([0]), np.array([len(word)]))[0])

    hashes = [number(w) for w in words]
    found = set(hashes)
    for size in toxicity.STEMS:
        found |= {(number(w[:size]) + size) % 2**64 for w in words if len(w) > size}
    for gap in toxicity.GAPS:
        for a, b in zip(hashes, hashes[gap:], strict=False):
            second = int(mix(np.array([(b + gap) % 2**64], np.uint64))[0])
            found.add((a * (2 * gap + 1) + second) % 2**64)
    return {int(mix(np.array([h], np.uint64))[0]) >> (64 - toxicity.BUCKET_BITS) for h in found}


def plain_ftrl(examples):
    """The published update, one coordinate after the other, in dictionaries."""
    z, n = {}, {}
    share = min(max(sum(y for _, y in examples) / len(examples), 1e-3), 1 - 1e-3)
    offset = math.log(share / (1 - share))

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        rate = (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2
        return -(z[i] - sign * toxicity.L1) / rate

    for _ in range(toxicity.EPOCHS):
        for buckets, y in examples:
            own = {i: weight(i) for i in [*buckets, "bias"]}
            g = 1 / (1 + math.exp(-(sum(own.values()) + offset))) - y
            for i, w in own.items():
                before = n.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = before + g * g
    weights = {i: weight(i) for i in z if i != "bias"}
    return {i: w for i, w in weights.items() if w}, weight("bias") + offset


def test_toxicity_equals_a_plain_loop(spark, labelled):
    docs, marks = labelled
    toxic = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    # The order of the examples is that of the choice.
    chosen = toxicity.labelled_texts(docs, marks, "toxic", toxicity.TRAINING_ROWS).collect()
    chosen.sort(key=lambda r: (r["order"], r["text"], r["label"]))
    weights, bias = plain_ftrl([(plain_features(r["text"]), r["label"]) for r in chosen])
    model = toxicity.fit_toxicity_model(docs, marks)
    assert set(model.buckets.tolist()) == set(weights)
    assert np.allclose(model.weights, [weights[b] for b in model.buckets.tolist()], atol=1e-9)
    assert abs(model.bias - bias) < 1e-9
    scored = toxicity.score_toxicity(helpers.with_clashes(docs, "_text", "table"), model).collect()
    assert len(scored) == len(toxic)
    for row in scored:
        total = bias + sum(weights.get(b, 0.0) for b in plain_features(row["text"]))
        assert abs(row["score"] - 1 / (1 + math.exp(-total))) < 1e-9
