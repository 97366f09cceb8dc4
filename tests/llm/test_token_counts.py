"""Edit-aware counts against counting the edited text anew."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import token_counts as counts
from tests.llm import helpers

LETTERS = st.text(alphabet="ab'lsve  \n\t1.é!", max_size=120)


def counter():
    return counts.pretoken_counts(counts.tokenizer_path(), counts.pretoken_pattern())


@given(LETTERS, st.lists(st.tuples(st.integers(0, 150), st.integers(0, 20), LETTERS), max_size=4))
@settings(max_examples=300, deadline=None)
def test_counts_after_edits(text, edits):
    own = counter()
    tree = counts.build_tree(text, own)
    assert tree.tokens[1] == len(own.encode_text(text))
    for start, size, replacement in edits:
        at, end = min(start, len(text)), min(start + size, len(text))
        want = text[:at] + replacement + text[end:]
        text, _ = counts.apply_edit(text, tree, start, start + size, replacement, own)
        assert text == want
        assert (tree.tokens[1], tree.chars[1]) == (len(own.encode_text(text)), len(text))
        for node in range(1, tree.slots):
            assert tree.chars[node] == tree.chars[2 * node] + tree.chars[2 * node + 1]
            assert tree.tokens[node] == tree.tokens[2 * node] + tree.tokens[2 * node + 1]


def test_only_the_touched_region_is_counted_again():
    own = counter()
    text = helpers.ENGLISH * 2_000
    tree = counts.build_tree(text, own)
    draw = random.Random(1)
    for _ in range(50):
        at = draw.randrange(len(text))
        text, scanned = counts.apply_edit(text, tree, at, at + 5, "edited", own)
        assert scanned < 600
    assert tree.tokens[1] == len(own.encode_text(text))


def test_tables(spark):
    docs = helpers.with_clashes(helpers.awkward(spark), "n_tokens", "count_tree", "edits", "_edited")
    docs = docs.drop("_edited", "edits")
    trees = counts.with_count_trees(docs)
    own = counter()
    for r in trees.collect():
        assert r["n_tokens"] == len(own.encode_text(r["text"] or ""))
    edits = F.expr("array(named_struct('start', 4, 'end', 9, 'replacement', 'slow'), "
                   "named_struct('start', 1000000, 'end', 2000000, 'replacement', cast(null as string)))")
    for r in counts.apply_edits(trees, edits).collect():
        assert r["n_tokens"] == len(own.encode_text(r["text"])) and r["n_edits"] == 2
    for r in counts.apply_edits(trees, F.lit(None).cast(counts.EDITS)).collect():
        assert (r["n_edits"], r["recounted_chars"]) == (0, 0)
    assert counts.with_count_trees(docs.limit(0)).collect() == []


def test_redacted_counts(spark):
    texts = ["write to a.b@c.org or call +49 123 4567890 now", "nothing here", None, "x" * 50_000 + " 1234567"]
    rows = counts.redacted_counts(helpers.documents(spark, list(enumerate(texts)))).collect()
    own = counter()
    want = ["write to <mail> or call <number> now", "nothing here", "", "x" * 50_000 + " <number>"]
    for r in rows:
        assert r["tokens_before"] == len(own.encode_text(texts[r["doc_id"]] or ""))
        assert r["tokens_after"] == len(own.encode_text(want[r["doc_id"]]))
        assert r["chars_after"] == len(want[r["doc_id"]])
