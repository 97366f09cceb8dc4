"""Filter audit against a plain count over every document, order and step."""

import re
from collections import Counter
from itertools import permutations

from keelson.llm import filter_audit
from tests.llm.helpers import awkward, documents, labels, with_clashes

COLUMNS = [
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
    "toxic_lost", "shapley",
]


def brute(docs, marks):
    good = {k for k, q, t in marks if q == 1 and k is not None}
    toxic = {k for k, q, t in marks if t == 1 and k is not None}
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None
            and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        }
        rows.append((source or "", {f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                counts = Counter()
                for own, fails, is_good, is_toxic in rows:
                    if own != part:
                        continue
                    before = bool(fails & set(order[: step - 1]))
                    fail = name in fails
                    counts["kept"] += not before and not fail
                    counts["removed"] += not before and fail
                    counts["redundant"] += before and fail
                    counts["unique_fails"] += fails == {name}
                    counts["good_lost"] += not before and fail and is_good
                    counts["toxic_lost"] += not before and fail and is_toxic
                shapley[name] += counts["removed"]
                found[part, "".join(order), step] = [counts[c] for c in COLUMNS[3:9]]
        for (own, order, step), row in found.items():
            if own == part:
                row.append(shapley[order[step - 1]])
    return sorted((*key, *row) for key, row in found.items())


def audited(docs, marks):
    found = filter_audit.filter_audit(docs, marks)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (5, 1, 1), (None, 1, 1), (5, 1, 1), (77, 1, 1)]


def test_counts_equal_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, words + f" {i % 3} tail", "a") for i in range(12)]
    rows += [(20 + i, "Same text again", "ab"[i % 2]) for i in range(30)]
    rows += [(5, "Same text again", "b"), (5, "Same text again", "b"), (20, "Same text again", "b")]
    rows += [(60, None, None), (61, "", "a"), (None, words, "a"), (None, words, "b"), (63, "x " * 90, "c")]
    rows += [(64, words + " # A B", "c"), (65, words.upper(), "c"), (66, "\x0b\x0c \u00a0 \u2003", ""), (1, "ONE $", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    crowded = with_clashes(docs, "part", "mask", "n", "good", "digest", "cell")
    marks = with_clashes(labels(spark, MARKS), "text", "source", "first_id")
    assert audited(crowded.repartition(5), marks) == brute(rows, MARKS)


def test_awkward_documents(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert audited(docs, labels(spark, MARKS)) == brute(rows, MARKS)


def test_empty_tables(spark):
    assert audited(documents(spark, []), labels(spark, [])) == []
    rows = [(1, "a b c")]
    assert audited(documents(spark, rows), labels(spark, [])) == brute([(1, "a b c", "src0")], [])


def test_orders_come_to_the_same_end(spark):
    found = audited(awkward(spark), labels(spark, MARKS))
    ends = {r[3] for r in found if r[2] == 5}
    assert len(ends) == 1 and len(found) == 600
