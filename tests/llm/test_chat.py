"""Chat formatting: exact round trips, masks over tokens, long conversations in parts."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import chat

TRICKY = ["\\### Assistant: </turn> ok", "####", "a\\", "<</turn>", "</turn>\n", "### User: x", "#\\#", "", "é\n### Role x: "]


@given(st.text(alphabet="\\#<>/turnAs: \n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_hides_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert "</turn>" not in escaped and "##" not in escaped


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def expected(rows):
    found = defaultdict(list)
    order = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
    for key, _, role, text in order:
        found[key].append((role or "", text or ""))
    return found


def check(rows, digests):
    want = expected(rows)
    got = {r["conv_id"]: r for r in digests.collect()}
    assert set(got) == set(want)
    for key, own in want.items():
        every = "".join(f"{role}\n{text}\n" for role, text in own)
        learnt = "".join(text for role, text in own if role == "assistant")
        row = got[key]
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert row["loss_chars"] == len(learnt)
        assert row["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def awkward():
    rows = [(1, i, ("system", "user", "assistant")[i % 3], text) for i, text in enumerate(TRICKY)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (2, None, "tool: a\\b", "x"), (2, 1, "assistant", "again")]
    rows += [(2, 1, "assistant", "again"), (None, 0, "user", "no id"), (None, 1, "assistant", "y")]
    return rows + [(3, i, "assistant" if i % 2 else "user", f"turn {i} ### User: ") for i in range(500)]


def test_digests_equal_brute_force(spark):
    rows = awkward()
    table = turns(spark, rows).selectExpr("*", "1 as part", "2 as key", "3 as formatted")
    check(rows, chat.conversation_digests(chat.format_conversations(table)))


def test_parts_are_cut_where_tokens_end(spark, monkeypatch):
    rows = awkward()
    whole = {}
    for part in chat.format_conversations(turns(spark, rows).coalesce(1)).collect():
        whole.setdefault(part["conv_id"], []).append(part)
    tokenizer = chat._tokenizer(chat.tokenizer_path())
    for parts in whole.values():
        parts.sort(key=lambda p: p["part"])
        text = "".join(p["formatted"] for p in parts)
        ids = [i for p in parts for i in p["token_ids"]]
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids


def test_masked_tokens_cover_the_assistant_texts(spark):
    tokenizer = chat._tokenizer(chat.tokenizer_path())
    for part in chat.format_conversations(turns(spark, awkward())).collect():
        text = part["formatted"]
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        inside = {i for s in part["loss_spans"] for i in range(s["start"], s["end"])}
        for (start, end), learnt in zip(offsets, part["token_loss"], strict=True):
            assert learnt == bool(inside & set(range(start, end)))
            assert not learnt or set(range(start, end)) <= inside


def test_the_query_adds_the_self_quoting_conversation(spark):
    rows = chat.formatted_digests(turns(spark, [])).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in rows] == [(-7, 2)]
    said = "\\### Assistant: </turn> ok"
    assert rows[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
