"""Conversation repair against a plain search over all edit strings, and pieces against the whole."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(name.encode()) % 20
        if draw == 4:
            role = "user"
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        yield from [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)


def cheapest(rows):
    """(cost, audit, lines) over all edits: least cost, then least letters."""
    state = {("", 0): (0, "", [])}

    def accept(best, key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    def fits(form):
        return re.fullmatch("(s?(ua)*u?)?", form)

    def short(form):  # what the form's end allows
        return {"": "", "s": "s", "u": "u", "a": "ua"}[form[-1:]]

    def inserted(best):
        done = dict(best)
        for _ in range(4):
            for (form, i), (cost, audit, lines) in list(done.items()):
                for name in ("user", "assistant"):
                    if fits(form + name[0]):
                        accept(done, (short(form + name[0]), i), (cost + 3, audit + "I", [*lines, name + ":"]))
        return done

    for i, (fault, role, text) in enumerate(rows):
        state = inserted(state)
        after = {}
        for (form, _), (cost, audit, lines) in state.items():
            accept(after, (form, i + 1), (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                if name and fits(form + name[0]):
                    accept(after, (short(form + name[0]), i + 1), (cost + price + more, audit + letter, [*lines, f"{name}:{text}"]))
        state = after
    state = inserted(state)
    return min((v for (form, _), v in state.items() if form == "" or form[-1] == "a"), key=lambda v: v[:2])


def expected(rows):
    found = {}
    broken = list(damage(rows))
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in broken if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            tail = text.rstrip(" \t\n\x0b\x0c\r")
            if BLANK.fullmatch(text):
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("truncated" if tail[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        initials = [r[1][:1] for r in own]
        cost, audit, lines = cheapest([(f, role, text) for f, (_, role, text) in zip(faults, own, strict=True)])
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def repaired(spark, rows, *clashes):
    table = spark.createDataFrame(rows, SCHEMA)
    for name in clashes:
        table = table.selectExpr("*", f"'x' as `{name}`")
    return {r[0]: tuple(r[1:]) for r in turn_repair.repaired_conversations(table).collect()}


def random_rows(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for i in range(draw.randint(0, longest)):
            turn = draw.choice([i, i, i, None, i + 3])
            role = draw.choice(["user", "assistant", "assistant", "user", "system", None, "", "tool", "Assistant"])
            rows.append((conv, turn, role, draw.choice(["Yes.", "No", " \n", None, "Why? \t", "é!", "two\nlines", "A b."])))
    return rows


@given(st.lists(st.integers(0, 15), max_size=9), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_prices_and_tight_paths_equal_a_plain_search(kinds, cut):
    names = ["s", "u", "a", "x"]
    faults = ["", "blank", "duplicate", "truncated"]
    cost, audit, _ = cheapest([(faults[k % 4], names[k // 4], "") for k in kinds])
    whole = bytes(kinds)
    assert turn_repair.auction(whole, turn_repair.END_PRICES)[0][turn_repair.NOTHING] == cost
    assert audit.startswith(turn_repair.trace(whole, turn_repair.END_PRICES)[turn_repair.NOTHING])
    # Pieces chained by their distances cost the same.
    exits = turn_repair.END_PRICES
    for piece in (whole[cut:], whole[:cut]):
        costs = turn_repair.distances(piece)
        exits = [min(costs[4 * e + x] + exits[x] for x in range(4)) for e in range(4)]
    assert exits[turn_repair.NOTHING] == cost


def test_repairs_equal_a_plain_search(spark):
    rows = random_rows(3, 150, 9)
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Hi.")]
    rows += [(900, t, "user" if t % 2 else "assistant", "Same.") for t in range(40)] * 2
    assert repaired(spark, rows, "conv", "key", "place", "segment", "kind", "first") == expected(rows)


def test_conversations_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE_BITS", 2)
    rows = random_rows(4, 12, 40) + [(1_000, t, "user", f"Turn {t}") for t in range(120)]
    assert repaired(spark, rows) == expected(rows)


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repaired(spark, []) == {}


def test_prices_stay_linear_in_long_conversations():
    draw = random.Random(5)
    kinds = bytes(draw.choice([4, 8, 5, 9, 10, 11, 0]) for _ in range(4_096))
    prices = turn_repair.auction(kinds, turn_repair.END_PRICES)
    letters = turn_repair.trace(kinds, turn_repair.END_PRICES)[turn_repair.NOTHING]
    paid = sum({"K": 0, "I": 3, "D": 4, "R": 3}[x] for x in letters)
    rows = [k for k in kinds]
    at = 0
    for letter in letters:
        if letter != "I":
            paid += 3 * (letter in "KR" and rows[at] % 4 == turn_repair.TRUNCATED)
            at += 1
    assert at == len(kinds)
    assert prices[0][turn_repair.NOTHING] - paid in turn_repair.END_PRICES
