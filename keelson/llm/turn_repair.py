"""Repair of broken conversations at least cost, by the auction algorithm for shortest paths.

A conversation is a lattice. Its nodes are a place between two rows and the state of the wanted
form: nothing yet, after the system turn, after a user turn, after an assistant turn. Its arcs are
the edits with their whole costs. Every node has a price, at first a lower bound. A path grows from an origin
along the cheapest arc; where the price of its end is under the least (cost + price of the next
node), the price rises to it and the path contracts. Prices never exceed true distances, so when a
path reaches a node whose price is exact, all prices on it are exact. Origins are taken from the
last row to the first, so each path soon meets exact prices. In the end every price is exact, the
arcs with price = cost + next price are tight, and the audit is the tight path with the least
letters.

A conversation may be of any length: its rows are cut into pieces. Each piece is priced towards each
of its four exits, the few numbers of a conversation's pieces are chained from the last to the
first, and every piece is then traced on its own from each of its four entries. Only the choice among
these and the checksum, which is sequential by definition, stream over the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import small_batches, store
from keelson.session import salted_join

#: Fixed values of the contract: costs of the edits.
REROLE, DELETE, INSERT, KEEP_TRUNCATED = 3, 4, 3, 3
#: States of the form (s?(ua)+)?; a conversation may end in NOTHING or ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Rows of a partition that are one piece, as a power of two.
PIECE_BITS = 12
#: White space; anything else is a character of its own.
BLANKS = " \t\n\x0b\x0c\r"

#: A row's kind is 4 * initial + fault, by the places here.
INITIALS = "sua"  # other initials: 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: More than any distance within a piece: what cannot be reached.
FAR = 1 << 40


# -- the lattice ---------------------------------------------------------------------------------


def _next_role(state: int) -> int:
    """The state after a turn whose role is free."""
    return ASSISTANT if state == USER else USER


def _arcs(kind: int, state: int) -> list[tuple[str, int, int, int]]:
    """Letter, cost, rows passed and next state of every edit at a node before a row, by letter."""
    initial, fault = divmod(kind, 4)
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _next_role(state))]
    if fault not in (BLANK, DUPLICATE):
        more = KEEP_TRUNCATED if fault == TRUNCATED else 0
        if initial == 0 and state == NOTHING:
            arcs.append(("K", more, 1, SYSTEM))
        elif initial in (1, 2) and initial + 1 == _next_role(state):
            arcs.append(("K", more, 1, initial + 1))
        arcs.append(("R", REROLE + more, 1, _next_role(state)))
    return arcs


ARCS = [[_arcs(kind, state) for state in STATES] for kind in range(16)]


def auction(kinds: bytes, exits: Sequence[int], known: frozenset[int] = frozenset()) -> list[list[int]]:
    """Exact prices of all nodes of a piece: one list of four per place, the last being ``exits``.

    ``exits`` are the exact prices behind the last row. ``known`` are states from which no wanted
    exit can be reached; their nodes are FAR from the start.
    """
    prices = [[0] * 4 for _ in kinds]
    prices.append(list(exits))
    exact = [[state in known for state in STATES] for _ in kinds]
    exact.append([True] * 4)
    for place in range(len(kinds) - 1, -1, -1):
        # The least price behind is under every distance from here, and keeps prices feasible.
        start = min(prices[place + 1])
        prices[place] = [FAR if state in known else start for state in STATES]
        for origin in STATES:
            path = [] if exact[place][origin] else [(place, origin)]
            while path:
                at, state = path[-1]
                least, to = min(
                    (cost + prices[at + rows][target], (at + rows, target))
                    for _, cost, rows, target in ARCS[kinds[at]][state]
                )
                if prices[at][state] < least:
                    prices[at][state] = least
                    if len(path) > 1:
                        path.pop()
                elif exact[to[0]][to[1]]:
                    for i, s in path:
                        exact[i][s] = True
                    path = []
                else:
                    path.append(to)
    return prices


#: Behind the last row: inserts only. Two turns are missing after a system turn, one after a user.
END_PRICES = (0, 2 * INSERT, INSERT, 0)
END_LETTERS = ("", "II", "I", "")


@lru_cache(maxsize=1 << 14)
def distances(kinds: bytes) -> tuple[int, ...]:
    """Least costs from each entry (first index) to each exit of a piece; FAR where there is no way."""
    found = [[FAR] * 4 for _ in STATES]
    for end in STATES:
        # The form never goes back to NOTHING or SYSTEM.
        known = frozenset(s for s in STATES if end < USER and s > end)
        prices = auction(kinds, [0 if s == end else FAR for s in STATES], known)
        for entry in STATES:
            found[entry][end] = min(prices[0][entry], FAR)
    return tuple(cost for row in found for cost in row)


@lru_cache(maxsize=1 << 14)
def trace(kinds: bytes, exits: tuple[int, ...]) -> tuple[str, ...]:
    """For each entry of a piece the letters of its least tight path."""
    prices = auction(kinds, exits)
    found = []
    for entry in STATES:
        at, state, letters = 0, entry, []
        while at < len(kinds):
            for letter, cost, rows, target in ARCS[kinds[at]][state]:
                if prices[at][state] == cost + prices[at + rows][target]:
                    letters.append(letter)
                    at, state = at + rows, target
                    break
        found.append("".join(letters))
    return tuple(found)


# -- rows ----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The contract's damage: columns ``conv``, ``turn``, ``role``, ``text``.

    Null roles and texts are one space, and so are null keys and numbers in the draw. By the draw
    of its key and number a row is dropped, emptied, robbed of its ends of sentences, doubled, or
    made the user's.
    """
    key, turn = F.col(conversation), F.col("turn")
    one = F.lit(" ")
    draw = F.crc32(
        F.concat(F.coalesce(key.cast("string"), one), F.lit(":"), F.coalesce(turn.cast("string"), one))
    ) % 20
    text = F.coalesce("text", one)
    return (
        conversations.select(
            key.alias("conv"),
            turn.alias("turn"),
            F.when(draw == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
            F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            draw.alias("draw"),
        )
        .where("draw <> 0")
        .select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))))
        .drop("col")
    )


def _name(conversation: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


def _ordered(rows: DataFrame) -> DataFrame:
    """All rows with their ``place`` in one order over all tasks, written once.

    Dealt by ranges of the order, so a conversation of any length is spread. The range sample sees
    beginnings of texts only.
    """
    keys = [F.col("key"), F.col("turn").asc_nulls_first()]
    return store(
        rows.withColumn("key", _name(F.col("conv")))
        .repartitionByRange(*keys, F.left("role", F.lit(64)), F.left("text", F.lit(64)))
        .sortWithinPartitions(*keys, "role", "text")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("segment", F.shiftright("place", PIECE_BITS))
    )


def _kinds(ordered: DataFrame) -> DataFrame:
    """Rows ``key``, ``segment``, ``place``, ``kind``, without texts.

    A row is a duplicate if its role and text (as SHA-256) stand at a lesser place of the
    conversation; the first place comes from one aggregate and is joined back salted, so neither a
    long conversation nor a text said a million times is one task's.
    """
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = ordered.select(
        "key",
        "segment",
        "place",
        F.left("role", F.lit(1)).alias("initial"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256)).alias("said"),
        (F.length(ends) == 0).alias("blank"),
        (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    first = rows.groupBy("key", "said").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    seen = salted_join(rows, first.where("n > 1").drop("n"), ["key", "said"], ["place"], how="left")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1)
    initial = initial.when(F.col("initial") == "a", 2).otherwise(3)
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("place") > F.col("first"), DUPLICATE)
        .when(F.col("truncated"), TRUNCATED)
        .otherwise(FINE)
    )
    return seen.select("key", "segment", "place", (4 * initial + fault).alias("kind"))


# -- pieces --------------------------------------------------------------------------------------

_Batches = Iterator[pa.RecordBatch]


def _rows(batches: _Batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> _Batches:
    """Arrow batches of ``size`` rows."""
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in waiting], schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in waiting], schema)


_KEY = [("key", pa.string()), ("segment", pa.int64()), ("kinds", pa.binary())]
_PIECE = pa.schema([*_KEY, ("distances", pa.list_(pa.int64()))])
_PRICED = pa.schema([*_KEY, ("exits", pa.list_(pa.int64())), ("cost", pa.int64())])
_TRACED = pa.schema(
    [*_KEY, ("cost", pa.int64()), ("letters", pa.list_(pa.string()))]
)
_REPAIRED = pa.schema(
    [("key", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_SPARK = {
    pa.string(): "string",
    pa.int64(): "long",
    pa.binary(): "binary",
    pa.list_(pa.int64()): "array<long>",
    pa.list_(pa.string()): "array<string>",
}


def _spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SPARK[f.type]}" for f in schema)


def _cut(batches: _Batches) -> _Batches:
    """From rows in order, each piece with its distances."""

    def pieces() -> Iterator[tuple]:
        now, kinds = None, bytearray()
        for key, segment, kind in _rows(batches):
            if now != (key, segment):
                if now is not None:
                    yield (*now, bytes(kinds), distances(bytes(kinds)))
                now, kinds = (key, segment), bytearray()
            kinds.append(kind)
        if now is not None:
            yield (*now, bytes(kinds), distances(bytes(kinds)))

    return _batches(pieces(), _PIECE)


def _price(batches: _Batches) -> _Batches:
    """From pieces, the last of a conversation first, their exact exit prices.

    ``cost`` is the conversation's if this were its first piece.
    """

    def priced() -> Iterator[tuple]:
        now, exits = None, END_PRICES
        for key, segment, kinds, costs in _rows(batches):
            if now != key:
                now, exits = key, END_PRICES
            entries = tuple(
                min(costs[4 * entry + end] + exits[end] for end in STATES) for entry in STATES
            )
            yield key, segment, kinds, exits, entries[NOTHING]
            exits = entries

    return _batches(priced(), _PRICED)


def _trace(batches: _Batches) -> _Batches:
    """For every piece the letters of its four entries."""

    def traced() -> Iterator[tuple]:
        for key, segment, kinds, exits, cost in _rows(batches):
            ways = trace(kinds, tuple(exits))
            yield key, segment, kinds, cost, ways

    return _batches(traced(), _TRACED, 16)


_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of a conversation while its pieces and rows stream by in order."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.cost: int | None = None
        self.state = NOTHING
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0
        self.turns: list[int] = []  # least, greatest, how many
        self.initial: str | None = None
        self.kinds = b""
        self.letters = ""
        self.row = self.letter = 0

    def start_piece(self, kinds: bytes, cost: int, letters: list[str]) -> None:
        self.inserts()  # of the piece before
        if self.cost is None:
            self.cost = cost
        self.kinds, self.letters = kinds, letters[self.state]
        self.audit.append(self.letters)
        self.row = self.letter = 0

    def write(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def free_turn(self, text: str) -> None:
        self.state = _next_role(self.state)
        self.write("user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.letters[self.letter : self.letter + 1] == "I":
            self.free_turn("")
            self.letter += 1

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.faults[self.kinds[self.row] % 4] += 1
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.inserts()
        letter = self.letters[self.letter]
        if letter == "R":
            self.free_turn(text)
        elif letter == "K":
            self.state = SYSTEM if self.kinds[self.row] // 4 == 0 else _next_role(self.state)
            self.write(role, text)
        self.letter += 1
        self.row += 1

    def result(self) -> tuple:
        self.inserts()
        for _ in END_LETTERS[self.state]:
            self.audit.append("I")
            self.free_turn("")
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        _, blank, duplicate, truncated = self.faults
        return (
            self.key, gaps, blank, duplicate, truncated, self.illegal, self.cost or 0,
            "".join(self.audit), self.digest.hexdigest(),
        )


def _repair(batches: _Batches) -> _Batches:
    """From markers, traced pieces and rows in order, one row per conversation."""

    def repaired() -> Iterator[tuple]:
        now: _Conversation | None = None
        for key, step, kinds, cost, letters, turn, role, text in _rows(batches):
            if now is None or now.key != key:
                if now is not None:
                    yield now.result()
                now = _Conversation(key)
            if step == 1:
                now.start_piece(kinds, cost, letters)
            elif step == 2:
                now.add(turn, role, text)
        if now is not None:
            yield now.result()

    return _batches(repaired(), _REPAIRED, 64)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Repair ``rows`` (``conv``, ``turn``, ``role``, ``text``, without null roles and texts).

    One row per distinct ``conv`` of ``conversations``, also for those without a row: ``conv``,
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``. Rows of a conversation are taken by turn, null ones first, then by role
    and text, so repeated rows are adjacent. ``audit`` holds one letter per edit, as long as
    the conversation by its definition.
    """
    small_batches(rows.sparkSession)
    ordered = _ordered(rows)
    pieces = (
        _kinds(ordered)
        .repartition("key", "segment")
        .sortWithinPartitions("key", "segment", "place")
        .select("key", "segment", "kind")
        .mapInArrow(_cut, _spark_schema(_PIECE))
    )
    priced = (
        pieces.repartition("key")
        .sortWithinPartitions("key", F.desc("segment"))
        .mapInArrow(_price, _spark_schema(_PRICED))
    )
    traced = priced.repartition("key", "segment").mapInArrow(_trace, _spark_schema(_TRACED))
    names = conversations.select(F.col("conv")).distinct().select(_name(F.col("conv")).alias("key"), "conv")
    columns = ["key", "segment", "place", "step", "kinds", "cost", "letters", "turn", "role", "text"]
    stream = (
        names.select("key", F.lit(-1).cast("long").alias("segment"), F.lit(0).alias("step"))
        .unionByName(traced.withColumn("step", F.lit(1)), allowMissingColumns=True)
        .unionByName(
            ordered.select("key", "segment", "place", F.lit(2).alias("step"), "turn", "role", "text"),
            allowMissingColumns=True,
        )
        .select(columns)
        .repartition("key")
        .sortWithinPartitions("key", "segment", "step", "place")
        .drop("segment", "place")
    )
    found = stream.mapInArrow(_repair, _spark_schema(_REPAIRED))
    return found.join(names, "key").drop("key")


def repaired_conversations(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Damage all conversations as the contract says, and repair them.

    Nulls are written as one space; a null conversation is one of its own. Conversations all of
    whose rows were dropped have zeros, an empty audit and the hash of nothing. Further columns are
    not read; an empty table gives no rows.
    """
    names = conversations.select(F.col(conversation).alias("conv"))
    found = repair(damaged(conversations, conversation), names)
    return found.select(F.col("conv").alias(conversation), *_REPAIRED.names[1:])
