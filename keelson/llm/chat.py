"""Chat formatting with offset-aligned loss masks.

Conversations are rendered with a fixed template, encoded once with character offsets, and the
sorted spans of the assistant turns are intersected with the token spans by binary search.

The template of a turn is ``### Role: text</turn>`` and a line feed. Its control strings are
special tokens, so no token reaches across the edge of a text. In texts a backslash is put before
every backslash, before a ``#`` that follows a ``#``, and before the ``/`` of ``</turn>``; removing
it restores the text exactly, and no text can hold a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import small_batches, store

#: Roles of the template; any other role is written out, escaped, behind OTHER.
ROLES = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER = "### Role "
NO_ROLE = "### Turn: "
END = "</turn>\n"
#: Characters of text after which a conversation goes on in a further part.
PART_CHARS = 1 << 20

_ESCAPE = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HEADER = re.compile(r"### (?:System|User|Assistant|Turn|Role ((?:[^\\:]|\\.)*)): ", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def header(role: str | None) -> str:
    if role is None:
        return NO_ROLE
    return ROLES.get(role) or OTHER + escape(role).replace(":", "\\:") + ": "


def tokenizer_path() -> str:
    """The vocabulary file used unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_tokenizers: dict = {}


def _tokenizer(path: str):
    """The tokenizer of this Python process, with the template's control strings as tokens."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        loaded = Tokenizer.from_file(path)
        strings = [*ROLES.values(), OTHER, NO_ROLE, END]
        loaded.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in strings])
        _tokenizers[path] = loaded
    return _tokenizers[path]


@dataclass
class _Part:
    """A run of turns of one conversation while it is rendered."""

    conversation: int | None
    pieces: list[str] = field(default_factory=list)
    chars: int = 0
    turns: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)

    def add(self, role: str | None, text: str) -> None:
        before, body = header(role), escape(text)
        if role == "assistant":
            start = self.chars + len(before)
            self.loss.append((start, start + len(body)))
        self.pieces += [before, body, END]
        self.chars += len(before) + len(body) + len(END)
        self.turns += 1


def token_mask(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Whether each token lies in one of the sorted, disjoint character spans."""
    mask = np.zeros(len(offsets), bool)
    starts, ends = offsets[:, 0], offsets[:, 1]
    for start, end in spans:
        # Tokens that end behind the start and begin before the end: two binary searches.
        first = np.searchsorted(ends, start, side="right")
        mask[first : np.searchsorted(starts, end, side="left")] = True
    return mask


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Render, encode and mask all conversations.

    One row per part of a conversation: the conversation's key, ``part`` (in order), ``n_turns``,
    ``formatted``, ``token_ids``, ``token_loss`` (whether the token is to be learnt) and
    ``loss_spans`` (character spans of the assistant texts in ``formatted``). Most conversations
    are one part. Turns are dealt by ranges of (conversation, turn), so a very long conversation
    is spread over tasks, and cut into parts where a range or PART_CHARS ends; parts begin and end
    with control tokens, so the parts' tokens joined are those of the whole.

    Turns with the same number follow each other by role and text; null numbers come first. A null
    text is empty, a null role has its own header, null keys are one conversation. Other columns
    are not read. An empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    path = path or tokenizer_path()
    kind = turns.schema[conversation].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        base = TaskContext.get().partitionId() << 32
        done = 0
        key_type = pa.int64()

        def finished(parts: list[_Part]) -> pa.RecordBatch:
            nonlocal done
            texts = ["".join(p.pieces) for p in parts]
            encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
            masks = [
                token_mask(p.loss, np.array(e.offsets, np.int64).reshape(-1, 2))
                for p, e in zip(parts, encoded, strict=True)
            ]
            numbers = [base + done + i for i in range(len(parts))]
            done += len(parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p.conversation for p in parts], key_type),
                    pa.array(numbers, pa.int64()),
                    pa.array([p.turns for p in parts], pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                    pa.array([m.tolist() for m in masks], pa.list_(pa.bool_())),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in p.loss] for p in parts],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["key", "part", "n_turns", "formatted", "token_ids", "token_loss", "loss_spans"],
            )

        waiting: list[_Part] = []
        current: _Part | None = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conversation != key or current.chars >= PART_CHARS:
                    if current is not None:
                        waiting.append(current)
                    current = _Part(key)
                current.add(name, value or "")
            if sum(p.chars for p in waiting) >= PART_CHARS:
                yield finished(waiting)
                waiting = []
        if current is not None:
            waiting.append(current)
        if waiting:
            yield finished(waiting)

    order = ["key", "turn", "role", "text"]
    rows = turns.select(
        F.col(conversation).alias("key"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    return (
        # The sample of the ranges sees beginnings of names and texts only.
        rows.repartitionByRange("key", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)))
        .sortWithinPartitions(*order)
        .select("key", "role", "text")
        .mapInArrow(
            render,
            f"key {kind}, part long, n_turns long, formatted string, token_ids array<int>, "
            "token_loss array<boolean>, loss_spans array<struct<start: long, end: long>>",
        )
        .withColumnRenamed("key", conversation)
    )


def parse_turns(formatted: str) -> Iterator[tuple[str | None, str]]:
    """The (role, text) pairs of a rendered part."""
    names = {value: key for key, value in ROLES.items()}
    at = 0
    while at < len(formatted):
        found = _HEADER.match(formatted, at)
        end = formatted.index(END, found.end())
        if found[1] is not None:
            role: str | None = unescape(found[1])
        else:
            role = names.get(found[0])
        yield role, unescape(formatted[found.end() : end])
        at = end + len(END)


def conversation_digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the formatted parts: counts and checksums.

    A checksum runs over a whole conversation in order; parts stream through it one by one, so a
    task never holds more than one part of a long conversation.
    """
    kind = formatted.schema[conversation].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: list | None = None
        key_type = pa.int64()

        def close() -> None:
            if state is not None:
                key, turns, all_turns, loss_chars, loss, chars = state
                rows.append((key, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != key:
                    close()
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if rows:
                yield batch_of(rows)
                rows = []
        close()
        if rows:
            yield batch_of(rows)

    return (
        formatted.select(F.col(conversation).alias("key"), "part", "formatted", "loss_spans")
        .repartition("key")
        .sortWithinPartitions("key", "part")
        .select("key", "formatted", "loss_spans")
        .mapInArrow(
            digest,
            f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long",
        )
        .withColumnRenamed("key", conversation)
    )


#: The conversation that the query adds: texts that hold the template's own control strings.
SELF_QUOTING = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of the self-quoting one."""
    spark = conversations.sparkSession
    columns = conversations.select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(SELF_QUOTING, columns.schema)
    # The parts are written once: the range exchange samples its input.
    return conversation_digests(store(format_conversations(columns.unionByName(added))))
