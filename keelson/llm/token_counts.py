"""Edit-aware token counts.

A document's text is cut into pre-tokens, which a byte-pair tokenizer encodes one by one. A segment
tree over slots of consecutive pre-tokens keeps the characters and tokens below every node. An edit
finds its slots by descending the tree, is re-encoded with a little context before it until the old
and the new cuts meet again, and updates the sums on the paths of the slots it touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import replace_columns, small_batches, texts_of

#: Pre-tokens per slot when a tree is built.
SLOT_PRETOKENS = 16
#: The pre-token pattern looks at most so many characters beyond a pre-token's end.
LOOK_AHEAD = 3
#: Different pre-tokens whose counts a Python process remembers.
REMEMBERED = 200_000


def tokenizer_path() -> str:
    """The vocabulary file used unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PretokenCounts(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode_text = encoding.encode_ordinary
        self._merged = encoding._core_bpe.encode_single_piece
        self.compiled = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = len(self._merged(piece.encode("utf-8", "surrogatepass")))
        return found


_counters: dict[tuple[str, str], PretokenCounts] = {}


def pretoken_counts(path: str, pattern: str) -> PretokenCounts:
    """The counter of this Python process."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = PretokenCounts(path, pattern)
    return _counters[path, pattern]


@dataclass
class CountTree:
    """Heap-ordered sums: node 1 is the root, the slots are the leaves from ``slots`` on."""

    slots: int
    chars: list[int]
    tokens: list[int]

    @classmethod
    def of(cls, lengths: list[int], counts: list[int]) -> CountTree:
        """The tree over consecutive runs of SLOT_PRETOKENS pre-tokens."""
        step = SLOT_PRETOKENS
        leaves = max(1, -(-len(lengths) // step))
        slots = 1 << (leaves - 1).bit_length()
        chars, tokens = [0] * (2 * slots), [0] * (2 * slots)
        for slot in range(leaves):
            chars[slots + slot] = sum(lengths[slot * step : (slot + 1) * step])
            tokens[slots + slot] = sum(counts[slot * step : (slot + 1) * step])
        for node in range(slots - 1, 0, -1):
            chars[node] = chars[2 * node] + chars[2 * node + 1]
            tokens[node] = tokens[2 * node] + tokens[2 * node + 1]
        return cls(slots, chars, tokens)

    def slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds a character, and where the slot starts."""
        node, start = 1, 0
        while node < self.slots:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.slots, start

    def put(self, slot: int, chars: int, tokens: int) -> None:
        """Set a slot and the sums above it."""
        node = self.slots + slot
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


def build_tree(text: str, counter: PretokenCounts) -> CountTree:
    pieces = counter.compiled.findall(text)
    return CountTree.of([len(p) for p in pieces], [counter[p] for p in pieces])


def apply_edit(
    text: str, tree: CountTree, start: int, end: int, replacement: str, counter: PretokenCounts
) -> tuple[str, int]:
    """Replace ``text[start:end]`` and update the tree; the new text and the characters encoded.

    Cuts before the edit stay where a pre-token and what its pattern looks at end before it.
    Behind the edit, scanning goes on to the first cut that is also a slot's start: from there on
    old and new cuts are the same, as the pattern never looks back.
    """
    size = len(text)
    start = min(max(start, 0), size)
    end = min(max(end, start), size)
    edited = text[:start] + replacement + text[end:]
    shift = len(edited) - size
    # A slot's first pre-token may be changed by what stands right behind it, so go back to a slot
    # that starts clear of the edit; its own pre-tokens are scanned again.
    slot, at = tree.slot_at(min(max(start - LOOK_AHEAD - 1, 0), max(size - 1, 0)))
    first, first_at = slot, at
    if first_at > 0:
        # The cut at this slot's start depends on the pre-token before it.
        while first > 0 and (first_at > start - LOOK_AHEAD or tree.chars[tree.slots + first] == 0):
            first -= 1
            first_at -= tree.chars[tree.slots + first]
    # Starts of the slots that lie wholly behind the edit, in the new text.
    last, last_at = tree.slot_at(max(end - 1, 0)) if size else (0, 0)
    last = max(last, first)
    if last == first:
        last_at = first_at
    next_at = last_at + tree.chars[tree.slots + last]
    lengths = tokens = 0
    scan = first_at
    for found in counter.compiled.finditer(edited, first_at):
        while scan > next_at + shift and last + 1 < tree.slots:
            last += 1
            next_at += tree.chars[tree.slots + last]
        if scan == next_at + shift and next_at >= end and scan >= start + len(replacement):
            break
        scan = found.end()
        lengths += found.end() - found.start()
        tokens += counter[found[0]]
    else:
        while last + 1 < tree.slots and next_at < size:
            last += 1
            next_at += tree.chars[tree.slots + last]
    for slot in range(first, last + 1):
        if slot == first:
            tree.put(slot, lengths, tokens)
        elif tree.chars[tree.slots + slot] or tree.tokens[tree.slots + slot]:
            tree.put(slot, 0, 0)
    return edited, lengths


TREE = "struct<slots: int, chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: int, end: int, replacement: string>>"
_INTS = pa.list_(pa.int32())
_TREE = pa.struct([("slots", pa.int32()), ("chars", _INTS), ("tokens", _INTS)])


def with_count_trees(
    docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """All columns plus ``n_tokens`` and ``count_tree``, to be kept beside the texts.

    A null or empty text has no tokens. Input columns named like the results are replaced.
    """
    small_batches(docs.sparkSession)
    path, pattern = path or tokenizer_path(), pattern or pretoken_pattern()

    def build(array: pa.Array) -> pa.Array:
        counter = pretoken_counts(path, pattern)
        trees = [build_tree(value, counter) for value in texts_of(array)]
        return pa.array([vars(tree) for tree in trees], _TREE)

    built = docs.select("*", arrow_udf(build, TREE).asNondeterministic()(F.col(text)).alias("_tree"))
    return replace_columns(
        built, n_tokens=F.col("_tree.tokens")[1].cast("long"), count_tree=F.col("_tree")
    ).drop("_tree")


def apply_edits(
    docs: DataFrame,
    edits: Column,
    text: str = "text",
    tree: str = "count_tree",
    path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Apply each row's edits and recount what they touch.

    ``edits`` is an array of (start, end, replacement) over characters of the row's text, which do
    not overlap; they are applied from the last to the first. The text and the tree are replaced
    by the new ones; ``n_tokens``, ``n_edits`` and ``recounted_chars`` (characters encoded again)
    are added or replaced. Null edits and null replacements are empty, places beyond the text are
    its end.
    """
    small_batches(docs.sparkSession)
    path, pattern = path or tokenizer_path(), pattern or pretoken_pattern()
    result = pa.struct(
        [("text", pa.string()), ("tree", _TREE), ("edits", pa.int32()), ("chars", pa.int64())]
    )

    def edit(texts: pa.Array, trees: pa.Array, changes: pa.Array) -> pa.Array:
        counter = pretoken_counts(path, pattern)
        rows = []
        for value, stored, own in zip(texts_of(texts), trees.to_pylist(), changes.to_pylist(), strict=True):
            own = sorted(own or (), key=lambda x: (x["start"], x["end"]), reverse=True)
            kept = CountTree(stored["slots"], stored["chars"], stored["tokens"])
            scanned = 0
            for change in own:
                value, chars = apply_edit(
                    value, kept, change["start"], change["end"], change["replacement"] or "", counter
                )
                scanned += chars
            rows.append({"text": value, "tree": vars(kept), "edits": len(own), "chars": scanned})
        return pa.array(rows, result)

    run = arrow_udf(edit, f"text string, tree {TREE}, edits int, chars long").asNondeterministic()
    changed = docs.select("*", run(F.col(text), F.col(tree), edits).alias("_edited"))
    return replace_columns(
        changed,
        **{
            text: F.col("_edited.text"),
            tree: F.col("_edited.tree"),
            "n_tokens": F.col("_edited.tree.tokens")[1].cast("long"),
            "n_edits": F.col("_edited.edits"),
            "recounted_chars": F.col("_edited.chars"),
        },
    ).drop("_edited")


#: Mail addresses and long numbers, as the redacting query replaces them.
_PRIVATE = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ()./-]{5,}\d")


def private_spans(text: Column) -> Column:
    """Edits that replace mail addresses and long numbers by placeholders."""

    def find(array: pa.Array) -> pa.Array:
        rows = [
            [
                {"start": m.start(), "end": m.end(), "replacement": "<mail>" if "@" in m[0] else "<number>"}
                for m in _PRIVATE.finditer(value)
            ]
            for value in texts_of(array)
        ]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())])
        return pa.array(rows, pa.list_(kind))

    return arrow_udf(find, EDITS).asNondeterministic()(text)


def redacted_counts(documents: DataFrame) -> DataFrame:
    """Token counts of all documents before and after private data are replaced."""
    small_batches(documents.sparkSession)
    rows = with_count_trees(documents.select("doc_id", "text"))
    rows = rows.withColumn("edits", private_spans(F.col("text"))).withColumn("tokens_before", F.col("n_tokens"))
    return apply_edits(rows, F.col("edits")).select(
        "doc_id",
        "tokens_before",
        "n_edits",
        F.col("n_tokens").alias("tokens_after"),
        F.length("text").cast("long").alias("chars_after"),
        "recounted_chars",
    )
