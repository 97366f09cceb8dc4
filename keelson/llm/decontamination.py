"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may appear in a document with up to n // WORDS_PER_EDIT word edits. It is
split into one piece more than it may have edits, so at least one piece of every such appearance
is untouched. All pieces are found by one pass of a multi-pattern automaton over the document's
words; around each hit the edit distance of the whole item is verified with Myers' bit-parallel
recurrence over words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import small_batches, store, texts_of

#: One edit is allowed for so many words of an item; items with fewer words must appear as they are.
WORDS_PER_EDIT = 5
#: Words of test items that are broadcast at once. More items are met in several blocks.
WORDS_PER_BLOCK = 100_000

_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(" ")
HIT = "array<struct<item: int, distance: int, end_word: int>>"


def normalized_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def pieces_of(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """``edits + 1`` consecutive pieces of nearly equal length, with their places."""
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Items:
    """A block of test items: their words."""

    words: list[list[str]]

    @cached_property
    def matcher(self) -> Matcher:
        """Made once in each Python process that searches."""
        return Matcher(self)


class Matcher:
    """The automaton of all pieces and the word masks of all items of a block."""

    def __init__(self, items: Items) -> None:
        self.lengths = [len(words) for words in items.words]
        self.masks: list[dict[str, int]] = []
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, words in enumerate(items.words):
            masks: dict[str, int] = defaultdict(int)
            for i, word in enumerate(words):
                masks[word] |= 1 << i
            self.masks.append(dict(masks))
            for place, piece in pieces_of(words, len(words) // WORDS_PER_EDIT) if words else ():
                owners[f" {' '.join(piece)} "].append((item, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.automaton.add_word(piece, (len(piece), owner))
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item, least distance, words of the text up to its end) of every item that appears."""
        if not len(self.automaton):
            return []
        words = normalized_words(text)
        line = f" {' '.join(words)} "
        windows: dict[int, list[int]] = defaultdict(list)
        blanks: list[int] = []
        for end, (length, owner) in self.automaton.iter(line):
            # Words before a piece are the blanks before it.
            blanks = blanks or [found.start() for found in _BLANK.finditer(line)]
            begin = bisect_left(blanks, end - length + 1)
            for item, place in owner:
                windows[item].append(begin - place)
        found = []
        for item, begins in windows.items():
            best = self._verify(item, sorted(begins), words)
            if best:
                found.append((item, *best))
        return sorted(found)

    def _verify(self, item: int, begins: list[int], words: list[str]) -> tuple[int, int] | None:
        size = self.lengths[item]
        edits = size // WORDS_PER_EDIT
        best: tuple[int, int] | None = None
        at = 0
        while at < len(begins):
            # Overlapping windows are searched together.
            low, high = begins[at] - edits, begins[at] + size + edits
            while at < len(begins) and begins[at] - edits <= high:
                high = begins[at] + size + edits
                at += 1
            low = max(low, 0)
            found = bit_parallel_search(self.masks[item], size, words[low:high])
            if found and found[0] <= edits:
                found = (found[0], found[1] + low)
                best = min(best, found) if best else found
        return best


def bit_parallel_search(masks: dict[str, int], size: int, words: list[str]) -> tuple[int, int] | None:
    """Least edit distance of a pattern to any run of ``words``, and the first end of such a run.

    Myers' recurrence: bit i of the two vectors says whether the column of distances rises or
    falls by one from row i to row i + 1. A run may start anywhere, so the first row stays 0.
    """
    full, last = (1 << size) - 1, 1 << (size - 1)
    rises, falls, distance = full, 0, size
    best: tuple[int, int] | None = None
    for end, word in enumerate(words, 1):
        equal = masks.get(word, 0)
        vertical = equal | falls
        diagonal = (((equal & rises) + rises) ^ rises) | equal
        right_up = falls | (full & ~(diagonal | rises))
        right_down = rises & diagonal
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        rises = right_down | (full & ~(vertical | right_up))
        falls = right_up & vertical
        if best is None or distance < best[0]:
            best = (distance, end)
    return best


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, Items]]:
    """The test items, one block of bounded size after the other; there is at least one.

    Items without words cannot appear anywhere.
    """
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // WORDS_PER_BLOCK))
    numbered = items.select(
        F.col(key).alias("item"),
        F.col(text).alias("text"),
        F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block"),
    )
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).orderBy("item", "text").collect()
        split = [(row["item"], normalized_words(row["text"])) for row in rows]
        split = [(item, own) for item, own in split if own]
        yield [item for item, _ in split], Items([own for _, own in split])


def _hits(docs: DataFrame, items: Items, text: str) -> Column:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def match(array: pa.Array) -> pa.Array:
        matcher = shared.value.matcher
        kind = pa.struct([("item", pa.int32()), ("distance", pa.int32()), ("end_word", pa.int32())])
        rows = [
            [dict(zip(("item", "distance", "end_word"), hit, strict=True)) for hit in matcher.hits(value)]
            for value in texts_of(array)
        ]
        return pa.array(rows, pa.list_(kind))

    return arrow_udf(match, HIT).asNondeterministic()(F.col(text))


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and test item that appears in it.

    Columns: the document's and the item's key, ``distance`` (word edits of the best appearance),
    ``item_words``, and ``end_word`` (words of the document up to the first such appearance's
    end). Words are lower-cased runs of letters and digits. Whole texts are searched; null and
    empty texts and items without words give no rows; repeated documents and items are reported
    each; empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    parts = []
    for names, block in _blocks(items, item_key, item_text):
        lookup = spark.createDataFrame(
            [(i, name, len(own)) for i, (name, own) in enumerate(zip(names, block.words, strict=True))],
            f"item int, item_key {kind}, item_words int",
        )
        found = (
            docs.select(F.col(key).alias("doc"), _hits(docs, block, text).alias("hits"))
            .select("doc", F.inline("hits"))
            .join(F.broadcast(lookup), "item")
            .select(
                F.col("doc").alias(key),
                F.col("item_key").alias(item_key),
                "distance",
                "item_words",
                "end_word",
            )
        )
        # A block's hits are written before the next block comes to the driver.
        parts.append(store(found))
    return reduce(DataFrame.union, parts)


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents in which no test item appears, with their columns as they are."""
    for number, (_, block) in enumerate(_blocks(items, item_key, item_text)):
        if number:  # what a block leaves is written before the next block comes to the driver
            docs = store(docs)
        row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
        docs = (
            row.select("row", _hits(row, block, "text").alias("hits"))
            .where(F.size("hits") == 0)
            .select("row.*")
        )
    return docs
