"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Texts become token ids in Arrow batches. Every document is cut into pieces of at most one
sequence; pieces are dealt at random into groups of bounded size, and each group is packed on its
own: pieces by falling length, each into the first open sequence with room, found by descending a
tournament tree whose nodes hold the largest free capacity below them.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import mix, small_batches, texts_of

#: Tasks that the groups are dealt to at most; a task packs its groups one after the other.
MOST_TASKS = 20_000
SEQUENCE_TOKENS = 2_048
END_OF_DOCUMENT = 1
#: Bytes of text that a group holds on average (a token has at least one byte of text).
GROUP_BYTES = 8 << 20
#: Distinct words whose ids a task remembers before it starts anew.
REMEMBERED_WORDS = 100_000


def tokenizer_path() -> str:
    """The vocabulary file used unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts whose words the tokenizer certainly treats alone, whatever stands around them: printable
#: ASCII and composed Latin letters. Case folding and normalisation keep these to themselves.
_UNUSUAL = re.compile(r"[^\t\n\r -~¡-įı-ɏ]")
#: What such a tokenizer takes as one word inside a run of signs that are not white space.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the vocabulary's mark of a word's end; no usual text holds this byte.
_WORD_END = b"\x01"


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordTokens(dict):
    """Ids of a text as little-endian 32-bit integers, from remembered ids of its words.

    Only a lower-casing byte-pair vocabulary with marked word ends, which drops white space, is
    treated so: the ids of a text are those of its words one after another, and a word is merged
    by rank. All other vocabularies, unusual texts and texts that hold an added token are encoded
    as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        added = [x["content"] for x in parts.get("added_tokens", ())]
        # Written in a text, an added token is that token; where it starts and ends, and in which
        # letter case it counts, is left to the tokenizer.
        self.added = regex.compile("|".join(map(regex.escape, added)), regex.I) if added else None
        self.by_word = (
            model.get("end_of_word_suffix") == "</w>"
            and _WORD_PATTERN in json.dumps(parts.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\")
            and '"Lowercase"' in json.dumps(parts.get("normalizer"))
        )
        if self.by_word:
            import tiktoken

            letters = _byte_letters()
            ranks = {}
            special = set(added)
            for token, rank in model["vocab"].items():
                if token not in special:
                    body = token.removesuffix("</w>")
                    ends = _WORD_END if body != token else b""
                    ranks[bytes(letters[c] for c in body) + ends] = rank
            merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.merged = merges._core_bpe.encode_single_piece
            self.words = regex.compile(_WORD_PATTERN).findall

    def __missing__(self, run: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        # Mostly letters, perhaps with one sign behind them: no pattern is needed for these.
        if run.isalpha():
            ids = self.merged(run.encode() + _WORD_END)
        elif run[-1] in ".,;:!?" and run[:-1].isalpha():
            ids = self.merged(run[:-1].encode() + _WORD_END) + self.merged(run[-1:].encode() + _WORD_END)
        else:
            ids = []
            for word in self.words(run):
                ids += self.merged(word.encode() + _WORD_END)
        found = self[run] = array("I", ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_word or _UNUSUAL.search(text) or self.added and self.added.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join([self[run] for run in text.lower().split()])


_tokenizers: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; equal lengths are taken in their given order."""
    size = 1
    while size < max(len(lengths), 1):
        size *= 2
    # tree[1] is the root; the leaves are the bins in order, all still empty. Room is kept as a
    # plain list: the tree is walked item by item.
    tree = [capacity] * (2 * size)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        node = 1
        while node < size:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[item] = node - size
        offsets[item] = capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def token_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    path: str | None = None,
    end_token: int = END_OF_DOCUMENT,
) -> DataFrame:
    """Cut every document's ids, with ``end_token`` behind them, into pieces of one sequence at most.

    Columns: the key, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian 32-bit) and
    ``draw``, a random number. It is drawn from the partition, the key, the text, the start and how
    many equal rows the partition had before, so a task that runs again over the same rows in any
    order draws the same.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    step = 4 * sequence_tokens
    end = np.array([end_token], "<u4").tobytes()
    fields = docs.select(F.col(key), F.col(text)).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(path).encode
        partition = TaskContext.get().partitionId().to_bytes(8, "little")
        seen: Counter[bytes] = Counter()
        for batch in batches:
            owner, start, doc_tokens, pieces, draws = [], [], [], [], []
            keys = batch.column(0).to_pylist()
            for i, value in enumerate(texts_of(batch.column(1))):
                row = hashlib.blake2b(repr(keys[i]).encode() + b"\n", digest_size=16, key=partition)
                row.update(value.encode("utf-8", "surrogatepass"))
                name = row.digest()
                seed = int.from_bytes(name[:8], "little") + seen[name]
                seen[name] += 1
                ids = encode(value) + end
                for at in range(0, len(ids), step):
                    owner.append(i)
                    start.append(at // 4)
                    doc_tokens.append(len(ids) // 4)
                    pieces.append(ids[at : at + step])
                    draws.append((seed + (at // step << 32)) % (1 << 64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array([len(p) // 4 for p in pieces], pa.int64()),
                    pa.array(doc_tokens, pa.int64()),
                    pa.array(pieces, pa.binary()),
                    pa.array((mix(np.array(draws, np.uint64)) >> np.uint64(2)).astype(np.int64)),
                ],
                ["key", "start", "length", "doc_tokens", "ids", "draw"],
            )

    kind = fields[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        cut, f"key {kind}, start long, length long, doc_tokens long, ids binary, draw long"
    )


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_bytes: int = GROUP_BYTES,
    path: str | None = None,
    end_token: int = END_OF_DOCUMENT,
) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``sequence_tokens``.

    One row per piece: the key, ``start`` (ids of the document before it), ``length``,
    ``doc_tokens``, ``ids``, ``sequence_id`` and ``offset`` in the sequence. A null or empty text
    is the end token alone; repeated rows are packed each; an empty table gives no rows; null keys
    stay null. Other columns of ``docs``, whatever their names, are not read.
    """
    # Groups by bytes of text: known from one light scan, and at least the number of tokens.
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    pieces = token_pieces(docs, key, text, sequence_tokens, path, end_token)
    kind = pieces.schema["key"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        # A fixed order, so that a repeated task packs alike.
        group = group.sort_values(["draw", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), sequence_tokens)
        group["sequence_id"] = (group["slot"].to_numpy().astype(np.int64) << 32) + bins
        group["offset"] = offsets
        return group[["key", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]]

    packed = (
        pieces.withColumn("slot", F.col("draw") % groups)
        # Tasks grow with the groups, so that few of them meet in one task.
        .repartition(min(groups, MOST_TASKS), "slot")
        .groupBy("slot")
        .applyInPandas(
            pack,
            f"key {kind}, start long, length long, doc_tokens long, ids binary, "
            "sequence_id long, offset long",
        )
    )
    return packed.withColumnRenamed("key", key)


def packed_digest(packed: DataFrame) -> DataFrame:
    """The rows of the packing query: as packed, with a checksum in place of the ids."""
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
