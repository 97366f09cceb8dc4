"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A text is the set of its distinct five-word shingles. The minima of HASHES permutations give band
keys that propose candidates; only the low BITS of each minimum are kept in a packed signature.
The share of equal lanes of two signatures, counted as bits and corrected for chance collisions,
estimates their similarity; pairs that may reach the threshold are confirmed on the full sets.

Groups of any size are met without listing their pairs:

1. Equal sets are one class before anything else, by an aggregate.
2. In every bucket all members are compared with one random member. The confirmed links join
   most of each group of near copies into one component.
3. What is left are members of one bucket in different components. Those buckets, in blocks of
   bounded size, are compared signature by signature inside tasks. Members with a candidate in
   another component come again with their full sets and are compared exactly, inside tasks
   again; only links come out, one per member and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import (
    byte_view,
    hashed_words,
    mix,
    small_batches,
    store,
    text_slices,
)
from keelson.llm.components import connected_components

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: BANDS * ROWS permutations. Similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Estimates below this are not confirmed: five standard errors under the threshold.
LEAST_ESTIMATE = 0.55
#: Members of a bucket compared with each other in one task on average.
BLOCK = 1_024

_random = np.random.default_rng(75)
_FACTORS = _random.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, HASHES, np.uint32)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW_LANES = np.uint64(0x1111111111111111)


def shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and the offsets of the texts.

    A text of one to four words is one shingle; without words it has none.
    """
    data, offsets = byte_view(array)
    texts = len(offsets) - 1
    words, owner = hashed_words(data, offsets)
    spread = mix(words + np.uint64(SHINGLE_WORDS))
    cuts = np.searchsorted(owner, np.arange(texts + 1))
    counts = np.diff(cuts)
    last = len(words) - SHINGLE_WORDS + 1
    hashed = np.zeros(max(last, 0), np.uint64)
    for place in range(SHINGLE_WORDS if last > 0 else 0):
        hashed = hashed * _ODD + spread[place : place + last]
    whole = owner[: max(last, 0)] == owner[SHINGLE_WORDS - 1 :] if last > 0 else np.zeros(0, bool)
    hashed, text_of = mix(hashed[whole]), owner[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    if len(short):
        single = np.zeros(len(short), np.uint64)
        for place in range(SHINGLE_WORDS - 1):
            there = counts[short] > place
            single[there] = single[there] * _ODD + spread[cuts[short][there] + place]
        hashed = np.concatenate((hashed, mix(single + counts[short].astype(np.uint64))))
        text_of = np.concatenate((text_of, short))
    order = np.lexsort((hashed, text_of))
    hashed, text_of = hashed[order], text_of[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text_of[1:] != text_of[:-1])
    hashed, text_of = hashed[new], text_of[new]
    return hashed, np.searchsorted(text_of, np.arange(texts + 1))


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))
    )


def minima(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each permutation (rows) over each run of shingles (columns)."""
    folded = (hashed >> np.uint64(32)).astype(np.uint32)
    found = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        found[k] = np.minimum.reduceat(folded * _FACTORS[k] + _SHIFTS[k], starts)
    return found


def pack_low_bits(found: np.ndarray) -> np.ndarray:
    """The low BITS of the minima, packed into 64-bit words: one row per text."""
    lanes = 64 // BITS
    low = (found.T & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, HASHES // lanes, lanes)
    places = np.uint64(BITS) * np.arange(lanes, dtype=np.uint64)
    return np.bitwise_or.reduce(low << places, axis=2)


def estimated_similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity from packed signatures (the last axis holds their words)."""
    differ = left ^ right
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    unequal = np.bitwise_count(differ & _LOW_LANES).sum(-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_shingles``, a fingerprint of the set, packed signature and band keys."""
    small_batches(docs.sparkSession)

    def sign(array: pa.Array) -> pa.Array:
        parts = []
        for part in text_slices(array):
            hashed, cuts = shingle_sets(part)
            sizes = np.diff(cuts)
            filled = np.flatnonzero(sizes)
            if len(hashed):
                found = minima(hashed, cuts[filled])
                packed = pack_low_bits(found)
                bands = np.zeros((BANDS, len(filled)), np.uint64)
                for row in range(ROWS):
                    bands = mix(bands * _ODD + found[row::ROWS].astype(np.uint64))
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None])
                first = np.add.reduceat(hashed, cuts[filled])
                second = np.add.reduceat(mix(hashed ^ _ODD), cuts[filled])
            else:
                packed = np.zeros((0, HASHES * BITS // 64), np.uint64)
                bands = np.zeros((BANDS, 0), np.uint64)
                first = second = np.zeros(0, np.uint64)
            at = np.cumsum(sizes > 0)

            def lists(rows: np.ndarray, at: np.ndarray = at) -> pa.Array:
                width = rows.shape[1]
                return _list_array(
                    np.ascontiguousarray(rows).ravel(), np.concatenate(([0], at * width))
                )

            def spread(values: np.ndarray, filled: np.ndarray = filled, size: int = len(part)) -> pa.Array:
                out = np.zeros(size, np.int64)
                out[filled] = values.view(np.int64)
                return pa.array(out)

            parts.append(
                pa.StructArray.from_arrays(
                    [pa.array(sizes.astype(np.int64)), spread(first), spread(second), lists(packed), lists(bands.T)],
                    ["n_shingles", "first", "second", "signature", "bands"],
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], signed_type)

    longs = pa.list_(pa.int64())
    signed_type = pa.struct(
        [("n_shingles", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("signature", longs), ("bands", longs)]
    )
    signed = arrow_udf(
        sign, "n_shingles long, first long, second long, signature array<long>, bands array<long>"
    ).asNondeterministic()
    return docs.select(F.col(key).alias("id"), signed(F.col(text)).alias("_s")).select("id", "_s.*")


def _full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """The shingle sets of the documents in ``ids``: columns ``id`` and ``shingles``."""

    def sets(array: pa.Array) -> pa.Array:
        parts = [_list_array(*shingle_sets(part)) for part in text_slices(array)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest")
    )
    wanted = rows.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id", "digest"])
    return wanted.select("id", arrow_udf(sets, "array<long>")("text").alias("shingles"))


def _confirmed(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = store(_full_sets(docs, ids, key, text))
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.select("u", "v")
        .join(left, "u")
        .join(right, "v")
        .select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), common.alias("common"))
        .where(f"100 * common >= {PERCENT} * (m + n - common)")
        .select("u", "v")
        .distinct()
    )


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures and sizes leave the threshold in reach."""
    own = classes.select("node", "n_shingles", "signature")
    left = own.toDF("u", "m", "a")
    right = own.toDF("v", "n", "b")
    differ = F.zip_with("a", "b", lambda a, b: a.bitwiseXOR(b))
    # Fold the four bits of a lane into its lowest one, then count the lanes that differ.
    lanes = F.lit(int(_LOW_LANES)).cast("long")
    halves = F.transform(differ, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    folded = F.transform(halves, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(lanes))
    unequal = F.aggregate(folded, F.lit(0), lambda total, x: total + F.bit_count(x))
    chance = 1 / (1 << BITS)
    estimate = ((1 - unequal / HASHES) - chance) / (1 - chance)
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .where(f"100 * least(m, n) >= {PERCENT} * greatest(m, n)")
        .where(estimate >= LEAST_ESTIMATE)
        .select("u", "v")
        .distinct()
    )


_GROUP = ["bucket", "low", "high"]
_MEMBER = (
    "bucket long, low long, high long, block long, node long, component long, n_shingles long, "
    "signature array<long>, bands array<long>"
)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches again, cut only where a group ends."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        # The last group may go on in the next batch.
        same = np.ones(len(table), bool)
        for column in _GROUP:
            values = table[column].to_numpy()
            same &= values == values[-1]
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


def _lists(table: pa.Table, column: str, width: int) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy().reshape(-1, width)


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of its group that it may link across components.

    Sizes and signatures must leave the threshold in reach, and the group's bucket must be the
    first one that both rows share, so that a pair of documents comes up once.
    """
    bucket, low, high, block, node, component, sizes = (
        table[c].to_numpy()
        for c in (*_GROUP, "block", "node", "component", "n_shingles")
    )
    packed = _lists(table, "signature", HASHES * BITS // 64).view(np.uint64)
    bands = _lists(table, "bands", BANDS)
    new = np.zeros(len(table), bool)
    for column in (bucket, low, high):
        new[1:] |= column[1:] != column[:-1]
    cuts = np.concatenate(([0], np.flatnonzero(new), [len(table)]))
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        one_block = low[start] == high[start]
        for i in range(start, stop):
            others = slice(i + 1, stop)
            fits = component[others] != component[i]
            if not one_block:
                fits &= block[others] != block[i]
            least = np.minimum(sizes[others], sizes[i])
            fits &= 100 * least >= PERCENT * np.maximum(sizes[others], sizes[i])
            at = np.flatnonzero(fits) + i + 1
            if len(at):
                at = at[estimated_similarity(packed[at], packed[i]) >= LEAST_ESTIMATE]
            if len(at):
                shared = bands[at] == bands[i]
                at = at[bands[i][shared.argmax(1)] == bucket[start]]
            if len(at):
                yield i, at


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _links_across(members: DataFrame, blocks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (u, v) across components within buckets, at least one for any two that have some.

    ``members`` has bucket, node, component, n_shingles, signature and bands; ``blocks`` has
    bucket and its number of blocks. Every two blocks of a bucket meet in one group of bounded
    size. Signatures tell which members have a candidate at all; only these come again with their
    full sets, and the candidates are compared inside the tasks. No pairs are listed.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            wanted = np.zeros(len(table), bool)
            for i, at in _candidates(table):
                wanted[i] = True
                wanted[at] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            node, component = table["node"].to_numpy(), table["component"].to_numpy()
            shingles = table["shingles"].combine_chunks()
            edges = shingles.offsets.to_numpy() - shingles.offsets[0].as_py()
            flat = shingles.flatten().to_numpy().view(np.uint64)
            us, vs = [], []
            for i, at in _candidates(table):
                own = flat[edges[i] : edges[i + 1]]
                counts = edges[at + 1] - edges[at]
                begins = np.cumsum(counts) - counts
                take = np.repeat(edges[at] - begins, counts) + np.arange(counts.sum())
                other = flat[take]
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = np.add.reduceat((own[place] == other).astype(np.int64), begins)
                linked = at[100 * common >= PERCENT * (len(own) + counts - common)]
                # One link to a component is as good as all.
                linked = linked[np.unique(component[linked], return_index=True)[1]]
                us.append(np.full(len(linked), node[i]))
                vs.append(node[linked])
            u = np.concatenate(us) if us else np.zeros(0, np.int64)
            v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = (
        members.join(blocks, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select(*_GROUP, "block", "node", "component", "n_shingles", "signature", "bands")
    )
    marked = store(_dealt(dealt).mapInArrow(mark, _MEMBER))
    sets = store(_full_sets(docs, marked.select(F.col("node").alias("id")).distinct(), key, text))
    rows = marked.join(sets.withColumnRenamed("id", "node"), "node").select(*marked.columns, "shingles")
    return _dealt(rows).mapInArrow(confirm, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_shingles``, ``component_id`` and ``kept``, with the key.

    A-Z are lower-cased, words are what white space parts, a document's set are its distinct
    five-word shingles, or its only words if there are fewer. ``component_id`` is the least key
    reachable over links, the own one included; ``kept`` says that it is the document's own. Null
    and empty texts have no set and link nothing. Rows with the same key are one document, linked
    if any of its texts is. A null key has a null component, links nothing and is kept. An empty
    table gives no rows. Keys are integers; other columns are not read.
    """
    signed = store(signatures(docs, key, text))
    fingerprint = ["n_shingles", "first", "second"]
    classes = store(
        signed.where("n_shingles > 0 and id is not null")
        .groupBy(*fingerprint)
        .agg(
            F.min("id").alias("node"),
            F.min(F.struct("signature", "bands")).alias("_s"),
        )
        .select(*fingerprint, "node", "_s.signature", "_s.bands")
    )
    members = classes.select("node", F.explode("bands").alias("bucket")).distinct()
    # The random member of a bucket is the one with the least hash.
    draw = F.struct(F.xxhash64("node", "bucket"), "node")
    buckets = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.min(draw)["node"].alias("leader"))
        .where("size > 1")
    )
    crowd = store(members.join(buckets, "bucket"))
    first_pairs = (
        crowd.where("node <> leader")
        .select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v"))
        .distinct()
    )
    first_links = store(_confirmed(docs, store(_promising(first_pairs, classes)), key, text))
    # Rows with the same key but other sets are one document.
    at_class = signed.where("n_shingles > 0").join(classes.drop("signature", "bands"), fingerprint)
    repeated = at_class.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w")
    same_key = at_class.join(repeated, "id").select(F.col("node").alias("u"), "v").where("u <> v").distinct()
    links = store(first_links.union(same_key))
    found = connected_components(links)

    placed = crowd.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        placed.groupBy("bucket")
        .agg(F.first("size").alias("size"), F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a <> b")
        .select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    open_members = placed.select("bucket", "node", "component").join(
        classes.select("node", "n_shingles", "signature", "bands"), "node"
    )
    last_links = _links_across(open_members, mixed, docs, key, text)
    found = connected_components(links.union(last_links))

    component = classes.drop("signature", "bands").join(found, "node", "left")
    return (
        signed.select("id", *fingerprint)
        .join(component, fingerprint, "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.coalesce("component", "node", "id").alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col(key).isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Rows that share an id are judged each by its text: near copies go, other texts stay. Of equal
    ids the least hash of id and text decides, of equal texts the least hash of the row. A document
    without id is no duplicate of anything.
    """
    columns = docs.columns
    number = F.xxhash64("doc_id", F.col("text").isNull(), "text")
    named = docs.where("doc_id is not null").select(F.struct(*columns).alias("row"), number.alias("number"))
    rows = named.select("number", "row.doc_id", "row.text")
    found = near_duplicates(rows, key="number").select("number", "component_id")
    first = (
        found.distinct()
        .join(rows.select("number", "doc_id").distinct().hint("shuffle_hash"), "number")
        .groupBy("component_id")
        .agg(F.min(F.struct("doc_id", "number"))["number"].alias("number"))
        .select("number")
    )
    kept = (
        named.join(first.hint("shuffle_hash"), "number", "left_semi")
        .withColumn("draw", F.xxhash64("row"))
        .groupBy("number")
        .agg(F.min_by("row", "draw").alias("row"))
        .select("row.*")
    )
    return kept.unionByName(docs.where("doc_id is null"))
