"""Candidate search for names: every pair whose matching ratio reaches a threshold.

The matched letters of two names stand in one order in both, so ``m`` of them are a common
subsequence. From ratio = 2 m / (la + lb) >= t follows, whatever the blocks are:

1. the shorter name has at least ``m >= t (la + lb) / 2`` letters: a band of lengths;
2. the names share ``m`` letters, counted with repeats;
3. at most la + lb - 2 m letters interrupt the blocks, so they share ``3 m - la - lb - 1`` letter
   pairs, counted with repeats.

The index is an exact one: names are filed per pair of length classes under their rarest letter
pairs (or letters, where rule 3 promises too little), ``n - need + 1`` of them, so that names with
``need`` in common meet. Crowded buckets are split by a further shared one, as long as ``need``
allows. A pair is taken only where the bucket is that of its first common ones, so it comes up once,
and its real number in common is checked before any letters are matched.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import blank, matching_ratios, normalized_name
from keelson.operators.similarity import size_classes
from keelson.session import cut_lineage, salted_join

#: All letters of a normalised name.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Repeats of one letter pair in a name are told apart up to this many.
REPEATS = 1 << 20
#: Comparisons in a bucket from which it is split.
CROWD = 4_096
EPS = 1e-9


class NamePairs(NamedTuple):
    """``pairs``: mention, candidate, similarity of distinct names; and the rows of each name."""

    pairs: DataFrame
    mentions: DataFrame
    candidates: DataFrame


def spelled(rows: DataFrame, name: str, key: str) -> DataFrame:
    """``key`` and the normalised ``spelling`` of every row; a null name is empty."""
    return rows.select(F.col(key).alias("key"), normalized_name(blank(F.col(name))).alias("spelling"))


def _grams(spelling: Column, length: int) -> Column:
    """Codes of all runs of ``length`` letters, in order."""
    codes = F.transform(
        F.split(spelling, ""), lambda c: F.position(c, F.lit(ALPHABET)).cast("int") - 1
    )
    if length == 1:
        return codes
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: a * len(ALPHABET) + b,
    )


def _rare_first(names: DataFrame, length: int) -> Column:
    """The names' runs of letters as numbers, rare ones least; repeats are numbers of their own.

    The counts of all 37 letters or 1,369 pairs of letters come to the driver, no more.
    """
    counts = (
        names.select(F.explode(_grams(F.col("spelling"), length)).alias("gram"))
        .groupBy("gram")
        .count()
        .orderBy("count", "gram")
        .collect()
    )
    place = [0] * len(ALPHABET) ** length
    for i, r in enumerate(counts):
        place[r["gram"]] = i
    ranks = F.lit(place)
    grams = F.transform(_grams(F.col("spelling"), length), lambda g: F.get(ranks, g).cast("long"))
    return F.array_sort(
        F.transform(
            grams,
            lambda g, i: g * REPEATS + F.size(F.filter(F.slice(grams, 1, i), lambda before: before == g)),
        )
    )


def _shared(total: Column, t: float, of_pairs: bool) -> Column:
    """How many letters or letter pairs two names of so many letters together share at least."""
    least = (1.5 * t - 1) * total - 1 if of_pairs else t / 2 * total
    return F.ceil(least - EPS).cast("int")


def _filed(names: DataFrame, side: int, t: float, bounds: list[int]) -> DataFrame:
    """``sig, side, name, size, tokens, path, rest, need, pairwise``: one row per name, partner
    class and token of its prefix; ``rest`` are the tokens behind it."""
    lower = F.array(*[F.lit(b) for b in bounds])

    def class_of(size: Column) -> Column:
        return F.size(F.filter(lower, lambda b: b <= size)) - 1

    size = F.length("spelling")
    sized = names.select(
        "spelling",
        "letters",
        "letter_pairs",
        size.alias("size"),
        class_of(size).alias("own"),
        F.explode(
            F.sequence(
                class_of(F.greatest(F.ceil(size * t / (2 - t) - EPS), F.lit(1))),
                class_of(F.floor(size * (2 - t) / t + EPS)),
            )
        ).alias("partner"),
    )
    classes = ("own", "partner") if side == 0 else ("partner", "own")
    total = F.get(lower, F.col("own")) + F.get(lower, F.col("partner"))
    by_pairs = _shared(total, t, True) >= 2
    needed = sized.select(
        F.lit(side).alias("side"),
        F.col("spelling").alias("name"),
        "size",
        by_pairs.alias("pairwise"),
        F.when(by_pairs, F.col("letter_pairs")).otherwise(F.col("letters")).alias("tokens"),
        F.when(by_pairs, _shared(total, t, True))
        .otherwise(F.greatest(_shared(total, t, False), F.lit(1)))
        .alias("need"),
        F.xxhash64(*classes).alias("sig"),
    )
    return _refiled(needed.withColumns({"path": F.array().cast("array<bigint>"), "rest": F.col("tokens")}))


def _refiled(rows: DataFrame) -> DataFrame:
    """File every row under one more of its ``rest`` tokens."""
    # With k tokens of the path, n - need + k + 1 tokens are the prefix.
    used = F.size("tokens") - F.size("rest")
    prefix = F.size("tokens") - F.col("need") + F.size("path") + 1 - used
    more = F.slice("rest", F.lit(1), F.greatest(prefix, F.lit(0)))
    return rows.select("*", F.posexplode(more).alias("at", "token")).select(
        F.xxhash64("sig", "token").alias("sig"),
        "side",
        "name",
        "size",
        "pairwise",
        "tokens",
        "need",
        F.concat("path", F.array("token")).alias("path"),
        F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
    )


def _buckets(filed: DataFrame, crowd: int) -> DataFrame:
    """Rows in buckets that both sides use, crowded ones split as far as ``need`` allows."""
    done: list[DataFrame] = []
    while True:
        filed = cut_lineage(filed)
        uses = filed.groupBy("sig").agg(
            F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")
        )
        met = uses.where("a > 0 and b > 0").select("sig", (F.col("a") * F.col("b") > crowd).alias("crowded"))
        marked = cut_lineage(salted_join(filed, met, ["sig"], ["name"]))
        split = F.col("crowded") & (F.col("need") > F.size("path"))
        done.append(marked.where(~split).drop("crowded"))
        crowded = marked.where(split).drop("crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, done)
        filed = _refiled(crowded)


def similar_names(
    mentions: DataFrame,
    candidates: DataFrame,
    threshold: float = 0.78,
    mention: str = "mention",
    candidate: str = "candidate_name",
    mention_key: str = "case_id",
    candidate_key: str = "supplier_id",
    crowd: int = CROWD,
) -> NamePairs:
    """All pairs of normalised names whose matching ratio (mention first) is at least ``threshold``.

    Names are normalised and made distinct first: ``pairs`` hold each pair of distinct names once,
    however many rows share them; ``mentions`` and ``candidates`` say which rows (``key``) have
    which ``spelling``. Two empty names are equal, an empty name is like no other. No pair is
    missed, and no name is compared with all others.
    """
    if not 0 < threshold <= 1:
        raise ValueError("The threshold must be above 0 and at most 1.")
    t = float(threshold)
    sides = [
        cut_lineage(spelled(mentions, mention, mention_key)),
        cut_lineage(spelled(candidates, candidate, candidate_key)),
    ]
    names = [s.select("spelling").distinct() for s in sides]
    every = names[0].unionByName(names[1]).where("spelling <> ''")
    largest = every.agg(F.max(F.length("spelling"))).first()[0] or 0
    bounds = size_classes(int(largest * 2 / t) + 1)
    tokens = {"letters": _rare_first(every, 1), "letter_pairs": _rare_first(every, 2)}
    filed = [
        _filed(n.where("spelling <> ''").withColumns(tokens), side, t, bounds)
        for side, n in enumerate(names)
    ]
    rows = _buckets(filed[0].unionByName(filed[1]), crowd)
    left = rows.where("side = 0").select(
        "sig", F.col("name").alias("mention"), F.col("size").alias("size_a"), F.col("tokens").alias("a"), "path", "pairwise"
    )
    right = rows.where("side = 1").select(
        "sig", F.col("name").alias("candidate"), F.col("size").alias("size_b"), F.col("tokens").alias("b"),
        F.col("path").alias("path_b"),
    )
    total = F.col("size_a") + F.col("size_b")
    common = F.array_intersect("a", "b")
    wanted = F.when(F.col("pairwise"), _shared(total, t, True)).otherwise(_shared(total, t, False))
    close = (
        salted_join(left, right, ["sig"], ["mention"])
        .where(2 * F.least("size_a", "size_b") >= total * t - EPS)
        .where(F.col("path") == F.col("path_b"))
        .withColumn("common", common)
        .where((F.slice("common", 1, F.size("path")) == F.col("path")) & (F.size("common") >= wanted))
        .select("mention", "candidate")
    )
    ratio = F.get(matching_ratios(F.array("mention"), F.array("candidate")), 0)
    found = close.withColumn("similarity", ratio).where(F.col("similarity") >= t)
    empty = names[0].where("spelling = ''").join(names[1].where("spelling = ''"), "spelling").select(
        F.col("spelling").alias("mention"), F.col("spelling").alias("candidate"), F.lit(1.0).alias("similarity")
    )
    return NamePairs(found.unionByName(empty), *sides)


def candidate_links(found: NamePairs) -> DataFrame:
    """Per pair of distinct names: how many mentions and candidates have them."""
    counts = [
        rows.groupBy("spelling").agg(F.count("*").alias(f"n_{name}"))
        for name, rows in (("mentions", found.mentions), ("candidates", found.candidates))
    ]
    return (
        found.pairs.join(counts[0].withColumnRenamed("spelling", "mention"), "mention")
        .join(counts[1].withColumnRenamed("spelling", "candidate"), "candidate")
        .select("mention", "candidate", "similarity", "n_mentions", "n_candidates")
    )
