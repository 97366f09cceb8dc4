"""Filter interaction audit: what every order of a set of filters keeps, removes and repeats.

A document's verdicts are one bit mask, so a part of the corpus is at most 32 mask cells whatever its
size. Each cell folds over the broadcast array of all 120 filter orders with ``transform`` and
``aggregate``: 600 structs, weighted by the cell's counts. The structs of a part's cells are merged
by elementwise sums. All of it is native columns.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import store
from keelson.session import compute_once, salted_join

#: The filters; the bit of a filter is its place here.
FILTERS = "ABCDE"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Fixed values of the contract's filters.
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SIGNS = "[#$%&*|]"

#: What one step of one order counts, besides its order and number.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which a text fails by itself."""
    words = F.filter(F.split(text, WORD_BREAK), lambda word: word != "")
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (
        size < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * size,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        text.rlike(SIGNS),
    )
    return sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), F.lit(0))


def _marked(labels: DataFrame) -> DataFrame:
    """One row per labelled document; of differing labels a 1 decides."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"),
    )


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``part``, ``mask``, ``n``, ``good``, ``toxic``: documents per part and set of failed filters.

    Texts travel as their SHA-256. Rows of one text, part and id are counted together before
    anything else, so groups of copies shrink before every shuffle but the first, and the row with
    a text's least id is split off inside the aggregate: no group of copies is collected anywhere.
    A null text is empty, a null source is the part ``''``. Documents without id are never a copy
    (no id is smaller) and make no copies. Repeated rows of the least id all count as that id's.
    """
    rows = compute_once(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("part"),
            F.coalesce("text", F.lit("")).alias("body"),
        ),
        "_mask",
        text_mask(F.col("body")),
    ).select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), F.col("_mask").alias("mask"))
    # Written once, without texts: what follows reads it three times.
    counted = store(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    labelled = salted_join(counted, _marked(labels), ["doc_id"], ["digest", "part"], how="left")
    one = labelled.select(
        "doc_id", "part", "digest", "mask", "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    named = one.where("doc_id is not null")
    # Per text and part: all rows, and those of its least id there.
    groups = named.groupBy("digest", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")),
        F.min(F.struct("doc_id", "n", "good", "toxic")).alias("least"),
    )
    # Only texts in several parts have to look for their least id.
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"), F.count("*").alias("parts"))
    copies = salted_join(groups, first.where("parts > 1").drop("parts"), ["digest"], ["part"], how="left")
    is_first = F.coalesce(F.col("least.doc_id") == F.col("first_id"), F.lit(True))
    split = copies.select(
        "part",
        F.explode(
            F.array(
                F.struct(
                    F.col("mask"),
                    *(F.when(is_first, F.col("least")[c]).otherwise(0).alias(c) for c in ("n", "good", "toxic")),
                ),
                F.struct(
                    F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"),
                    *(
                        (F.col(c) - F.when(is_first, F.col("least")[c]).otherwise(0)).alias(c)
                        for c in ("n", "good", "toxic")
                    ),
                ),
            )
        ).alias("cell"),
    ).select("part", "cell.*")
    unnamed = one.where("doc_id is null").select("part", "mask", "n", "good", "toxic")
    return (
        split.unionByName(unnamed)
        .where("n > 0")
        .groupBy("part", "mask")
        .agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    )


def _fold(order: Column) -> Column:
    """The steps of one order for one cell: the first failed filter removes the whole cell."""
    mask, n = F.col("mask"), F.col("n")
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        own = bit["flag"]
        fails = mask.bitwiseAND(own) != 0
        alive = state["alive"]
        removed = alive & fails
        done = F.struct(
            F.when(alive & ~fails, n).otherwise(none).alias("kept"),
            F.when(removed, n).otherwise(none).alias("removed"),
            F.when(~alive & fails, n).otherwise(none).alias("redundant"),
            F.when(mask == own, n).otherwise(none).alias("unique_fails"),
            F.when(removed, F.col("good")).otherwise(none).alias("good_lost"),
            F.when(removed, F.col("toxic")).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(done)).alias("steps"))

    empty = F.array().cast("array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), empty.alias("steps"))
    return F.aggregate(order["steps"], start, step, lambda state: state["steps"])


def audit(cells: DataFrame) -> DataFrame:
    """All orders and steps of every part of ``mask_cells``; see ``filter_audit``."""
    orders = F.array(
        *(
            F.struct(
                F.lit("".join(order)).alias("name"),
                F.array(
                    *(
                        F.struct(F.lit(f).alias("filter"), F.lit(1 << FILTERS.index(f)).alias("flag"))
                        for f in order
                    )
                ).alias("steps"),
            )
            for order in permutations(FILTERS)
        )
    )
    folded = cells.select("part", F.flatten(F.transform(orders, _fold)).alias("counts"))
    # At most 32 cells a part, each of 600 structs.
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    size = 120 * len(FILTERS)

    def add(total: Column, cell: Column) -> Column:
        return F.zip_with(
            total, cell, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
        )

    merged = folded.groupBy("part").agg(F.collect_list("counts").alias("cells")).select(
        "part", F.aggregate("cells", F.array_repeat(zero, size), add).alias("counts")
    )
    places = F.flatten(
        F.transform(
            orders,
            lambda order: F.transform(
                order["steps"],
                lambda s, i: F.struct(
                    order["name"].alias("filter_order"), (i + 1).alias("step"), s["filter"].alias("filter")
                ),
            ),
        )
    )
    steps = merged.select("part", F.arrays_zip(places.alias("place"), F.col("counts").alias("count")).alias("steps"))
    def removed_by(name: str) -> Column:
        own = F.filter("steps", lambda s: s["place"]["filter"] == name)
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, s: total + s["count"]["removed"])

    sums = F.create_map(*(part for f in FILTERS for part in (F.lit(f), removed_by(f))))
    return (
        steps.withColumn("sums", sums)
        .select("part", "sums", F.explode("steps").alias("s"))
        .select(
            "part",
            "s.place.filter_order",
            "s.place.step",
            *(f"s.count.{c}" for c in COUNTS),
            F.element_at("sums", F.col("s.place.filter")).alias("shapley"),
        )
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, zeros included.

    Columns: ``part``, ``filter_order``, ``step`` (from 1), ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``. Further columns of the inputs are
    not read. No documents give no rows; documents without a label are neither good nor toxic; see
    ``mask_cells`` for nulls and repeated rows and ids.
    """
    return audit(mask_cells(docs, labels))
