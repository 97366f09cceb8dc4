"""Exact order statistics and quantiles without sorting the table.

The wanted ranks are narrowed down, for columns of any size alike: each pass counts the values of
the current bracket in buckets (a tiny aggregate with map-side combine) and goes on in the bucket
that holds the wanted rank, until that bucket has a single value. A bracket that spans more than
two powers of two is split by sign and exponent, any other into ``BUCKETS`` of equal width, so a
double is found in at most six passes, whatever the range. All columns and ranks share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048


def _is_wide(low: float, high: float) -> bool:
    """Whether the bracket spans zero or more than one power of two."""
    if math.isinf(low) or math.isinf(high) or low <= 0 <= high:
        return True
    least, most = sorted((abs(low), abs(high)))
    return most / 4 > least  # a bucket of one exponent is never split by exponent again


def _exponent(value: Column) -> Column:
    """Sign and binary exponent as one number that grows with the value; zero is 0."""
    size = F.floor(F.log2(F.abs(value))).cast("int") + 1_100
    size = F.when(F.abs(value) == float("inf"), F.lit(3_000)).otherwise(size)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def order_statistics(
    df: DataFrame,
    wanted: Mapping[str, Sequence[int]],
    limits: Mapping[str, tuple[float, float]],
    buckets: int = BUCKETS,
) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks per numeric column; ``limits`` are the columns' (min, max)."""
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    # (column, low, high) -> {wanted rank: rank inside the bracket}
    open_: dict[tuple[str, float, float], dict[int, int]] = {}
    for column, ranks in wanted.items():
        low, high = limits[column]
        open_[(column, low, high)] = {r: r for r in ranks}
    while open_:
        brackets, following = list(open_), {}
        cells = []
        for i, (column, low, high) in enumerate(brackets):
            value = F.col(column)
            if low == high:
                bucket = F.lit(0)
            elif _is_wide(low, high):
                bucket = _exponent(value)
            else:
                # Each step is monotone in floating point, so buckets keep the order of values.
                share = (value / 2 - low / 2) / (high / 2 - low / 2)
                bucket = (
                    F.when(value == low, F.lit(0))
                    .when(value == high, F.lit(buckets - 1))
                    .otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))
                )
            cells.append(
                F.when(
                    value.between(F.lit(low), F.lit(high)),
                    F.struct(
                        F.lit(i).alias("bracket"),
                        bucket.alias("bucket"),
                        value.cast("double").alias("value"),
                    ),
                )
            )
        counted = (
            df.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
            .groupBy("c.bracket", "c.bucket")
            .agg(
                F.count("*").alias("n"), F.min("c.value").alias("low"), F.max("c.value").alias("high")
            )
            .collect()  # at most len(brackets) * 4,300 rows
        )
        by_bracket: dict[int, list] = {}
        for row in counted:
            by_bracket.setdefault(row["bracket"], []).append(row)
        for i, key in enumerate(brackets):
            rows = sorted(by_bracket.get(i, []), key=lambda r: r["bucket"])
            for rank, inside in open_[key].items():
                for row in rows:
                    if inside < row["n"]:
                        break
                    inside -= row["n"]
                else:
                    raise IndexError(f"rank {rank} is beyond the rows of {key[0]}")
                if row["low"] == row["high"]:
                    found[key[0]][rank] = row["low"]
                else:
                    nested = (key[0], row["low"], row["high"])
                    following.setdefault(nested, {})[rank] = inside
        open_ = following
    return found


def profile(df: DataFrame, columns: Sequence[str]) -> list:
    """Aggregates that ``exact_quantiles`` needs; may run along with others in one job."""
    return [
        f(F.col(c).cast("double")).alias(f"_{name}_{c}")
        for c in columns
        for name, f in (("n", F.count), ("min", F.min), ("max", F.max))
    ]


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    known: Mapping[str, object] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; nulls are left out, ``None`` if all null."""
    columns = list(wanted)
    if not columns:
        return {}
    if known is None:
        known = df.agg(*profile(df, columns)).first().asDict()
    sizes = {c: known[f"_n_{c}"] for c in columns}
    result: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in columns}
    filled = [c for c in columns if sizes[c]]
    ranks = {}
    for c in filled:
        places = [q * (sizes[c] - 1) for q in wanted[c]]
        ranks[c] = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    limits = {c: (known[f"_min_{c}"], known[f"_max_{c}"]) for c in filled}
    values = order_statistics(df, ranks, limits)
    for c in filled:
        for i, q in enumerate(wanted[c]):
            place = q * (sizes[c] - 1)
            below, above = math.floor(place), math.ceil(place)
            low, high = values[c][below], values[c][above]
            result[c][i] = low if low == high else (above - place) * low + (place - below) * high
    return result
