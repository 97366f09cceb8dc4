"""Boosted trees of second order, and exact attributions of their margins.

Rows are binned once and kept as blocks of arrays in a persisted RDD of at most as many partitions
as there are cores. A round grows one tree level by level: every task adds up gradients and
hessians of its rows per (node, feature, bin), and the driver adds these sums, whose size does not
depend on the data, and reads the best splits off them. Sums are of integers, so
trees do not depend on how the rows are partitioned. Missing values have a bin of their own and go
to the side that gains more.

Attributions are path-dependent Shapley values: a feature that is left out follows both branches,
weighted by the hessians that went there in training.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.session import cut_lineage

#: Gradients and hessians are counted in units of 2^-20: sums of 10^12 rows stay exact.
GRAIN = 1 << 20
#: Ranges of equal width per feature that the bins are made from.
FINE = 4_096
#: Rounds after which the margins are brought up to date.
ROUNDS_AT_ONCE = 5
#: Rows that are worth a task of their own.
ROWS_PER_TASK = 20_000
#: Rows of a block, about.
BLOCK_ROWS = 65_536
#: A split has to gain more than this.
LEAST_GAIN = 1e-6


class Tree(NamedTuple):
    """Nodes in heap order; ``feature`` is -1 at leaves, ``value`` is 0 elsewhere.

    A row goes right if its value is at least ``threshold``.
    """

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """The leaf of every row of a matrix of feature values."""
        node = np.zeros(len(values), np.int64)
        rows = np.arange(len(values))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            own = values[rows, np.maximum(feature, 0)]
            right = np.where(np.isnan(own), ~self.missing_left[node], own >= self.threshold[node])
            node = np.where(inner, 2 * node + 1 + right, node)


class BoostedTrees(NamedTuple):
    features: list[str]
    base: float
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        for tree in self.trees:
            total += tree.value[tree.leaves(values)]
        return total


def feature_values(features: Sequence[str]) -> Column:
    """All features of a row as doubles; missing ones are NaN."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _matrix(array: pa.Array, width: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), width)


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Values that start a new bin, about equally many rows apart.

    One pass finds the ranges, one counts ``FINE`` parts of each: at most that many rows per
    feature come to the driver.
    """
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features]
    limits = train.agg(
        *[f(v).alias(f"{name}{i}") for i, v in enumerate(numbers) for name, f in (("a", F.min), ("z", F.max))]
    ).first()
    cells = []
    for i, value in enumerate(numbers):
        low, high = limits[f"a{i}"], limits[f"z{i}"]
        if low is None or low == high:
            continue
        share = (value / 2 - low / 2) / (high / 2 - low / 2)
        part = F.least(F.floor(share * FINE), F.lit(FINE - 1)).cast("int")
        cells.append(F.struct(F.lit(i).alias("feature"), part.alias("part"), value.alias("value")))
    found: list[list] = [[] for _ in features]
    if cells:
        counted = (
            train.select(F.inline(F.array(*cells)))
            .where("value is not null")
            .groupBy("feature", "part")
            .agg(F.count("*").alias("n"), F.min("value").alias("least"))
            .orderBy("feature", "part")
            .collect()
        )
        for row in counted:
            found[row["feature"]].append((row["n"], row["least"]))
    edges = []
    for parts in found:
        total, before, own = sum(n for n, _ in parts), 0, []
        for n, least in parts:
            if before and before * bins >= (len(own) + 1) * total:
                own.append(least)
            before += n
        if len(parts) <= bins:
            own = [least for _, least in parts[1:]]
        edges.append(np.array(own, np.float64))
    return edges


def _binned(values: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin numbers; ``bins`` for a missing value."""
    found = np.empty(values.shape, np.uint8)
    for i, own in enumerate(edges):
        column = values[:, i]
        found[:, i] = np.where(np.isnan(column), bins, np.searchsorted(own, column, side="right"))
    return found


class _Growing(NamedTuple):
    """A tree whose cuts are numbers of edges."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def nodes(self, binned: np.ndarray, bins: int) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            own = binned[rows, np.maximum(feature, 0)]
            right = np.where(own == bins, ~self.missing_left[node], own > self.cut[node])
            node = np.where(inner, 2 * node + 1 + right, node)


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in whole grains."""
    chance = 1 / (1 + np.exp(-margin))
    return np.rint((chance - label) * GRAIN), np.rint(chance * (1 - chance) * GRAIN)


def best_split(
    g: np.ndarray, h: np.ndarray, edges: Sequence[int], least_weight: float, penalty: float
) -> tuple[float, int, int, bool] | None:
    """``(gain, feature, cut, missing_left)`` of the best split of a node, or none.

    ``g`` and ``h`` are sums by feature and bin, the missing ones last; features with no edges
    cannot split. Ties go to the first feature, then the first cut, then missing values right.
    """
    best: tuple[float, int, int, bool] | None = None
    for feature, count in enumerate(edges):
        if not count:
            continue
        own_g, own_h = g[feature] / GRAIN, h[feature] / GRAIN
        all_g, all_h = own_g.sum(), own_h.sum()
        left_g, left_h = np.cumsum(own_g[:count]), np.cumsum(own_h[:count])
        sides = []
        for more_g, more_h in ((0.0, 0.0), (own_g[-1], own_h[-1])):
            a, b = left_g + more_g, left_h + more_h
            c, d = all_g - a, all_h - b
            gain = a * a / (b + penalty) + c * c / (d + penalty) - all_g * all_g / (all_h + penalty)
            sides.append(np.where((b >= least_weight) & (d >= least_weight), gain, -np.inf))
        gains = np.stack(sides, axis=1)
        at = int(gains.argmax())
        gain = float(gains.flat[at])
        if gain > LEAST_GAIN and (best is None or gain > best[0]):
            best = (gain, feature, at // 2, at % 2 == 1)
    return best


def chosen_features(count: int, share: float, seed: int, number: int) -> list[int]:
    """The features of one round."""
    draw = np.random.default_rng((seed, number))
    return sorted(draw.permutation(count)[: max(1, int(share * count))].tolist())


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    rounds: int = 180,
    depth: int = 3,
    rate: float = 0.045,
    row_share: float = 0.85,
    feature_share: float = 0.85,
    least_weight: float = 3.0,
    penalty: float = 2.0,
    bins: int = 64,
    seed: int = 42,
) -> BoostedTrees:
    """Boost ``rounds`` trees for the logistic loss.

    A leaf's value is ``-rate * G / (H + penalty)``; a child needs a hessian of ``least_weight``.
    Each round sees the rows whose hash of ``keys`` and round is below ``row_share`` and a
    ``feature_share`` of the features. Boosting starts from the log odds of the label. Null and NaN
    are missing values; rows without label are not learned from. Infinite values are not allowed.
    """
    if not 2 <= bins < 255:
        raise ValueError("From 2 to 254 bins.")
    rows = train.where(F.col(label).isNotNull())
    edges = bin_edges(rows, features, bins)
    width, slots = len(features), bins + 1
    counts = [len(e) for e in edges]

    def to_bins(array: pa.Array) -> pa.Array:
        binned = _binned(_matrix(array, width), edges, bins)
        return pa.array([row.tobytes() for row in binned], pa.binary())

    stats = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("ones")).first()
    share = min(max((stats["ones"] or 0.0) / max(stats["n"], 1), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    table = cut_lineage(
        rows.select(
            F.xxhash64(*keys).alias("id"),
            arrow_udf(to_bins, "binary")(feature_values(features)).alias("bins"),
            F.col(label).cast("double").alias("label"),
        )
    )

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(found: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(found)
            ids, labels = own["id"].to_numpy(), own["label"].to_numpy()
            binned = np.frombuffer(b"".join(own["bins"].to_pylist()), np.uint8).reshape(-1, width)
            packed = pickle.dumps((ids, binned, labels, np.full(len(ids), base)))
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["block"])

        found: list[pa.RecordBatch] = []
        for batch in batches:
            found.append(batch)
            if sum(map(len, found)) >= BLOCK_ROWS:
                yield block(found)
                found = []
        if sum(map(len, found)):
            yield block(found)

    packed = table.mapInArrow(to_blocks, "block binary").rdd
    # A round is three small jobs: few rows are few tasks, many rows a task per core.
    tasks = min(packed.context.defaultParallelism, 1 + stats["n"] // ROWS_PER_TASK)
    blocks = packed.coalesce(tasks).map(lambda row: pickle.loads(row["block"]))
    state = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    outdated: list[RDD] = []

    def histogram(pending: list[_Growing], growing: _Growing, number: int, used: list[int], level: int):
        first, nodes = (1 << level) - 1, 1 << level
        cells = nodes * len(used) * slots
        starts = np.arange(len(used)) * slots

        def add(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
            sums = np.zeros((2, cells))
            for ids, binned, labels, margin in blocks:
                # The draw of a row in a round: bits of its hash, shuffled by the round's number.
                keep = sampled(ids, seed, number, row_share)
                binned, margin = binned[keep], margin[keep]
                for tree in pending:
                    margin = margin + tree.value[tree.nodes(binned, bins)]
                node = growing.nodes(binned, bins) - first
                here = node >= 0
                place = (node[here] * len(used) * slots)[:, None] + starts + binned[np.ix_(here, used)]
                for k, values in enumerate(gradients(margin, labels[keep])):
                    sums[k] += np.bincount(place.ravel(), np.repeat(values[here], len(used)), cells)
            yield sums.astype(np.int64)

        # As many small sums as there are partitions.
        found = sum(state.mapPartitions(add).collect(), np.zeros((2, cells), np.int64)).astype(np.float64)
        while outdated:
            outdated.pop().unpersist()
        g, h = found.reshape(2, nodes, len(used), slots)
        return g, h

    def advanced(pending: list[_Growing]) -> RDD:
        def move(block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            ids, binned, labels, margin = block
            for tree in pending:
                margin = margin + tree.value[tree.nodes(binned, bins)]
            return ids, binned, labels, margin

        outdated.append(state)
        return state.map(move).persist(StorageLevel.MEMORY_AND_DISK)

    trees: list[Tree] = []
    pending: list[_Growing] = []
    size = (2 << depth) - 1
    for number in range(rounds):
        used = chosen_features(width, feature_share, seed, number)
        growing = _Growing(
            np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
        )
        threshold, cover, gain = np.zeros(size), np.zeros(size), np.zeros(size)
        for level in range(depth):
            g, h = histogram(pending, growing, number, used, level)
            split = False
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                own_g, own_h = g[i, 0].sum() / GRAIN, h[i, 0].sum() / GRAIN
                if level and growing.feature[(node - 1) // 2] < 0:
                    continue
                cover[node] = own_h
                growing.value[node] = -rate * own_g / (own_h + penalty)
                best = best_split(g[i], h[i], [counts[f] for f in used], least_weight, penalty)
                if best is None:
                    continue
                split = True
                gain[node], place, cut, left = best
                growing.feature[node], growing.cut[node] = used[place], cut
                growing.missing_left[node], growing.value[node] = left, 0.0
                threshold[node] = edges[used[place]][cut]
                # The children's sums are known already; a further level only splits them.
                for child, sums in _children(g[i, place], h[i, place], cut, left):
                    at = 2 * node + 1 + child
                    cover[at] = sums[1]
                    growing.value[at] = -rate * sums[0] / (sums[1] + penalty)
            if not split:
                break
        pending.append(growing)
        trees.append(
            Tree(growing.feature, threshold, growing.missing_left, growing.value, cover, gain)
        )
        if len(pending) == ROUNDS_AT_ONCE and number + 1 < rounds:
            state, pending = advanced(pending), []
    for rdd in (*outdated, state):
        rdd.unpersist()
    return BoostedTrees(list(features), base, trees)


def _children(g: np.ndarray, h: np.ndarray, cut: int, missing_left: bool):
    left = np.arange(len(g)) <= cut
    left[-1] = missing_left
    for child, side in enumerate((left, ~left)):
        yield child, (g[side].sum() / GRAIN, h[side].sum() / GRAIN)


def sampled(ids: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Which rows a round sees, by their hashes alone."""
    x = ids.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < share


# -- using the trees -----------------------------------------------------------------------------


def margin(model: BoostedTrees) -> Column:
    """The log odds that the model gives a row with its feature columns."""

    def score(array: pa.Array) -> pa.Array:
        return pa.array(model.margins(_matrix(array, len(model.features))))

    return arrow_udf(score, "double")(feature_values(model.features))


def gain_importance(model: BoostedTrees) -> dict[str, float]:
    """Mean gain of each feature's splits, as a share of all features'."""
    gains = np.zeros(len(model.features))
    splits = np.zeros(len(model.features))
    for tree in model.trees:
        inner = tree.feature >= 0
        np.add.at(gains, tree.feature[inner], tree.gain[inner])
        np.add.at(splits, tree.feature[inner], 1)
    means = gains / np.maximum(splits, 1)
    return dict(zip(model.features, (means / (means.sum() or 1.0)).tolist(), strict=True))


class _Path(NamedTuple):
    """A leaf and what leads to it: per distinct feature the allowed values and the cover share."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    missing: list[bool]
    share: list[float]


def _paths(tree: Tree) -> list[_Path]:
    found: list[_Path] = []

    def walk(node: int, sides: dict[int, tuple[float, float, bool, float]]) -> None:
        feature = int(tree.feature[node])
        if feature < 0:
            own = list(sides.items())
            found.append(
                _Path(
                    float(tree.value[node]),
                    [f for f, _ in own],
                    *([s[i] for _, s in own] for i in range(4)),
                )
            )
            return
        low, high, missing, share = sides.get(feature, (-math.inf, math.inf, True, 1.0))
        cut, left = float(tree.threshold[node]), bool(tree.missing_left[node])
        for child, bounds, goes in (
            (2 * node + 1, (low, min(high, cut)), left),
            (2 * node + 2, (max(low, cut), high), not left),
        ):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            walk(child, {**sides, feature: (*bounds, missing and goes, share * part)})

    walk(0, {})
    return found


def expected_margin(model: BoostedTrees) -> float:
    """The margin of a row of which nothing is known."""
    return model.base + sum(p.value * math.prod(p.share) for t in model.trees for p in _paths(t))


def shapley_values(model: BoostedTrees, paths: list[_Path], values: np.ndarray) -> np.ndarray:
    """Contributions of all features to the margin of each row.

    Along a path of m features the game is a product, so the coalitions of one size are a
    coefficient of the polynomial prod(share + follows * x) over the other features; Shapley's
    weights of the sizes then sum them up.
    """
    found = np.zeros(values.shape)
    for path in paths:
        m = len(path.features)
        weights = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
        follows = []
        for feature, low, high, missing in zip(path.features, path.low, path.high, path.missing, strict=True):
            own = values[:, feature]
            follows.append(np.where(np.isnan(own), missing, (own >= low) & (own < high)).astype(np.float64))
        for j, feature in enumerate(path.features):
            sizes = [np.ones(len(values))]
            for k in range(m):
                if k != j:
                    longer = [c * path.share[k] for c in sizes] + [np.zeros(len(values))]
                    for s, c in enumerate(sizes):
                        longer[s + 1] = longer[s + 1] + c * follows[k]
                    sizes = longer
            total = sum(w * c for w, c in zip(weights, sizes, strict=True))
            found[:, feature] += path.value * (follows[j] - path.share[j]) * total
    return found


def contributions(model: BoostedTrees) -> Column:
    """An array column: the signed contribution of each feature to the row's margin.

    With ``expected_margin`` they add up to the margin.
    """
    paths = [p for tree in model.trees for p in _paths(tree)]

    def explain(array: pa.Array) -> pa.Array:
        values = _matrix(array, len(model.features))
        found = shapley_values(model, paths, values)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(model.features))
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return arrow_udf(explain, "array<double>")(feature_values(model.features))


def mean_contributions(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """``feature, mean_abs_contribution, directional_mean_contribution`` over all rows, largest first."""
    names = F.array(*[F.lit(f) for f in model.features])
    return (
        df.select(F.inline(F.arrays_zip(names.alias("feature"), contributions(model).alias("value"))))
        .groupBy("feature")
        .agg(
            F.avg(F.abs("value")).alias("mean_abs_contribution"),
            F.avg("value").alias("directional_mean_contribution"),
        )
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )
