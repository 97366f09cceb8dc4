"""Approximate nearest neighbours by inner product: robust-pruned graphs over shards.

Equal vectors are one node. Nodes are dealt at random into shards of bounded size; in each shard a
directed graph is built by inserting nodes in batches: greedy searches of the graph so far propose
neighbours, and relaxed distance pruning keeps those that lead in different directions. One more
coordinate makes all vectors of a shard equally long, so that nearness by distance is nearness by
inner product. Queries run a beam search in each shard; the best of all shards are ranked by exact
inner products in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import store

NEIGHBOURS = 20
#: Vectors per shard and queries per block on average.
SHARD_ROWS, QUERY_ROWS = 8_192, 4_096
#: Most edges per node, beam widths of building and searching, and the relaxation of pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXATION = 32, 64, 160, 1.2
#: Nodes searched for, and nodes expanded, at once.
BATCH, EXPANDED = 512, 4


def beam_search(
    points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that greedy search finds for each query, nearest first.

    Returns node numbers (-1 beyond the last) and squared distances. ``graph`` holds node numbers,
    -1 where a node has fewer edges.
    """
    count, rows = len(queries), np.arange(len(queries))[:, None]
    squares = (points * points).sum(1)
    own = (queries * queries).sum(1)[:, None]
    seen = np.zeros((count, len(points) + 1), bool)
    seen[:, -1] = True  # stands for the missing edge -1
    beam = np.full((count, width), -1, np.int64)
    far = np.full((count, width), np.inf, np.float32)
    closed = np.zeros((count, width), bool)

    def distances(found: np.ndarray) -> np.ndarray:
        inner = np.matmul(points[found], queries[:, :, None])[:, :, 0]
        return squares[found] - 2 * inner + own

    start = np.broadcast_to(entries, (count, len(entries)))
    seen[rows, start] = True
    new, gap = start, distances(start)
    while True:
        joined = np.concatenate((beam, new), 1)
        spans = np.concatenate((far, gap), 1)
        done = np.concatenate((closed, np.zeros(new.shape, bool)), 1)
        order = np.argsort(spans, axis=1, kind="stable")[:, :width]
        beam, far = np.take_along_axis(joined, order, 1), np.take_along_axis(spans, order, 1)
        closed = np.take_along_axis(done, order, 1)
        waiting = ~closed & np.isfinite(far)
        if not waiting.any():
            return np.where(np.isfinite(far), beam, -1), far
        # The beam is sorted: the first open places are the nearest ones.
        first = np.argsort(~waiting, axis=1, kind="stable")[:, :EXPANDED]
        open_ = np.take_along_axis(waiting, first, 1)
        closed[rows, first] |= open_
        picked = np.take_along_axis(beam, first, 1)
        new = np.where(open_[:, :, None], graph[picked], -1).reshape(count, -1)
        # A node proposed by several expanded nodes counts once.
        ordered = np.sort(new, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        fresh = ~seen[rows, ordered]
        seen[rows, ordered] = True
        new = np.where(fresh, ordered, 0)
        gap = np.where(fresh, distances(new), np.inf).astype(np.float32)


def robust_prune(
    points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int
) -> np.ndarray:
    """At most ``degree`` diverse neighbours of every node out of its candidates (-1: none).

    The nearest candidate is kept and drops all others that are RELAXATION times nearer to it
    than to the node; so on with the nearest one left.
    """
    count = len(nodes)
    there = (candidates >= 0) & (candidates != nodes[:, None])
    vectors = points[np.where(there, candidates, 0)]
    gap = ((vectors - points[nodes][:, None, :]) ** 2).sum(2)
    gap = np.where(there, gap, np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    gap = np.take_along_axis(gap, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    squares = (vectors * vectors).sum(2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = np.isfinite(gap)
    kept = np.full((count, degree), -1, np.int64)
    rows = np.arange(count)
    for place in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        kept[some, place] = candidates[rows, first][some]
        # Distances are squared, and so is the relaxation.
        covered = RELAXATION**2 * between[rows, first] <= gap
        alive &= ~covered
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all nodes (rows padded by -1) and the entry nodes."""
    size = len(points)
    middle = points.mean(0)
    entry = int(((points - middle) ** 2).sum(1).argmin())
    graph = np.full((size, degree), -1, np.int64)
    order = np.random.default_rng(size).permutation(size)
    order = np.concatenate(([entry], order[order != entry]))
    entries = np.array([entry])
    done = 1
    while done < size:
        batch = order[done : done + min(done, BATCH)]
        found, _ = beam_search(points, graph, entries, points[batch], beam)
        graph[batch] = robust_prune(points, batch, found, degree)
        # Edges back; a node with too many is pruned again.
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        incoming = np.full((len(nodes), counts.max() if len(nodes) else 1), -1, np.int64)
        incoming[np.repeat(np.arange(len(nodes)), counts), place] = source
        for at in range(0, len(nodes), BATCH):
            own = nodes[at : at + BATCH]
            merged = np.concatenate((graph[own], incoming[at : at + BATCH]), 1)
            full = (merged >= 0).sum(1) > degree
            graph[own[~full]] = -np.sort(-merged[~full], axis=1)[:, :degree]
            if full.any():
                graph[own[full]] = robust_prune(points, own[full], merged[full], degree)
        done += len(batch)
    return graph, _all_entries(graph, entries)


def _all_entries(graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry nodes and one more for every part of the graph that they do not reach."""
    reached = np.zeros(len(graph) + 1, bool)
    reached[-1] = True  # stands for the missing edge -1
    found = entries.tolist()
    new = entries
    while True:
        while len(new):
            reached[new] = True
            new = np.unique(graph[new])
            new = new[~reached[new]]
        if reached.all():
            return np.array(found)
        new = np.flatnonzero(~reached)[:1]
        found += new.tolist()


def _valid(vectors: DataFrame, key: str, vector: str, length: int | None = None) -> DataFrame:
    """Rows with a key and a finite vector that is not zero, of the given or commonest length."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.coalesce(bad, F.lit(True))
        & F.exists("vector", lambda x: x != 0)
    )
    if length is None:
        common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = common["n"] if common else 0
    return rows.where(F.size("vector") == length)


def build_index(vectors: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """The graph of all vectors, one row per different vector, written to shared storage.

    Columns: ``shard``, ``node`` (its number in the shard), ``ids`` (the ``keep`` least keys of
    equal vectors), ``vector``, ``edges`` and ``entry``.
    """
    rows = _valid(vectors, key, vector)
    # Of equal vectors only the least keys can be among the nearest: ties go to smaller keys.
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    nodes = (
        rows.withColumn("rank", rank)
        .where(F.col("rank") <= keep)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    nodes = store(nodes)
    shards = max(1, -(-nodes.count() // SHARD_ROWS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first", kind="stable", ignore_index=True)
        points = np.stack(group["vector"].to_numpy())
        squares = (points * points).sum(1)
        level = np.sqrt(np.maximum(squares.max() - squares, 0))
        graph, entries = build_graph(np.column_stack((points, level)).astype(np.float32))
        entry = np.zeros(len(group), bool)
        entry[entries] = True
        group["node"] = np.arange(len(group))
        group["edges"] = [row[row >= 0] for row in graph]
        group["entry"] = entry
        return group[["shard", "node", "ids", "vector", "edges", "entry"]]

    return store(
        nodes.withColumn("first", F.col("ids")[0])
        .withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            build,
            "shard long, node long, ids array<long>, vector array<double>, edges array<long>, "
            "entry boolean",
        )
    )


def search_index(index: DataFrame, queries: DataFrame, key: str, vector: str, nearest: int) -> DataFrame:
    """The ``nearest`` best nodes of all shards for every query, the query's own key left out."""
    some = index.select(F.size("vector").alias("n")).first()
    asked = _valid(queries, key, vector, some["n"] if some else 0)
    shards = index.agg(F.max("shard")).first()[0]
    shards = 0 if shards is None else shards + 1
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def search(nodes: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
        if not len(nodes) or not len(block):
            return empty
        nodes = nodes.sort_values("node", ignore_index=True)
        exact = np.stack(nodes["vector"].to_numpy())
        squares = (exact * exact).sum(1)
        level = np.sqrt(np.maximum(squares.max() - squares, 0))
        points = np.column_stack((exact, level)).astype(np.float32)
        edges = nodes["edges"].to_numpy()
        graph = np.full((len(nodes), max(max(map(len, edges)), 1)), -1, np.int64)
        for node, own in enumerate(edges):
            graph[node, : len(own)] = own
        entries = np.flatnonzero(nodes["entry"].to_numpy())
        ids = nodes["ids"].to_numpy()
        asked = np.stack(block["vector"].to_numpy())
        names = block["id"].to_numpy()
        out_query, out_id, out_score = [], [], []
        for at in range(0, len(asked), BATCH):
            part = asked[at : at + BATCH]
            flat = np.column_stack((part, np.zeros(len(part)))).astype(np.float32)
            found, _ = beam_search(points, graph, entries, flat, SEARCH_BEAM)
            for row, query, own in zip(found, part, names[at : at + BATCH], strict=True):
                row = row[row >= 0]
                scores = (exact[row] * query).sum(1)
                best = np.argsort(-scores, kind="stable")[: nearest + 1]
                owner = np.concatenate([ids[n] for n in row[best]])
                score = np.repeat(scores[best], [len(ids[n]) for n in row[best]])
                other = owner != own
                owner, score = owner[other], score[other]
                first = np.lexsort((owner, -score))[:nearest]
                out_query.append(np.full(len(first), own))
                out_id.append(owner[first])
                out_score.append(score[first])
        return pd.DataFrame(
            {
                "query_id": np.concatenate(out_query),
                "vec_id": np.concatenate(out_id),
                "score": np.concatenate(out_score),
            }
        )

    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long")))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards - 1, 0)).cast("long")))
    dealt = index.withColumn("block", spread)
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))).withColumn(
        "shard", everywhere
    )
    found = (
        dealt.groupBy("shard", "block")
        .cogroup(blocked.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEIGHBOURS,
) -> DataFrame:
    """The ``nearest`` vectors found for every query by largest inner product.

    Columns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the exact inner product in
    double precision; ties go to the smaller key. A query's own key is no candidate. Null keys,
    and vectors that are null, zero, of another length than most of ``vectors``, or hold null, NaN or infinite
    components take no part, as queries too. Repeated rows are one candidate and one query.
    Other columns are not read; empty tables give no rows.
    """
    index = build_index(vectors, key, vector, nearest + 1)
    return search_index(index, queries, key, vector, nearest)
