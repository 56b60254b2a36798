"""Two-dimensional layout of neighbourhoods, for scatter plots only.

Each distinct vector has the edges of its own list of nearest vectors, with fuzzy weights. Rows are grouped by
neighbourhood, and a task moves the rows of a group over many epochs at a time: along sampled
edges towards their neighbours, and away from rows drawn at random. Beside its own rows a group holds the
border (neighbours that other groups move) and a sample of the whole question, both at rest; after some epochs
the groups exchange positions by a join. A question that fits into one group needs no exchange.

The start is spectral: leading eigenvectors of the neighbour graph of a question that is one group, else of
the graph of its cells, where each row begins between the cells of its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from commentloom.config import ClusteringSettings
from commentloom.operators.neighbours import Blocks, build_blocks, distinct_points, knn, with_point
from commentloom.operators.vectors import enough_docs, id_type, reduce_dimensions, valid_vectors
from commentloom.runtime import cut

# Curve 1 / (1 + a d^2b) fitted for spread 1 and minimum distance 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
REPELLERS = 5
STEP_LIMIT = 4.0
# Half the width of the plane at the start.
SPAN = 10.0
# Rows of a question, in expectation, that all of its groups see.
FAR_ROWS = 1024


def layout(df: DataFrame, settings: ClusteringSettings = ClusteringSettings(), epochs: int | None = None) -> DataFrame:
    """`question, response_id, x, y` of vectors `question, response_id, embedding`."""
    rows = cut(enough_docs(valid_vectors(df), settings.min_docs).select("question", "response_id", "embedding"))
    scores = cut(reduce_dimensions(rows, settings.pca_dims))
    return embed_plane(scores, settings, epochs)


def neighbour_weights(near: DataFrame, n_neighbors: int) -> DataFrame:
    """`question, response_id, neighbour_id, weight` for each listed neighbour.

    exp(-(d - d1) / s), with d1 the nearest distance and s such that the weights of a
    row add up to log2(n_neighbors). Where two rows list each other, p + q - pq. A row has as many edges as it lists
    neighbours, however many rows list it.
    """
    ids = id_type(near)
    listed = near.groupBy("question", "response_id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near")
    )
    # As many neighbours in a list as were asked for.
    parts = listed.select(
        "question", "response_id",
        F.transform("near", lambda n: n["distance"]).alias("distance"),
        F.transform("near", lambda n: n["neighbour_id"]).alias("neighbour"),
    )

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["distance"].str.len().to_numpy()
            rows = np.full((len(batch), held.max(initial=1)), np.inf)
            rows[np.arange(rows.shape[1]) < held[:, None]] = np.concatenate(batch["distance"].to_list() or [[]])
            weights = _weights(rows, n_neighbors)
            yield batch.assign(weight=[w[:n] for w, n in zip(weights, held)])

    weighed = parts.mapInPandas(
        weigh,
        f"question string, response_id {ids}, distance array<double>, neighbour array<{ids}>, weight array<double>",
    )
    one_way = cut(
        weighed.select("question", "response_id", F.inline(F.arrays_zip("neighbour", "weight"))).select(
            "question", "response_id", F.col("neighbour").alias("neighbour_id"), "weight"
        )
    )
    back = one_way.select(
        "question",
        F.col("neighbour_id").alias("response_id"),
        F.col("response_id").alias("neighbour_id"),
        F.col("weight").alias("_back"),
    )
    weight = F.coalesce(F.col("weight") + F.col("_back") - F.col("weight") * F.col("_back"), F.col("weight"))
    return one_way.join(back, ["question", "response_id", "neighbour_id"], "left").select(
        "question", "response_id", "neighbour_id", weight.alias("weight")
    )


def _weights(distance: np.ndarray, n_neighbors: int) -> np.ndarray:
    """Weights of all rows of a batch, by bisection of their scales; absent neighbours are at infinity."""
    gap = np.maximum(distance - distance.min(axis=1, keepdims=True), 0.0)
    target = np.log2(n_neighbors)
    low, high, scale = np.zeros(len(gap)), np.full(len(gap), np.inf), np.ones(len(gap))
    for _ in range(64):
        total = np.exp(-gap / scale[:, None]).sum(axis=1)
        moving = (np.abs(total - target) >= 1e-5) & (scale >= 1e-12)
        if not moving.any():
            break
        above = total > target
        high = np.where(moving & above, scale, high)
        low = np.where(moving & ~above, scale, low)
        middle = np.where(np.isinf(high), scale * 2, (low + np.where(np.isinf(high), 0.0, high)) / 2)
        scale = np.where(moving, middle, scale)
    return np.exp(-gap / np.maximum(scale, 1e-12)[:, None])


def embed_plane(scores: DataFrame, settings: ClusteringSettings, epochs: int | None = None) -> DataFrame:
    """Coordinates from materialised scores, after `epochs` epochs (`layout_epochs` if None).

    Copies of a vector share its point.
    """
    epochs = settings.layout_epochs if epochs is None else epochs
    rows = scores.select("question", "response_id", "embedding")
    points = cut(distinct_points(rows))
    near = knn(points, settings.n_neighbors, settings.pair_rows, settings.max_pivots)
    edges = neighbour_weights(near, settings.n_neighbors)
    blocks = build_blocks(points.select("question", "response_id", "embedding"), settings.layout_rows, settings.max_pivots)
    at = _placed(points, blocks, edges)
    if blocks.single or epochs == 0:
        steps = [(0, epochs)]
    else:
        pieces = min(epochs, settings.layout_exchanges)
        marks = [epochs * i // pieces for i in range(pieces + 1)]
        steps = list(zip(marks, marks[1:]))
    seen = None if blocks.single else cut(_seen(at))
    for start, end in steps:
        at = cut(_moved(at, seen, start, end, epochs, settings.seed))
    found = at.select("question", F.col("response_id").alias("point_id"), "x", "y")
    return with_point(rows, points).join(found, ["question", "point_id"]).select("question", "response_id", "x", "y")


def labelled(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """Points with `cluster` and `label` of the cluster tables; null for rows without a cluster."""
    names = assigned.select("question", "response_id", "cluster", F.col("cluster_label").alias("label"))
    return points.join(names, ["question", "response_id"], "left")


def _placed(points: DataFrame, blocks: Blocks, edges: DataFrame) -> DataFrame:
    """Rows with their group, their edges as arrays, and a start: null in a question of one group."""
    own = F.sort_array(F.collect_list(F.struct("neighbour_id", "weight")))
    lists = edges.groupBy("question", "response_id").agg(own.alias("_e"))
    lists = lists.select(
        "question", "response_id",
        F.col("_e.neighbour_id").alias("neighbours"), F.col("_e.weight").alias("weights"),
    )
    rows = blocks.rows.select("question", "response_id", "cell", "sub")
    nothing = lambda column: F.coalesce(column, F.array().cast(lists.schema[column].dataType)).alias(column)
    grouped = rows.join(lists, ["question", "response_id"], "left").select(
        "question", "response_id", "cell", "sub", nothing("neighbours"), nothing("weights")
    )
    unset = F.lit(None).cast("double")
    if blocks.single:
        return cut(grouped.select("*", unset.alias("x"), unset.alias("y")))
    grouped = cut(grouped)
    ends = rows.select("question", F.col("response_id").alias("neighbour_id"), F.col("cell").alias("other"))
    links = cut(
        grouped.select("question", "response_id", "cell", F.inline(F.arrays_zip("neighbours", "weights")))
        .withColumnsRenamed({"neighbours": "neighbour_id", "weights": "weight"})
        .join(ends, ["question", "neighbour_id"])
    )
    # At most `max_pivots` cells in a question.
    graph = links.groupBy("question", "cell", "other").agg(F.sum("weight").alias("weight"))
    middles = F.broadcast(graph.groupBy("question").applyInPandas(_cell_places, "question string, other int, cx double, cy double"))
    start = (
        links.join(middles, ["question", "other"])
        .groupBy("question", "response_id")
        .agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(to) for c, to in (("cx", "x"), ("cy", "y"))])
    )
    # A little apart, by the first two scores.
    score = lambda i: F.coalesce(F.get("embedding", F.lit(i)), F.lit(0.0))
    span = F.broadcast(points.groupBy("question").agg(F.max(F.greatest(F.abs(score(0)), F.abs(score(1)))).alias("_span")))
    scale = F.when(F.col("_span") > 0, SPAN / 20 / F.col("_span")).otherwise(0.0)
    apart = points.join(span, "question").select(
        "question", "response_id", (score(0) * scale).alias("_dx"), (score(1) * scale).alias("_dy")
    )
    place = lambda c, d: (F.coalesce(c, F.lit(0.0)) + F.col(d)).alias(c)
    return cut(
        grouped.join(start, ["question", "response_id"], "left")
        .join(apart, ["question", "response_id"])
        .select(*grouped.columns, place("x", "_dx"), place("y", "_dy"))
    )


def _seen(at: DataFrame) -> DataFrame:
    """`question, cell, sub, response_id`: the rows that a group holds beside its own."""
    # Groups of a question times the rows that all of them see.
    groups = at.select("question", "cell", "sub").distinct()
    share = at.groupBy("question").agg(F.greatest(F.lit(1), F.floor(F.count("*") / FAR_ROWS)).alias("_share"))
    far = (
        at.select("question", "response_id")
        .join(F.broadcast(share), "question")
        .where(F.pmod(F.xxhash64("response_id", F.lit(1)), F.col("_share")) == 0)
    )
    border = at.select("question", "cell", "sub", F.explode("neighbours").alias("response_id"))
    wanted = border.unionByName(far.join(groups, "question").select(*border.columns)).distinct()
    return wanted.join(at.select(*border.columns), border.columns, "left_anti")


def _moved(at: DataFrame, seen: DataFrame | None, start: int, end: int, epochs: int, seed: int) -> DataFrame:
    """Positions after epochs `start` to `end`, each group on its own."""
    schema = at.schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["neighbours"].notna()].sort_values("response_id")
        rest = frame[frame["neighbours"].isna()].sort_values("response_id")
        if not len(own):
            return own
        index = pd.Index(pd.concat([own["response_id"], rest["response_id"]]))
        counts = own["neighbours"].str.len().to_numpy()
        tail = index.get_indexer(np.concatenate(own["neighbours"].to_list()))
        weight = np.concatenate(own["weights"].to_list()).astype(float)
        head = np.repeat(np.arange(len(own)), counts)
        rank = np.arange(len(head)) - np.repeat(np.cumsum(counts) - counts, counts)
        plane = np.concatenate([own[["x", "y"]], rest[["x", "y"]]]).astype(float)
        if np.isnan(plane).any():
            plane = spectral(len(own), head, tail, weight) * SPAN
        key = f"{seed} {start} {own['question'].iloc[0]} {own['cell'].iloc[0]} {own['sub'].iloc[0]}"
        random = np.random.default_rng(zlib.crc32(key.encode()))
        _epochs(plane, len(own), head, tail, weight, rank, start, end, epochs, random)
        return own.assign(x=plane[: len(own), 0], y=plane[: len(own), 1])

    rows = at
    if seen is not None:
        nothing = [F.lit(None).cast(schema[c].dataType).alias(c) for c in ("neighbours", "weights")]
        others = seen.join(at.select("question", "response_id", "x", "y"), ["question", "response_id"])
        rows = at.unionByName(others.select("question", "response_id", "cell", "sub", *nothing, "x", "y"))
    return rows.groupBy("question", "cell", "sub").applyInPandas(run, schema)


def _cell_places(graph: pd.DataFrame) -> pd.DataFrame:
    """Places of the cells of a question, from the weights between them."""
    cells = np.unique(np.concatenate([graph["cell"], graph["other"]]))
    head, tail = np.searchsorted(cells, graph["cell"]), np.searchsorted(cells, graph["other"])
    plane = spectral(len(cells), head, tail, graph["weight"].to_numpy()) * SPAN
    return pd.DataFrame({"question": graph["question"].iloc[0], "other": cells.astype(np.int32), "cx": plane[:, 0], "cy": plane[:, 1]})


def spectral(n: int, head: np.ndarray, tail: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The two leading nontrivial eigenvectors of the normalised weights, within [-1, 1].

    By orthogonal iteration on the lazy walk, whose eigenvalues are not negative; edges out of the `n` rows are left out.
    """
    inside = tail < n
    head, tail, weight = head[inside], tail[inside], weight[inside]
    degree = np.bincount(head, weight, n) + np.bincount(tail, weight, n)
    root = np.sqrt(np.maximum(degree, 1e-12))
    scaled = weight / (root[head] * root[tail])
    vectors = np.concatenate([root[:, None], np.random.default_rng(0).normal(size=(n, 3))], axis=1)[:, : max(1, min(4, n))]
    for _ in range(rounds):
        vectors = np.linalg.qr(vectors)[0]
        walked = np.empty_like(vectors)
        for c in range(vectors.shape[1]):
            v = vectors[:, c]
            walked[:, c] = np.bincount(head, scaled * v[tail], n) + np.bincount(tail, scaled * v[head], n)
        vectors = (vectors + walked) / 2
    out = np.zeros((n, 2))
    found = (vectors / root[:, None])[:, 1:3]
    found = found / np.maximum(np.abs(found).max(axis=0, initial=0), 1e-12)
    out[:, : found.shape[1]] = found
    # Rows that coincide would never part.
    return out + np.random.default_rng(1).normal(scale=1e-3, size=out.shape)


def _epochs(plane, own, head, tail, weight, rank, start, end, epochs, random) -> None:
    """Epochs `start` to `end` of `epochs`, in place; only the first `own` rows move.

    An edge takes part in an epoch with a probability in proportion to its weight, and edges of one rank
    at a time, so that a row goes one step along its own edges before it looks again.
    """
    if not len(head):
        return
    chance = weight / weight.max()
    by_rank = [np.flatnonzero(rank == r) for r in range(rank.max() + 1)]
    for epoch in range(start, end):
        rate = 1.0 - epoch / epochs
        for edges in by_rank:
            picked = edges[random.random(len(edges)) < chance[edges]]
            i, j = head[picked], tail[picked]
            gap = plane[i] - plane[j]
            d2 = (gap * gap).sum(axis=1)
            near = np.maximum(d2, 1e-12)
            pull = np.where(d2 > 0, -2 * CURVE_A * CURVE_B * near ** (CURVE_B - 1) / (1 + CURVE_A * near**CURVE_B), 0.0)
            step = rate * np.clip(pull[:, None] * gap, -STEP_LIMIT, STEP_LIMIT)
            inner = j < own
            for axis in (0, 1):
                plane[:own, axis] += np.bincount(i, step[:, axis], own)
                # Many rows can list one; together they pull it no farther than one of them can.
                pulled = np.bincount(j[inner], step[inner, axis], own)
                plane[:own, axis] -= np.clip(pulled, -STEP_LIMIT * rate, STEP_LIMIT * rate)
            others = random.integers(0, len(plane), (len(i), REPELLERS))
            gap = plane[i][:, None] - plane[others]
            d2 = (gap * gap).sum(axis=2)
            push = np.where(others == i[:, None], 0.0, 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * d2**CURVE_B)))
            step = rate * np.clip(push[:, :, None] * gap, -STEP_LIMIT, STEP_LIMIT).sum(axis=1)
            step = np.clip(step, -STEP_LIMIT * rate, STEP_LIMIT * rate)
            for axis in (0, 1):
                plane[:own, axis] += np.bincount(i, step[:, axis], own)
