"""Centroid clustering over a vector-approximation file.

Vectors of integers are compressed to `BITS` bits a dimension: the number of the cell that a component
falls into. Cells are equally wide within `REACH` deviations of the dimension's mean; the outer ones end at its least and
greatest value. (Cells at quantiles leave most vectors open: the outer ones are too wide.) For given
centroids, lookup tables hold the least and the greatest squared gap between a centroid and each cell of each
dimension; their sums over a vector's cells are an interval that holds its distance to the centroid. A
centroid whose interval begins beyond the end of another one's is out, and a vector with one centroid left
is assigned by its cells alone. The full vector is fetched, by a join on the row's number, where
intervals overlap, and where a vector changes its cluster, as the sums of the clusters are kept from round to round
and only moved vectors change them. All numbers are integers and exact.

The first round and the last pass need every full vector (all sums, all distances) and read them beside the
cells, without a join. To the driver come sums per dimension and cluster only.

Vectors of another width, null ones, and those with a null, non-finite or huge component (beyond
±`MOST`, whose squares would not fit) take no part. Rows with a repeated id are rows like others; rows without an
id are assigned and never start as centroids. With fewer vectors than centroids, each is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from commentloom.llm.batches import arrow, columns, record
from commentloom.runtime import cut

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
BITS = 6
REACH = 3.2
MOST = 1 << 27
CHUNK = 1024


def whole_vectors(
    table: DataFrame, scale: int = SCALE, width: int = WIDTH, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, v) with integers floor(scale * x) of the rows that take part."""
    x = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * F.lit(float(scale)))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(MOST)))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == width) & F.forall("v", fits))
    return rows.select("id", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))


class Grid:
    """Cells of each dimension; `least` and `greatest` close a cell's range of integers."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int):
        self.bits = bits
        z = np.linspace(-REACH, REACH, (1 << bits) - 1)
        self.edges = np.round(mean[:, None] + deviation[:, None] * z).astype(np.int64)
        # A cell that no number falls into may be the wrong way round.
        self.least = np.concatenate([low[:, None], np.maximum(self.edges, low[:, None])], axis=1)
        self.greatest = np.concatenate([np.minimum(self.edges - 1, high[:, None]), high[:, None]], axis=1)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of each row, `bits` bits a dimension."""
        cells = np.empty(vectors.shape, np.uint8)
        for j in range(vectors.shape[1]):
            cells[:, j] = np.searchsorted(self.edges[j], vectors[:, j], side="right")
        spread = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(spread.reshape(len(cells), -1), axis=1)

    def unpacked(self, packed: np.ndarray, width: int) -> np.ndarray:
        spread = np.unpackbits(packed, axis=1, count=width * self.bits).reshape(len(packed), width, self.bits)
        return (spread * (1 << np.arange(self.bits - 1, -1, -1))).sum(axis=2)

    def gaps(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared gap of each centroid to each cell of each dimension."""
        c = centroids[:, :, None]
        under, over = self.least[None] - c, c - self.greatest[None]
        return np.maximum(np.maximum(under, over), 0) ** 2, np.maximum(np.abs(under), np.abs(over)) ** 2


def decided(grid: Grid, centroids: np.ndarray, packed: list[bytes], width: int) -> np.ndarray:
    """The cluster of each row where the intervals leave one, else -1."""
    out = np.full(len(packed), -1, np.int64)
    n = 1 << grid.bits
    least, greatest = (g.reshape(len(centroids), -1) for g in grid.gaps(centroids))
    for start in range(0, len(packed), CHUNK):
        rows = np.frombuffer(b"".join(packed[start : start + CHUNK]), np.uint8).reshape(-1, -(-width * grid.bits // 8))
        at = grid.unpacked(rows, width) + np.arange(width) * n
        low = np.stack([g[at].sum(axis=1) for g in least], axis=1)
        high = np.stack([g[at].sum(axis=1) for g in greatest], axis=1)
        open_ = low <= high.min(axis=1, keepdims=True)
        alone = open_.sum(axis=1) == 1
        out[start : start + CHUNK] = np.where(alone, open_.argmax(axis=1), -1)
    return out


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        out[:, c] = ((vectors - centroid) ** 2).sum(axis=1)
    return out


def _settled(cluster: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """`cluster` with the open rows assigned by exact distance, ties to the smaller number."""
    open_ = np.flatnonzero(cluster < 0)
    if len(open_):
        cluster = cluster.copy()
        cluster[open_] = distances(vectors[open_], centroids).argmin(axis=1)
    return cluster


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class Moves:
    """What changes the sums of the clusters: per cluster and dimension, `count` as dimension -1."""

    def __init__(self, k: int, width: int):
        self.sums, self.counts, self.fetched = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0

    def add(self, old: np.ndarray, new: np.ndarray, vectors: np.ndarray) -> None:
        self.fetched += len(new)
        moved = old != new
        for sign, where in ((1, new), (-1, old)):
            held = moved & (where >= 0)
            np.add.at(self.sums, where[held], sign * vectors[held])
            np.add.at(self.counts, where[held], sign)

    def rows(self) -> list[tuple]:
        c, j = np.nonzero(self.sums)
        out = list(zip(c.tolist(), j.tolist(), self.sums[c, j].tolist()))
        out += [(c, -1, n) for c, n in enumerate(self.counts.tolist()) if n]
        return out + [(0, -2, self.fetched)]


ROUND = "row long, cells binary, cluster int, dim int, total long"


@dataclass
class Clusters:
    """`rows` (id, cluster, distance), the centroids, and how many full vectors each round fetched."""

    rows: DataFrame
    centroids: list[list[int]]
    fetched: list[int]


def _grid(rows: DataFrame, width: int, bits: int) -> Grid | None:
    """Cells from each dimension's least and greatest value, mean and deviation."""
    schema = columns("dim int, n long, least long, greatest long, total double, squares double")
    made = arrow(schema)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            if not len(v):
                continue
            f = v.astype(float)
            new = [v.min(axis=0), v.max(axis=0), f.sum(axis=0), (f * f).sum(axis=0)]
            if held:
                new = [np.minimum(held[0], new[0]), np.maximum(held[1], new[1]), held[2] + new[2], held[3] + new[3]]
            held, n = new, n + len(v)
        if held:
            yield record(made, [list(range(width)), [n] * width, *[x.tolist() for x in held]])

    found = rows.select("v").mapInArrow(facts, schema).groupBy("dim").agg(
        F.sum("n"), F.min("least"), F.max("greatest"), F.sum("total"), F.sum("squares")
    ).orderBy("dim").collect()
    if not found:
        return None
    _, n, low, high, total, squares = (np.array(x) for x in zip(*found))
    mean = total / n
    return Grid(low, high, mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), bits)


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, width: int = WIDTH, seed: int = 1
) -> Clusters | None:
    """Clusters of `vectors` (id, v); None without a vector.

    Starts at the `k` vectors with the least sha256 of `seed:id`. A round assigns every vector
    to its nearest centroid (ties: smaller number) and replaces each centroid that has vectors by
    the floor of their mean. Distances are to the centroids of the last round.
    """
    plain = cut(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v"))
    grid = _grid(plain, width, bits)
    if grid is None:
        return None
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = plain.orderBy(by_hash.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in starts], np.int64)
    k = len(centroids)

    schema = columns(ROUND)
    made = arrow(schema)

    def decisions(rows: list, cells: list, clusters: list, totals: list[tuple]) -> pa.RecordBatch:
        n, m = len(rows), len(totals)
        c, j, t = zip(*totals) if totals else ((), (), ())
        return record(
            made,
            [[*rows, *[None] * m], [*cells, *[None] * m], [*clusters, *c], [*[None] * n, *j], [*[None] * n, *t]],
        )

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(k, width)
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("v"), width)
            cells = [p.tobytes() for p in grid.packed(v)]
            new = _settled(decided(grid, centroids, cells, width), v, centroids)
            moves.add(np.full(len(new), -1), new, v)
            yield decisions(batch.column("row").to_pylist(), cells, new.tolist(), [])
        yield decisions([], [], [], moves.rows())

    def update(found: DataFrame, sums: list[list[int]], counts: list[int]) -> int:
        """Take the moves over into sums and counts; the number of vectors fetched."""
        fetched = 0
        exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        for c, j, total in found.where("dim is not null").groupBy("cluster", "dim").agg(exact).collect():
            if j == -2:
                fetched += int(total)
            elif j == -1:
                counts[c] += int(total)
            else:
                sums[c][j] += int(total)
        return fetched

    sums, counts, fetched = [[0] * width for _ in range(k)], [0] * k, []
    state = None
    for _ in range(rounds):
        now = centroids
        if state is None:
            found = cut(plain.select("row", "v").mapInArrow(first_round, schema))
            state = found.where("dim is null").select("row", "cells", "cluster")
        else:
            bounds, exact = _round(now, grid, width, k, decisions, schema)
            seen = cut(state.mapInArrow(bounds, columns("row long, cells binary, old int, cluster int")))
            asked = seen.where("cluster <> old")
            found = cut(asked.join(plain.select("row", "v"), "row").mapInArrow(exact, schema))
            settled = seen.where("cluster = old").select("row", "cells", "cluster")
            state = cut(settled.unionByName(found.where("dim is null").select("row", "cells", "cluster")))
        fetched.append(update(found, sums, counts))
        centroids = np.array(
            [[s // counts[c] for s in sums[c]] if counts[c] else now[c].tolist() for c in range(k)], np.int64
        )
    return Clusters(_last(plain, grid, centroids, width), centroids.tolist(), fetched)


def _round(centroids: np.ndarray, grid: Grid, width: int, k: int, decisions, schema):
    """The two functions of a later round: by cells alone, and with the vectors that must be fetched."""
    made = arrow(columns("row long, cells binary, old int, cluster int"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = decided(grid, centroids, batch.column("cells").to_pylist(), width)
            yield record(made, [batch.column("row"), batch.column("cells"), batch.column("cluster"), new.tolist()])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(k, width)
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("v"), width)
            new = _settled(batch.column("cluster").to_numpy().astype(np.int64), v, centroids)
            moves.add(batch.column("old").to_numpy().astype(np.int64), new, v)
            yield decisions(batch.column("row").to_pylist(), batch.column("cells").to_pylist(), new.tolist(), [])
        yield decisions([], [], [], moves.rows())

    return bounds, exact


def _last(plain: DataFrame, grid: Grid, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, cluster, distance) under the last centroids."""
    schema = columns("id long, cluster int, distance long")
    made = arrow(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("v"), width)
            cells = [p.tobytes() for p in grid.packed(v)]
            new = _settled(decided(grid, centroids, cells, width), v, centroids)
            yield record(made, [batch.column("id"), new.tolist(), ((v - centroids[new]) ** 2).sum(axis=1).tolist()])

    return cut(plain.select("id", "v").mapInArrow(measure, schema))


REPORT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def report(vectors: DataFrame, **options) -> DataFrame:
    """Per vector its cluster, squared distance, the sums of both over the cluster and over all, and the centroid's digest."""
    spark = vectors.sparkSession
    found = cluster(vectors, **options)
    if found is None:
        return spark.createDataFrame([], REPORT)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(total).collect()}
    facts = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        for c, x in enumerate(found.centroids)
    ]
    clusters = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid.
    return found.rows.join(F.broadcast(clusters), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
