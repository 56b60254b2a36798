"""Exact Euclidean neighbours within a question, without all pairs.

The vectors of a question are assigned to the nearest of a few pivots. A pivot's
cell is cut into blocks of bounded size by hash, so a cell that holds many
copies of one vector is no hot task. Distances are computed block against block
inside tasks; by the triangle inequality most pairs of blocks are never formed, and
only the nearest rows leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from commentloom.operators.vectors import id_type
from commentloom.runtime import cut

# Relative slack of pruning bounds against rounding.
SLACK = 1e-9


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows as a column-major matrix."""
    return np.asfortranarray(np.vstack(vectors.to_list()), dtype=np.float64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows of `x` and of `y`.

    Summed one dimension after the other, so that d(a, b) and d(b, a) are
    the same double wherever they are computed, and equal rows are at 0.
    """
    total = np.zeros((x.shape[0], y.shape[0]))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def screens(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small floats whose product is, for each row of `x` and of `y`, no more than `limits` of their distance.

    The squares are made smaller by more than the product may be wrong by. Where numbers are too large
    for small floats, the product is 0 and so screens nothing out.
    """
    centre = y.mean(axis=0) if len(y) else 0.0
    x, y = x - centre, y - centre
    x_square, y_square = (x**2).sum(axis=1), (y**2).sum(axis=1)
    less = 1 - 2.0**-21 * (x.shape[1] + 8)
    left = np.column_stack([-2 * x, less * x_square, np.ones(len(x))]).astype(np.float32)
    right = np.vstack([y.T, np.ones(len(y)), less * y_square]).astype(np.float32)
    if not max(x_square.max(initial=0.0), y_square.max(initial=0.0)) < 1e30:
        left, right = np.zeros_like(left), np.zeros_like(right)
    return left, right


def limits(distance: np.ndarray) -> np.ndarray:
    """Squares of distances as small floats, none of them smaller than the square."""
    with np.errstate(over="ignore"):
        return (np.maximum(distance, 0.0) ** 2 * (1 + 1e-6) + 1e-30).astype(np.float32)


def pair_distances(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances from the rows `i` of `x` to the rows `j` of `y`, summed as in `distances`."""
    total = np.zeros(len(i))
    for at in range(0, len(i), 8192):
        some = slice(at, at + 8192)
        gaps = x[i[some]] - y[j[some]]
        gaps *= gaps
        for d in range(x.shape[1]):
            total[some] += gaps[:, d]
    return np.sqrt(total)


@dataclass
class Blocks:
    """`rows`: question, response_id, embedding, cell, reach, sub, with other columns kept.
    `cells`: question, cell, n, n_sub, radius. At most `max_pivots` cells per question.
    """

    rows: DataFrame
    cells: DataFrame
    pivots: dict[str, np.ndarray]
    single: bool


def build_blocks(df: DataFrame, block_rows: int = 2048, max_pivots: int = 256) -> Blocks:
    """Assign cells and blocks. `df` should be materialised; it is read a few times."""
    counts = {r["question"]: r["count"] for r in df.groupBy("question").count().collect()}
    if all(n <= block_rows for n in counts.values()):
        rows = df.select(
            "*", F.lit(0).alias("cell"), F.lit(0.0).alias("reach"), F.lit(0).alias("sub")
        )
        return Blocks(rows, _cells(rows, block_rows), {}, True)

    wanted = {q: min(max_pivots, -(-n // block_rows)) for q, n in counts.items()}
    by_hash = Window.partitionBy("question").orderBy(F.xxhash64("response_id"), "response_id")
    # The ids are picked first: at most `max_pivots` rows per question meet the vectors.
    picked = df.select("question", "response_id", F.row_number().over(by_hash).alias("_r")).where(
        F.col("_r") <= max(wanted.values())
    )
    sample = df.join(F.broadcast(picked), ["question", "response_id"]).orderBy("question", "_r").collect()
    found: dict[str, list] = {}
    for row in sample:
        if row["_r"] <= wanted[row["question"]]:
            found.setdefault(row["question"], []).append(row["embedding"])
    pivots = {q: np.unique(np.asarray(v, dtype=np.float64), axis=0) for q, v in found.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), dtype=np.int32)
            reach = np.zeros(len(batch))
            for q, at in batch.groupby("question").indices.items():
                for part in np.array_split(at, -(-len(at) // 512)):
                    d = distances(matrix(batch["embedding"].iloc[part]), pivots[q])
                    cell[part] = d.argmin(axis=1)
                    reach[part] = d.min(axis=1)
            yield batch.assign(cell=cell, reach=reach)

    schema = f"{df._jdf.schema().toDDL()}, cell int, reach double"
    placed = cut(df.mapInPandas(nearest, schema))
    cells = cut(_cells(placed, block_rows))
    parts = cells.select("question", "cell", "n_sub")
    rows = (
        placed.join(F.broadcast(parts), ["question", "cell"])
        .withColumn("sub", F.pmod(F.xxhash64("response_id"), F.col("n_sub")).cast("int"))
        .drop("n_sub")
    )
    return Blocks(rows, cells, pivots, False)


def _cells(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.groupBy("question", "cell").agg(
        F.count("*").alias("n"),
        F.ceil(F.count("*") / block_rows).cast("int").alias("n_sub"),
        F.max("reach").alias("radius"),
    )


def block_pairs(cell_pairs: DataFrame, ordered: bool) -> DataFrame:
    """Pairs of different blocks from pairs of cells `question, a, b, n_sub_a, n_sub_b`.

    Without `ordered`, each unordered pair comes once, its lower block first.
    """
    pairs = (
        cell_pairs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub_a") - 1)))
        .withColumn("other_sub", F.explode(F.sequence(F.lit(0), F.col("n_sub_b") - 1)))
        .select("question", F.col("a").alias("cell"), "sub", F.col("b").alias("other_cell"), "other_sub")
    )
    mine, theirs = F.struct("cell", "sub"), F.struct("other_cell", "other_sub")
    return pairs.where(mine != theirs if ordered else mine < theirs)


# Rows that a task on pairs of blocks holds on either side, about.
SIDE_ROWS = 131_072
# Rows on either side for which a task is worth its overhead, and that a call on the right of a block takes at a time.
PIECE_ROWS = 8192
# Copies of all rows that a round of tasks may have on both sides, about.
ROUND_COPIES = 4


def _dealt(rows: DataFrame, pairs: DataFrame, side_rows: int, either: bool) -> DataFrame:
    """The pairs with their task `row_side, column_side` and its round, see `grid` and `on_sides`."""
    sizes = rows.groupBy("question", "cell", "sub").count().groupBy("question").agg(
        F.greatest(
            F.least(F.ceil(F.sqrt(F.count("*"))), F.ceil(F.sum("count") / PIECE_ROWS)), F.ceil(F.sum("count") / side_rows)
        ).cast("int").alias("_sides"),
        F.sum("count").alias("_n"),
    )
    # One row for each question. Copies of a question: each row for each super-block that its own one meets, on both sides.
    copies = F.col("_n") * (F.col("_sides") + 1 if either else 2 * F.col("_sides"))
    whole, before = Window.partitionBy(), Window.orderBy("question").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum(copies).over(before), F.lit(0)), "_most": ROUND_COPIES * F.sum("_n").over(whole)})
    number = lambda cell, sub: F.pmod(F.xxhash64(cell, sub), F.col("_sides")).cast("int")
    dealt = pairs.join(F.broadcast(sizes), "question").withColumns(
        {"row_side": number("cell", "sub"), "column_side": number("other_cell", "other_sub")}
    )
    row = F.col("row_side")
    if either:
        ends = {"cell": "other_cell", "sub": "other_sub", "row_side": "column_side"}
        ends |= {b: a for a, b in ends.items()}
        over = row > F.col("column_side")
        dealt = dealt.select(
            *[F.when(over, F.col(ends[c])).otherwise(F.col(c)).alias(c) if c in ends else F.col(c) for c in dealt.columns]
        )
        held = 2 * F.col("_n") / F.col("_sides") * (F.col("_sides") * row - row * (row - 1) / 2)
    else:
        held = 2 * F.col("_n") * row
    return cut(
        dealt.withColumn("_round", F.floor((F.col("_before") + held) / F.col("_most")).cast("int")).drop("_sides", "_n", "_before", "_most")
    )


def grid(rows: DataFrame, pairs: DataFrame, side_rows: int = SIDE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of a grid of tasks over the pairs of blocks; `row_side, column_side` is a task.

    The blocks of a question are dealt to super-blocks: as many as the root of their number, fewer where these would
    hold less than `PIECE_ROWS` rows, or more where one would hold more than about `side_rows` rows. A task has those on
    its left and right that its pairs name, so that a row is copied at most once for each super-block on either
    side, and not for each block it meets, however small the blocks are.
    The left side also has the pairs themselves: a row for each of its blocks, with those it `meets`.
    """
    return _filled(rows, _dealt(rows, pairs, side_rows, False).drop("_round"))


def _block(cell, sub):
    """One number for a block, of columns or of arrays."""
    if isinstance(cell, str):
        return F.shiftleft(F.col(cell).cast("long"), 32) + F.col(sub)
    return cell.to_numpy(np.int64) << 32 | sub.to_numpy(np.int64)


def _filled(rows: DataFrame, dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    task = ["row_side", "column_side"]
    wanted = dealt.select("question", "cell", "sub", *task).distinct()
    # New names, as both sides come from the same tables.
    wanted_right = dealt.select(
        "question", F.col("other_cell").alias("cell"), F.col("other_sub").alias("sub"), *[F.col(c).alias(c) for c in task]
    ).distinct()
    # One row for each block of a task, and not for each pair.
    meets = dealt.groupBy("question", "cell", "sub", *task).agg(F.collect_list(_block("other_cell", "other_sub")).alias("meets"))
    left = rows.join(wanted, ["question", "cell", "sub"]).unionByName(meets, allowMissingColumns=True)
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns]).join(wanted_right, ["question", "cell", "sub"])
    return left, right


def on_sides(rows: DataFrame, pairs: DataFrame, function, schema: str, side_rows: int = SIDE_ROWS, either: bool = False, fold=None) -> DataFrame:
    """Apply `function(left, right, named)` to the two sides of each task of the grid.

    `named` has for each block on the left its rows' places there and, for each block it meets, the places on the right.
    With `either` a pair may be turned over, so that two super-blocks meet in one task and rows have half as many copies.

    Copies grow with the root of the number of blocks. So the tasks are run in rounds of a few copies of all rows, and the shuffle files of a
    round are deleted before the next one: they grow with the rows only. All tasks of a super-block on the left are in one
    round, and `fold` may reduce what they found before it is written.
    """
    dealt = _dealt(rows, pairs, side_rows, either)
    rounds = (dealt.agg(F.max("_round")).first()[0] or 0) + 1
    if rounds == 1:
        return _met(rows, dealt.drop("_round"), function, schema)
    found = [_met(rows, dealt.where(F.col("_round") == r).drop("_round"), function, schema) for r in range(rounds)]
    return reduce(DataFrame.unionByName, [cut(fold(some) if fold else some) for some in found])


def _met(rows: DataFrame, dealt: DataFrame, function, schema: str) -> DataFrame:
    left, right = _filled(rows, dealt)

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        a_list = mine["meets"].notna()
        held, theirs, lists = mine[~a_list].reset_index(drop=True), theirs.reset_index(drop=True), mine[a_list]
        own, others = (pd.Series(_block(side["cell"], side["sub"])).groupby(_block(side["cell"], side["sub"])).indices for side in (held, theirs))
        listed = zip(_block(lists["cell"], lists["sub"]).tolist(), lists["meets"])
        named = [(own[block], [others[b] for b in sorted(np.asarray(met).tolist())]) for block, met in sorted(listed, key=lambda pair: pair[0])]
        return function(held, theirs, named)

    keys = ["question", "row_side", "column_side"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def lots(places: list[np.ndarray], most: int = PIECE_ROWS) -> Iterator[np.ndarray]:
    """The places of several blocks put together, about `most` at a time; no block is cut."""
    held, n = [], 0
    for at in places:
        if held and n + len(at) > most:
            yield np.concatenate(held)
            held, n = [], 0
        held.append(at)
        n += len(at)
    if held:
        yield np.concatenate(held)


def on_pairs(rows: DataFrame, pairs: DataFrame, function, schema: str, merge=None, side_rows: int = SIDE_ROWS) -> DataFrame:
    """Apply `function(left, right)` to each block and those it meets, small ones together, many in a task call.

    `merge` may fold what a left block has from all of its pairs there.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame, named: list) -> pd.DataFrame:
        out = []
        for at, others in named:
            found, block = None, left.iloc[at]
            for lot in lots(others):
                more = function(block, right.iloc[lot])
                found = more if found is None else pd.concat([found, more], ignore_index=True)
                found = merge(found) if merge else found
            out.append(found)
        return pd.concat(out, ignore_index=True)

    return on_sides(rows, pairs, run, schema, side_rows)


def distinct_points(df: DataFrame) -> DataFrame:
    """`question, response_id, embedding, copies`: equal vectors once, under their smallest id.

    Partial aggregation folds a large group of copies before the shuffle.
    """
    return df.groupBy("question", "embedding").agg(
        F.min("response_id").alias("response_id"), F.count("*").alias("copies")
    )


def with_point(df: DataFrame, points: DataFrame) -> DataFrame:
    """`question, response_id, point_id`: the distinct point that stands for each row."""
    keyed = points.select(
        "question", F.col("response_id").alias("point_id"), "embedding", F.xxhash64("embedding").alias("_h")
    )
    rows = df.withColumn("_h", F.xxhash64("embedding"))
    return rows.join(keyed, ["question", "_h", "embedding"]).select("question", "response_id", "point_id")


def knn(df: DataFrame, k: int, block_rows: int = 16_384, max_pivots: int = 256) -> DataFrame:
    """`question, response_id, rank, neighbour_id, distance`: the `k` nearest other rows.

    Exact. Equal distances are ranked by neighbour id. Distances are computed
    between distinct vectors only, so many copies of one vector cost no more than one.
    """
    rows = cut(df.select("question", "response_id", "embedding"))
    points = cut(distinct_points(rows))
    blocks = build_blocks(points, block_rows, max_pivots)
    return expand_copies(rows, points, nearest_neighbours(blocks, k), k)


def expand_copies(rows: DataFrame, points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of rows from neighbours of distinct points."""
    if points.where(F.col("copies") > 1).isEmpty():
        return near
    members = cut(with_point(rows, points))
    # No row needs more than the first k + 1 members of any point.
    by_id = Window.partitionBy("question", "point_id").orderBy("response_id")
    first = (
        members.withColumn("_r", F.row_number().over(by_id))
        .where(F.col("_r") <= k + 1)
        .select("question", "point_id", F.col("response_id").alias("member_id"))
    )
    near_points = near.select(
        "question", F.col("response_id").alias("of"), F.col("neighbour_id").alias("point_id"), "distance"
    )
    own = first.select("question", F.col("point_id").alias("of"), F.lit(0.0).alias("distance"), "member_id")
    listed = near_points.join(first, ["question", "point_id"]).select(*own.columns).unionByName(own)
    best = listed.groupBy("question", F.col("of").alias("point_id")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "member_id"))), 1, k + 1).alias("_near")
    )
    others = F.filter("_near", lambda n: n["member_id"] != F.col("response_id"))
    return (
        members.join(best, ["question", "point_id"])
        .select("question", "response_id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_n"))
        .select(
            "question",
            "response_id",
            (F.col("_at") + 1).alias("rank"),
            F.col("_n.member_id").alias("neighbour_id"),
            F.col("_n.distance").alias("distance"),
        )
    )


# Share of the rows met beyond which the nearest are found among all of them, and not by distances of those that the screen leaves.
MANY = 1 / 32
# Rows met at a time, after which the bounds are the nearest ones so far.
SCREEN_ROWS = 2048


def nearest_neighbours(blocks: Blocks, k: int) -> DataFrame:
    ids = id_type(blocks.rows)
    schema = (
        f"question string, response_id {ids}, cell int, neighbour_id {ids}, distance double, bound double"
    )

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        return _top(rows, rows, k)

    def between(left: pd.DataFrame, right: pd.DataFrame, named: list) -> pd.DataFrame:
        return _top_between(left, right, named, k)

    rows = blocks.rows.select("question", "response_id", "embedding", "cell", "sub")
    near = rows.groupBy("question", "cell", "sub").applyInPandas(own, schema)
    if not blocks.single:
        near = cut(near)
        # A cell's bound: no row in it needs a neighbour farther away than this.
        bounds = near.groupBy("question", "cell").agg(F.max("bound").alias("bound"))
        pivots = blocks.pivots

        def needed(cells: pd.DataFrame) -> pd.DataFrame:
            q = cells["question"].iloc[0]
            c = cells["cell"].to_numpy()
            apart = distances(np.asfortranarray(pivots[q][c]), np.asfortranarray(pivots[q][c]))
            radius, bound = cells["radius"].to_numpy(), cells["bound"].to_numpy()
            lower = apart - radius[:, None] - radius[None, :]
            a, b = np.nonzero(lower <= bound[:, None] + SLACK * (1 + apart))
            subs = cells["n_sub"].to_numpy()
            return pd.DataFrame(
                {"question": q, "a": c[a], "b": c[b], "n_sub_a": subs[a], "n_sub_b": subs[b]}
            )

        cell_pairs = (
            blocks.cells.join(bounds, ["question", "cell"])
            .groupBy("question")
            .applyInPandas(needed, "question string, a int, b int, n_sub_a int, n_sub_b int")
        )
        pairs = cut(block_pairs(cell_pairs, ordered=True))

        own_bounds = near.groupBy("question", "response_id").agg(F.max("bound").alias("bound"))
        bounded = cut(rows.join(own_bounds, ["question", "response_id"], "left"))
        near = near.unionByName(on_sides(bounded, pairs, between, schema, fold=lambda found: _ranked(found, k).drop("rank")))
    return _ranked(near, k).select("question", "response_id", "rank", "neighbour_id", "distance")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row, with their `rank`."""
    order = Window.partitionBy("question", "response_id").orderBy("distance", "neighbour_id")
    return near.where(F.col("neighbour_id").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of `y` and their distances, without those marked `own`.

    A matrix product screens; the few rows it leaves get exact distances. Where
    its rounding could hide a nearer row, all distances of that row are computed.
    """
    squares_x, squares_y = (x**2).sum(axis=1), (y**2).sum(axis=1)
    rough = squares_x[:, None] + squares_y[None, :] - 2 * (x @ y.T)
    rough[own] = np.inf
    most = min(k + 8, len(y))
    # In order of the ids, so that a stable sort gives ties to the smaller one.
    seen = np.sort(np.argpartition(rough, most - 1, axis=1)[:, :most], axis=1)
    total = np.zeros(seen.shape)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[seen, j]
        total += gap * gap
    exact = np.where(np.take_along_axis(own, seen, axis=1), np.inf, np.sqrt(total))
    order = np.argsort(exact, axis=1, kind="stable")[:, :k]
    picked, value = np.take_along_axis(seen, order, axis=1), np.take_along_axis(exact, order, axis=1)
    if most < len(y):
        slack = 1e-13 * x.shape[1] * (squares_x.max() + squares_y.max())
        unsure = np.flatnonzero(value[:, -1] ** 2 + slack >= np.take_along_axis(rough, seen, axis=1).max(axis=1) - slack)
        if len(unsure):
            d = distances(x[unsure], y)
            d[own[unsure]] = np.inf
            picked[unsure] = np.argsort(d, axis=1, kind="stable")[:, : picked.shape[1]]
            value[unsure] = np.take_along_axis(d, picked[unsure], axis=1)
    return picked, value


def _top_between(left: pd.DataFrame, right: pd.DataFrame, named: list, k: int) -> pd.DataFrame:
    """The k nearest rows for each row on the left, among those of the blocks it meets and no farther than its `bound`.

    A product of small floats leaves the rows that may be nearer than the k-th one so far; only these get distances.
    """
    # In order of the ids, so that of equal distances the smaller place has the smaller id.
    rank = np.empty(len(right), np.int64)
    rank[right["response_id"].argsort(kind="stable")] = np.arange(len(right))
    mine, other = left["response_id"].to_numpy(), right["response_id"].to_numpy()
    x, y = np.vstack(left["embedding"].to_list()), np.vstack(right["embedding"].to_list())
    x_screen, y_screen = screens(x, y)
    # Without a bound, any row may be one of the nearest.
    given = left["bound"].fillna(np.inf).to_numpy(dtype=float)
    frames = []
    for block, others in named:
        value, picked = np.full((len(block), k), np.inf), np.full((len(block), k), -1)
        for lot in lots(others, SCREEN_ROWS):
            y_part = y_screen[:, lot]
            for start in range(0, len(block), 256):
                rows = slice(start, start + 256)
                part = block[rows]
                bound = np.minimum(given[part], value[rows, -1])
                at = np.flatnonzero(x_screen[part] @ y_part <= limits(bound)[:, None])
                i = at // len(lot)
                many = np.bincount(i, minlength=len(part)) > MANY * len(lot)
                if many.any():
                    at, i = at[~many[i]], i[~many[i]]
                j = lot[at % len(lot)]
                total = np.where(mine[part[i]] == other[j], np.inf, pair_distances(x, part[i], y, j))
                if many.any():
                    lot_in_order = lot[np.argsort(rank[lot])]
                    found, apart = _nearest(x[part[many]], y[lot_in_order], mine[part[many], None] == other[None, lot_in_order], k)
                    i = np.append(i, np.repeat(np.flatnonzero(many), found.shape[1]))
                    j, total = np.append(j, lot_in_order[found.ravel()]), np.append(total, apart.ravel())
                fit, held = np.isfinite(total), np.nonzero(picked[rows] >= 0)
                i = np.concatenate([held[0], i[fit]])
                j, total = np.append(picked[rows][held], j[fit]), np.append(value[rows][held], total[fit])
                order = np.lexsort((rank[j], total, i))
                i, j, total = i[order], j[order], total[order]
                at = np.arange(len(i)) - np.searchsorted(i, i)
                best = at < k
                value[rows][i[best], at[best]], picked[rows][i[best], at[best]] = total[best], j[best]
        i, at = np.nonzero(picked >= 0)
        frames.append(
            pd.DataFrame(
                {
                    "question": left["question"].iloc[0],
                    "response_id": mine[block[i]],
                    "cell": left["cell"].iloc[block[0]],
                    "neighbour_id": other[picked[i, at]],
                    "distance": value[i, at],
                    "bound": given[block[i]],
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def _top(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of `right` for each row of `left`, itself left out.

    `bound` is the k-th distance, infinite where fewer rows were seen. A row without any
    candidate keeps one line with a null neighbour, so that its bound is known.
    """
    right = right.sort_values("response_id")
    other = right["response_id"].to_numpy()
    mine = left["response_id"].to_numpy()
    frames = []
    y = matrix(right["embedding"]) if len(right) else None
    for start in range(0, len(left), 256):
        part = slice(start, start + 256)
        here = mine[part]
        if y is None:
            picked, value = np.zeros((len(here), 0), dtype=int), np.zeros((len(here), 0))
        else:
            picked, value = _nearest(matrix(left["embedding"].iloc[part]), y, here[:, None] == other[None, :], k)
        finite = np.isfinite(value)
        bound = np.where(finite.sum(axis=1) == k, np.max(value, axis=1, initial=0.0), np.inf)
        i, j = np.nonzero(finite)
        bare = np.nonzero(~finite.any(axis=1))[0]
        frames.append(
            pd.DataFrame(
                {
                    "response_id": np.concatenate([here[i], here[bare]]),
                    "neighbour_id": pd.Series(
                        list(other[picked[i, j]]) + [None] * len(bare),
                        dtype="Int64" if other.dtype.kind in "iu" else object,
                    ),
                    "distance": np.concatenate([value[i, j], np.full(len(bare), np.inf)]),
                    "bound": np.concatenate([bound[i], bound[bare]]),
                }
            )
        )
    out = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(
        columns=["response_id", "neighbour_id", "distance", "bound"]
    )
    out["question"] = left["question"].iloc[0] if len(left) else None
    out["cell"] = left["cell"].iloc[0] if len(left) else None
    return out[["question", "response_id", "cell", "neighbour_id", "distance", "bound"]]


def core_distances(neighbours: DataFrame, min_pts: int = 5) -> DataFrame:
    """`question, response_id, core`: distance to the (min_pts - 1)-th other row.

    Rows with fewer neighbours have the distance of the last one.
    """
    return (
        neighbours.where(F.col("rank") <= min_pts - 1)
        .groupBy("question", "response_id")
        .agg(F.max("distance").alias("core"))
    )


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Add `reachability = max(core_i, core_j, distance)` to neighbour edges."""
    theirs = core.select("question", F.col("response_id").alias("neighbour_id"), F.col("core").alias("_core"))
    return (
        edges.join(core, ["question", "response_id"])
        .join(theirs, ["question", "neighbour_id"])
        .withColumn("reachability", F.greatest("core", "_core", "distance"))
        .drop("core", "_core")
    )
