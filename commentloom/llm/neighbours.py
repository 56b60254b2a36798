"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are brought to one length by an extra coordinate (so that the largest inner product is the
least distance), rotated at random, and cut into groups of `dims` coordinates, one for each
ordering. Each ordering shifts its coordinates, quantises them and sorts all vectors by their
Hilbert index; Spark range-partitions the keys and numbers them. A query meets the blocks that its
window covers in each ordering: the share `window` of all vectors around its own place. Each block
hands on its best few, which are merged and ranked by exact inner products.

Equal vectors are searched once and expanded to their smallest ids, so a vector that a third of
all rows hold costs no more than another. Inner products are sums in index order in double
precision. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
rows with a null id; shorter vectors count as filled up with zeros. A row that repeats an id and
its vector counts once. Ties go to the smaller id, also where a whole block ties. Other columns are not
read, whatever their names.

On vectors without structure (independent directions, as in the given table) no ordering of few
coordinates says much about 64, and recall follows from the share of the vectors that is looked at:
the default looks at about two thirds for a recall above 0.9. On vectors with clusters or of few
effective dimensions far smaller windows do; `window` is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from commentloom.llm.batches import arrow, columns, record
from commentloom.runtime import cut, numbered

K = 20
ORDERINGS = 16
DIMS = 4
BITS = 10
WINDOW = 0.07
BLOCK = 1024
SEED = 7
#: Queries that meet a block in one task call.
ASKING = 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of non-negative integers below 2^bits.

    From the highest bit down, each coordinate's bit says which half the point is in; the rest
    of the curve is mirrored or turned accordingly. The index is the interleaved Gray code.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(d):
            upper = (x[i] >> bit) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            index = index << 1 | (x[i] >> bit) & 1
    return index


class Curves:
    """The orderings for vectors of one width, whose length is at most `longest`."""

    def __init__(self, width: int, longest: float, orderings: int, dims: int, bits: int, seed: int):
        random = np.random.default_rng(seed)
        self.width, self.longest, self.dims, self.bits = width, longest, dims, bits
        blocks = [
            np.linalg.qr(random.normal(size=(width + 1, width + 1)))[0]
            for _ in range(math.ceil(orderings * dims / (width + 1)))
        ]
        self.rotation = np.concatenate(blocks, axis=1)[:, : orderings * dims]
        self.shifts = random.uniform(0, 0.5, orderings * dims)

    def keys(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Keys of rows, one column for each ordering."""
        norms = np.sqrt((vectors**2).sum(axis=1))
        if query:
            rows = np.concatenate([vectors * (self.longest / norms)[:, None], np.zeros((len(vectors), 1))], axis=1)
        else:
            rows = np.concatenate([vectors, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))[:, None]], axis=1)
        # Coordinates of a random direction are within three deviations, as good as always.
        spread = 3 * self.longest / math.sqrt(self.width + 1)
        unit = np.clip(rows @ self.rotation / spread, -1, 1) / 4 + 0.25 + self.shifts
        cells = np.minimum((unit * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
        return np.stack([hilbert(cells[:, i : i + self.dims], self.bits) for i in range(0, cells.shape[1], self.dims)], axis=1)


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; v in double precision."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in index order; `rows` and `query` broadcast."""
    total = np.zeros(np.broadcast_shapes(rows.shape, query.shape)[:-1])
    for j in range(rows.shape[-1]):
        total += rows[..., j] * query[..., j]
    return total


def search(
    table: DataFrame,
    queries: DataFrame,
    k: int = K,
    orderings: int = ORDERINGS,
    dims: int = DIMS,
    bits: int = BITS,
    window: float = WINDOW,
    block: int = BLOCK,
    id_column: str = "vec_id",
    vector: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """The `k` nearest rows of `table` found for each row of `queries`, its own id left out.

    query_id, rank from 1, vec_id, score.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = usable(table, id_column, vector).distinct().withColumn("r", first).where(F.col("r") <= k + 1)
    held = cut(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "v", "ids"))
    asked = cut(usable(queries, id_column, vector).distinct())
    points = cut(asked.groupBy("v").agg(F.min("id").alias("vid")))
    facts = held.agg(
        F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ).first()
    n, width, longest = facts[0], max(facts[1] or 1, points.agg(F.max(F.size("v"))).first()[0] or 1), math.sqrt(facts[2] or 1.0)
    curves = Curves(width, longest, orderings, dims, bits, seed)
    rows_per_block = max(16, min(block, math.ceil(window * n / 2)))
    reach = math.ceil(window * n / 2 / rows_per_block)

    key_schema = columns("curve int, key long, vid long, asks boolean")
    arrow_key = arrow(key_schema)

    def keyed(query: bool):
        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 4096):
                    part = batch.slice(start, 4096)
                    keys = curves.keys(_matrix(part.column("v"), width), query)
                    vid = part.column("vid").to_numpy()
                    m = keys.shape[1]
                    yield record(arrow_key, [np.tile(np.arange(m), len(vid)), keys.reshape(-1), np.repeat(vid, m), [query] * (m * len(vid))])

        return compute

    places = held.select("vid", "v").mapInArrow(keyed(False), key_schema)
    places = places.unionByName(points.select("vid", "v").mapInArrow(keyed(True), key_schema))
    ranked = numbered(places, "curve", ["key", "vid", "asks"], "rank").withColumn(
        "block", F.expr(f"cast((rank - 1) div {rows_per_block} as int)")
    )
    at = ranked.groupBy("asks", "vid").agg(F.collect_list(F.struct("curve", "block")).alias("at"))  # one per ordering
    # A block's queries are dealt to parts of about `ASKING`, and each part has the block's rows.
    parts = max(1, math.ceil(points.count() * (2 * reach + 1) * rows_per_block / (max(1, n) * ASKING)))
    rows = (
        held.select("vid", "v")
        .join(at.where("not asks").select("vid", "at"), "vid")
        .select("vid", "v", F.inline("at"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    near = F.sequence(F.col("place.block") - reach, F.col("place.block") + reach)
    visits = (
        points.join(at.where("asks").select("vid", "at"), "vid")
        .select("vid", "v", F.explode("at").alias("place"))
        .select("vid", "v", F.col("place.curve").alias("curve"), F.explode(near).alias("block"))
        .withColumn("part", F.pmod(F.xxhash64("vid"), F.lit(parts)).cast("int"))
    )

    def best(there: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(asking):
            return pd.DataFrame([], columns=["q", "vids", "scores"], dtype=object)
        a, vids = _matrix(there["v"], width), there["vid"].to_numpy()
        longest_here = (a**2).sum(axis=1).max()
        out = []
        for start in range(0, len(asking), 256):
            part = asking.iloc[start : start + 256]
            q = _matrix(part["v"], width)
            rough = q @ a.T
            take = min(k + 1 + 8, len(vids))
            picked = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            score = inner(a[picked], q[:, None, :])
            order = np.lexsort((vids[picked], -score), axis=1)[:, : k + 1]
            chosen, best_scores = np.take_along_axis(picked, order, 1), np.take_along_axis(score, order, 1)
            # A row that was not taken has at most the least rough product taken. Where that could tie with
            # the last place, all rows of the block are ranked by their exact products.
            slack = 1e-13 * width * np.sqrt((q**2).sum(axis=1) * longest_here)
            unsure = np.flatnonzero(np.take_along_axis(rough, picked, 1).min(axis=1) + slack >= best_scores[:, -1])
            for i in unsure.tolist() if take < len(vids) else ():
                exact = inner(a, q[i])
                chosen[i] = np.lexsort((vids, -exact))[: k + 1]
                best_scores[i] = exact[chosen[i]]
            for query, c, s in zip(part["vid"], vids[chosen], best_scores):
                out.append((query, c.tolist(), s.tolist()))
        return pd.DataFrame(out, columns=["q", "vids", "scores"])

    merged_schema = "q long, vids array<long>, scores array<double>"
    dealt = ["curve", "block", "part"]
    found = rows.groupBy(*dealt).cogroup(visits.groupBy(*dealt)).applyInPandas(best, merged_schema)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        vids, scores = (np.concatenate(frame[c].to_list()) for c in ("vids", "scores"))
        vids, index = np.unique(vids, return_index=True)
        order = np.lexsort((vids, -scores[index]))[: k + 1]
        return pd.DataFrame([(frame["q"].iloc[0], vids[order].tolist(), scores[index][order].tolist())], columns=["q", "vids", "scores"])

    # A distinct vector stands for its smallest ids; the best k + 1 rows include the query's own.
    top = found.groupBy("q").applyInPandas(merge, merged_schema).select("q", F.inline(F.arrays_zip(F.col("vids").alias("vid"), F.col("scores").alias("score"))))
    full = top.join(held.select("vid", "ids"), "vid").select("q", "score", F.explode("ids").alias("vec_id"))
    per_query = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = full.withColumn("r", F.row_number().over(per_query)).where(F.col("r") <= k + 1)
    answers = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("answers"))
    final = (
        asked.select(F.col("id").alias("query_id"), "v")
        .join(points.select("v", F.col("vid").alias("q")), "v")
        .join(answers, "q")
        .select("query_id", F.filter("answers", lambda x: x["vec_id"] != F.col("query_id")).alias("own"))
        .select("query_id", F.posexplode(F.slice("own", 1, k)).alias("pos", "a"))
    )
    return final.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))
