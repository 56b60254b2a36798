"""Near copies by the Jaccard similarity of their word shingles, verified exactly.

A 64-bit SimHash cannot find these pairs: at similarity 0.8 a bit differs with probability 0.15, so two fingerprints
differ in about ten bits, and so wide a Hamming ball has no selective keys (a 32-bit segment is within one bit with probability
0.037: for a miss rate of 1 % 124 segments of 33 probes each, 4,092 keys a row). Candidates are therefore found by MinHash:
`BANDS` keys of `ROWS` minima each. A pair of similarity s shares none of them with probability
(1 - s^ROWS)^BANDS, 1.3e-7 at 0.8 and less above. Rows that share a key are joined to its least
row; the components of these links are groups that hold every pair in question.

Each row's shingle hashes are then sent once, to its group, and a small group compares all pairs. A large group is first
split by its rarest shingles: of two similar sets, put in order of how many rows of the group hold a shingle,
the first 1 - similarity of each have one in common. Pages of one template share their frequent shingles only, and so
fall apart. What is still a large group holds many similar rows. All its rows are measured against some of them in a round
(pivots), all groups at a time, part by part. Links join the rows to components, pivots are taken from outside of the
largest one, and a group is done when none are left there: pairs within a component need no comparison. So no similar pair is
lost, no task holds a large group, and a group of near copies takes a round or two whatever its size.

Words lie between ASCII white space, with A-Z lower-cased. A text of at most `shingle` words is one
shingle, also one without a word; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.llm.components import least_rows, members, numbered
from commentloom.runtime import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 5
SEED = 42
#: Rows and shingles of a group that one task compares.
MOST = 512
MOST_SHINGLES = 1 << 20
#: Pivots of a group in a round; together they have no more shingles than a task compares.
PIVOTS = 1024
NEAR = 1e-9
SLICE_BYTES = 1 << 19


def hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(words) - shingle + 1))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(odd) for odd in (1, 0))


def keys(found: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> list[int]:
    """The bands' keys of a set of hashes."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 2048):
        least = np.minimum(least, ((found[a : a + 2048] ^ masks) * factors).min(axis=1))
    data = least.tobytes()
    width = 8 * ROWS
    # The band is the seed, so that bands do not meet.
    out = [xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)]
    return np.array(out, np.uint64).view(np.int64)


def _similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / (a + b - shared)


class Group:
    """Sets laid end to end, to measure one set against all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.distinct, self.place = np.unique(np.concatenate(sets), return_inverse=True)
        self.seen = np.zeros(len(self.distinct), bool)

    def like(self, places: np.ndarray, size: int, first: int, similarity: float) -> np.ndarray:
        """Sets from `first` on that are similar to one of `size` members, `places` of which are known here."""
        self.seen[places] = True
        shared = np.add.reduceat(self.seen[self.place[self.starts[first] :]], self.starts[first:-1] - self.starts[first], dtype=np.int64)
        self.seen[places] = False
        return np.flatnonzero(_similar(shared, size, self.sizes[first:]) >= similarity - NEAR) + first


class Forest:
    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def settle(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Indices of links that join all similar sets, as a forest; all pairs are compared."""
    group, forest = Group(sets), Forest(len(sets))
    for i in range(len(sets) - 1):
        if len(forest.links) == len(sets) - 1:
            break
        own = group.place[group.starts[i] : group.starts[i + 1]]
        for j in group.like(own, len(own), i + 1, similarity).tolist():
            forest.join(i, j)
    return forest.links


def against(sets: list[np.ndarray], pivots: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (set, pivot) that join what the similar pairs of both lists join, as a forest."""
    group, forest = Group(sets), Forest(len(sets) + len(pivots))
    for p, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(group.distinct, pivot), len(group.distinct) - 1)
        for i in group.like(at[group.distinct[at] == pivot], len(pivot), 0, similarity).tolist():
            forest.join(i, len(sets) + p)
    return [(i, j - len(sets)) for i, j in forest.links]


def candidates(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, component) of the rows (row, t) that share a key with another, directly or by others."""
    out = columns("key long, row long")
    arrow_out = arrow(out)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, masks = _permutations()
        for batch in small(batches, "t", SLICE_BYTES):
            found = [keys(hashes(t.as_py() or "", shingle), factors, masks) for t in batch.column("t")]
            yield record(arrow_out, [np.concatenate(found), np.repeat(batch.column("row").to_numpy(), BANDS)])

    entered = cut(texts.select("row", "t").mapInArrow(sketch, out))
    least = entered.groupBy("key").agg(F.min("row").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = entered.join(least, "key").where("row <> v").select(F.col("row").alias("u"), "v").distinct()
    return cut(members(links))


SETS = columns("component long, row long, size long, found binary")


def _sizes(sets: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """(component, parts, large) of the components of more than one row; a part is what one task measures."""
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / most, F.col("m") / most_shingles)).cast("int")
    return cut(sizes.select("component", parts.alias("parts"), (parts > 1).alias("large")))


def split(sets: DataFrame, similarity: float) -> DataFrame:
    """`sets` with smaller components, none of which parts two similar sets; rows that are alone go.

    By prefixes: a row's shingles in order of their number of rows in the component. Those that only one row holds
    link nothing, but count in the prefix.
    """
    listed = columns("component long, row long, size long, shingle long")
    arrow_listed = arrow(listed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "found", SLICE_BYTES):
            sizes = batch.column("size").to_numpy()
            own = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("component", "row", "size")]
            yield record(arrow_listed, [*own, np.frombuffer(b"".join(batch.column("found").to_pylist()), np.int64)])

    entries = sets.select(*SETS.names).mapInArrow(each, listed)
    frequent = cut(entries.groupBy("component", "shingle").agg(F.count("*").alias("n"), F.min("row").alias("v")).where("n > 1"))
    shared = entries.join(frequent, ["component", "shingle"])
    by_row = shared.groupBy("component", "row", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "v"))).alias("found"))
    # Shingles of one row alone come first, so they use up places of the prefix.
    prefix = F.col("size") - F.ceil(F.col("size") * (similarity - NEAR)) + 1
    places = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("found"))).cast("int")
    links = by_row.select("row", F.explode(F.slice("found", 1, places)).alias("s")).select(F.col("row").alias("u"), F.col("s.v").alias("v"))
    # The least row that holds a shingle may hold it outside its own prefix: then it only joins more than it must.
    parts = members(links.where("u <> v").distinct())
    return sets.select("row", "size", "found").join(parts, "row").select(*SETS.names)


def verified(sets: DataFrame, similarity: float, most: int = MOST, most_shingles: int = MOST_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """Links (u, v) that join all similar rows of each component of (component, row, size, found)."""
    out = columns("u long, v long")
    arrow_out = arrow(out)

    def compare(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_pylist()
        found = settle([np.frombuffer(s.as_py(), np.uint64) for s in table.column("found")], similarity)
        return pa.table([[rows[i] for i, _ in found], [rows[j] for _, j in found]], schema=arrow_out)

    def measure(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        if not len(rows) or not len(chosen):
            return arrow_out.empty_table()
        names, others = rows.column("row").to_pylist(), chosen.column("row").to_pylist()
        found = against(*[[np.frombuffer(s.as_py(), np.uint64) for s in t.column("found")] for t in (rows, chosen)], similarity)
        # A row is its own pivot.
        found = [(names[i], others[j]) for i, j in found if names[i] != others[j]]
        return pa.table([[u for u, _ in found], [v for _, v in found]], schema=arrow_out)

    def small_groups(some: DataFrame, sizes: DataFrame) -> DataFrame:
        members = some.join(sizes.where("NOT large").select("component"), "component", "left_semi")
        return cut(members.groupBy("component").applyInArrow(compare, out))

    sizes = _sizes(sets, most, most_shingles)
    made = small_groups(sets, sizes)
    if sizes.where("large").isEmpty():
        return made
    parted = cut(split(sets.join(sizes.where("large").select("component"), "component", "left_semi"), similarity))
    sizes = _sizes(parted, most, most_shingles)
    made = made.unionByName(small_groups(parted, sizes))
    large = sizes.where("large").select("component", "parts")
    if large.isEmpty():
        return made
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    active = cut(parted.join(large, "component").withColumn("part", part))
    links = used = None
    while True:
        outside = active.select("component", "row", "size")
        if links is not None:
            outside = _outside(outside, links).join(used, "row", "left_anti")
        order = Window.partitionBy("component").orderBy(F.xxhash64("row"), "row")
        first = outside.withColumn("at", F.row_number().over(order)).where(F.col("at") <= pivots)
        within = (F.col("at") == 1) | (F.sum("size").over(order) <= most_shingles)
        chosen = cut(first.withColumn("within", within).where("within").select("component", "row"))
        if chosen.isEmpty():
            return made.unionByName(links)
        used = chosen.select("row") if used is None else used.unionByName(chosen.select("row"))
        # New names, as both sides come from one table.
        again = active.select(*[F.col(c).alias(c) for c in active.columns])
        held = again.join(chosen, ["component", "row"], "left_semi").select(
            "component", "row", "found", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        # Groups that are done are not measured again.
        rows = active.join(chosen.select("component").distinct(), "component", "left_semi")
        dealt = ["component", "part"]
        more = cut(rows.groupBy(*dealt).cogroup(held.groupBy(*dealt)).applyInArrow(measure, out))
        links = more if links is None else links.unionByName(more)


def _outside(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (component, row, size) that the links do not join to the largest set of their component."""
    joined = members(links).withColumnRenamed("component", "joined")
    labelled = cut(rows.join(joined, "row", "left").select(*rows.columns, F.coalesce("joined", "row").alias("joined")))
    sets = labelled.groupBy("component", "joined").agg(F.count("*").alias("n"))
    largest = sets.groupBy("component").agg(F.max_by("joined", F.struct("n", "joined")).alias("largest"))
    return labelled.join(largest, "component").where("joined <> largest").select(*rows.columns)


def groups(texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, **limits: int) -> DataFrame:
    """(row, component) of the rows (row, t) that are similar to another."""
    near = candidates(texts, shingle)
    arrow_out = arrow(SETS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", SLICE_BYTES):
            found = [hashes(t.as_py() or "", shingle) for t in batch.column("t")]
            yield record(arrow_out, [batch.column("component"), batch.column("row"), [len(s) for s in found], [s.tobytes() for s in found]])

    sets = cut(texts.join(near, "row").select("component", "row", "t").mapInArrow(collect, SETS))
    links = cut(verified(sets, similarity, **limits))
    return members(links)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, **limits: int) -> DataFrame:
    """One row of `docs` of each group of rows linked by similarity, with all columns: that with the smallest id."""
    rows = numbered(docs)
    found = groups(rows.select("row", F.col(f"c{docs.columns.index(text)}").alias("t")), similarity, shingle, **limits)
    return least_rows(rows, found, docs.columns, id_column)
