"""SimHash near duplicates by multi-index hashing.

A fingerprint has bit i set if more than half of the document's shingle hashes have it. Two
fingerprints that differ in at most `distance` bits differ in at most `distance // segments` bits
of some segment. Every fingerprint is entered in a table under each of its segments, and asks for
all keys in the Hamming ball of that radius around them; whoever meets under a key is verified by
the complete distance.

Fingerprints are folded to distinct ones before, so copies cost nothing. Under one key only a
forest of links is handed on, never all pairs. A key that more than `most` fingerprints share is
not compared in one task: they go on to narrower keys, which add a quarter of the bits that are
still free at a time (of at most three differing bits, some quarter has none), until the groups
are small, as they are when few bits are free. So no link is lost and no group grows with the data.

Null texts count as empty; texts without a word have fingerprint zero and link like any other.
Null ids take part and are never a component's id unless it has no other. Repeated rows are linked to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from commentloom.llm.batches import arrow, columns, record
from commentloom.llm.components import components, least_rows, numbered
from commentloom.runtime import cut

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 2
MOST = 2048


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text: words between ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    half = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, half, 1 << 15):
        b = min(half, a + (1 << 15))
        spans = zip(starts[a:b].tolist(), ends[a + shingle - 1 : b + shingle - 1].tolist())
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) of each row; the fingerprint as a signed long."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    out = columns("id long, fp long")
    arrow_out = arrow(out)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle, seed) for t in batch.column("t")], np.uint64)
            yield record(arrow_out, [batch.column("id"), found.view(np.int64)])

    return rows.mapInArrow(compute, out)


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Indices of links that join all of `values` within the distance, as a forest."""
    n = len(values)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance)
        for j in (near + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _quarters(mask: int) -> list[int]:
    """The mask with each quarter of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [_signed(mask | sum(1 << b for b in free[i::4])) for i in range(4)]


def _asked(flips: Column, mask: int, own: Column) -> Column:
    return F.transform(flips, lambda x: F.struct(F.lit(mask).alias("mask"), own.bitwiseOR(x).alias("key")))


def entries(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Keys of each fingerprint: (mask, key, fp).

    A pair needs one side to ask, so only keys that set a bit more are asked for.
    """
    bounds = [64 * i // segments for i in range(segments + 1)]
    balls = []
    if distance // segments > 1:
        raise ValueError("balls of more than one bit are not built: use more segments")
    for a, b in zip(bounds[:-1], bounds[1:]):
        mask = _signed(((1 << b) - 1) ^ ((1 << a) - 1))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        balls.append(F.array(F.struct(F.lit(mask).alias("mask"), own.alias("key"))))
        flips = [_signed(1 << i) for i in range(a, b)]
        if distance >= segments:
            asked = F.filter(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("fp").bitwiseAND(x) == 0)
            balls.append(_asked(asked, mask, own))
    return distinct.select("fp", F.inline(F.concat(*balls)))


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """A forest of links (a, b) between distinct fingerprints, by verified distance."""
    out = columns("a long, b long")
    arrow_out = arrow(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; groups are within the bound."""
        held: list[np.ndarray] = []
        for batch in [*batches, None]:
            if batch is not None:
                rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")], axis=1)
                rows = np.concatenate([*held, rows])
                ends = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
                whole = int(ends[-1]) if len(ends) else 0
                held, rows = [rows[whole:]], rows[:whole]
            else:
                rows = held[0] if held else np.zeros((0, 3), np.int64)
                held = []
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1, [len(rows)]])
            sizes = np.diff(starts)
            found = []
            for s, n in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                values = rows[s : s + n, 2].view(np.uint64) if rows.flags.c_contiguous else rows[s : s + n, 2].astype(np.uint64)
                found += [(int(rows[s + i, 2]), int(rows[s + j, 2])) for i, j in _forest(values, distance)]
            if found:
                yield record(arrow_out, list(zip(*found)))

    level, made = cut(entries(distinct, distance, segments)), None
    while True:
        # With few free bits a group is small by itself, whatever the data.
        wide = F.bit_count("mask") <= 56
        crowded = cut(level.where(wide).groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > most))
        heavy = crowded.count()
        small = level if not heavy else level.join(crowded, ["mask", "key"], "left_anti")
        sorted_rows = small.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = sorted_rows.select("mask", "key", "fp").mapInArrow(verify, out)
        made = found if made is None else made.unionByName(found)
        if not heavy:
            return cut(made.distinct())
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # 2 at first, 4 more each per round
        narrower = [(m, w) for m in masks for w in _quarters(m % (1 << 64))]
        table = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(w) for k, w in narrower if k == m]))])
        hot = level.join(crowded.select("mask", "key"), ["mask", "key"], "left_semi").distinct()
        level = cut(
            hot.select("fp", F.col("mask").alias("old"), F.col("key").alias("base"), F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
            # The old key stays part of the new one, as visitors differ from it in a bit.
            .select("mask", (F.col("base").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not("old")))).alias("key"), "fp")
        )


def classes(marked: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (id, fp) rows."""
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("id")))
    near = links(distinct.select("fp"), distance, segments, most)
    found = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # The component of fingerprints is named by its smallest document.
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.select("fp", "root").join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint in hex, and its component's smallest id."""
    marked = cut(fingerprints(docs, id_column, text))
    found = classes(marked, distance, segments, most)
    return marked.join(found, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def groups(rows: DataFrame, text: str, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """(row, component) of all rows of a table with a number `row`."""
    marked = cut(fingerprints(rows, "row", text))
    return marked.join(classes(marked, distance, segments, most), "fp").select(F.col("id").alias("row"), F.col("component_id").alias("component"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """One row of `docs` of each component, with all columns: that with the smallest id.

    Rows without an id, and different texts under one id, count like any others.
    """
    rows = numbered(docs)
    found = groups(rows, f"c{docs.columns.index(text)}", distance, segments, most)
    return least_rows(rows, found, docs.columns, id_column)
