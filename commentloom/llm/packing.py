"""Packing of documents into token sequences: dominance reduction, then best fit.

An item is a piece of a document, and only its length matters. All decisions are therefore
taken on the histogram of lengths, which has at most `capacity` entries whatever the corpus:

1. Reduction (after Martello and Toth): a set of one to three lengths that provably dominates
   every other feasible set with its item is fixed as a sequence, as often as it occurs, and its
   items leave the instance. This goes on until no length has such a set.
2. The remainder is packed best-fit, longest first, with equal sequences treated as a group.

The plan is a list of patterns with multiplicities. Each piece takes a place of its length by
its rank among the pieces of that length; ranks come from range partitions and offsets, so a
length that a third of all pieces share is spread over many tasks.

Null and empty texts have one piece: the end id alone. Repeated rows and null identifiers are
items of their own; equal lengths are ranked by identifier and piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.llm.bpe import load
from commentloom.llm.codec import encode_batch
from commentloom.runtime import cut, numbered

CAPACITY = 1024
END_ID = 2
Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each text followed by `end_id`.

    Only the first piece of a longer document may be shorter than the capacity.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = T.StructType([rows.schema["doc_id"], *columns("piece int, start long, length long, ids_crc32 long")])
    arrow_out = arrow(out)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches, "t", 1 << 19):
            row, number, start, length, crc = [], [], [], [], []
            for i, found in enumerate(encode_batch(bpe, batch.column("t").to_pylist())):
                ids = np.append(found, end_id).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield record(arrow_out, [batch.column("doc_id").take(pa.array(row, pa.int64())), number, start, length, crc])

    return rows.mapInArrow(cut_up, out)


def dominating(counts: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with length `j` that dominates all feasible sets with it, or None."""
    room = capacity - j
    rest = dict(counts)
    rest[j] -= 1
    fitting = sorted((w for w, n in rest.items() if n and w <= room), reverse=True)
    if not fitting:
        return (j,)
    k = fitting[0]
    if k == room:
        return (j, k)
    smallest = [w for w in reversed(fitting) for _ in range(min(rest[w], 3))][:3]
    if len(smallest) == 1 or smallest[0] + smallest[1] > room:
        return (j, k)  # one more item fits at most, and k is the largest
    if len(smallest) == 2 or sum(smallest) > room:
        # Two more fit at most: the two largest dominate all others if they fit together.
        second = k if rest[k] > 1 else fitting[1]
        if k + second <= room:
            return (j, k, second)
        best = max((a + b for i, a in enumerate(fitting) for b in fitting[i:] if a + b <= room and (a != b or rest[a] > 1)), default=0)
        if k >= best:
            return (j, k)
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns, and the counts that no rule settles."""
    counts = {w: n for w, n in counts.items() if n}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                chosen = dominating(counts, j, capacity)
                if chosen is None:
                    break
                need = {w: chosen.count(w) for w in chosen}
                # A rule that holds for these counts also holds while its items last.
                times = min(counts[w] // n for w, n in need.items())
                for w, n in need.items():
                    counts[w] -= n * times
                    if not counts[w]:
                        del counts[w]
                fixed.append((chosen, times))
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: each item goes where the least room stays."""
    groups: dict[tuple[int, ...], int] = {}  # open sequences by content
    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            fitting = [g for g in groups if capacity - sum(g) >= w]
            best = max(fitting, key=lambda g: (sum(g), g), default=())
            each = (capacity - sum(best)) // w
            full, part = divmod(left, each)
            if best:
                available = groups.pop(best)
                if full >= available:
                    full, part = available, 0
                elif part and full + 1 <= available:
                    pass
                if spare := available - full - bool(part):
                    groups[best] = groups.get(best, 0) + spare
            for content, n in ((best + (w,) * each, full), (best + (w,) * part, int(part > 0))):
                if n:
                    groups[content] = groups.get(content, 0) + n
            left -= full * each + part
    return list(groups.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce(counts, capacity)
    return [*fixed, *best_fit(rest, capacity)]


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces of it in one sequence)."""
    rows, used, sequence = [], {}, 0
    for content, times in patterns:
        offset = 0
        for w in sorted(set(content), reverse=True):
            each = content.count(w)
            rows.append((w, used.get(w, 0), sequence, offset, each))
            used[w] = used.get(w, 0) + each * times
            offset += w * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, each with its sequence and its offset there."""
    # A table first: range partitioning looks at its input twice.
    cut_up = cut(pieces(docs, path, capacity, end_id, id_column, text))
    found = numbered(cut_up, "length", ["doc_id", "piece"], "rank")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, capacity))
    out = T.StructType([f for f in found.schema if f.name != "rank"] + list(columns("sequence_id long, offset long")))
    arrow_out = arrow(out)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lengths and ranks as one ordered key, the place with the last start at or before it.
        wide = np.int64(1) << np.int64(50)
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length * wide + rank - 1, side="right") - 1]
            ahead = rank - 1 - at[:, 1]
            sequence, inside = at[:, 2] + ahead // at[:, 4], at[:, 3] + ahead % at[:, 4] * length
            yield record(arrow_out, [*[batch.column(f.name) for f in out[:-2]], sequence, inside])

    return found.mapInArrow(put, out)
