"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least `max(shortest, 2q)` long, that no
neighbouring word extends. The words of a document are numbered; ranks of all blocks of 1, 2, 4, …
words come from prefix doubling, which ends in the suffix array. The starts that a block of words
has in the document are an interval of that array, and a wavelet tree over it answers range
successor queries: where does this block begin again within a window?

A run of period q repeats, q words on, every block that lies in its first `length - q` words. So with
blocks of m words at multiples of m, a run with q from 2m - 1 to 4m - 2 holds a block that begins
again exactly q words on, in one of two windows of m starts. At most two starts in a window
are candidates as they are. Three or more form an arithmetic progression whose difference p is the
block's own period: where the whole window lies in one stretch of period p, that stretch is
found among the shorter periods and the window has no candidate, else each member is one. A candidate
is extended both ways by comparing ranks of blocks from the longest down; of equal stretches the one
with the least period counts (the others are multiples of it).

Rows stay where they are: nothing is shuffled. Several documents are handled at a time as one sequence in which
they share no number, about `SLICE_BYTES` of text; memory is 4 bytes times the words times the doubling
steps (a text of a million words: about 150 MB). Null and empty texts have no words and no run.
Rows with a null or a repeated id are rows like others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from commentloom.llm.batches import arrow, columns, record, small

SHORTEST = 12
SLICE_BYTES = 1 << 20

Words = list[bytes]


class Suffixes:
    """Suffix array of a sequence of numbers whose last one occurs nowhere else.

    `levels[k][i]` is the place in the array of the first suffix that begins with the same 2^k numbers as
    suffix i, so two blocks are equal if these are.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        sizes = np.bincount(ids)
        starts = np.cumsum(sizes) - sizes
        self.order = np.argsort(ids, kind="stable").astype(np.int32)
        rank = starts[ids].astype(np.int32)
        self.levels = [rank]
        active = np.flatnonzero(sizes[ids] > 1)
        step = 1
        while len(active):
            # No block that occurs twice holds the last number of its document, so the next block exists.
            key = rank[active].astype(np.int64) * n + rank[active + step]
            by_key = np.argsort(key)
            active, key = active[by_key], key[by_key]
            old = rank[active]
            at = np.arange(len(active))
            first = lambda starts_here: np.maximum.accumulate(np.where(starts_here, at, 0))
            slot = old + at - first(np.r_[True, old[1:] != old[:-1]])
            self.order[slot] = active
            same = key[1:] == key[:-1]
            rank = rank.copy()
            rank[active] = slot[first(np.r_[True, ~same])]
            self.levels.append(rank)
            shared = np.zeros(len(active), bool)
            shared[1:] |= same
            shared[:-1] |= same
            active = active[shared]
            step *= 2

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers agree from x and y on."""
        x, y, began = x.copy(), y.copy(), x
        for k in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[k][x] == self.levels[k][y], 1 << k, 0)
            x += step
            y += step
        return x - began

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers agree before x and y; x is the smaller."""
        x, y, began = x.copy(), y.copy(), x
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            same = (x >= step) & (rank[np.maximum(x - step, 0)] == rank[np.maximum(y - step, 0)])
            step = np.where(same, step, 0)
            x -= step
            y -= step
        return began - x


class Wavelet:
    """Wavelet tree, level by level, of numbers below 2^bits: counts and order statistics of any interval."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            upper = (values >> bit & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(upper, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~upper], values[upper]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in [left, right) are less than x."""
        out = np.zeros(len(x), np.int64)
        for depth, ones in enumerate(self.ones):
            a, b = ones[left], ones[right]
            upper = (x >> (self.bits - 1 - depth) & 1).astype(bool)
            out += np.where(upper, (right - left) - (b - a), 0)
            left = np.where(upper, self.zeros[depth] + a, left - a)
            right = np.where(upper, self.zeros[depth] + b, right - b)
        return out

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th number of [left, right) by size, from 0."""
        out, k = np.zeros(len(k), np.int64), k.copy()
        for depth, ones in enumerate(self.ones):
            a, b = ones[left], ones[right]
            lower = (right - left) - (b - a)
            upper = k >= lower
            k -= np.where(upper, lower, 0)
            out = out << 1 | upper
            left = np.where(upper, self.zeros[depth] + a, left - a)
            right = np.where(upper, self.zeros[depth] + b, right - b)
        return out


def _candidates(suffixes: Suffixes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs of which each run has one; `longest` is the longest document's length."""
    n, levels = len(suffixes.order), suffixes.levels
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(levels) < 2:
        return places[0], periods[0]
    # Starts of blocks of two that occur once are never asked for.
    repeated = (np.bincount(levels[1], minlength=n) > 1)[levels[1]]
    held = repeated[suffixes.order]
    before = np.r_[0, np.cumsum(held)]
    bits = n.bit_length()
    tree = Wavelet(suffixes.order[held].astype(np.int64), bits)
    for k in range(1, len(levels)):
        m = 1 << k
        low, high = (1, 6) if m == 2 else (2 * m - 1, 4 * m - 2)
        if 2 * low > longest:
            break
        sizes = np.bincount(levels[k], minlength=n)
        block = np.arange(0, n, m)
        block = block[sizes[levels[k][block]] > 1]
        left = before[levels[k][block]]
        right = before[levels[k][block] + sizes[levels[k][block]]]
        for gap in range(low, high + 1, m):
            start, end = np.minimum(block + gap, n), np.minimum(block + min(gap + m, high + 1), n)
            skipped = tree.below(left, right, start)
            count = tree.below(left, right, end) - skipped
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            i, l, r, s, c = block[hit], left[hit], right[hit], skipped[hit], count[hit]
            first = tree.smallest(l, r, s)
            several = np.flatnonzero(c > 1)
            apart = np.ones(len(hit), np.int64)
            apart[several] = tree.smallest(l[several], r[several], s[several] + 1) - first[several]
            many = np.flatnonzero(c > 2)
            last = first + (c - 1) * apart
            inside = i[many] + apart[many] + suffixes.ahead(i[many], i[many] + apart[many]) >= last[many] + m
            c[many[inside]] = 0
            which = np.repeat(np.arange(len(hit)), c)
            member = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
            places.append(i[which])
            periods.append(first[which] + member * apart[which] - i[which])
    return np.concatenate(places), np.concatenate(periods)


def find(sequences: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Runs of each sequence of numbers: rows (start, length, period) by start, then period.

    `shortest` is at least 5: shorter runs of period 1 or 2 need not hold a whole block.
    """
    if shortest < 5:
        raise ValueError("runs of fewer than 5 words are not found")
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    used = [j for j, s in enumerate(sequences) if len(s) >= shortest]
    if not used:
        return out
    parts, base = [], 0
    for j in used:
        top = int(sequences[j].max()) + 1
        parts += [sequences[j] + base, np.array([base + top])]
        base += top + 1
    ids = np.concatenate(parts)
    lengths = np.array([len(sequences[j]) for j in used])
    offsets = np.r_[0, np.cumsum(lengths + 1)]
    suffixes = Suffixes(ids)
    i, q = _candidates(suffixes, int(lengths.max()))
    start = i - suffixes.behind(i, i + q)
    end = i + q + suffixes.ahead(i, i + q)
    good = end - start >= np.maximum(shortest, 2 * q)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(q) else np.zeros(0, bool)
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    cuts = np.searchsorted(start, offsets)
    for place, j in enumerate(used):
        own = slice(cuts[place], cuts[place + 1])
        if own.start < own.stop:
            out[j] = np.stack([start[own] - offsets[place], end[own] - start[own], q[own]], axis=1)
    return out


def numbers(words: Words) -> np.ndarray:
    """The words as numbers from 0, in order of first appearance."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of `n` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def scan(
    docs: DataFrame,
    row: Callable[[Words, np.ndarray], tuple],
    schema: str,
    prepare: Callable[[int | None, Words], Words] | None = None,
    shortest: int = SHORTEST,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id` and what `row(words, runs)` makes of each document, as columns of `schema`.

    Words are stretches without ASCII white space, in UTF-8. `prepare` may change a document's words first.
    """
    full = columns(f"doc_id long, {schema}")
    made = arrow(full)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            words = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if prepare:
                words = [prepare(i, w) for i, w in zip(ids, words)]
            found = find([numbers(w) for w in words], shortest)
            rows = [(i, *row(w, f)) for i, w, f in zip(ids, words, found)]
            yield record(made, list(zip(*rows)))

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        compute, full
    )


def spans(docs: DataFrame, **options) -> DataFrame:
    """One row for each run: doc_id, start, length, period, counted in words."""

    def row(words: Words, runs: np.ndarray) -> tuple:
        return (runs.astype("<i8").tobytes(),)

    flat = scan(docs, row, "runs binary", **options)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, "<i8").reshape(-1, 3) for b in batch.column("runs").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield record(made, [batch.column("doc_id").take(pa.array(at)), rows[:, 0], rows[:, 1], rows[:, 2]])

    full = columns("doc_id long, start long, length long, period long")
    made = arrow(full)
    return flat.mapInArrow(listed, full)


def collapsed(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with one period of each run, its words joined by one space."""

    def row(words: Words, runs: np.ndarray) -> tuple:
        return (_joined(words, runs).decode(),)

    return scan(docs, row, "text string", **options)


def _joined(words: Words, runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    return b" ".join([w for w, stays in zip(words, kept(len(words), runs).tolist()) if stays])


def with_repeats(doc_id: int | None, words: Words) -> Words:
    """The words of a document in ten end in a repeated passage, whose place and length its id decides."""
    number = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if number is None or number % 10 or not words:
        return words
    n, g = len(words), number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


REPORT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def report(docs: DataFrame, prepare=with_repeats, **options) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period), and digests.

    `runs_sha256` is over the lines `start,length,period` of all runs, `collapsed_sha256` over the text
    that `collapsed` returns.
    """

    def row(words: Words, runs: np.ndarray) -> tuple:
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_joined(words, runs)).hexdigest()
        if not len(runs):
            return (0, None, None, None, None, *digests)
        s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        return (len(runs), s, n, q, 1000 * n // q, *digests)

    return scan(docs, row, REPORT, prepare, **options)
