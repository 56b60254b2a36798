"""Stupid-backoff scores of documents, computed relationally over byte n-grams.

Texts are dealt out to blocks of about `block_bytes`; a block's texts are exploded to their
distinct n-grams of all orders, so the tables grow with the text but not with each of its bytes.
N-gram count tables are sums of these rows, partitioned by the n-gram, and are joined to the
exploded n-grams; each block then looks its bytes' n-grams up in what it got and sums the scores
of each document.

A byte w after context u scores count(uw) / count(u) if uw was counted, else `backoff` times the
score of w after the context without its first byte; a single byte scores its share of all bytes,
and one that was never counted 1 / (bytes + 256). Counts are cross-fitted: documents are
dealt to `folds` by a hash of their id, and each is scored by the counts of the other folds, so no
document vouches for itself and all documents are counted and scored.

Null counts as empty; empty texts have score 0 and no bits per byte. Rows with a null id belong to
fold 0. Repeated rows are counted and scored as often as they occur; those equal in id and text
share a block. N-grams are exact numbers, not hashes: the order above, the bytes below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns
from commentloom.runtime import cut

ORDER = 5
BACKOFF = 0.4
FOLDS = 2
BLOCK_BYTES = 32 << 20
SLICE = 2 << 20


def _coded(order: int, grams: np.ndarray) -> np.ndarray:
    return grams | np.int64(order) << np.int64(56)


def longest(texts: list[bytes], order: int) -> np.ndarray:
    """The longest n-gram of at most `order` bytes that ends at each byte of each text."""
    codes = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    held = np.minimum(place + 1, order)
    out = codes.copy()
    for back in range(1, order):
        earlier = np.zeros_like(codes)
        earlier[back:] = codes[:-back]
        out += np.where(held > back, earlier << np.int64(8 * back), 0)
    return out | held << np.int64(56)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `SLICE` bytes: index of the first, and the texts."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > SLICE:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _shorter(grams: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes of each n-gram."""
    return _coded(order, grams & np.int64((1 << (8 * order)) - 1))


def tally(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders in the texts, and their counts."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(more: np.ndarray, n: np.ndarray) -> None:
        nonlocal grams, counts
        grams, inverse = np.unique(np.concatenate([grams, more]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(grams)).astype(np.int64)

    for _, part in _slices(texts):
        add(*np.unique(longest(part, order), return_counts=True))
    for k in range(order - 1, 0, -1):  # each n-gram's ending is one as well
        longer = (grams >> np.int64(56)) == k + 1
        more, inverse = np.unique(_shorter(grams[longer], k), return_inverse=True)
        add(more, np.bincount(inverse, counts[longer], len(more)).astype(np.int64))
    return grams, counts


def rate(grams: np.ndarray, counts: np.ndarray, total: int, order: int, backoff: float) -> np.ndarray:
    """Log2 score of the last byte of each n-gram; `grams` are sorted and closed under both ends."""
    scores = np.full(len(grams), -np.log2(total + 256.0))
    for k in range(1, order + 1):
        own = np.flatnonzero((grams >> np.int64(56)) == k)
        if not len(own):
            continue
        g, c = grams[own], counts[own]
        if k == 1:
            found = np.where(c > 0, np.log2(np.maximum(c, 1) / max(total, 1)), scores[own])
        else:
            context = np.searchsorted(grams, _coded(k - 1, (g & np.int64((1 << 56) - 1)) >> np.int64(8)))
            ending = np.searchsorted(grams, _shorter(g, k - 1))
            # A context is counted at least as often as the n-gram it begins.
            seen = np.log2(np.maximum(c, 1) / np.maximum(counts[context], 1))
            found = np.where(c > 0, seen, np.log2(backoff) + scores[ending])
        scores[own] = found
    return scores


def score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    folds: int = FOLDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, log2_score, bits_per_byte."""
    identity = F.col(f"`{id_column}`")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(identity.alias("id"), value.alias("t"), F.coalesce(F.crc32(identity.cast("string")) % folds, F.lit(0)).cast("int").alias("fold"))
    sizes = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-sizes // block_bytes))
    # One number for fold and block; the hash spreads a hot source or fold alike.
    rows = rows.withColumn("block", (F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) * folds + F.col("fold")).cast("int"))

    gram_schema = columns("block int, gram long, n long")
    arrow_gram = arrow(gram_schema)

    def explode(table: pa.Table) -> pa.Table:
        grams, counts = tally([t.encode() for t in table.column("t").to_pylist()], order)
        block = np.full(len(grams), table.column("block")[0].as_py(), np.int32)
        return pa.table([block, grams, counts], schema=arrow_gram)

    exploded = cut(rows.select("block", "t").groupBy("block").applyInArrow(explode, gram_schema))
    by_fold = exploded.groupBy("gram", F.pmod("block", F.lit(folds)).alias("fold")).agg(F.sum("n").alias("n"))
    # One row per n-gram with the counts of all folds.
    counts = by_fold.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("by_fold"), F.sum("n").alias("all"))
    others = F.col("all") - F.coalesce(F.element_at("by_fold", F.pmod("block", F.lit(folds))), F.lit(0))
    asked = exploded.select("block", "gram").join(counts, "gram").select("block", "gram", others.alias("n"))
    totals = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.sum(F.octet_length("t").cast("long")).alias("n")).collect()}
    every = sum(totals.values())

    out = T.StructType([T.StructField("doc_id", rows.schema["id"].dataType), *columns("n_bytes long, log2_score double")])
    arrow_out = arrow(out)

    def look_up(texts: pa.Table, table: pa.Table) -> pa.Table:
        grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        by_gram = np.argsort(grams)
        grams, n = grams[by_gram], n[by_gram]
        data = [t.encode() for t in texts.column("t").to_pylist()]
        sizes = np.array([len(t) for t in data], np.int64)
        sums = np.zeros(len(data))
        if len(grams):
            fold = texts.column("block")[0].as_py() % folds
            scores = rate(grams, n, every - totals.get(fold, 0), order, backoff)
            for start, part in _slices(data):
                own = sizes[start : start + len(part)]
                full = np.flatnonzero(own)
                if len(full):
                    each = scores[np.searchsorted(grams, longest(part, order))]
                    begins = np.concatenate([[0], np.cumsum(own[full])[:-1]])
                    sums[start + full] = np.add.reduceat(each, begins)
        return pa.table([texts.column("id"), sizes, sums], schema=arrow_out)

    found = (
        rows.select("block", "id", "t").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(look_up, out)
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("log2_score") / F.col("n_bytes"))
    return found.withColumn("bits_per_byte", bits)
