"""Suffix-array dedup: bytes covered by strings of `length` bytes that also start elsewhere.

Suffixes are taken at anchors only: of every `length` bytes, the places where a hash of the next
`gram` bytes is least. Equal strings have the same anchors, so a repeated string is seen from an
anchor x as "a bytes before x and length - a bytes from x on" at each of its places.

1. Anchors whose gram occurs once in the corpus can be in no repeated string and go.
2. An anchor's context is what any such string can hold: `length - gram` bytes before it and
   `length` from it on. Anchors that share their whole context with another one are settled.
3. What is left are distinct contexts that share a gram with others: where copies begin, end or
   differ. A pass in order of gram and preceding bytes leaves each no more of these than another
   one shares. The suffixes are then range-partitioned by their leading bytes (Spark samples the
   splitters), sorted in their bucket by multikey quicksort over 8-byte words, and again
   backwards. For each a the equal strings have equal first bytes and equal last bytes before
   the anchor, which are neighbours in both orders. Where a group of equal leading bytes
   reaches the border of its bucket, the digest of each of its strings is exchanged instead, so a
   group that fills many buckets is compared across all of them.

Texts are told apart by digest; copies of a text are occurrences of their own. Null counts as empty;
texts shorter than `length` bytes lose nothing. Null, repeated or clashing columns do no harm.
Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.runtime import cut, drop

LENGTH = 200
GRAM = 48
CHUNK = 1 << 20
BUCKET = 20_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def key_of(text: Column) -> Column:
    """Digest that stands for a text: the first half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Places of `data` where, in some window of `length` bytes, the hash of a gram is least.

    The text is taken in overlapping chunks, so arrays stay bounded; a window lies in one of them.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64)
    step, found = CHUNK - length + 1, []
    for start in range(0, max(1, n - length + 1), step):
        found.append(_anchors(data[start : start + CHUNK], length, gram) + start)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _anchors(data: bytes, length: int, gram: int) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    # Hash of 2^k bytes from those of its halves, then of `gram` bytes from two that overlap.
    h = (codes.astype(np.uint64) + np.uint64(1)) * MULTIPLY
    width = 1
    while 2 * width <= gram:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[width:]
        width *= 2
    if width < gram:
        h = (h[: len(h) - (gram - width)] ^ (h[: len(h) - (gram - width)] >> np.uint64(31))) * MULTIPLY + h[gram - width :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    # Hash above, place below: the least is the leftmost place of the least hash.
    places = np.arange(len(h), dtype=np.uint64)
    least = (h & ~np.uint64((1 << 20) - 1)) | places
    span, reach = length - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    # Windows pass over an anchor in one run, as leftmost places only move on.
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _context(data: bytes, x: int, length: int, gram: int) -> tuple[int, bytes]:
    """Bytes before the anchor in its context, and the context."""
    a = max(0, x - (length - gram))
    return x - a, data[a : x + length]


def gram_hashes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram) of all anchors of (text key, t) rows."""
    out = columns("gram long")
    arrow_out = arrow(out)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", 2 << 20):
            grams: list[int] = []
            for t in batch.column("t").to_pylist():
                data = t.encode()
                grams += [xxhash.xxh3_64_intdigest(data[x : x + gram]) for x in anchors(data, length, gram).tolist()]
            yield record(arrow_out, [np.array(grams, np.uint64).view(np.int64)])

    return rows.mapInArrow(compute, out)


def found_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, context, text, at) of all anchors of (text key, t) rows."""
    out = columns("gram long, context binary, text binary, at long")
    arrow_out = arrow(out)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", 2 << 20):
            grams, contexts, texts, at = [], [], [], []
            for text, t in zip(batch.column("text").to_pylist(), batch.column("t").to_pylist()):
                data = t.encode()
                own = anchors(data, length, gram).tolist()
                at += own
                texts += [text] * len(own)
                grams += [xxhash.xxh3_64_intdigest(data[x : x + gram]) for x in own]
                for x in own:
                    before, context = _context(data, x, length, gram)
                    contexts.append(_digest(context + before.to_bytes(2, "big")))
            yield record(arrow_out, [np.array(grams, np.uint64).view(np.int64), contexts, texts, at])

    return rows.mapInArrow(compute, out)


# ---- multikey quicksort over words


def multikey_quicksort(keys: np.ndarray, small_group: int = 48) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words.

    Each step splits a group by one word into less, equal and greater; only the equal rows go on to
    the next word. Small groups are ordered by their remaining words at once.
    """
    n, width = keys.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == width:
            continue
        own = order[a:b]
        if b - a <= small_group:
            order[a:b] = own[np.lexsort(keys[own, depth:].T[::-1])]
            continue
        word = keys[own, depth]
        pivot = np.sort(word[:: max(1, len(word) // 15)])[len(word[:: max(1, len(word) // 15)]) // 2]
        less, equal = own[word < pivot], own[word == pivot]
        order[a:b] = np.concatenate([less, equal, own[word > pivot]])
        x, y = a + len(less), a + len(less) + len(equal)
        stack += [(a, x, depth), (x, y, depth + 1), (y, b, depth)]
    return order


def _words(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes as big-endian words, filled up with zeros."""
    size = -(-width // 8) * 8
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), ">u8").reshape(len(rows), size // 8).astype(np.uint64)


def common(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Number of leading bytes each row shares with the one before it in the order."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    differ = keys[order[1:]] ^ keys[order[:-1]]
    word = (differ != 0).argmax(axis=1)
    value = differ[np.arange(len(differ)), word]
    bits = np.zeros(len(value), np.int64)
    for shift in (32, 16, 8):  # leading zero bytes of the first word that differs
        high = (value >> np.uint64(64 - shift)) == 0
        bits[high] += shift
        value = np.where(high, value << np.uint64(shift), value)
    shared = np.where((differ != 0).any(axis=1), word * 8 + bits // 8, keys.shape[1] * 8)
    return np.concatenate([[0], shared])


def compare(frame: list[tuple[bytes, bytes, bytes]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of one bucket, by row and number of bytes before the anchor.

    Rows are (context key, reversed bytes before, bytes from the anchor on). Gives whether each
    string repeats in the bucket, and whether it is to be sent to others: its group of leading
    bytes reaches the bucket's border, and it is the first of its equals here.
    """
    forward = _words([f for _, _, f in frame], length)
    backward = _words([b for _, b, _ in frame], length - gram)
    order, back_order = multikey_quicksort(forward), multikey_quicksort(backward)
    shared, back_shared = common(forward, order), common(backward, back_order)
    n = len(frame)
    fore_len = np.array([len(f) for _, _, f in frame])
    back_len = np.array([len(b) for _, b, _ in frame])
    repeats = np.zeros((n, length - gram + 1), bool)
    border = np.zeros((n, length - gram + 1), bool)
    fore_group, back_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(length - gram + 1):
        fore_group[order] = np.cumsum(shared < length - a)
        back_group[back_order] = np.cumsum(back_shared < a)
        valid = (fore_len >= length - a) & (back_len >= a)
        rows = np.flatnonzero(valid)
        if not len(rows):
            continue
        pair = fore_group[rows] * (n + 1) + back_group[rows]
        _, head, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        repeats[rows, a] = count[inverse] > 1
        reps = rows[head]
        border[reps, a] = (fore_group[reps] == fore_group[order[0]]) | (fore_group[reps] == fore_group[order[-1]])
    return repeats, border


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text key, spans) of the texts that lose bytes: arrays of start and end."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(key_of(value).alias("text"), value.alias("t")).where(F.octet_length("t") >= length)
    counts = gram_hashes(rows.select("t"), length, gram).groupBy("gram").agg(F.count("*").alias("n"))
    frequent = cut(counts.where("n > 1").select("gram"))
    # A table between the join and the sums: a gram that many texts share is then dealt out by
    # all four columns. One row per place of a text, with the number of rows that have the text.
    places = cut(found_anchors(rows, length, gram).join(frequent, "gram", "left_semi"))
    # Here and below, tables that nothing reads any more are deleted.
    drop(frequent)
    kept = cut(places.groupBy("gram", "context", "text", "at").agg(F.count("*").alias("copies")))
    drop(places)
    holder = F.min(F.struct("text", "at"))
    contexts = cut(kept.groupBy("gram", "context").agg(F.sum("copies").alias("n"), holder.alias("holder")))
    mixed = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    open_contexts = contexts.where("n = 1").select("gram", "context", "holder")
    others = contexts.where("n > 1").select("gram", "context", "holder")
    # Settled contexts take part as partners of the open ones only.
    asked = open_contexts.select("gram").distinct().join(mixed, "gram", "left_semi")
    wanted = cut(
        open_contexts.unionByName(others).join(asked, "gram", "left_semi").select("context", F.col("holder.text").alias("text"), F.col("holder.at").alias("at"))
    )
    suffixes = cut(_shared_before(_suffixes(rows, wanted, length, gram), length, gram))
    drop(wanted)
    compared = cut(_buckets(suffixes, length, gram))
    drop(suffixes)
    inside = compared.where("digest is null").select("context", "low", "high")
    crossing = compared.where("digest is not null")
    # By a too: a place may be seen from two anchors, but only once with the same a.
    met = crossing.groupBy("digest", "low").agg(F.count("*").alias("n")).where("n > 1").select("digest", "low")
    across = crossing.where("context is not null").join(met, ["digest", "low"], "left_semi").select("context", "low", "high")
    settled = others.select("context", F.lit(0).alias("low"), F.lit(length - gram).alias("high"))
    ranges = inside.unionByName(across).unionByName(settled)
    # A table, so that adaptive execution can split a context that very many places share.
    ranges = cut(ranges.groupBy("context").agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
    drop(compared)
    drop(contexts)
    # A string starts a bytes before the anchor, so low..high covers one stretch, which the text's
    # ends cut off where a settled context is cut off by them.
    at = kept.join(ranges, "context").select(
        "text",
        F.transform("ranges", lambda r: F.struct(F.greatest(F.col("at") - r["high"], F.lit(0)).alias("start"), (F.col("at") - r["low"] + length).alias("end"))).alias("own"),
    )
    return at.groupBy("text").agg(F.flatten(F.collect_list("own")).alias("spans"))


def _suffixes(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(context, before, after): the bytes of the wanted contexts, each from one text.

    Those before the anchor are in reversed order.
    """
    places = wanted.groupBy("text").agg(F.collect_list(F.struct("context", "at")).alias("places"))
    out = columns("context binary, before binary, after binary")
    arrow_out = arrow(out)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", 2 << 20):
            found = []
            for t, places in zip(batch.column("t").to_pylist(), batch.column("places").to_pylist()):
                data = t.encode()
                for p in places:
                    before, context = _context(data, p["at"], length, gram)
                    found.append((p["context"], context[:before][::-1], context[before:]))
            if found:
                yield record(arrow_out, list(zip(*found)))

    # Copies of a text would give the same suffixes again.
    return rows.join(places, "text").select("t", "places").mapInArrow(fetch, out).dropDuplicates(["context"])


def _shared_before(suffixes: DataFrame, length: int, gram: int) -> DataFrame:
    """The suffixes with no more bytes before the anchor than some other one with their gram shares.

    In order of gram and reversed bytes, the one that shares most stands next to it. No
    repeated string can reach back farther, so most contexts that a common passage stands
    in have few strings left to compare. At a bucket's ends all bytes stay.
    """
    out = columns("context binary, before binary, after binary")
    arrow_out = arrow(out)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        known = length  # shared with the row before the first one held
        for batch in chain(batches, [None]):
            if batch is not None:
                held += zip(*(batch.column(c).to_pylist() for c in ("context", "before", "after")))
            if not held:
                continue
            keys = _words([a[:gram].ljust(-(-gram // 8) * 8, b"\0") + b for _, b, a in held], -(-gram // 8) * 8 + length - gram)
            shared = np.append(common(keys, np.arange(len(held))) - -(-gram // 8) * 8, length)
            shared[0] = known
            done = len(held) if batch is None else len(held) - 1
            most = np.maximum(np.maximum(shared[:-1], shared[1:]), 0)[:done].tolist()
            if done:
                yield record(arrow_out, list(zip(*((c, b[:n], a) for (c, b, a), n in zip(held, most)))))
            held, known = held[done:], int(shared[done])

    by_gram = [F.substring("after", 1, gram), F.col("before")]
    return suffixes.repartitionByRange(*by_gram).sortWithinPartitions(*by_gram).mapInArrow(trim, out)


def _buckets(suffixes: DataFrame, length: int, gram: int, most: int = BUCKET) -> DataFrame:
    """Repeated strings of each range of suffixes: (context, low, high), or a digest for each
    string that other buckets may hold."""
    out = columns("context binary, low int, high int, digest binary")
    arrow_out = arrow(out)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("context", "before", "after")))
            while len(held) >= most:
                yield from settle(held[:most])
                held = held[most:]
        if held:
            yield from settle(held)

    def settle(frame: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        repeats, border = compare(frame, length, gram)
        found = []
        for i in np.flatnonzero(repeats.any(axis=1) | border.any(axis=1)).tolist():
            context, before, after = frame[i]
            found += [(context, low, high, None) for low, high in _runs(repeats[i])]
            # One of those that repeat inside is sent as well, for its equals elsewhere to find.
            found += [
                (None if repeats[i, a] else context, a, a, _digest(before[:a] + after[: length - a]))
                for a in np.flatnonzero(border[i]).tolist()
            ]
            if len(found) > 50_000:
                yield record(arrow_out, list(zip(*found)))
                found = []
        if found:
            yield record(arrow_out, list(zip(*found)))

    # Also by what stands before, so that many contexts with one ending are no hot range.
    ranges = suffixes.repartitionByRange("after", "before").sortWithinPartitions("after", "before")
    return ranges.mapInArrow(bucket, out)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted({(s["start"], s["end"]) for s in spans or []}):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)]))


def _with_spans(docs: DataFrame, text: str, length: int, gram: int, keep: list[str]) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], key_of(value).alias("text"), value.alias("t"))
    return rows.join(repeated_spans(docs, text, length, gram), "text", "left").drop("text")


REPORT = columns("n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs`: doc_id, and what its text loses."""
    rows = _with_spans(docs, text, length, gram, [id_column])
    out = T.StructType([T.StructField("doc_id", rows.schema["k0"].dataType), *REPORT])
    arrow_out = arrow(out)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", 2 << 20):
            done = []
            for t, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist()):
                data, merged = t.encode(), _merged(spans)
                rest = _kept(data, merged)
                done.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()))
            yield record(arrow_out, [batch.column("k0"), *zip(*done)])

    return rows.mapInArrow(measure, out)


def strip(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with the repeated bytes taken out of their texts, all rows and columns kept, whatever their names.

    Bytes of a character that is cut in two go as well. Null texts stay null.
    """
    at = docs.columns.index(text)
    kept = [f"c{i}" for i in range(len(docs.columns)) if i != at]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("none", F.col(f"c{at}").isNull())
    rows = _with_spans(numbered, f"c{at}", length, gram, [*kept, "none"])
    names = [f"k{i}" for i in range(len(kept))]
    out = T.StructType([*[rows.schema[c] for c in names], T.StructField("rest", T.StringType())])
    arrow_out = arrow(out)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", 2 << 20):
            texts = []
            for t, spans, none in zip(*(batch.column(c).to_pylist() for c in ("t", "spans", f"k{len(kept)}"))):
                texts.append(None if none else _kept(t.encode(), _merged(spans)).decode("utf-8", "ignore") if spans else t)
            yield record(arrow_out, [*[batch.column(c) for c in names], texts])

    done = rows.mapInArrow(cut_out, out)
    places = {f"c{at}": "rest"} | dict(zip(kept, names))
    return done.select(*[F.col(places[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])
