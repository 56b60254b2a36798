"""BPE encoding and decoding with tree concatenation of long texts.

A text of more than `part_chars` characters is cut into parts that are encoded as rows of their
own. Neighbouring encodings are then joined in a tree. A join re-encodes a window around the
seam that grows until both sides agree, which is decided exactly:

* Pre-tokens that end three characters before the end of the left part are final, as the
  splitter looks no further; scanning goes on from the last such boundary, and as soon as it
  meets a boundary of the right part, all that follows is the right part's own.
* Where one pre-token runs across the seam, ids of its two sides are kept but for a window of
  ids at the seam. The result of a merge table is right if each adjacent pair of ids is its own
  encoding, so the window grows until the pairs at both of its ends are.

Nulls count as empty texts, and an empty text has no ids. Texts are told apart by content, so
null, repeated or clashing identifiers do no harm: each input row gets one output row. A text
that contains the string of a special token is encoded by the library whole, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.llm.bpe import ByteBpe, load

PART_CHARS = 32_768
FINAL = 3


class Node:
    """A stretch of text: its pre-token offsets, their first id's index, and its ids."""

    def __init__(self, text: str, at: np.ndarray, first: np.ndarray, ids: np.ndarray):
        self.text, self.at, self.first, self.ids = text, at, first, ids

    @classmethod
    def of(cls, bpe: ByteBpe, text: str) -> "Node":
        found = bpe.encode_pieces([text])
        counts = found.counts()
        return cls(text, found.at, np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts, found.ids()[0])


def _stable(bpe: ByteBpe, pair) -> bool | None:
    """Whether two ids are the encoding of their bytes; None where those end inside a character."""
    try:
        piece = b"".join(bpe.bytes_of[i] for i in pair).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return bpe.merge(piece) == list(pair)


def join_ids(bpe: ByteBpe, left: list[int], right: list[int], window: int = 4) -> list[int]:
    """Ids of one pre-token from those of its two sides."""
    take = window
    while True:
        a, b = max(0, len(left) - take), min(len(right), take)
        try:
            piece = b"".join(bpe.bytes_of[i] for i in [*left[a:], *right[:b]]).decode("utf-8")
        except UnicodeDecodeError:
            take += 1
            continue
        middle = bpe.merge(piece)
        before = not a or _stable(bpe, (left[a - 1], middle[0]))
        after = b == len(right) or _stable(bpe, (middle[-1], right[b]))
        if before and after:
            return [*left[:a], *middle, *right[b:]]
        # A pair that ends inside a character is not decided: another window is.
        take = take + 1 if before is None or after is None else 2 * take


def join_nodes(bpe: ByteBpe, left: Node, right: Node, window: int = 64) -> Node:
    """Encoding of the two texts laid end to end."""
    if not left.text or not right.text:
        return left if left.text else right
    n = len(left.text)
    kept = int(np.searchsorted(left.at, n - FINAL, side="right")) - 1  # its start is final
    kept = max(kept, 0)
    p = int(left.at[kept])
    while True:
        end = min(len(right.text), window)
        text = left.text[p:] + right.text[:end]
        at = bpe.pretokens([text])[1]
        whole = end == len(right.text)
        final = at[(at >= n - p) & (at <= len(text) - FINAL)] - (n - p)
        shared = final[np.isin(final, right.at)]
        if len(shared) or whole:
            break
        window *= 4
    q = int(shared[0]) if len(shared) else len(right.text)
    middle = left.text[p:] + right.text[:q]
    at = at[at < len(middle)]
    ahead = int(np.searchsorted(right.at, q))
    right_ids = int(right.first[ahead]) if ahead < len(right.at) else len(right.ids)
    left_ids = int(left.first[kept])
    if len(at) == 1 and kept == len(left.at) - 1 and ahead == 1:
        found = [join_ids(bpe, left.ids[left_ids:].tolist(), right.ids[:right_ids].tolist())]
    else:
        # Pre-tokens found with what follows them in view, each merged by itself.
        found = [bpe.merge(middle[s:e]) for s, e in zip(at.tolist(), [*at[1:].tolist(), len(middle)])]
    inner = Node(
        middle, at, np.cumsum([0, *map(len, found)])[:-1], np.array([i for ids in found for i in ids], np.int32)
    )
    return Node(
        left.text + right.text,
        np.concatenate([left.at[:kept], inner.at + p, right.at[ahead:] + n]),
        np.concatenate([left.first[:kept], inner.first + left_ids, right.first[ahead:] - right_ids + left_ids + len(inner.ids)]),
        np.concatenate([left.ids[:left_ids], inner.ids, right.ids[right_ids:]]),
    )


def concatenate(bpe: ByteBpe, nodes: list[Node]) -> Node:
    """All parts of a text, joined pairwise in a balanced tree."""
    while len(nodes) > 1:
        pairs = [join_nodes(bpe, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0]


def encode(
    docs: DataFrame,
    text: str,
    keep: list[str],
    path: str,
    summary: Callable[[ByteBpe, np.ndarray], tuple],
    summary_schema: T.StructType,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """The `keep` columns of each row, and `summary(tokenizer, ids)` of its text.

    Rows of short texts are encoded where they are read. Long texts are exchanged by part, once
    for each distinct text, so that neither a very long text nor many copies of one make a
    long task; their copies get the result by a join.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    special = list(load(path).special)
    plain = F.lit(True)
    for s in special:
        plain &= ~F.contains("t", F.lit(s))
    is_long = (F.length("t") > part_chars) & plain
    kept = [f"k{i}" for i in range(len(keep))]
    out = T.StructType([f for f in rows.schema if f.name != "t"] + list(summary_schema))
    arrow_out = arrow(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches, "t"):
            found = [summary(bpe, ids) for ids in bpe.encode(batch.column("t").to_pylist())]
            yield record(arrow_out, [*[batch.column(c) for c in kept], *zip(*found)])

    short = rows.where(~is_long).mapInArrow(whole, out)
    long_rows = rows.where(is_long).select(*kept, F.sha2("t", 256).alias("key"), "t")
    pieces = columns("key string, part int, t string")
    arrow_pieces = arrow(pieces)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t"):
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                found = [t[s : s + part_chars] for s in range(0, len(t), part_chars)]
                yield record(arrow_pieces, [[key] * len(found), range(len(found)), found])

    cut_up = long_rows.select("key", "t").mapInArrow(split, pieces)
    parts = cut_up.groupBy("key", "part").agg(F.first("t").alias("t"))
    part_schema = columns("key string, part int, t string, at binary, first binary, ids binary")
    arrow_part = arrow(part_schema)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches, "t"):
            nodes = [Node.of(bpe, t) for t in batch.column("t").to_pylist()]
            yield record(
                arrow_part,
                [batch.column("key"), batch.column("part"), batch.column("t")]
                + [[n.at.astype("<i4").tobytes() for n in nodes], [n.first.astype("<i4").tobytes() for n in nodes], [n.ids.astype("<i4").tobytes() for n in nodes]],
            )

    merged_schema = T.StructType([T.StructField("key", T.StringType()), *summary_schema])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path)
        frame = frame.sort_values("part")
        nodes = [
            Node(t, *(np.frombuffer(x, "<i4") for x in rest))
            for t, *rest in zip(frame["t"], frame["at"], frame["first"], frame["ids"])
        ]
        return pd.DataFrame([(key[0], *summary(bpe, concatenate(bpe, nodes).ids))], columns=merged_schema.names)

    merged = parts.mapInArrow(encode_parts, part_schema).groupBy("key").applyInPandas(merge, merged_schema)
    done = long_rows.select(*kept, "key").join(merged, "key").select(*kept, *summary_schema.names)
    return short.unionByName(done).select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *summary_schema.names)


DIGESTS = columns("n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(bpe: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, and digest of the text they decode to."""
    as_list = ids.tolist()
    return (
        len(as_list),
        hashlib.sha256(",".join(map(str, as_list)).encode()).hexdigest(),
        hashlib.sha256(bpe.decode(as_list).encode("utf-8", "surrogatepass")).hexdigest(),
    )


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Encodes and decodes every text: the id column and the three columns of `DIGESTS`."""
    return encode(docs, text, [id_column], path, digests, DIGESTS, part_chars)


def encode_batch(bpe: ByteBpe, texts: list[str], part_chars: int = 1 << 20) -> list[np.ndarray]:
    """Ids of each text; very long ones by parts, so that the arrays of a task stay bounded."""
    found = bpe.encode([t if len(t) <= part_chars or bpe.has_special(t) else "" for t in texts])
    for i, t in enumerate(texts):
        if len(t) > part_chars and not bpe.has_special(t):
            found[i] = concatenate(bpe, [Node.of(bpe, t[s : s + part_chars]) for s in range(0, len(t), part_chars)]).ids
    return found
