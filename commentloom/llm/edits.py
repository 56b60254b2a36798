"""Token counts that follow edits.

Each text has a segment tree over groups of pre-tokens ("leaves"): characters per leaf, and sums
of tokens in heap order. An edit re-encodes only the leaves it touches and what borders on
them: from the start of the leaf that holds the third character before the edit (the splitter
looks no further back), up to the first leaf border behind the edit at which the new pre-tokens
begin one as well. From there on scanning goes on as before, so the count is exact. Sums are
updated along the paths from the changed leaves to the root.

Trees are kept in a table by content digest, so that equal texts share one, and null or
repeated identifiers do no harm. Null counts as empty; an empty text has a tree with one empty
leaf. Edits of one text must not overlap; they are (position, characters removed, characters
put in) in terms of the old text. A text with the string of a special token, before or after the
edits, is counted whole. Columns other than the id and the text are not read, whatever their names.
An empty table of documents has no tree and no count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.llm.bpe import ByteBpe, load
from commentloom.llm.codec import encode_batch

LEAF = 32
BACK = 3
AHEAD = 3
#: Runs of digits and addresses, which a redaction step replaces.
PERSONAL = r"[0-9]{3,}|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
EDITS = T.ArrayType(columns("at int, removed int, inserted string"))
TREE = columns("key binary, chars binary, sums binary, total long")
SLICE_BYTES = 1 << 19


class Tree:
    """Characters and token counts of a text's leaves, with subtree sums in heap order."""

    def __init__(self, chars: np.ndarray, sums: np.ndarray):
        self.chars, self.sums, self.width = chars, sums, len(sums) // 2
        self.encoded = 0

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> "Tree":
        width = 1 << max(0, (len(tokens) - 1).bit_length())
        sums = np.zeros(2 * width, np.int64)
        sums[width : width + len(tokens)] = tokens
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            sums[a : 2 * a] = sums[2 * a : 4 * a : 2] + sums[2 * a + 1 : 4 * a : 2]
        return cls(chars, sums)

    def total(self) -> int:
        return int(self.sums[1])

    def put(self, leaf: int, tokens: int) -> None:
        i = self.width + leaf
        change = tokens - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def edit(self, bpe: ByteBpe, text: str, edits: list[tuple[int, int, str]]) -> str:
        """Applies edits of `text`, last one first, and returns the new text."""
        for at, removed, inserted in sorted(edits, reverse=True):
            text = self._one(bpe, text, at, removed, inserted)
        return text

    def _one(self, bpe: ByteBpe, text: str, at: int, removed: int, inserted: str) -> str:
        ends = np.cumsum(self.chars)
        new = text[:at] + inserted + text[at + removed :]
        a = int(np.searchsorted(ends, max(0, at - BACK), side="right"))
        a = min(a, len(ends) - 1)
        start = int(ends[a] - self.chars[a])
        shift = len(inserted) - removed
        b = min(int(np.searchsorted(ends, at + removed)), len(ends) - 1)
        while True:
            end = int(ends[b])  # a leaf border in the old text, at or behind the edit
            last = end == len(text)
            stop = min(len(new), end + shift + AHEAD)
            window = new[start:stop]
            found = bpe.pretokens([window])[1]
            border = end + shift - start
            if last or border in found:
                break
            b += 1
        counts = bpe.encode_pieces([window]).counts()
        tokens = int(counts[found < border].sum())
        self.encoded += int((found < border).sum())
        self.chars[a] = end + shift - start
        self.chars[a + 1 : b + 1] = 0
        self.put(a, tokens)
        for leaf in range(a + 1, b + 1):
            self.put(leaf, 0)
        return new


def build(bpe: ByteBpe, texts: list[str], leaf: int = LEAF) -> list[Tree]:
    found = bpe.encode_pieces(texts)
    counts = found.counts()
    trees = []
    for i in range(len(texts)):
        a, b = int(found.of_text[i]), int(found.of_text[i + 1])
        if a == b:
            trees.append(Tree.of_leaves(np.zeros(1, np.int64), np.zeros(1, np.int64)))
            continue
        heads = np.arange(a, b, leaf)
        starts = found.at[heads]
        trees.append(Tree.of_leaves(np.diff(np.append(starts, found.text_starts[i + 1])), np.add.reduceat(counts[:b], heads)))
    return trees


def _keyed(docs: DataFrame, id_column: str | None = None, text: str = "text") -> DataFrame:
    """(id, key, t) of each row: only these columns are read, whatever the others are called."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{id_column}`").alias("id")] if id_column else []
    return docs.select(*own, F.unhex(F.sha2(value, 256)).alias("key"), value.alias("t"))


def trees(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """One tree for each distinct text, with the token count of the whole text."""
    arrow_tree = arrow(TREE)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches, "t", SLICE_BYTES):
            texts = batch.column("t").to_pylist()
            grown = build(bpe, texts, leaf)
            totals = [t.total() for t in grown]
            for i in [i for i, t in enumerate(texts) if bpe.has_special(t)]:
                totals[i] = len(encode_batch(bpe, [texts[i]])[0])
            chars, sums = ([x.astype(kind).tobytes() for x in arrays] for kind, arrays in (("<i4", [t.chars for t in grown]), ("<i8", [t.sums for t in grown])))
            yield record(arrow_tree, [batch.column("key"), chars, sums, totals])

    grown = _keyed(docs, text=text).mapInArrow(grow, TREE)
    return grown.groupBy("key").agg(*[F.first(c).alias(c) for c in ("chars", "sums", "total")])


EDITED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("t", T.StringType()), T.StructField("edits", EDITS)])


def redactions(docs: DataFrame, text: str = "text", pattern: str = PERSONAL, by: str = "<redacted>") -> DataFrame:
    """Edits that replace each match of `pattern`: one row with the old text for each distinct text that has any."""
    arrow_out = arrow(EDITED)
    found = re.compile(pattern)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "t", SLICE_BYTES):
            rows = []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                own = [{"at": m.start(), "removed": m.end() - m.start(), "inserted": by} for m in found.finditer(t)]
                if own:
                    rows.append((key, t, own))
            if rows:
                yield record(arrow_out, list(zip(*rows)))

    edited = _keyed(docs, text=text).mapInArrow(search, EDITED)
    return edited.groupBy("key").agg(F.first("t").alias("t"), F.first("edits").alias("edits"))


UPDATED = columns("key binary, after long, n_edits int, pretokens_encoded long")


def updated(kept_trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Token counts of the edited texts (key, t, edits), by updating their trees."""
    arrow_out = arrow(UPDATED)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches, "t", SLICE_BYTES):
            done = []
            for key, t, chars, sums, own in zip(*(batch.column(c).to_pylist() for c in ("key", "t", "chars", "sums", "edits"))):
                tree = Tree(np.frombuffer(chars, "<i4").astype(np.int64), np.frombuffer(sums, "<i8").copy())
                own = [(e["at"], e["removed"], e["inserted"] or "") for e in own]
                new = tree.edit(bpe, t, own)
                special = bpe.has_special(t) or bpe.has_special(new)
                after = len(encode_batch(bpe, [new])[0]) if special else tree.total()
                done.append((key, after, len(own), tree.encoded))
            if done:
                yield record(arrow_out, list(zip(*done)))

    return edits.join(kept_trees, "key").select("key", "t", "chars", "sums", "edits").mapInArrow(update, UPDATED)


def recount(docs: DataFrame, kept_trees: DataFrame, edits: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts of each row before and after the edits of its text.

    Of a text without edits only the digest travels and the tree's total is read. Rows of one text, however many,
    meet one row of each table, so that adaptive execution can split them.
    """
    counts = kept_trees.select("key", "total").join(updated(kept_trees, edits, path), "key", "left")
    total = F.col("total").alias("n_tokens_before")
    return _keyed(docs, id_column, text).select("id", "key").join(counts, "key").select(
        F.col("id").alias("doc_id"),
        total,
        F.coalesce("after", "total").alias("n_tokens"),
        F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
        F.coalesce("pretokens_encoded", F.lit(0).cast("long")).alias("pretokens_encoded"),
    )
