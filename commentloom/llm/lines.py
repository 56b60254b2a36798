"""Incremental and reversible line dedup: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Of a key of at least
`LEAST` code points that two documents hold, only the document with the smallest id keeps its lines. An
index holds

* `references`: one row for each key and document that holds it (keys as 128 bits of SHA-256),
* `counts`: one row for each key with its exact number of documents and the smallest id,
* `filters`: for each shard of keys a cuckoo filter (16-bit fingerprints, four to a bucket, in layers of
  one size), as bytes.

Insertion asks the shard's filter first. A key that it does not hold is new for certain and goes into
`counts` without a look at the history; only the others are joined with the exact table, which also
tells false alarms apart. Deletion takes a document's references back, recounts the keys they touch, and
removes keys that no document holds from the filter. So an index after insertions and deletions
is that of the documents that are left, and the text of each can be had with its lines back.

Documents are told apart by id: rows that share an id are one document, and so are all rows without an
id, which comes after all others. Null and empty texts are one empty line. A line that a third of all
documents hold is folded before it is exchanged; the joins have one row for each key on one side, so that adaptive
execution can split the other.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from commentloom.llm.batches import arrow, columns, record, small
from commentloom.runtime import cut

LEAST = 10
WHITE = " \t\n\x0b\x0c\r"
#: Keys that a shard is meant for, and buckets of four in each layer of its filter.
SHARD_KEYS = 40_000
BUCKETS = 1 << 14
FULL = 0.94
KICKS = 400


class Cuckoo:
    """Cuckoo filter over 16-byte digests, in layers of `buckets` (a power of two) times four fingerprints."""

    def __init__(self, layers: list[bytes], buckets: int = BUCKETS):
        self.buckets = buckets
        self.layers = [np.frombuffer(b, "<u2").reshape(buckets, 4).copy() for b in layers]

    def blobs(self) -> list[bytes]:
        return [x.astype("<u2").tobytes() for x in self.layers]

    def _keys(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = digests.reshape(-1, 16).view("<u8")
        print_ = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        return print_, (words[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (print_ * 0x5BD1E995 >> 8 & (self.buckets - 1))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        print_, bucket = self._keys(digests)
        found = np.zeros(len(print_), bool)
        for cells in self.layers:
            for b in (bucket, self._other(print_, bucket)):
                found |= (cells[b] == print_[:, None]).any(axis=1)
        return found

    def add(self, digests: np.ndarray) -> None:
        print_, bucket = self._keys(digests)
        layer = 0
        while len(print_):
            if layer == len(self.layers):
                self.layers.append(np.zeros((self.buckets, 4), "<u2"))
            cells = self.layers[layer]
            room = max(0, int(FULL * cells.size) - np.count_nonzero(cells))
            rest = self._fill(cells, print_[:room], bucket[:room])
            print_, bucket = np.r_[rest[0], print_[room:]], np.r_[rest[1], bucket[room:]]
            layer += 1

    def _fill(self, cells: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place fingerprints, all at a time; those without a place after `KICKS` rounds are returned."""
        random = np.random.default_rng(len(print_))
        moved = np.zeros(len(print_), bool)
        for _ in range(KICKS):
            if not len(print_):
                break
            order = np.argsort(bucket, kind="stable")
            print_, bucket, moved = print_[order], bucket[order], moved[order]
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            at = np.arange(len(bucket))
            rank = at - np.maximum.accumulate(np.where(first, at, 0))
            free = cells[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
            cells[bucket[fits], slot[fits]] = print_[fits]
            # One of those that have tried both buckets puts out a fingerprint there; the others go to their other bucket.
            kicks = ~fits & moved
            kicks[kicks] = np.r_[True, bucket[kicks][1:] != bucket[kicks][:-1]]
            victim = random.integers(0, 4, int(kicks.sum()))
            out = cells[bucket[kicks], victim].astype(np.int64)
            cells[bucket[kicks], victim] = print_[kicks]
            print_[kicks] = out
            left = ~fits
            print_, bucket = print_[left], self._other(print_[left], bucket[left])
            moved = np.ones(len(print_), bool)
        return print_, bucket

    def remove(self, digests: np.ndarray) -> None:
        """Take keys out that were added, one fingerprint each."""
        print_, bucket = self._keys(digests)
        for cells in self.layers:
            for b in (bucket, self._other(print_, bucket)):
                pending = np.arange(len(print_))
                while len(pending):
                    same = cells[b[pending]] == print_[pending, None]
                    pending = pending[same.any(axis=1)]
                    slot = same[same.any(axis=1)].argmax(axis=1)
                    # Of several keys with one fingerprint and bucket, one at a time.
                    _, one = np.unique(b[pending] * 4 + slot, return_index=True)
                    cells[b[pending[one]], slot[one]] = 0
                    print_[pending[one]] = -1
                    pending = np.delete(pending, one)
            live = print_ >= 0
            print_, bucket = print_[live], bucket[live]


@dataclass
class LineIndex:
    """`references` (shard, digest, doc), `counts` (shard, digest, refs, least) and `filters` (shard, layer, cells)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


KEY = ["shard", "digest"]
FILTERS = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("layer", T.IntegerType()), T.StructField("cells", T.BinaryType())]
)


def key_of(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def references(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, doc) of all keys that count, once for each document."""
    lines = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc"),
        F.explode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)).alias("line"),
    ).select("doc", key_of(F.col("line")).alias("key"))
    digest = F.substring(F.unhex(F.sha2("key", 256)), 1, 16)
    return lines.where(F.length("key") >= LEAST).select(digest.alias("digest"), "doc").distinct()


def empty(spark: SparkSession, shards: int) -> LineIndex:
    """An index of no document. `shards` times `SHARD_KEYS` is the number of keys it is meant for."""
    rows = lambda ddl: spark.createDataFrame([], ddl)
    return LineIndex(
        rows("shard int, digest binary, doc long"), rows("shard int, digest binary, refs long, least long"),
        spark.createDataFrame([], FILTERS), shards,
    )


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def _digests(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8)


def _held(table: pa.Table) -> Cuckoo:
    order = np.argsort(table.column("layer").to_numpy(), kind="stable")
    return Cuckoo(table.column("cells").take(pa.array(order)).to_pylist())


def _changed(filters: DataFrame, keys: DataFrame, change) -> DataFrame:
    """The filters after `change(filter, digests)` in each shard."""
    made = arrow(FILTERS)

    def compute(held: pa.Table, asked: pa.Table) -> pa.Table:
        shard = (held if len(held) else asked).column("shard")[0].as_py()
        cuckoo = _held(held)
        if len(asked):
            change(cuckoo, _digests(asked))
        blobs = cuckoo.blobs()
        return pa.Table.from_batches([record(made, [[shard] * len(blobs), range(len(blobs)), blobs])], made)

    return filters.groupBy("shard").cogroup(keys.select(*KEY).groupBy("shard")).applyInArrow(compute, FILTERS)


def _asked(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """`keys` with `maybe`: whether the shard's filter holds the key."""
    schema = T.StructType([*keys.schema.fields, T.StructField("maybe", T.BooleanType())])
    made = arrow(schema)

    def compute(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked):
            return made.empty_table()
        maybe = _held(held).contains(_digests(asked)) if len(held) else np.zeros(len(asked), bool)
        return asked.append_column("maybe", pa.array(maybe)).cast(made)

    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(compute, schema)


def insert(index: LineIndex, arrivals: DataFrame) -> LineIndex:
    """The index with the `references` (digest, doc) of documents that are not in it yet."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(index.shards)).cast("int")
    new = cut(arrivals.select(shard.alias("shard"), "digest", "doc"))
    # A row without an id is one document, so it counts once.
    fresh = new.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("least"))
    asked = cut(_asked(fresh, index.filters))
    old = index.counts.select(*KEY, F.col("refs").alias("old_refs"), F.col("least").alias("old_least"))
    met = cut(asked.where("maybe").join(old, KEY, "left"))
    strangers = asked.where("not maybe").select(*KEY, "refs", "least").unionByName(
        met.where("old_refs is null").select(*KEY, "refs", "least")
    )
    known = met.where("old_refs is not null")
    grown = known.select(*KEY, (F.col("refs") + F.col("old_refs")).alias("refs"), F.least("least", "old_least").alias("least"))
    untouched = index.counts.join(known.select(*KEY), KEY, "left_anti")
    return LineIndex(
        index.references.unionByName(new),
        cut(untouched.unionByName(grown).unionByName(strangers)),
        cut(_changed(index.filters, strangers, Cuckoo.add)),
        index.shards,
    )


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents in the one column of `ids`; null means the rows without an id."""
    gone_ids = ids.toDF("gone").distinct()
    is_gone = F.col("doc").eqNullSafe(F.col("gone"))
    gone = cut(index.references.join(gone_ids, is_gone, "left_semi"))
    left = cut(index.references.join(gone_ids, is_gone, "left_anti"))
    touched = cut(gone.select(*KEY).distinct())
    recounted = cut(
        left.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc").alias("least"))
    )
    untouched = index.counts.join(touched, KEY, "left_anti")
    dead = touched.join(recounted, KEY, "left_anti")
    return LineIndex(
        left, cut(untouched.unionByName(recounted)), cut(_changed(index.filters, dead, Cuckoo.remove)), index.shards
    )


def dropped(index: LineIndex) -> DataFrame:
    """(doc, digests): the keys whose lines each document loses."""
    shared = index.counts.where("refs > 1").select(*KEY, "least")
    lost = index.references.join(shared, KEY).where(~F.col("doc").eqNullSafe(F.col("least")))
    return lost.groupBy("doc").agg(F.collect_list("digest").alias("digests"))


def _kept(text: bytes | None, digests: list[bytes] | None) -> tuple[int, list[bytes]]:
    """The number of lines, and those that stay."""
    lines = (text or b"").split(b"\n")
    if not digests:
        return len(lines), lines
    lost = set(digests)
    white = WHITE.encode()
    return len(lines), [x for x in lines if hashlib.sha256(x.strip(white).lower()).digest()[:16] not in lost]


def cleaned(index: LineIndex, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the lines that the index leaves them; a null text stays null."""
    names, at = docs.columns, docs.columns.index(text)
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    mine = F.col(f"c{names.index(id_column)}").cast("long")
    joined = rows.join(dropped(index), mine.eqNullSafe(F.col("doc")), "left").drop("doc")
    schema = T.StructType(joined.schema.fields[:-1])
    made = arrow(schema)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, f"c{at}"):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            lost = batch.column("digests").to_pylist()
            kept = [None if t is None else b"\n".join(_kept(t, d)[1]).decode() for t, d in zip(texts, lost)]
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(kept, made.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=made)

    return joined.mapInArrow(compute, schema).toDF(*names)


def report(index: LineIndex, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of `docs`."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(dropped(index), F.col("doc_id").eqNullSafe(F.col("doc")), "left").drop("doc")
    schema = columns("doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    made = arrow(schema)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [_kept(t, d) for t, d in zip(texts, batch.column("digests").to_pylist())]
            counts = [n for n, _ in found]
            lost = [n - len(lines) for n, lines in found]
            digests = [hashlib.sha256(b"\n".join(lines)).hexdigest() for _, lines in found]
            yield record(made, [batch.column("doc_id"), counts, lost, digests])

    return joined.mapInArrow(compute, schema)


def in_arrivals(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> LineIndex:
    """An index of a whole table, which arrives in two parts: documents with an even id, then the others."""
    all_references = cut(references(docs, id_column, text))
    even = F.coalesce(F.col("doc") % 2 == 0, F.lit(False))
    index = empty(docs.sparkSession, shards_for(all_references.count()))
    return insert(insert(index, all_references.where(even)), all_references.where(~even))
