"""Exact dedup against a history, by minimal perfect hashing of its distinct digests.

The history's distinct digests are spread over buckets of bounded size. Each bucket has a minimal
perfect hash (hash and displace): as many slots as digests, each slot holding the full digest, the
winner's id, and the number of copies. A newcomer's digest is looked up in its bucket and compared
byte by byte with the slot's, because a perfect hash also sends strangers to some slot. Members
join the history's groups; nonmembers are grouped among themselves.

Before any exchange rows are folded to one per digest and task, so a text that a third of all
rows share costs no more than another. Null counts as empty. Rows with a null id take part; a
group's winner is its smallest non-null id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from commentloom.runtime import cut

BUCKET_SLOTS = 50_000
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers from each 32-byte digest: one picks the group, one the slot."""
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 1].copy(), words[:, 2] ^ words[:, 3]


def _placed(word: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot under displacement `d`: a 64-bit mix of both, modulo `n`."""
    z = word + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def slots_of(displacement: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest in a bucket of `n` slots."""
    one, two = _words(digests)
    d = displacement[(one % np.uint64(len(displacement))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -d - 1, _placed(two, np.maximum(d, 0), n))


def perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements, and the order of the (distinct) digests by slot.

    Groups of one get a free slot outright, written as a negative number.
    """
    n = len(digests)
    one, two = _words(digests)
    m = max(1, n // 3)
    group = (one % np.uint64(m)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(m + 1))
    sizes = np.diff(starts)
    taken = np.zeros(n, bool)
    slot = np.empty(n, np.int64)
    displacement = np.zeros(m, np.int64)
    tries = np.arange(32)
    for g in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[g])
        if size < 2:
            break
        own = order[starts[g] : starts[g + 1]]
        d = 0
        while True:
            # Several displacements at a time: the first one whose slots are free and differ.
            places = np.sort(_placed(two[own][:, None], d + tries[None, :], n), axis=0)
            good = ~taken[places].any(axis=0) & (places[1:] != places[:-1]).all(axis=0)
            if good.any():
                d += int(good.argmax())
                break
            d += len(tries)
        displacement[g] = d
        slot[own] = _placed(two[own], np.full(size, d), n)
        taken[slot[own]] = True
    free = iter(np.flatnonzero(~taken).tolist())
    for g in np.flatnonzero(sizes == 1).tolist():
        place = next(free)
        displacement[g] = -place - 1
        slot[order[starts[g]]] = place
    by_slot = np.empty(n, np.int64)
    by_slot[slot] = np.arange(n)
    return displacement, by_slot


def groups(rows: DataFrame) -> DataFrame:
    """(digest, id) rows folded: the smallest id, the number of rows, and of rows with that id."""
    by_id = rows.groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = F.min_by("n", F.coalesce(F.struct(F.col("id").isNull(), "id"), F.struct(F.lit(True), "id")))
    return by_id.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"), first.alias("same"))


INDEX = "bucket int, displacement binary, digests binary, ids array<long>, counts array<long>, sames array<long>"


def index(history: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket with the perfect hash of its digests."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        digests = np.frombuffer(b"".join(frame["digest"]), np.uint8).reshape(-1, 32)
        displacement, by_slot = perfect_hash(digests)
        frame = frame.iloc[by_slot]
        ids = [None if pd.isna(x) else int(x) for x in frame["id"]]
        return pd.DataFrame(
            [(key[0], displacement.astype("<i4").tobytes(), digests[by_slot].tobytes(), ids, frame["n"].tolist(), frame["same"].tolist())],
            columns=["bucket", "displacement", "digests", "ids", "counts", "sames"],
        )

    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(build, INDEX)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


FOUND = "digest binary, id long, n long, same long, winner long, copies long, winner_rows long, member boolean"


def lookup(table: DataFrame, newcomers: DataFrame, buckets: int) -> DataFrame:
    """Each newcomer's digest with the history's winner and counts, if it is a member."""

    def find(frame: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        out = frame[["digest", "id", "n", "same"]].copy()
        empty = pd.array([None] * len(out), dtype="Int64")
        member, winner, copies, rows = np.zeros(len(out), bool), empty.copy(), empty.copy(), empty.copy()
        if len(slots) and len(out):
            row = slots.iloc[0]
            held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            asked = np.frombuffer(b"".join(frame["digest"]), np.uint8).reshape(-1, 32)
            at = slots_of(np.frombuffer(row["displacement"], "<i4"), len(held), asked)
            member = (held[at] == asked).all(axis=1)
            for to, column in ((winner, "ids"), (copies, "counts"), (rows, "sames")):
                values = pd.array([None if pd.isna(x) else int(x) for x in row[column]], dtype="Int64")
                to[member] = values[at[member]]
        return out.assign(winner=winner, copies=copies, winner_rows=rows, member=member)

    return _bucketed(newcomers, buckets).groupBy("bucket").cogroup(table.groupBy("bucket")).applyInPandas(find, FOUND)


def winners(history: DataFrame, newcomers: DataFrame, bucket_slots: int = BUCKET_SLOTS) -> DataFrame:
    """One row per distinct digest of either side: digest, keep_id, group_size, same.

    Both sides are (digest, id) rows. `same` is the number of rows that have the winner's id.
    """
    old, new = cut(groups(history)), cut(groups(newcomers))
    buckets = max(1, -(-max(old.count(), new.count()) // bucket_slots))
    found = cut(lookup(index(old, buckets), new, buckets))
    keep = F.least("id", "winner")
    joined = found.where("member").select(
        "digest",
        keep.alias("keep_id"),
        (F.col("n") + F.col("copies")).alias("group_size"),
        (
            F.when(F.col("id").eqNullSafe(keep), F.col("same")).otherwise(0)
            + F.when(F.col("winner").eqNullSafe(keep), F.col("winner_rows")).otherwise(0)
        ).alias("same"),
    )
    alone = found.where("not member").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "same")
    untouched = old.join(found.where("member").select("digest"), "digest", "left_anti").select(
        "digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "same"
    )
    return joined.unionByName(alone).unionByName(untouched)


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """The columns of `docs` by number, with the digest and the id to go by."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    value, identity = (F.col(f"c{docs.columns.index(c)}") for c in (text, id_column))
    return rows.select("*", F.unhex(F.sha2(normalised(value), 256)).alias("__digest"), identity.alias("__id"))


def _winners_of(keyed: DataFrame, bucket_slots: int) -> DataFrame:
    """A table taken as two arrivals: rows with an even id are the history of the others."""
    # Texts are read and digested once; what follows needs the digests only.
    rows = cut(keyed.select(F.col("__digest").alias("digest"), F.col("__id").cast("long").alias("id")))
    even = F.coalesce(F.col("id") % 2 == 0, F.lit(False))
    return winners(rows.where(even), rows.where(~even), bucket_slots)


def flags(docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_slots: int = BUCKET_SLOTS) -> DataFrame:
    """One row per row of `docs`: which row of its group stays, and the group's size.

    Rows that repeat the winner's id and text are all flagged as kept.
    """
    keyed = cut(_keyed(docs, id_column, text).select("__digest", "__id"))
    won = _winners_of(keyed, bucket_slots)
    return keyed.join(won, F.col("__digest") == F.col("digest")).select(
        F.col("__id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_slots: int = BUCKET_SLOTS) -> DataFrame:
    """The rows of `docs` that stay, with all columns; exactly one row for each distinct text.

    Of rows that repeat the winner's id and text, one stays (they may differ in other columns;
    any of them can be the one).
    """
    keyed = _keyed(docs, id_column, text)
    won = _winners_of(keyed, bucket_slots).select("digest", "keep_id", "same")
    kept = keyed.join(won, (F.col("__digest") == F.col("digest")) & F.col("__id").eqNullSafe(F.col("keep_id")))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    repeated = kept.where("same > 1").dropDuplicates(["__digest"])
    return kept.where("same = 1").select(*own).unionByName(repeated.select(*own))
