"""Records of tab-separated files whose quoted cells hold line breaks, each file read by many tasks.

Whether a line break ends a record depends on all that stands before it in the file. A first scan
gives for each block of a file, and for both ways it can begin, whether a quoted cell is open at its end and how many records end in
it. Put one after the other these tell how each block really begins. In a second scan every task cuts its
blocks into records, and the few pieces of records that go beyond a border are put together by their file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from commentloom.runtime import cut

TAB, QUOTE = b"\t", b'"'
BLOCK = ["path", "at"]
# Lines that become Python objects at a time, and bytes of records after which a task hands them on.
LINES, HANDED_ON_BYTES = 1024, 4 << 20


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, if one was (`inside`) at its start.

    A cell is quoted if it begins with a quote; a doubled quote in it stands for one. Quotes elsewhere mean nothing.
    """
    if QUOTE not in line:
        return inside
    i = 0
    while True:
        if not inside:
            if line[i : i + 1] != QUOTE:
                i = line.find(TAB, i) + 1
                if not i:
                    return False
                continue
            i += 1
        end = line.find(QUOTE, i)
        if end < 0:
            return True
        inside = line[end + 1 : end + 2] == QUOTE
        i = end + 2 if inside else end + 1


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path, at, line`: the bytes of each line, and the place of its block; lines of a block are in one task, in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("line"),
    )


def _by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Runs of rows that agree in `columns`, with their lines. These are streamed, so a block is never held."""

    def rows() -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                part = batch.slice(at, LINES)
                yield from zip(zip(*(part.column(c).to_pylist() for c in columns)), part.column("line").to_pylist())

    for key, run in groupby(rows(), itemgetter(0)):
        yield key, (line for _, line in run)


ENDS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("at", T.LongType())]
    + [T.StructField(f"{name}_{i}", kind) for i in (0, 1) for name, kind in (("open", T.BooleanType()), ("records", T.LongType()))]
)
BLOCKS = "path string, at long, inside boolean, ends_inside boolean, skip long"


def blocks(spark: SparkSession, path: str | list[str], skip: int) -> DataFrame:
    """`path, at, inside, ends_inside, skip`: how each block begins and ends, and how many of its records are left out.

    The first `skip` records of a file are left out after its header, if it has as many. One row for each block.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key_path, at, line in zip(batch["path"], batch["at"], batch["line"]):
                state = held.setdefault((key_path, at), [False, 0, True, 0])
                for i in (0, 2):
                    was = state[i]
                    state[i] = open_after(line, was)
                    state[i + 1] += not state[i] and (was or not _blank(line))
        if held:  # no line begins in a block within a very long one
            yield pd.DataFrame([(*key, *state) for key, state in held.items()], columns=ENDS.names)

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        inside, before, found = False, 0, []
        for r in rows.itertuples():
            after, n = (r.open_1, r.records_1) if inside else (r.open_0, r.records_0)
            found.append((r.path, r.at, bool(inside), bool(after), before, int(n)))
            inside, before = after, before + n
        # A record that is open at the end of the file counts, as its last line does.
        total = before + bool(inside)
        left_out = 1 + skip if total >= 1 + skip else 1
        return pd.DataFrame(
            [(p, at, i, a, max(0, min(n + 1, left_out - b))) for p, at, i, a, b, n in found],
            columns=["path", "at", "inside", "ends_inside", "skip"],
        )

    found = lines(spark, path).mapInPandas(ends, ENDS)
    return found.groupBy("path").applyInPandas(follow, BLOCKS)


def records(spark: SparkSession, path: str | list[str], encoding: str, skip: int = 0) -> DataFrame:
    """`record`: the text of each record without the files' headers and, in files that have as many, their next `skip` records.

    For charsets that hold ASCII and in which no byte of a longer character is a tab, quote or line end.
    """
    found = cut(blocks(spark, path, skip))
    usual = (F.col("skip") == F.when(F.col("at") == 0, F.lit(1 + skip)).otherwise(F.lit(0))) & ~F.col("inside")
    # At most one row for each block that can be split off, a ten-millionth of the bytes that are read.
    unusual = F.broadcast(found.where(~usual).select(*BLOCK, "inside", "skip"))
    scan = lines(spark, path).join(unusual, BLOCK, "left").select(
        "path", "at", "line",
        F.coalesce("inside", F.lit(False)).alias("inside"),
        F.coalesce("skip", F.when(F.col("at") == 0, F.lit(1 + skip)).otherwise(F.lit(0))).cast("long").alias("skip"),
    )
    text = T.StructType([T.StructField("record", T.StringType())])
    arrow_text = pa.schema([("record", pa.string())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, inside, left_out), found in _by_block(batches, ["path", "at", "inside", "skip"]):
            texts, n = [], 0
            for kind, piece, kept in _cut_up(found, inside, left_out):
                if kind != "whole" or not kept:
                    continue
                texts.append(_text(piece, encoding))
                n += len(piece)
                if n >= HANDED_ON_BYTES:
                    yield pa.record_batch([texts], schema=arrow_text)
                    texts, n = [], 0
            yield pa.record_batch([texts], schema=arrow_text)

    complete = scan.mapInArrow(whole, text)
    broken = found.where("inside OR ends_inside").select(*BLOCK)
    if broken.isEmpty():
        return complete
    pieces = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType()),
         T.StructField("kind", T.StringType()), T.StructField("piece", T.BinaryType()), T.StructField("kept", T.BooleanType())]
    )
    arrow_pieces = pa.schema([("path", pa.string()), ("at", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("piece", pa.binary()), ("kept", pa.bool_())])

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, at, inside, left_out), found in _by_block(batches, ["path", "at", "inside", "skip"]):
            rows = [(file, at, i, *p) for i, p in enumerate(_cut_up(found, inside, left_out)) if p[0] != "whole"]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_pieces)], schema=arrow_pieces)

    # At most two pieces of a block. A record begins where a cell is left open.
    ends = scan.join(F.broadcast(broken), BLOCK, "left_semi").mapInArrow(border, pieces)
    order = Window.partitionBy("path").orderBy("at", "part")
    joined = (
        cut(ends).withColumn("record", F.sum((F.col("kind") == "begins").cast("int")).over(order))
        .groupBy("path", "record")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part", "piece"))).alias("p"), F.max_by("kept", F.struct("at", "part")).alias("kept"))
        .where("kept")
    )

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([[_text(b"\n".join(p["piece"] for p in r), encoding) for r in batch.column("p").to_pylist()]], schema=arrow_text)

    return complete.unionByName(joined.select("p").mapInArrow(put_together, text))


def _text(record: bytes, encoding: str) -> str:
    return record.removesuffix(b"\r").decode(encoding, "replace")


def _cut_up(found: Iterable[bytes], inside: bool, left_out: int) -> Iterator[tuple[str, bytes, bool]]:
    """Kind, bytes and whether it stays, of the records and pieces of a block, one after the other.

    A piece `begins` a record that the block leaves open, `goes on` through it, or `ends` one that it began with.
    """
    held, begun = [], not inside
    number = 0
    for line in found:
        if not held and begun and _blank(line):
            continue
        held.append(line)
        inside = open_after(line, inside)
        if not inside:
            yield "whole" if begun else "ends", b"\n".join(held), number >= left_out
            held, begun, number = [], True, number + 1
    if held:
        yield "begins" if begun else "goes on", b"\n".join(held), number >= left_out
