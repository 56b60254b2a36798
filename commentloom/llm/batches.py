"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which `column` holds about `most_bytes`, one row at least.

    Array temporaries of a task stay bounded whatever the number of rows in a batch.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of `schema` from arrays or lists."""
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "string": T.StringType(), "binary": T.BinaryType(),
}


def columns(ddl: str) -> T.StructType:
    """A schema from `name kind, name kind`; needs no session, unlike Spark's own parser."""
    pairs = [x.split() for x in ddl.split(",")]
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in pairs])
