"""Small session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Whether the shuffle files of a query are deleted at its end, and not when the driver's garbage collector finds them unused.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application.

    It lies in the shared folder the cluster names in `spark.checkpoint.dir`. Only in
    local mode, with none configured, a folder of our own is made.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="commentloom-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables-{context.applicationId}"


# Folder, below the shared one, of the innermost scope that is open in this thread.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes inside are deleted at the end.

    For steps whose results are written or collected inside: a stage of a pipeline, a micro-batch.
    """
    name = uuid.uuid4().hex
    try:
        with scope(spark, name):
            yield
    finally:
        drop_scope(spark, name)


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that `cut` writes inside lie together, until `drop_scope(spark, name)` deletes them."""
    outer = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(outer)


def drop_scope(spark: SparkSession, name: str) -> None:
    _delete(spark, f"{shared_folder(spark)}/{name}")


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that `make()` returns as a table of `cut`; those that `cut` writes for it are deleted.

    So a step of many tables holds them until its result is written, and not until the session ends.
    """
    name = uuid.uuid4().hex
    try:
        with scope(spark, name):
            df = make()
        return cut(df)
    finally:
        drop_scope(spark, name)


def drop(df: DataFrame) -> None:
    """Delete a table of `cut` that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        _delete(df.sparkSession, path.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and go on from there.

    Later steps restart from files when executors are lost, read only the columns they
    need, and plan with true sizes. Unlike a checkpointed frame the table carries no
    inferred constraints, which would grow from round to round of an iteration. The shuffle files
    behind it go with the query that wrote it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), *filter(None, [_scope.get()]), uuid.uuid4().hex])
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def name(column: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(f"`{column}`")


def numbered(df: DataFrame, group: str, order: list[str], to: str) -> DataFrame:
    """Dense 1-based position of each row within `group`, ordered by `order`.

    A window would sort one group in one task. Here rows are range
    partitioned, each partition numbers its own rows, and the offsets come from
    per-partition counts, so a group of any size is spread over many tasks.
    """
    spread = df.repartitionByRange(F.col(group), *[F.col(c) for c in order])
    placed = cut(
        spread.sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), 33)
    pieces = placed.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n")
    )
    # At most one row per group and shuffle partition, whatever the number of rows.
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_g", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
        .withColumn(to, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_at", "_g", "_p", "_first", "_before")
    )


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """`df` with running totals: `{to: ("sum" or "max", column)}`, up to and with each row of its group in `order`.

    As in `numbered`, a group of any size is spread over range partitions: each has totals of its own, and
    what comes before a partition is known from one row for each group and partition. Nulls do not count.
    """
    total = {"sum": F.sum, "max": F.max}
    inputs = {to: column.alias(f"_{to}") for to, (_, column) in values.items()}
    spread = df.select("*", *inputs.values()).repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    placed = cut(spread.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright(F.col("_at"), 33))
    pieces = placed.groupBy(*keys, "_p").agg(*[total[kind](f"_{to}").alias(f"_{to}") for to, (kind, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = pieces.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_p").alias("_q"),
        *[total[kind](f"_{to}").over(before).alias(f"_before_{to}") for to, (kind, _) in values.items()],
    )
    here = Window.partitionBy(*keys, "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select(
        *df.columns, "_p", *[total[kind](f"_{to}").over(here).alias(f"_own_{to}") for to, (kind, _) in values.items()]
    )
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))

    def joined(to: str, kind: str) -> Column:
        a, b = F.col(f"_own_{to}"), F.col(f"_before_{to}")
        return (F.coalesce(a + b, a, b) if kind == "sum" else F.greatest(a, b)).alias(to)

    return own.join(earlier, same).select(*df.columns, *[joined(to, kind) for to, (kind, _) in values.items()])
