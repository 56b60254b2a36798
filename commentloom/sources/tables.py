"""Tables between the stages: partitioned by question, columns pruned on read."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)

CLUSTER_COLUMNS = ("text", "cluster", "cluster_label")
QUESTION_NUMBER = r"^Q4\.([0-9]+)(?:_translated)?$"


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write and overwrite; a failure raises. CSV shows null as NA."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, nullValue="NA", quote='"', escape='"').csv(path)
    else:
        writer.format(fmt).save(path)


def export_per_question(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table with a directory per question, in place of a file per question."""
    writer = df.write.mode("overwrite").partitionBy("question")
    if fmt == "csv":
        writer = writer.options(header=True, nullValue="NA", quote='"', escape='"')
    writer.format(fmt).save(path)


def question_number(col: Column) -> Column:
    return F.regexp_extract(col, QUESTION_NUMBER, 1).try_cast("int")


def select_questions(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Keep the questions whose number is in the set `ids` (not a range).

    On a table partitioned by question this prunes directories.
    """
    return df.where(question_number(F.col("question")).isin([int(i) for i in ids]))


def read_clusters(spark: SparkSession, path: str) -> DataFrame | None:
    """Only the columns term tables need; None when one of them is absent.

    Questions without any text contribute no row.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as problem:
        log.error("Failed to read %s: %s", path, problem)
        return None
    absent = [c for c in CLUSTER_COLUMNS if c not in table.columns]
    if absent:
        log.warning("Skipping %s: missing columns %s", path, absent)
        return None
    keys = [c for c in ("question", "response_id") if c in table.columns]
    return table.select(*keys, *CLUSTER_COLUMNS).where(F.col("text").isNotNull())
