"""Corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Every stage takes all rows its predecessor kept, and its decisions take effect. All but the last
return the columns of `documents`. An empty table passes through all stages.

A stage's result must be written before the next stage is called, as `run` does: that stage first deletes the
intermediate tables of the one before. Those of the last stage stay, as its result is read from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from commentloom.llm import bpe, exact, language, packing, similar, simhash, substrings
from commentloom.llm.components import least_rows, members, numbered
from commentloom.runtime import cut, drop_scope, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# The scope of the tables of the stage that ran before, by application.
_before: dict[str, str] = {}


def _freeing(stage: Stage, keep: bool = False) -> Stage:
    """`stage` with the tables of the stage before deleted first; its own are kept for good with `keep`."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        if application in _before:
            drop_scope(spark, _before.pop(application))
        own = uuid.uuid4().hex
        with scope(spark, own):
            found = stage(spark, docs, sf_dir)
        if not keep:
            _before[application] = own
        return found

    return run_stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a learned language; those without a letter go."""
    return language.accepted(docs, language.fit_with_limits(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: that with the smallest id."""
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Documents are linked by SimHash fingerprints that differ in at most three bits, and by a 5-word shingle similarity of at
    least 0.8, which three bits cannot see; the module of the latter says why.
    """
    rows = numbered(docs)
    text = f"c{docs.columns.index('text')}"
    alike = similar.groups(rows.select("row", F.col(text).alias("t")), similarity=0.8, shingle=5)
    links = simhash.groups(rows, text).unionByName(alike).where("row <> component")
    return least_rows(rows, members(links.select(F.col("row").alias("u"), F.col("component").alias("v"))), docs.columns, "doc_id")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that occur elsewhere too."""
    found = substrings.strip(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in training sequences."""
    return packing.pack(docs, bpe.default_path())


STAGES = [
    ("language", _freeing(known_language)),
    ("exact_dedup", _freeing(exact_copies)),
    ("near_dedup", _freeing(near_copies)),
    ("suffix_dedup", _freeing(repeated_passages)),
    ("packing", _freeing(packed, keep=True)),
]

#: Neither code lengths nor fingerprints, anchors and tokens can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a table before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
