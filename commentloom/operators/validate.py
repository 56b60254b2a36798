"""Quality flags on the wide survey."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from commentloom.config import DEFAULT_QUESTIONS
from commentloom.functions.text import is_missing, is_short
from commentloom.runtime import name


def resolve_questions(configured: Sequence[str] | None = None) -> list[str]:
    return list(configured) if configured else list(DEFAULT_QUESTIONS)


def columns_like(df: DataFrame, suffix: str = "_translated") -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def flag_issues(df: DataFrame, questions: Sequence[str], min_length: int = 10) -> DataFrame:
    """Add `<q>_is_missing`, `<q>_is_short` for each question, and `total_issues`.

    Blank text is both missing and short and counts twice.
    """
    flags = []
    for q in questions:
        flags.append(is_missing(name(q)).alias(f"{q}_is_missing"))
        flags.append(is_short(name(q), min_length).alias(f"{q}_is_short"))
    flagged = df.select("*", *flags)
    generated = [f"{q}_is_{kind}" for q in questions for kind in ("missing", "short")]
    total = reduce(lambda a, b: a + b, [name(c).cast("int") for c in generated], F.lit(0))
    return flagged.withColumn("total_issues", total)


def flagged_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("total_issues") > 0)


def clean_rows(df: DataFrame, max_issues: int = 2) -> DataFrame:
    """Rows within the allowed number of issues; one or two issues are also flagged."""
    return df.where(F.col("total_issues") <= max_issues)


def issue_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("total_issues").agg(F.count("*").alias("n"))
