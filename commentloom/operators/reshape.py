"""Between the wide survey and the long comment table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from commentloom.functions.text import clean_text, is_translatable
from commentloom.runtime import name


def to_long(df: DataFrame, questions: Sequence[str], ids: Sequence[str] = ("response_id", "user_language")) -> DataFrame:
    """One row per response and question; null answers stay."""
    return df.unpivot(list(ids), [name(q) for q in questions], "question", "text")


def comments(long: DataFrame, min_length: int = 10) -> DataFrame:
    """Clean each text and keep those long enough to translate.

    The clean text passes the test inside a generator, since a filter on a
    computed column would be pushed below it and compute the text twice.
    """
    long_enough = F.filter(F.array(clean_text(F.col("text"))), lambda c: is_translatable(c, min_length))
    return long.select("*", F.explode(long_enough).alias("clean_text"))


def to_wide(
    df: DataFrame,
    questions: Sequence[str],
    value: str = "translated",
    ids: Sequence[str] = ("response_id", "user_language"),
    suffix: str = "_translated",
) -> DataFrame:
    """One row per response, one column per question.

    The question list fixes the columns, so no scan is needed to find them. A
    question answered twice by one response is an error, as `max` would hide it.
    """
    cells = []
    for q in questions:
        here = F.col("question") == q
        twice = F.raise_error(F.lit(f"a response has two rows for {q}")).cast("string")
        cells.append(
            F.when(F.count_if(here) > 1, twice)
            .otherwise(F.max(F.when(here, name(value))))
            .alias(f"{q}{suffix}")
        )
    return df.groupBy(*ids).agg(*cells)


def drop_untranslated(df: DataFrame, suffix: str = "_translated") -> DataFrame:
    """Drop rows whose every `*_translated` is null. Failed rows hold '' and stay."""
    held = [name(c).isNotNull() for c in df.columns if c.endswith(suffix)]
    return df.where(reduce(lambda a, b: a | b, held, F.lit(False)))


def blank_nulls(df: DataFrame) -> DataFrame:
    """Null becomes '' in every string column."""
    return df.select(
        *[
            F.coalesce(name(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, StringType)
            else name(f.name)
            for f in df.schema.fields
        ]
    )


def combine(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
