"""Survey files as they arrive: row-local stages unchanged, stores by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from commentloom.config import Settings
from commentloom.operators import reshape, validate
from commentloom.runtime import name, scratch
from commentloom.sources.survey import ID_COLUMNS, nulled, survey_schema


def survey_stream(spark: SparkSession, folder: str, questions: Sequence[str]) -> DataFrame:
    """New tab-separated exports in `folder`; columns in the order of the survey schema, else it fails."""
    raw = (
        spark.readStream.schema(survey_schema(questions))
        .options(sep="\t", header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
        .csv(folder)
    )
    cells = raw.select(*[nulled(name(c)).alias(c) for c in (*ID_COLUMNS, *questions)])
    return cells.withColumnsRenamed({"ResponseId": "response_id", "UserLanguage": "user_language"})


def clean_comments(survey: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Long comments of clean responses: filters and projections only, so no state."""
    limits, questions = settings.translation, settings.input.comment_cols
    flagged = validate.flag_issues(survey, questions, limits.min_comment_length)
    clean = validate.clean_rows(flagged, limits.max_allowed_issues)
    chosen = clean.select("response_id", "user_language", *[name(q) for q in questions])
    return reshape.comments(reshape.to_long(chosen, questions), limits.min_comment_length)


def enrich_batches(
    comments: DataFrame, enrich: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Run a store-backed enrichment on every micro-batch and append the result.

    A batch that is run again after a failure overwrites its own directory, and finds its
    requests in the store.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            enrich(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        comments.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
