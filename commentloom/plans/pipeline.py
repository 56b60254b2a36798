"""The stages from a survey export to themes and term tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from commentloom.config import Settings
from commentloom.operators import cluster, enrich, labels, layout, reshape, terms, validate
from commentloom.operators.providers import BatchProvider
from commentloom.operators.vectors import valid_vectors
from commentloom.runtime import cut, numbered, scratch
from commentloom.sources import survey as source, tables
from commentloom.sources.store import ResultStore

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Services:
    """Providers in place of the offline ones, and the folder of their result stores."""

    detector: BatchProvider | None = None
    translator: BatchProvider | None = None
    embedder: BatchProvider | None = None
    store_folder: str | None = None

    def store(self, spark: SparkSession, kind: str, provider: BatchProvider, value_type) -> ResultStore:
        if not self.store_folder:
            raise ValueError("a provider needs a store folder")
        return ResultStore(spark, f"{self.store_folder}/{kind}", provider.provider_id, value_type)


def load(spark: SparkSession, path: str, settings: Settings = Settings(), encoding: str | None = None) -> DataFrame:
    """The survey exports at `path`, each file in its own charset unless one is given for all."""
    questions = validate.resolve_questions(settings.input.comment_cols)
    label_rows = settings.input.label_rows if settings.input.drop_label_rows else 0
    if encoding is None:
        raw = source.read_files(spark, path, questions, label_rows)
    else:
        raw = source.read_survey(spark, path, questions, encoding, label_rows)
    return raw.withColumnsRenamed({"ResponseId": "response_id", "UserLanguage": "user_language"})


def check(survey: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged rows, clean rows and the distribution of issues."""
    limits = settings.translation
    flagged = validate.flag_issues(survey, settings.input.comment_cols, limits.min_comment_length)
    return (
        validate.flagged_rows(flagged),
        validate.clean_rows(flagged, limits.max_allowed_issues),
        validate.issue_distribution(flagged),
    )


def translate(clean: DataFrame, settings: Settings = Settings(), services: Services = Services()) -> DataFrame:
    """Wide table `response_id, user_language, <question>_translated`."""
    spark, questions = clean.sparkSession, settings.input.comment_cols
    chosen = clean.select("response_id", "user_language", *[F.col(f"`{q}`") for q in questions])
    comments = reshape.comments(reshape.to_long(chosen, questions), settings.translation.min_comment_length)
    rows = Observation("comments")
    comments = comments.observe(rows, F.count(F.lit(1)).alias("rows"))
    if services.detector:
        store = services.store(spark, "languages", services.detector, StringType())
        detected = enrich.detect_with(cut(comments), services.detector, store, retry=settings.retry)
    else:
        detected = enrich.detect_language(comments)
    sourced = enrich.with_source_language(detected)
    if services.translator:
        store = services.store(spark, "translations", services.translator, StringType())
        done = enrich.translate_with(
            cut(sourced), services.translator, store, settings.translation.batch_size, retry=settings.retry,
            target=settings.translation.target,
        )
    else:
        done = enrich.translate_glossary(sourced)
    final = Observation("responses")
    wide = reshape.blank_nulls(reshape.drop_untranslated(reshape.to_wide(done, questions)))
    wide = cut(wide.observe(final, F.count(F.lit(1)).alias("rows")))
    log.info("Rows to process: %s; final rows: %s", rows.get["rows"], final.get["rows"])
    return wide


def embed(translated: DataFrame, settings: Settings = Settings(), services: Services = Services()) -> DataFrame:
    """`question, response_id, row_id, text, embedding`, a row per response and question."""
    columns = validate.columns_like(translated)
    if chosen := settings.clustering.embedding_columns:
        columns = [c for c in columns if c in chosen or c.removesuffix("_translated") in chosen]
    long = reshape.to_long(translated, columns).withColumn(
        "question", F.regexp_replace("question", "_translated$", "")
    )
    rows = numbered(long.select("question", "response_id", "text"), "question", ["response_id"], "row_id")
    if not services.embedder:
        return enrich.embed_hashed(rows, settings.embeddings.expected_dim)
    store = services.store(rows.sparkSession, "vectors", services.embedder, ArrayType(DoubleType()))
    return enrich.embed_with(
        rows, services.embedder, store, settings.embeddings.batch_size, settings.embeddings.expected_dim,
        retry=settings.retry,
    )


def themes(embedded: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Cluster tables `question, response_id, text, cluster, cluster_label`, and the summary."""
    found, methods = cluster.cluster(embedded, settings.clustering)
    texts = valid_vectors(embedded).select("question", "response_id", "text")
    rows = cut(found.join(texts, ["question", "response_id"]))
    named = cut(labels.label_clusters(rows))
    return labels.assignments(rows, named), labels.cluster_summary(named, methods)


def clouds(assigned: DataFrame, settings: Settings = Settings(), by_cluster: bool = False) -> tuple[DataFrame, DataFrame]:
    """Styled term table and its audit for the chosen questions, over all clusters.

    With `by_cluster`, each cluster of a question has a term table of its own.
    """
    chosen = tables.select_questions(assigned, settings.terms.question_ids)
    if by_cluster:
        return terms.term_tables_by_cluster(chosen, settings.terms), terms.term_audit(chosen, settings.terms)
    table = terms.term_table(chosen, settings.terms)
    return terms.term_style(table, settings.terms), terms.term_audit(chosen, settings.terms)


def run(
    spark: SparkSession,
    path: str,
    output: str,
    settings: Settings = Settings(),
    services: Services = Services(),
    encoding: str | None = None,
    with_layout: bool = False,
) -> None:
    """All stages, each written under `output` and read back by the next.

    A stage's own tables in the shared folder go when it is written.
    """
    with scratch(spark):
        flagged, clean, issues = check(cut(load(spark, path, settings, encoding)), settings)
        for name, df in (("flagged", flagged), ("clean", clean), ("issues", issues)):
            tables.write_table(df, f"{output}/{name}")
    with scratch(spark):
        translated = translate(spark.read.parquet(f"{output}/clean"), settings, services)
        tables.write_table(translated, f"{output}/translated")
    with scratch(spark):
        embedded = embed(spark.read.parquet(f"{output}/translated"), settings, services)
        tables.export_per_question(embedded, f"{output}/embeddings")
    embedded = spark.read.schema(embedded.schema).parquet(f"{output}/embeddings")
    tables.write_table(enrich.embedding_summary(embedded), f"{output}/embedding_summary")
    with scratch(spark):
        assigned, summary = themes(embedded, settings)
        tables.export_per_question(assigned, f"{output}/clusters")
        tables.write_table(summary, f"{output}/cluster_summary")
    if with_layout:
        with scratch(spark):
            named = spark.read.schema(assigned.schema).parquet(f"{output}/clusters")
            points = layout.labelled(layout.layout(embedded, settings.clustering), named)
            tables.export_per_question(points, f"{output}/layout")
    held = tables.read_clusters(spark, f"{output}/clusters")
    if held is not None:
        with scratch(spark):
            styled, audit = clouds(held, settings)
            tables.write_table(styled, f"{output}/terms")
            tables.write_table(audit, f"{output}/term_audit")
