"""The shared tables seen as survey data. All rows and whole texts take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from commentloom.config import DEFAULT_QUESTIONS
from commentloom.operators.reshape import to_long

PER_PAGE = len(DEFAULT_QUESTIONS)
SPREAD_BYTES = 256 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A shared table. One of a few splits and bounded size is spread over the cores.

    Files of one row group cannot be split, so a small table would be read by one task; a table
    beyond `SPREAD_BYTES` is never shuffled for it, whatever the number of cores.
    """
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as survey responses: every nine lines of a document are one response.

    Line i of a page answers question i; absent lines are null.
    """
    # Split once, below the generator, and not again for every page.
    documents = read(spark, folder, "documents").select("doc_id", "lang", F.split("text", "\n", -1).alias("lines"))
    lines = F.col("lines")
    pages = F.transform(
        F.sequence(F.lit(0), F.expr(f"(size(lines) - 1) div {PER_PAGE}").cast("int")),
        lambda p: F.struct(p.alias("page"), F.slice(lines, p * PER_PAGE + 1, PER_PAGE).alias("answers")),
    )
    rows = documents.select("doc_id", "lang", F.inline(pages))
    return rows.select(
        F.concat_ws("-", "doc_id", "page").alias("response_id"),
        F.col("lang").alias("user_language"),
        *[F.get("answers", F.lit(i)).alias(q) for i, q in enumerate(DEFAULT_QUESTIONS)],
    )


def survey_long(spark: SparkSession, folder: str) -> DataFrame:
    return to_long(survey(spark, folder), DEFAULT_QUESTIONS)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as answers: turn n answers question Tn."""
    return read(spark, folder, "conversations").select(
        F.col("conv_id").alias("response_id"), F.concat(F.lit("T"), "turn").alias("question"), "text"
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "lang", "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings spread over the nine questions."""
    return read(spark, folder, "embeddings").select(
        F.concat(F.lit("Q4."), 2 + F.col("vec_id") % 9).alias("question"),
        F.col("vec_id").alias("response_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("cluster"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the label of their vector as cluster; label 0 plays noise.

    Those without a vector take the last digit of their id.
    """
    documents = read(spark, folder, "documents").select(F.col("doc_id").alias("response_id"), "text")
    labels = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("response_id"), F.col("label").alias("cluster")
    )
    question = F.concat(F.lit("Q4."), 2 + F.col("response_id") % 9)
    known = F.coalesce("cluster", (F.col("response_id") % 10).cast("int"))
    return documents.join(labels, "response_id", "left").withColumn("cluster", known).withColumn("question", question)


def gapped_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of which every seventh has null components only, with a question of two rows."""
    gap = F.transform("embedding", lambda x: F.lit(None).cast("double"))
    return vectors(spark, folder).select(
        F.when(F.col("response_id") < 2, F.lit("Q4.1")).otherwise(F.col("question")).alias("question"),
        "response_id",
        F.when(F.col("response_id") % 7 == 3, gap).otherwise(F.col("embedding")).alias("embedding"),
    )
