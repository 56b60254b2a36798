"""Vectors per question: valid rows, standard scores, principal components.

Rows are `question, response_id, embedding array<double>`. A question is one
column of a survey, so tables with one row per question stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from commentloom.runtime import cut

# Partial sums that one task merges at a time.
FAN_IN = 16


def id_type(df: DataFrame) -> str:
    return df.schema["response_id"].dataType.simpleString()


def valid_vectors(df: DataFrame) -> DataFrame:
    """Vectors with at least one component; the others stand for missing text."""
    return df.where(F.exists("embedding", lambda x: x.isNotNull()))


def enough_docs(df: DataFrame, min_docs: int = 5) -> DataFrame:
    """Drop the questions with fewer than `min_docs` rows."""
    large = df.groupBy("question").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    return df.join(F.broadcast(large.select("question")), "question", "left_semi")


def moments(df: DataFrame) -> DataFrame:
    """`question, n, mean, sd`: one row per question, sample deviation."""
    summary = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col("embedding")))
    return df.groupBy("question").agg(summary.alias("s")).select(
        "question",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.std").alias("sd"),
    )


def standardise(df: DataFrame) -> DataFrame:
    """Centre and divide by the sample deviation, per question; 0 where it is 0."""
    partial = F.exists("embedding", lambda x: x.isNull())
    whole = F.when(
        partial, F.raise_error(F.lit("a vector has some null components")).cast("array<double>")
    ).otherwise(F.col("embedding"))
    checked = df.withColumn("embedding", whole)
    joined = checked.join(F.broadcast(moments(checked)), "question")
    centred = F.zip_with("embedding", "mean", lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("sd"), lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    return joined.withColumn("embedding", scaled).drop("n", "mean", "sd")


def principal_components(z: DataFrame, dims: int = 50) -> DataFrame:
    """`question, component, weights, variance` of standardised vectors.

    One pass over the data for all questions: each task adds up its outer
    products, the sums are merged by a tree of tasks of 16 inputs each, and the
    small symmetric matrix of a question is decomposed in one task. The largest
    weight of every component is positive, which fixes its sign.
    """
    def products(q: str, x: np.ndarray) -> np.ndarray:
        return np.append((x.T @ x).ravel(), len(x))

    sums = summed(z.select("question", "embedding"), products)

    def decompose(rows: pd.DataFrame) -> pd.DataFrame:
        totals = np.asarray(rows["totals"].iloc[0])
        n, width = int(totals[-1]), round(np.sqrt(len(totals) - 1))
        products = totals[:-1].reshape(width, width)
        k = min(dims, products.shape[0], n)
        variance, axes = np.linalg.eigh(products / max(n - 1, 1))
        best = np.argsort(-variance, kind="stable")[:k]
        axes, variance = axes[:, best], np.clip(variance[best], 0.0, None)
        peak = np.abs(axes).argmax(axis=0)
        axes = axes * np.where(axes[peak, np.arange(k)] < 0, -1.0, 1.0)
        return pd.DataFrame(
            {
                "question": rows["question"].iloc[0],
                "component": np.arange(1, k + 1, dtype=np.int32),
                "weights": list(axes.T),
                "variance": variance,
            }
        )

    return sums.groupBy("question").applyInPandas(
        decompose, "question string, component int, weights array<double>, variance double"
    )


def reduce_dimensions(df: DataFrame, dims: int = 50) -> DataFrame:
    """Principal component scores of the standardised vectors, per question.

    The fitted weights (dims x width numbers per question) travel to the tasks.
    """
    z = cut(standardise(df))
    fitted = principal_components(z, dims).orderBy("question", "component").collect()
    weights: dict[str, list] = {}
    for row in fitted:
        weights.setdefault(row["question"], []).append(row["weights"])
    axes = {q: np.asarray(w).T for q, w in weights.items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for q, rows in _by_question(batch):
                vectors = batch.column("embedding").take(rows)
                scores = weighted(vectors.flatten().to_numpy().reshape(len(rows), -1), axes[q])
                at.append(rows.to_numpy())
                parts.append(listed(scores, batch.schema.field("embedding").type))
            if parts:
                back = pa.array(np.argsort(np.concatenate(at)))
                column = pa.concat_arrays(parts).take(back)
                yield batch.set_column(batch.schema.get_field_index("embedding"), batch.schema.field("embedding"), column)

    return z.mapInArrow(project, z.schema)


def _by_question(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Each question of a batch with the places of its rows."""
    questions = batch.column("question").to_pandas()
    for q, at in questions.groupby(questions).indices.items():
        yield q, pa.array(at)


def weighted(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """`x @ axes`, summed in the order of the components.

    A matrix product may add in another order for another number of rows; here equal
    vectors have equal scores in whatever batch they come.
    """
    scores = np.zeros((len(x), axes.shape[1]))
    for component, weights in zip(x.T, axes):
        scores += component[:, None] * weights
    return scores


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array with the rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), type=kind)


def summed(df: DataFrame, numbers: Callable[[str, np.ndarray], np.ndarray]) -> DataFrame:
    """`question, totals`: summed `numbers(question, matrix)` over the vectors of a question.

    Each task adds up its own rows; a tree of tasks with 16 inputs each merges
    the partial sums, so that no task holds the sums of all others. `df` should be
    materialised: its number of tasks is asked for, which would run the exchanges of a longer plan.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for q, at in batch.groupby("question").indices.items():
                more = numbers(q, np.vstack(batch["embedding"].to_numpy()[at]))
                totals[q] = totals[q] + more if q in totals else more
        slot = TaskContext.get().partitionId()
        for q, total in totals.items():
            yield pd.DataFrame({"question": [q], "slot": [slot], "totals": [total]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = rows["totals"].iloc[0].copy()
        for more in rows["totals"].iloc[1:]:
            total += more
        return rows.iloc[:1].assign(totals=[total])

    schema = "question string, slot int, totals array<double>"
    sums = df.mapInPandas(add, schema)
    # As many merge steps as the number of tasks needs: none for one task.
    inputs = df.rdd.getNumPartitions()
    while inputs > 1:
        inputs = -(-inputs // FAN_IN)
        sums = (
            sums.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int"))
            .groupBy("question", "slot")
            .applyInPandas(merge, schema)
        )
    return sums.select("question", "totals")
