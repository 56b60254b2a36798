"""Registered queries: each operator over the shared tables, `(spark, folder) -> DataFrame`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from commentloom.config import DEFAULT_QUESTIONS, ClusteringSettings, TermSettings
from commentloom.functions import text as tx
from commentloom.operators import (
    cluster,
    density,
    enrich,
    kmeans,
    labels,
    layout as plane,
    neighbours,
    offline,
    reshape,
    silhouette as sil,
    terms,
    validate,
    vectors as vec,
)
from commentloom.plans import views
from commentloom.runtime import cut, drop, name, numbered, shared_folder
from commentloom.sources import store, survey, tables

Query = Callable[[SparkSession, str], DataFrame]

HASH_DIM = 64
NEIGHBOURS = 5
SMALL_BLOCK, SMALL_PASS = 16, 4
SWEEP = (2, 3, 4)
CLUSTERING = ClusteringSettings()
TERMS = TermSettings()


def _plain(df: DataFrame) -> DataFrame:
    """Column names without dots."""
    return df.select(*[name(c).alias(c.replace(".", "_")) for c in df.columns])


def _six(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _elements(df: DataFrame, column: str = "embedding") -> DataFrame:
    keys = ["question", "response_id"]
    # The outer form: for the inner one a filter is inferred that computes the array again.
    rows = df.select(*keys, F.posexplode_outer(column).alias("position", "value"))
    return rows.where(F.col("position").isNotNull()).select(
        *keys, (F.col("position") + 1).alias("position"), _six("value")
    )


# ---- validation ---------------------------------------------------------


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return validate.flag_issues(views.survey(spark, folder), DEFAULT_QUESTIONS)


def issue_distribution(spark, folder):
    return validate.issue_distribution(_flagged(spark, folder))


def flag_issues(spark, folder):
    return _plain(_flagged(spark, folder).drop(*DEFAULT_QUESTIONS))


def flagged(spark, folder):
    return _plain(validate.flagged_rows(_flagged(spark, folder)).select("response_id", name("Q4.2"), "total_issues"))


def clean(spark, folder):
    return _plain(validate.clean_rows(_flagged(spark, folder)).select("response_id", name("Q4.2"), "total_issues"))


# ---- reshaping ----------------------------------------------------------


def survey_long(spark, folder):
    return views.survey_long(spark, folder)


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.comments(views.survey_long(spark, folder))


def comments_long(spark, folder):
    return _comments(spark, folder).select("response_id", "user_language", "question", "clean_text")


def question_filter(spark, folder):
    chosen = tables.select_questions(_comments(spark, folder), TERMS.question_ids)
    return chosen.select("response_id", "question", "clean_text")


def distinct_texts(spark, folder):
    return _comments(spark, folder).select("clean_text").distinct()


def row_ids(spark, folder):
    return numbered(
        _comments(spark, folder).select("question", "response_id"), "question", ["response_id"], "row_id"
    )


def turns_union(spark, folder):
    """Answers of two sources appended by name; a column one of them lacks is null."""
    survey = _comments(spark, folder).select("response_id", "user_language", "question", "text")
    turns = views.turns(spark, folder).withColumn("response_id", F.col("response_id").cast("string"))
    return reshape.combine([survey, turns])


# ---- enrichment ---------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return views.texts(spark, folder).select(
        "doc_id", F.col("lang").alias("user_language"), tx.clean_text(F.col("text")).alias("clean_text")
    )


def _with_language(df: DataFrame) -> DataFrame:
    return enrich.with_source_language(enrich.detect_language(df))


def detect_language(spark, folder):
    return _with_language(_documents(spark, folder)).select("doc_id", "detected_lang", "source_lang")


def translate_glossary(spark, folder):
    done = enrich.translate_glossary(_with_language(_documents(spark, folder)))
    return done.select("doc_id", "source_lang", "translated")


def _store(spark: SparkSession, provider) -> store.ResultStore:
    """An empty store in the shared folder."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    return store.ResultStore(spark, folder, provider.provider_id, StringType())


def detect_stored(spark, folder):
    """Detection by a provider and a result store; the second run finds all results."""
    provider, docs = offline.WordListDetector(), cut(_documents(spark, folder))
    held = _store(spark, provider)
    enrich.detect_with(docs, provider, held)
    done = enrich.with_source_language(enrich.detect_with(docs, provider, held))
    return done.select("doc_id", "detected_lang", "source_lang")


def translate_stored(spark, folder):
    """Translation by a provider, in batches of one language, through a result store."""
    provider, docs = offline.GlossaryTranslator(), cut(_with_language(_documents(spark, folder)))
    done = enrich.translate_with(docs, provider, _store(spark, provider))
    return done.select("doc_id", "source_lang", "translated")


def survey_scan(spark, folder):
    """The survey written as a tab-separated export and read back by the survey scan."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = views.survey(spark, folder).withColumnsRenamed({"response_id": "ResponseId", "user_language": "UserLanguage"})
    rows.write.options(sep="\t", header=True, quote='"', escape='"', nullValue="NA", emptyValue="").csv(path)
    return _plain(survey.read_files(spark, path, DEFAULT_QUESTIONS))


def survey_parts(spark, folder):
    """The survey as two exports that differ in charset and column order, each file with two label rows."""
    rows = views.survey(spark, folder).withColumnsRenamed({"response_id": "ResponseId", "user_language": "UserLanguage"})
    base = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    odd = F.crc32("ResponseId") % 2 == 1
    paths = []
    for part, encoding, order in ((~odd, "UTF-8", rows.columns), (odd, "UTF-16", rows.columns[::-1])):
        paths.append(f"{base}/{encoding}")
        some = _with_label_rows(rows.where(part).select(*[name(c) for c in order]))
        some.write.options(sep="\t", header=True, quote='"', escape='"', nullValue="NA", emptyValue="", encoding=encoding).csv(paths[-1])
    return _plain(survey.read_files(spark, paths, DEFAULT_QUESTIONS, label_rows=2))


def _with_label_rows(rows: DataFrame) -> DataFrame:
    """Two rows of labels before the rows of each task, which become a file."""
    label = F.struct(*[F.lit("label").alias(c) for c in rows.columns])
    own = F.struct(*[name(c) for c in rows.columns])
    # The lower 33 bits count the rows of a task.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return rows.withColumn("_first", first).select(F.inline(F.when(F.col("_first"), F.array(label, label, own)).otherwise(F.array(own))))


def question_columns(spark, folder):
    """Configured questions in their order, and the translated columns by their names."""
    chosen = validate.resolve_questions(["Q4.10", "Q4.3"])
    rows = views.survey(spark, folder).select("response_id", *[name(c) for c in chosen])
    translated = rows.select("response_id", *[tx.clean_text(name(c)).alias(f"{c}_translated") for c in chosen], F.lit(1).alias("other"))
    return _plain(translated.select("response_id", *[name(c) for c in validate.columns_like(translated)]))


def question_files(spark, folder):
    """Comments exported with a directory per question; the scan reads the chosen ones."""
    path = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    tables.export_per_question(_comments(spark, folder), path)
    chosen = tables.select_questions(spark.read.parquet(path), TERMS.question_ids)
    return chosen.select("response_id", "question", "clean_text")


def translated_wide(spark, folder):
    """Survey to English, end to end: unpivot, clean, detect, translate, pivot, null rules."""
    done = enrich.translate_glossary(_with_language(_comments(spark, folder)))
    wide = reshape.to_wide(done, DEFAULT_QUESTIONS)
    return _plain(reshape.blank_nulls(reshape.drop_untranslated(wide)))


def store_missing(spark, folder):
    """Texts without a stored result, the texts of labelled documents being stored."""
    keyed = views.texts(spark, folder).select("doc_id", "text", tx.request_key(F.col("text")).alias("request_key"))
    stored = keyed.join(views.read(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    requests = keyed.groupBy("request_key").agg(F.min("doc_id").alias("doc_id"))
    return store.missing(requests, stored.select("request_key").distinct(), ["request_key"]).select("doc_id")


def embed_hash(spark, folder):
    done = enrich.embed_hashed(views.texts(spark, folder), HASH_DIM)
    rows = done.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "value"))
    return rows.where(F.col("value") != 0).select("doc_id", "bucket", _six("value"))


def embedding_summary(spark, folder):
    answers = views.survey_long(spark, folder)
    return enrich.embedding_summary(enrich.embed_hashed(answers, HASH_DIM))


def parse_predictions(spark, folder):
    """Raw responses with either spelling of the field, and with none."""
    held = F.struct(F.col("embedding").alias("values"))
    one = "struct<embedding:struct<values:array<double>>,embeddings:struct<values:array<double>>>"
    none = F.lit(None).cast("struct<values:array<double>>")
    spellings = F.array(*[F.struct(a, b).cast(one) for a, b in ((held, none), (none, held), (none, none))])
    raw = views.vectors(spark, folder).select(
        "response_id", F.to_json(F.struct(spellings.alias("predictions"))).alias("response")
    )
    parsed = enrich.parse_predictions(raw, dim=HASH_DIM)
    present = F.filter("embedding", lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda s, x: s + x)
    return parsed.select(
        "response_id", "position", F.size("embedding").alias("width"), F.size(present).alias("present"),
        F.round(total, 5).alias("total"),
    )


# ---- vectors ------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vec.enough_docs(vec.valid_vectors(views.vectors(spark, folder)), CLUSTERING.min_docs)


def valid_vectors(spark, folder):
    return _vectors(spark, folder).groupBy("question").agg(F.count("*").alias("valid_rows"))


def standardise(spark, folder):
    return _elements(vec.standardise(_vectors(spark, folder)))


def pca_scores(spark, folder):
    return _elements(vec.reduce_dimensions(cut(_vectors(spark, folder)), CLUSTERING.pca_dims))


def enough_vectors(spark, folder):
    """Valid vectors per question, where some vectors are gaps and one question is too small."""
    rows = vec.enough_docs(vec.valid_vectors(views.gapped_vectors(spark, folder)), CLUSTERING.min_docs)
    return rows.groupBy("question").agg(F.count("*").alias("valid_rows"))


def pca_gram(spark, folder):
    """Inner products of full-rank scores, which are those of the standardised vectors."""
    scores = cut(vec.reduce_dimensions(cut(_vectors(spark, folder)), HASH_DIM).select("question", "response_id", "embedding"))
    first = scores.groupBy("question").agg(F.min_by("embedding", "response_id").alias("first"))

    def product(other: str) -> Column:
        pairs = F.zip_with("embedding", other, lambda x, y: x * y)
        return F.round(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x), 5)

    return scores.join(first, "question").select(
        "question", "response_id", product("embedding").alias("squared"), product("first").alias("with_first")
    )


def knn_blocked(spark, folder):
    near = neighbours.knn(_vectors(spark, folder), NEIGHBOURS, SMALL_BLOCK)
    return near.select("question", "response_id", "rank", "neighbour_id", _six("distance"))


def knn(spark, folder):
    near = neighbours.knn(_vectors(spark, folder), NEIGHBOURS)
    return near.select("question", "response_id", "rank", "neighbour_id", _six("distance"))


def core_distance(spark, folder):
    near = neighbours.knn(_vectors(spark, folder), CLUSTERING.min_pts - 1)
    return neighbours.core_distances(near, CLUSTERING.min_pts).select("question", "response_id", _six("core"))


def mutual_reachability(spark, folder):
    near = cut(neighbours.knn(_vectors(spark, folder), NEIGHBOURS))
    core = neighbours.core_distances(near, CLUSTERING.min_pts)
    return neighbours.mutual_reachability(near, core).select(
        "question", "response_id", "neighbour_id", _six("reachability")
    )


def spanning_tree(spark, folder):
    edges = density.spanning_tree(cut(_vectors(spark, folder)), CLUSTERING)
    return edges.select("question", "lo", "hi", _six("weight"))


def spanning_tree_blocked(spark, folder):
    settings = replace(CLUSTERING, block_rows=SMALL_BLOCK, tree_limit=0)
    edges = density.spanning_tree(cut(_vectors(spark, folder)), settings)
    return edges.select("question", "lo", "hi", _six("weight"))


def hdbscan(spark, folder):
    return density.hdbscan(_vectors(spark, folder), CLUSTERING)


def only_noise(spark, folder):
    """Whether label 0 is the only label of a question."""
    return cluster.only_noise(_vectors(spark, folder))


def silhouette(spark, folder):
    return sil.silhouette(_vectors(spark, folder), CLUSTERING.pair_rows).select("question", _six("silhouette"))


def silhouette_blocked(spark, folder):
    scores = sil.silhouette(_vectors(spark, folder), SMALL_BLOCK, SMALL_PASS)
    return scores.select("question", _six("silhouette"))


def kmeans_pass(spark, folder):
    """One pass from the first three vectors of each question."""
    rows = cut(_vectors(spark, folder).select("question", "response_id", "embedding"))
    sums = kmeans.first_pass(rows, 3)
    return sums.select("question", "cluster", "n", F.round("cost", 5).alias("cost"))


def kmeans_best_k(spark, folder):
    rows = cut(_vectors(spark, folder).select("question", "response_id", "embedding"))
    _, best = cluster.choose_k(rows, CLUSTERING)
    return best.select("question", "k", _six("silhouette"))


def clusters(spark, folder):
    found, _ = cluster.cluster(_vectors(spark, folder), CLUSTERING)
    return found


def _document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the answer to a question."""
    return views.texts(spark, folder).select(
        F.concat(F.lit("Q4."), 2 + F.col("doc_id") % 9).alias("question"), F.col("doc_id").alias("response_id"), "text"
    )


def cluster_summary(spark, folder):
    """Clusters of all documents by their hashed vectors, labelled by their texts."""
    documents = _document_texts(spark, folder)
    vectors = cut(enrich.embed_hashed(documents, HASH_DIM).drop("text"))
    found, methods = cluster.cluster(vectors, CLUSTERING)
    drop(vectors)
    # The texts are read again, and not kept with the vectors.
    named = labels.label_clusters(found.join(documents, ["question", "response_id"]))
    return labels.cluster_summary(named, methods)


def _swept(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes of labels with 2, 3 and 4 clusters that follow from each vector's first component."""
    rows = _vectors(spark, folder)
    digits = F.floor(F.abs(F.element_at("embedding", 1)) * 10000).cast("int")
    labelled = rows.select(
        "question", "response_id", "embedding", F.array(*[F.lit(k) for k in SWEEP]).alias("ks"),
        F.array(*[digits % k + 1 for k in SWEEP]).alias("labels"),
    )
    return sil.sweep(labelled, CLUSTERING.pair_rows)


def silhouette_sweep(spark, folder):
    return _swept(spark, folder).select("question", "k", _six("silhouette"))


def best_k(spark, folder):
    """The k with the highest score of each question."""
    return cluster.best_k(_swept(spark, folder)).select("question", "k", _six("silhouette"))


def neighbour_weights(spark, folder):
    """Weights of the edges that the layout follows."""
    near = neighbours.knn(_vectors(spark, folder), CLUSTERING.n_neighbors)
    weights = plane.neighbour_weights(near, CLUSTERING.n_neighbors)
    return weights.select("question", "response_id", "neighbour_id", F.round("weight", 4).alias("weight"))


def layout(spark, folder):
    return plane.layout(_vectors(spark, folder), CLUSTERING)


# ---- labels and terms ---------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return labels.tf_idf(labels.cluster_words(views.labelled(spark, folder)))


def cluster_tf_idf(spark, folder):
    return _scored(spark, folder).select("question", "cluster", "word", "n", _six("tf_idf"))


def cluster_keywords(spark, folder):
    top = labels.top_keywords(_scored(spark, folder))
    return top.select("question", "cluster", "rank", "word", "n", _six("tf_idf"))


def cluster_labels(spark, folder):
    return labels.label_clusters(views.labelled(spark, folder))


def cluster_assignments(spark, folder):
    rows = views.labelled(spark, folder)
    named = labels.assignments(rows, labels.label_clusters(rows))
    return named.select("question", "response_id", "cluster", "cluster_label")


def sanitised_text(spark, folder):
    """Markup removed from raw pages."""
    return views.read(spark, folder, "pages").select("page_id", tx.sanitize(F.col("html")).alias("text"))


def term_table(spark, folder):
    table = terms.term_table(views.survey_long(spark, folder), TERMS)
    return table.select("question", "rank", "term", "freq_sum", _six("weight"))


def term_table_first_seen(spark, folder):
    """Ties by first appearance in the order of the responses."""
    table = terms.term_table(views.survey_long(spark, folder), replace(TERMS, ties=terms.FIRST_SEEN))
    return table.select("question", "rank", "term", "freq_sum")


def term_style(spark, folder):
    table = terms.term_style(terms.term_table(views.survey_long(spark, folder), TERMS), TERMS)
    return table.select("question", "rank", "term", "angle", "color")


def term_audit(spark, folder):
    return terms.term_audit(views.survey_long(spark, folder), TERMS)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        issue_distribution, flag_issues, flagged, clean,
        survey_long, comments_long, question_filter, distinct_texts, row_ids, turns_union,
        detect_language, translate_glossary, translated_wide, store_missing,
        detect_stored, translate_stored, survey_scan, survey_parts, question_columns, question_files,
        embed_hash, embedding_summary, parse_predictions,
        valid_vectors, enough_vectors, standardise, pca_scores, pca_gram, knn, knn_blocked, silhouette_blocked, kmeans_pass, core_distance, mutual_reachability,
        spanning_tree, spanning_tree_blocked, hdbscan, only_noise, silhouette, silhouette_sweep, best_k, kmeans_best_k, clusters, cluster_summary, neighbour_weights, layout,
        cluster_tf_idf, cluster_keywords, cluster_labels, cluster_assignments,
        sanitised_text, term_table, term_table_first_seen, term_style, term_audit,
    )
}
