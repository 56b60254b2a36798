"""Registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commentloom.llm import (
    bpe, codec, edits, exact, language, lines, neighbours, packing, runs, scoring, simhash, substrings, vafile, warc,
)
from commentloom.runtime import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.flags(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op5_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), bpe.default_path())


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents before and after personal data is replaced in them."""
    docs, path = table(spark, folder, "documents"), bpe.default_path()
    kept = cut(edits.trees(docs, path))
    return edits.recount(docs, kept, edits.redactions(docs), path)


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return codec.round_trip(table(spark, folder, "documents"), bpe.default_path())


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lines.report(lines.in_arrivals(docs), docs)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return vafile.report(vafile.whole_vectors(table(spark, folder, "embeddings")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_backoff_scores": op6_backoff_scores,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}

def _centroids_sql(rounds: int) -> str:
    """The rounds written out; inner products of integers this small are exact in double precision."""
    steps = ["""
        v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS a
              FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, a FROM v
               ORDER BY sha256('1:' || vec_id) LIMIT 16)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (SELECT r, vec_id, v.a, c, list_inner_product(v.a, v.a) - 2 * list_inner_product(v.a, m.a) + list_inner_product(m.a, m.a) AS d
                 FROM v, c{i} m),
        a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(a) AS a, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        u{i} AS (SELECT c, unnest(a) AS x, generate_subscripts(a, 1) AS j FROM a{i}),
        s{i} AS (SELECT c, j, floor(sum(x) / count(*)) AS x FROM u{i} GROUP BY c, j),
        n{i} AS (SELECT c, list(x ORDER BY j) AS a FROM s{i} GROUP BY c),
        c{i + 1} AS (SELECT o.c, coalesce(n{i}.a, o.a) AS a FROM c{i} o LEFT JOIN n{i} ON o.c = n{i}.c)""")
    digest = "sha256(array_to_string(list_transform(m.a, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))"
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, CAST(w.c AS INTEGER) AS cluster, CAST(w.d AS BIGINT) AS distance,
               CAST(sum(w.d) OVER (PARTITION BY w.c) AS BIGINT) AS cluster_inertia, CAST(sum(w.d) OVER () AS BIGINT) AS inertia,
               {digest} AS centroid_sha256
        FROM a{rounds} w JOIN c{rounds} m ON m.c = w.c"""


TWINS = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS winner FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
        FROM w""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        f AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.least AS gone FROM k LEFT JOIN c USING (key))
        SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM f GROUP BY r""",
    "op13_centroids": _centroids_sql(rounds=3),
}
