"""SQL with the same results as the registered queries, for an independent engine."""

from __future__ import annotations

from commentloom.config import DEFAULT_QUESTIONS, TermSettings
from commentloom.functions import text as tx, wordlists
from commentloom.plans.catalog import CLUSTERING, HASH_DIM, NEIGHBOURS, SWEEP, TERMS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in row) + ")" for row in rows
    )


def _trim(column: str) -> str:
    return f"regexp_replace({column}, {_text(tx.EDGE_SPACE)}, '', 'g')"


def _clean(column: str) -> str:
    breaks = "'[' || chr(13) || chr(10) || ']'"
    return _trim(f"regexp_replace({column}, {breaks}, ' ', 'g')")


def _sanitised(column: str) -> str:
    return _trim(f"lower(regexp_replace({column}, {_text(tx.MARKUP)}, ' ', 'g'))")


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {_text(tx.WORD)}, 0)"


def _terms(column: str) -> str:
    return f"regexp_extract_all({column}, {_text(tx.TERM)}, 0)"


_COLUMNS = ", ".join(f'l[page * 9 + {i + 1}] AS "{q}"' for i, q in enumerate(DEFAULT_QUESTIONS))
PAGES = """
lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
pages_of AS (SELECT doc_id, lang, l, unnest(generate_series(0, (len(l) - 1) // 9)) AS page FROM lines)
"""
SURVEY = PAGES + f""",
survey AS (SELECT doc_id || '-' || page AS response_id, lang AS user_language, {_COLUMNS} FROM pages_of)
"""
LONG = PAGES + """,
long AS (
  SELECT doc_id || '-' || page AS response_id, lang AS user_language, 'Q4.' || (i + 2) AS question,
         l[page * 9 + i + 1] AS text
  FROM pages_of, generate_series(0, 8) AS g(i)
)
"""
COMMENTS = LONG + f""",
comments AS (
  SELECT * FROM (SELECT *, {_clean('text')} AS clean_text FROM long) WHERE length(clean_text) >= 10
)
"""


def _flag(q: str, kind: str) -> str:
    if kind == "missing":
        return f"""("{q}" IS NULL OR {_trim(f'"{q}"')} = '')"""
    return f"""("{q}" IS NOT NULL AND length("{q}") < 10)"""


_FLAGS = [(q, kind) for q in DEFAULT_QUESTIONS for kind in ("missing", "short")]
_TOTAL = " + ".join(f"CAST({_flag(q, k)} AS INTEGER)" for q, k in _FLAGS)
FLAGGED = SURVEY + f", flags AS (SELECT *, {_TOTAL} AS total_issues FROM survey)"

DOCUMENTS = f"docs AS (SELECT doc_id, lang AS user_language, {_clean('text')} AS clean_text FROM documents)"


def _detected(source: str, key: str) -> str:
    """CTEs that add detected_lang and source_lang to `source` by its `key` columns."""
    weights = [
        (word, lang, weight)
        for lang, listed in wordlists.language_weights().items()
        for word, weight in listed.items()
    ]
    return f"""
profile(word, lang, weight) AS (VALUES {_values(weights)}),
spoken AS (SELECT {key}, unnest({_words('clean_text')}) AS word FROM {source}),
scored AS (SELECT {key}, lang, sum(weight) AS score FROM spoken JOIN profile USING (word) GROUP BY {key}, lang),
first_lang AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang) AS r FROM scored) WHERE r = 1
),
detected AS (SELECT s.*, coalesce(f.lang, '') AS detected_lang FROM {source} s LEFT JOIN first_lang f USING ({key})),
sourced AS (
  SELECT *, CASE WHEN clean_text IS NULL OR clean_text = '' THEN NULL WHEN detected_lang = '' THEN user_language
                 WHEN user_language IS NULL THEN NULL ELSE detected_lang END AS source_lang
  FROM detected
)
"""


def _translated(key: str) -> str:
    entries = [
        (lang, word, english) for lang, listed in wordlists.GLOSSARY.items() for word, english in listed.items()
    ]
    return f"""
glossary(source_lang, word, english) AS (VALUES {_values(entries)}),
tokens AS (
  SELECT {key}, source_lang, unnest({_words('clean_text')}) AS word,
         generate_subscripts({_words('clean_text')}, 1) AS place
  FROM sourced WHERE source_lang IS NOT NULL
),
joined AS (
  SELECT {key}, string_agg(coalesce(english, word), ' ' ORDER BY place) AS said
  FROM tokens LEFT JOIN glossary USING (source_lang, word) GROUP BY {key}
),
translated AS (
  SELECT s.*, CASE WHEN s.source_lang IS NOT NULL THEN coalesce(said, '') END AS translated
  FROM sourced s LEFT JOIN joined USING ({key})
)
"""


VECTORS = """
vectors AS (
  SELECT 'Q4.' || (2 + vec_id % 9) AS question, vec_id AS response_id, embedding::DOUBLE[] AS embedding,
         label AS cluster
  FROM embeddings
),
valid AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY question) AS n_q FROM vectors) WHERE n_q >= 5
)
"""
PAIRS = VECTORS + """,
pairs AS (
  SELECT a.question, a.response_id, b.response_id AS neighbour_id, list_distance(a.embedding, b.embedding) AS distance
  FROM valid a JOIN valid b ON a.question = b.question AND a.response_id <> b.response_id
),
near AS (
  SELECT *, row_number() OVER (PARTITION BY question, response_id ORDER BY distance, neighbour_id) AS rank FROM pairs
)
"""
CORE = PAIRS + f""",
cores AS (
  SELECT question, response_id, max(distance) AS core FROM near WHERE rank <= {CLUSTERING.min_pts - 1} GROUP BY ALL
)
"""

# Kruskal's rule, an edge a step: edges in order of weight, then ids, join two labels or none.
KRUSKAL = CORE + """,
members AS (
  SELECT question, response_id, row_number() OVER (PARTITION BY question ORDER BY response_id) AS place FROM valid),
weighted AS (
  SELECT p.question, p.response_id AS lo, p.neighbour_id AS hi, greatest(a.core, b.core, p.distance) AS weight
  FROM pairs p JOIN cores a USING (question, response_id)
  JOIN cores b ON b.question = p.question AND b.response_id = p.neighbour_id WHERE p.response_id < p.neighbour_id),
edges AS (
  SELECT w.*, x.place AS a, y.place AS b,
         row_number() OVER (PARTITION BY w.question ORDER BY weight, lo, hi) AS step
  FROM weighted w JOIN members x ON x.question = w.question AND x.response_id = lo
  JOIN members y ON y.question = w.question AND y.response_id = hi),
kruskal AS (
  SELECT question, CAST(0 AS BIGINT) AS step, range(1, count(*) + 1) AS labels, false AS picked
  FROM members GROUP BY question
  UNION ALL
  SELECT k.question, e.step,
         CASE WHEN labels[e.a] = labels[e.b] THEN labels
              ELSE list_transform(labels, lambda x: CASE WHEN x = labels[e.a] THEN labels[e.b] ELSE x END) END,
         labels[e.a] <> labels[e.b]
  FROM kruskal k JOIN edges e ON e.question = k.question AND e.step = k.step + 1)
"""
# The tree's steps as a hierarchy: a split joins two sides of `min_pts` rows or more, a side is a cluster, a row
# enters it at the step that first puts it among so many rows.
CONDENSED = KRUSKAL + f""",
joins AS (
  SELECT e.question, e.step, e.a, e.b, 1 / greatest(e.weight, 1e-10) AS density, before.labels AS l0,
         len(list_filter(before.labels, lambda x: x = before.labels[e.a])) AS n_a,
         len(list_filter(before.labels, lambda x: x = before.labels[e.b])) AS n_b
  FROM edges e JOIN kruskal k ON k.question = e.question AND k.step = e.step AND k.picked
  JOIN kruskal before ON before.question = e.question AND before.step = e.step - 1
),
entered AS (
  SELECT j.question, m.place, min(j.step) AS step FROM joins j JOIN members m USING (question)
  WHERE n_a + n_b >= {CLUSTERING.min_pts} AND l0[m.place] IN (l0[a], l0[b]) GROUP BY ALL
),
splits AS (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY step) AS k
  FROM joins WHERE n_a >= {CLUSTERING.min_pts} AND n_b >= {CLUSTERING.min_pts}
),
sides AS (
  SELECT question, step, k, density, l0, 0 AS side, l0[a] AS label FROM splits
  UNION ALL SELECT question, step, k, density, l0, 1, l0[b] FROM splits
),
within AS (
  SELECT s.question, s.k, s.side, max(c.k) AS inner_k, max(c.step) AS inner_step
  FROM sides s LEFT JOIN splits c ON c.question = s.question AND c.step < s.step AND s.l0[c.a] = s.label
  GROUP BY ALL
),
held AS (
  SELECT s.question, s.k, s.side, s.density, w.inner_k, e.place, greatest(e.step, coalesce(w.inner_step, 0)) AS leaves
  FROM sides s JOIN within w USING (question, k, side)
  JOIN entered e ON e.question = s.question AND s.l0[e.place] = s.label
),
stable AS (
  SELECT h.question, h.k, h.side, inner_k, sum(j.density - h.density) AS s
  FROM held h JOIN joins j ON j.question = h.question AND j.step = h.leaves GROUP BY ALL
),
pairs_of AS (
  SELECT a.question, a.k, a.s AS s_a, a.inner_k AS in_a, b.s AS s_b, b.inner_k AS in_b
  FROM stable a JOIN stable b ON a.question = b.question AND a.k = b.k AND a.side = 0 AND b.side = 1
),
totals AS (
  SELECT question, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS best, false AS wins_a, false AS wins_b FROM members GROUP BY question
  UNION ALL
  SELECT p.question, p.k,
         best || [greatest(s_a, coalesce(best[2 * in_a - 1] + best[2 * in_a], 0)), greatest(s_b, coalesce(best[2 * in_b - 1] + best[2 * in_b], 0))],
         s_a >= coalesce(best[2 * in_a - 1] + best[2 * in_a], 0), s_b >= coalesce(best[2 * in_b - 1] + best[2 * in_b], 0)
  FROM totals t JOIN pairs_of p ON p.question = t.question AND p.k = t.k + 1
),
top AS (
  SELECT h.question, h.place, max(2 * h.k + h.side) AS key
  FROM held h JOIN totals t USING (question, k) WHERE CASE WHEN side = 0 THEN wins_a ELSE wins_b END GROUP BY ALL
),
firsts AS (SELECT question, key, min(place) AS first FROM top GROUP BY ALL),
numbers AS (
  SELECT question, place, number FROM top
  JOIN (SELECT *, row_number() OVER (PARTITION BY question ORDER BY first) AS number FROM firsts) USING (question, key)
)
"""
# Scales by bisection, a step a row.
WEIGHTS = PAIRS + f""",
lists AS (
  SELECT question, response_id, neighbour_id, distance - min(distance) OVER (PARTITION BY question, response_id) AS gap
  FROM near WHERE rank <= {CLUSTERING.n_neighbors}
),
search AS (
  SELECT question, response_id, list(gap) AS gaps, CAST(0 AS DOUBLE) AS low, CAST('inf' AS DOUBLE) AS high, CAST(1 AS DOUBLE) AS scale, 0 AS step
  FROM lists GROUP BY question, response_id
  UNION ALL
  SELECT question, response_id, gaps, CASE WHEN above THEN low ELSE scale END, CASE WHEN above THEN scale ELSE high END,
         CASE WHEN above THEN (low + scale) / 2 WHEN isinf(high) THEN scale * 2 ELSE (scale + high) / 2 END, step + 1
  FROM (SELECT *, list_sum(list_transform(gaps, lambda g: exp(-g / scale))) - log2({CLUSTERING.n_neighbors}) AS off, off > 0 AS above FROM search)
  WHERE step < 64 AND abs(off) >= 1e-5 AND scale >= 1e-12
),
scales AS (SELECT question, response_id, arg_max(scale, step) AS scale FROM search GROUP BY ALL),
one_way AS (
  SELECT question, response_id, neighbour_id, exp(-gap / greatest(scale, 1e-12)) AS weight FROM lists JOIN scales USING (question, response_id)
),
joined AS (
  SELECT p.question, p.response_id, p.neighbour_id, p.weight + coalesce(q.weight, 0) - p.weight * coalesce(q.weight, 0) AS weight
  FROM one_way p LEFT JOIN one_way q ON q.question = p.question AND q.response_id = p.neighbour_id AND q.neighbour_id = p.response_id
)
"""

# Silhouettes of labels that follow from the first component, for each k.
SWEPT = PAIRS + f""",
labels AS (
  SELECT question, response_id, k, CAST(floor(abs(embedding[1]) * 10000) AS BIGINT) % k AS label
  FROM valid, (VALUES {_values([(k,) for k in SWEEP])}) AS ks(k)
),
means AS (
  SELECT p.question, p.response_id, a.k, a.label AS own, b.label AS other, avg(distance) AS m
  FROM pairs p JOIN labels a USING (question, response_id)
  JOIN labels b ON b.question = p.question AND b.response_id = p.neighbour_id AND b.k = a.k GROUP BY ALL
),
ab AS (
  SELECT question, k, response_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY ALL
),
scores AS (
  SELECT question, k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
  FROM ab GROUP BY question, k HAVING count(b) > 0
)
"""

LABELLED = """
labelled AS (
  SELECT doc_id AS response_id, text, coalesce(label, CAST(doc_id % 10 AS INTEGER)) AS cluster,
         'Q4.' || (2 + doc_id % 9) AS question
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id
)
"""
TF_IDF = LABELLED + f""",
stop(word) AS (VALUES {_values([(w,) for w in wordlists.ENGLISH_STOP_WORDS])}),
words AS (SELECT question, cluster, unnest({_words('text')}) AS word FROM labelled WHERE cluster <> 0),
counts AS (
  SELECT question, cluster, word, count(*) AS n FROM words
  WHERE word NOT IN (SELECT word FROM stop) AND regexp_matches(word, '[a-z]') GROUP BY ALL
),
clusters_of AS (SELECT question, count(DISTINCT cluster) AS k FROM counts GROUP BY question),
tfidf AS (
  SELECT c.*, n / sum(n) OVER (PARTITION BY c.question, cluster)
              * ln(k / count(*) OVER (PARTITION BY c.question, word)) AS tf_idf
  FROM counts c JOIN clusters_of USING (question)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question, cluster ORDER BY round(tf_idf, 12) DESC, n DESC, word) AS rank
  FROM tfidf
),
labels_of AS (
  SELECT question, cluster, string_agg(word, ', ' ORDER BY rank) AS label FROM ranked WHERE rank <= 3 GROUP BY ALL
  UNION ALL SELECT DISTINCT question, 0, 'Noise' FROM labelled
)
"""


def _term_ctes(settings: TermSettings = TERMS) -> str:
    shared = sorted({w.lower() for w in (*settings.stop_words, *settings.custom_stop_words)})
    own = [(q, w.lower()) for q, ws in settings.question_stop_words.items() for w in ws if w.lower() not in shared]
    pattern = "(?i)(?:" + "|".join(settings.regex_stop_words) + ")"
    return LONG + f""",
shared(term) AS (VALUES {_values([(w,) for w in shared])}),
own(question, term) AS (VALUES {_values(own)}),
clean AS (SELECT question, {_sanitised('text')} AS t FROM long WHERE text IS NOT NULL),
tokens AS (SELECT question, unnest({_terms('t')}) AS term FROM clean),
kept AS (
  SELECT * FROM tokens
  WHERE NOT regexp_matches(term, {_text(pattern)}) AND term NOT IN (SELECT term FROM shared)
    AND (question, term) NOT IN (SELECT (question, term) FROM own)
),
counted AS (SELECT question, term, count(*) AS freq_sum FROM kept GROUP BY ALL),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY freq_sum DESC, term) AS rank
    FROM counted WHERE freq_sum >= {settings.min_freq})
  WHERE rank <= {settings.max_words}
)
"""


def _first_seen() -> str:
    """The term table's terms with ties by place, from the same lists of stop words."""
    ctes = _term_ctes()
    placed = f"""
placed AS (
  SELECT question, response_id, unnest({_terms('t')}) AS term, generate_subscripts({_terms('t')}, 1) AS place
  FROM (SELECT question, response_id, {_sanitised('text')} AS t FROM long WHERE text IS NOT NULL)
),
firsts AS (SELECT question, term, min(ROW(response_id, place)) AS seen FROM placed GROUP BY ALL)"""
    return f"""WITH {ctes}, {placed}
        SELECT * FROM (
          SELECT c.question, row_number() OVER (PARTITION BY c.question ORDER BY freq_sum DESC, seen) AS rank, c.term, freq_sum
          FROM counted c JOIN firsts USING (question, term) WHERE freq_sum >= {TERMS.min_freq})
        WHERE rank <= {TERMS.max_words}"""


def _twins() -> dict[str, str]:
    wide = ", ".join(
        f"coalesce(max(translated) FILTER (question = '{q}'), '') AS \"{q.replace('.', '_')}_translated\""
        for q in DEFAULT_QUESTIONS
    )
    flags = ", ".join(f'{_flag(q, k)} AS "{q.replace(".", "_")}_is_{k}"' for q, k in _FLAGS)
    palette = "[" + ", ".join(_text(c) for c in TERMS.palette) + "]"
    n_own = ", ".join(
        f"({_text(q)}, {len({w.lower() for w in ws} - {x.lower() for x in (*TERMS.stop_words, *TERMS.custom_stop_words)})})"
        for q, ws in TERMS.question_stop_words.items()
    )
    n_shared = len({w.lower() for w in (*TERMS.stop_words, *TERMS.custom_stop_words)})
    twins = {
        "issue_distribution": f"WITH {FLAGGED} SELECT total_issues, count(*) AS n FROM flags GROUP BY total_issues",
        "flag_issues": f"WITH {FLAGGED} SELECT response_id, user_language, {flags}, total_issues FROM flags",
        "flagged": f'WITH {FLAGGED} SELECT response_id, "Q4.2" AS "Q4_2", total_issues FROM flags WHERE total_issues > 0',
        "clean": f'WITH {FLAGGED} SELECT response_id, "Q4.2" AS "Q4_2", total_issues FROM flags WHERE total_issues <= 2',
        "survey_long": f"WITH {LONG} SELECT response_id, user_language, question, text FROM long",
        "comments_long": f"WITH {COMMENTS} SELECT response_id, user_language, question, clean_text FROM comments",
        "question_filter": f"WITH {COMMENTS} SELECT response_id, question, clean_text FROM comments WHERE question IN ('Q4.2', 'Q4.10')",
        "distinct_texts": f"WITH {COMMENTS} SELECT DISTINCT clean_text FROM comments",
        "row_ids": f"WITH {COMMENTS} SELECT question, response_id, row_number() OVER (PARTITION BY question ORDER BY response_id) AS row_id FROM comments",
        "turns_union": f"""WITH {COMMENTS} SELECT response_id, user_language, question, text FROM comments
            UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, 'T' || turn, text FROM conversations""",
        "detect_language": f"WITH {DOCUMENTS}, {_detected('docs', 'doc_id')} SELECT doc_id, detected_lang, source_lang FROM sourced",
        "translate_glossary": f"WITH {DOCUMENTS}, {_detected('docs', 'doc_id')}, {_translated('doc_id')} SELECT doc_id, source_lang, translated FROM translated",
        "translated_wide": f"""WITH {COMMENTS}, {_detected('comments', 'response_id, question')}, {_translated('response_id, question')}
            SELECT response_id, user_language, {wide} FROM translated
            GROUP BY response_id, user_language HAVING count(translated) > 0""",
        "store_missing": """SELECT min(doc_id) AS doc_id FROM documents
            WHERE text NOT IN (SELECT text FROM documents SEMI JOIN labels USING (doc_id)) GROUP BY text""",
        "embed_hash": f"""WITH tokens AS (SELECT doc_id, md5(unnest({_words('text')})) AS h FROM documents),
            sums AS (
              SELECT doc_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {HASH_DIM} AS bucket,
                     sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s
              FROM tokens GROUP BY ALL)
            SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(value, 6) AS value
            FROM (SELECT doc_id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS value, s FROM sums) WHERE s <> 0""",
        "embedding_summary": f"""WITH {LONG} SELECT question, count(*) AS total_rows,
            count(*) FILTER (text <> '') AS valid_rows, {HASH_DIM} AS embedding_dim FROM long GROUP BY question""",
        "parse_predictions": f"""SELECT vec_id AS response_id, position, {HASH_DIM} AS width,
            CASE WHEN position < 3 THEN {HASH_DIM} ELSE 0 END AS present,
            CASE WHEN position < 3 THEN round(list_sum(embedding::DOUBLE[]), 5) ELSE 0.0 END AS total
            FROM embeddings, (VALUES (1), (2), (3)) AS p(position)""",
        "valid_vectors": f"WITH {VECTORS} SELECT question, count(*) AS valid_rows FROM valid GROUP BY question",
        "enough_vectors": """SELECT question, count(*) AS valid_rows FROM (
              SELECT CASE WHEN vec_id < 2 THEN 'Q4.1' ELSE 'Q4.' || (2 + vec_id % 9) END AS question
              FROM embeddings WHERE vec_id % 7 <> 3)
            GROUP BY question HAVING count(*) >= 5""",
        "pca_gram": f"""WITH {VECTORS}, parts AS (
              SELECT question, response_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM valid),
            z AS (
              SELECT question, response_id, position,
                     CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END AS z
              FROM parts WINDOW w AS (PARTITION BY question, position)),
            firsts AS (SELECT question, min(response_id) AS first FROM valid GROUP BY question)
            SELECT a.question, a.response_id, round(sum(a.z * a.z), 5) AS squared, round(sum(a.z * b.z), 5) AS with_first
            FROM z a JOIN firsts f USING (question)
            JOIN z b ON b.question = a.question AND b.response_id = f.first AND b.position = a.position GROUP BY ALL""",
        "kmeans_pass": f"""WITH {VECTORS}, centres AS (
              SELECT * FROM (SELECT question, embedding AS c, row_number() OVER (PARTITION BY question ORDER BY response_id) AS cluster FROM valid)
              WHERE cluster <= 3),
            ranked AS (
              SELECT v.question, v.response_id, k.cluster, list_distance(embedding, c) AS d,
                     row_number() OVER (PARTITION BY v.question, v.response_id ORDER BY list_distance(embedding, c), k.cluster) AS r
              FROM valid v JOIN centres k USING (question))
            SELECT question, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(sum(d * d), 5) AS cost
            FROM ranked WHERE r = 1 GROUP BY ALL""",
        "standardise": f"""WITH {VECTORS}, parts AS (
              SELECT question, response_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM valid)
            SELECT question, response_id, CAST(position AS INTEGER) AS position,
                   round(CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END, 6) AS value
            FROM parts WINDOW w AS (PARTITION BY question, position)""",
        "knn": f"WITH {PAIRS} SELECT question, response_id, rank, neighbour_id, round(distance, 6) AS distance FROM near WHERE rank <= {NEIGHBOURS}",
        "core_distance": f"WITH {CORE} SELECT question, response_id, round(core, 6) AS core FROM cores",
        "mutual_reachability": f"""WITH {CORE} SELECT n.question, n.response_id, n.neighbour_id,
              round(greatest(a.core, b.core, n.distance), 6) AS reachability
            FROM near n JOIN cores a USING (question, response_id)
            JOIN cores b ON b.question = n.question AND b.response_id = n.neighbour_id WHERE rank <= {NEIGHBOURS}""",
        "spanning_tree": f"""WITH RECURSIVE {KRUSKAL}
            SELECT question, lo, hi, round(weight, 6) AS weight FROM kruskal JOIN edges USING (question, step) WHERE picked""",
        "hdbscan": f"WITH RECURSIVE {CONDENSED} SELECT question, response_id, CAST(coalesce(number, 0) AS INTEGER) AS cluster FROM members LEFT JOIN numbers USING (question, place)",
        "silhouette_sweep": f"WITH {SWEPT} SELECT question, k, round(silhouette, 6) AS silhouette FROM scores",
        "best_k": f"""WITH {SWEPT} SELECT question, arg_max(k, (silhouette, -k)) AS k, round(max(silhouette), 6) AS silhouette
            FROM scores GROUP BY question""",
        "question_columns": f"""WITH {SURVEY} SELECT response_id, {_clean('"Q4.10"')} AS "Q4_10_translated",
            {_clean('"Q4.3"')} AS "Q4_3_translated" FROM survey""",
        "neighbour_weights": f"WITH RECURSIVE {WEIGHTS} SELECT question, response_id, neighbour_id, round(weight, 4) AS weight FROM joined",
        "only_noise": f"WITH {VECTORS} SELECT question, bool_and(cluster = 0) AS noise FROM valid GROUP BY question",
        "silhouette": f"""WITH {PAIRS}, means AS (
              SELECT p.question, p.response_id, a.cluster AS own, b.cluster AS other, avg(distance) AS m
              FROM pairs p JOIN valid a USING (question, response_id)
              JOIN valid b ON b.question = p.question AND b.response_id = p.neighbour_id GROUP BY ALL),
            ab AS (
              SELECT question, response_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b
              FROM means GROUP BY ALL)
            SELECT question, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
            FROM ab GROUP BY question""",
        "cluster_tf_idf": f"WITH {TF_IDF} SELECT question, cluster, word, n, round(tf_idf, 6) AS tf_idf FROM tfidf",
        "cluster_keywords": f"WITH {TF_IDF} SELECT question, cluster, rank, word, n, round(tf_idf, 6) AS tf_idf FROM ranked WHERE rank <= 3",
        "cluster_labels": f"WITH {TF_IDF} SELECT question, cluster, label FROM labels_of",
        "cluster_assignments": f"""WITH {TF_IDF} SELECT d.question, d.response_id, d.cluster, label AS cluster_label
            FROM labelled d LEFT JOIN labels_of USING (question, cluster)""",
        "sanitised_text": f"SELECT page_id, {_sanitised('html')} AS text FROM pages",
        "term_table": f"""WITH {_term_ctes()} SELECT question, rank, term, freq_sum,
            round(pow(freq_sum, {TERMS.weight_power}) / max(pow(freq_sum, {TERMS.weight_power})) OVER (PARTITION BY question) * 100, 6) AS weight
            FROM top""",
        "term_style": f"""WITH {_term_ctes()}, numbered AS (
              SELECT *, count(*) OVER (PARTITION BY question) AS k,
                     row_number() OVER (PARTITION BY question ORDER BY term) AS place FROM top)
            SELECT question, rank, term, CASE WHEN rank > k - round_even(k * {TERMS.rotate_ratio}, 0) THEN 90 ELSE 0 END AS angle,
                   {palette}[1 + (place - 1) % {len(TERMS.palette)}] AS color FROM numbered""",
        "term_audit": f"""WITH {_term_ctes()}, sizes(question, n) AS (VALUES {n_own})
            SELECT c.question, c.chars, b.n AS tokens_before, a.n AS tokens_after, {n_shared} AS n_global_sw,
                   s.n AS n_question_sw, {len(TERMS.regex_stop_words)} AS n_regex
            FROM (SELECT question, sum(length(t)) AS chars FROM clean GROUP BY question) c
            JOIN (SELECT question, count(*) AS n FROM tokens GROUP BY question) b USING (question)
            JOIN (SELECT question, count(*) AS n FROM kept GROUP BY question) a USING (question)
            JOIN sizes s USING (question)""",
    }
    # The same results by way of small blocks and passes, as large questions take it.
    scanned = ", ".join(
        f"""nullif(nullif({_trim(f'"{c}"')}, ''), 'NA') AS "{to}\""""
        for c, to in [("response_id", "ResponseId"), ("user_language", "UserLanguage"), *((q, q.replace(".", "_")) for q in DEFAULT_QUESTIONS)]
    )
    twins |= {
        "detect_stored": twins["detect_language"],
        "translate_stored": twins["translate_glossary"],
        "question_files": twins["question_filter"],
        "term_table_first_seen": _first_seen(),
        "survey_scan": f"WITH {SURVEY} SELECT {scanned} FROM survey",
        "survey_parts": f"WITH {SURVEY} SELECT {scanned} FROM survey",
    }
    twins["spanning_tree_blocked"] = twins["spanning_tree"]
    return twins | {"knn_blocked": twins["knn"], "silhouette_blocked": twins["silhouette"]}


TWINS: dict[str, str] = _twins()
