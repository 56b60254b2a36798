from dataclasses import replace

from pyspark.sql import functions as F

from commentloom.config import Settings, TermSettings
from commentloom.operators import labels, terms


def texts(spark, rows):
    return spark.createDataFrame(rows, "question string, cluster int, text string")


def test_one_cluster_is_ranked_by_count_then_word(spark):
    df = texts(spark, [("q", 1, "pear apple fig fig the 2024"), ("q", 1, "pear kiwi")])
    scored = labels.tf_idf(labels.cluster_words(df))
    assert {r["tf_idf"] for r in scored.collect()} == {0.0}
    found = {(r["cluster"], r["label"]) for r in labels.label_clusters(df).collect()}
    assert found == {(1, "fig, pear, apple"), (0, "Noise")}


def test_noise_row_is_always_there(spark):
    df = texts(spark, [("a", 1, "word"), ("b", 0, "other")])
    found = {(r["question"], r["cluster"], r["label"]) for r in labels.label_clusters(df).collect()}
    assert found == {("a", 1, "word"), ("a", 0, "Noise"), ("b", 0, "Noise")}


def test_words_of_one_cluster_win(spark):
    df = texts(spark, [("q", 1, "care care common"), ("q", 2, "cost common"), ("q", 0, "noise")])
    found = {r["cluster"]: r["label"] for r in labels.label_clusters(df).collect()}
    assert found[1] == "care, common" and found[2] == "cost, common"


def test_summary_and_assignments(spark):
    rows = spark.createDataFrame([("q", 7, 1, "fig"), ("q", 8, 0, "x")], "question string, response_id int, cluster int, text string")
    named = labels.label_clusters(rows)
    assigned = {r["response_id"]: r["cluster_label"] for r in labels.assignments(rows, named).collect()}
    assert assigned == {7: "fig", 8: "Noise"}
    methods = spark.createDataFrame([("q", "HDBSCAN", 0.123)], "question string, method string, silhouette double")
    assert labels.cluster_summary(named, methods).count() == 2


def answers(spark):
    rows = [
        ("Q4.3", "Costs & services <b>help</b> well-being + 3 care"), ("Q4.3", "CARE can’t physiotherapy will"),
        ("Q4.2", "services care"), ("Q4.2", None),
    ]
    return spark.createDataFrame(rows, "question string, text string")


def test_term_table(spark):
    table = {(r["question"], r["term"]): r for r in terms.term_table(answers(spark)).collect()}
    assert {t for q, t in table if q == "Q4.3"} == {"care", "b", "help", "well-being", "3"}
    assert {t for q, t in table if q == "Q4.2"} == {"care", "services"}
    care = table["Q4.3", "care"]
    assert (care["freq_sum"], care["rank"], care["weight"]) == (2, 2, 100 * 2**1.2 / 2**1.2) or care["rank"] == 1
    assert abs(table["Q4.3", "help"]["weight"] - 100 * 1 / max(r["freq_sum"] for r in table.values()) ** 1.2) < 1e-9


def test_audit_agrees_with_table(spark):
    table = terms.term_table(answers(spark)).groupBy("question").agg(F.sum("freq_sum").alias("n"))
    kept = {r["question"]: r["n"] for r in table.collect()}
    audit = {r["question"]: r for r in terms.term_audit(answers(spark)).collect()}
    assert {q: r["tokens_after"] for q, r in audit.items()} == kept
    assert audit["Q4.3"]["n_question_sw"] == 6 and audit["Q4.3"]["n_regex"] == 6
    assert audit["Q4.2"]["tokens_before"] == 2 and audit["Q4.2"]["chars"] == len("services care")


def test_limits_and_style(spark):
    settings = replace(TermSettings(), max_words=4, min_freq=2)
    rows = [("Q4.9", "ant bee cat dog eel " * 2 + "fox")]
    df = spark.createDataFrame(rows, "question string, text string")
    styled = terms.term_style(terms.term_table(df, settings), settings).orderBy("rank").collect()
    assert [r["term"] for r in styled] == ["ant", "bee", "cat", "dog"]
    assert [r["angle"] for r in styled] == [0, 0, 0, 90]
    assert [r["color"] for r in styled] == list(settings.palette[:4])
    plain = terms.term_style(terms.term_table(df, settings), replace(settings, color="black"))
    assert {r["color"] for r in plain.collect()} == {"black"}


def test_term_tables_by_cluster(spark):
    df = spark.createDataFrame([("Q4.2", 1, "ant"), ("Q4.2", 2, "bee bee")], "question string, cluster int, text string")
    out = {(r["cluster"], r["term"], r["weight"]) for r in terms.term_tables_by_cluster(df).collect()}
    assert out == {(1, "ant", 100.0), (2, "bee", 100.0)}


def test_settings_from_a_mapping():
    given = {
        "paths": {"cache": "x"},
        "translation": {"min_comment_length": 3, "drop_label_rows": True},
        "clustering": {"umap_dims": 7, "make_plots": True},
        "visualization": {"q_range": [3], "custom_stopwords": ["Foo"]},
        "question_stopwords": {"Q4.3_translated": ["bar"]},
    }
    settings = Settings.from_mapping(given)
    assert settings.translation.min_comment_length == 3 and settings.input.drop_label_rows
    assert settings.clustering.pca_dims == 7 and settings.terms.question_ids == (3,)
    assert settings.terms.custom_stop_words == ("Foo",)
    assert settings.terms.question_stop_words == {"Q4.3": ("bar",)}


def test_texts_are_tokenised_once(spark):
    """Term, holder and total counts come from one table of counts."""
    rows = spark.createDataFrame([("q", "r1", "a good room", 1), ("q", "r2", "a bad room", 2)], "question string, response_id string, text string, cluster int")
    scored = labels.tf_idf(labels.cluster_words(rows))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("FileScan parquet") >= 1


def test_first_seen_keeps_its_counts_in_a_hash_table(spark):
    rows = [("Q", "r2", "pear fig"), ("Q", "r10", "plum fig"), ("Q", None, "kiwi"), ("Q", "r10", "lime plum"), ("Q", None, "date kiwi"), ("P", "r3", "fig"), ("P", "r3", None)]
    answers = spark.createDataFrame(rows, "question string, response_id string, text string").repartition(3)
    table = terms.term_table(answers, TermSettings(ties=terms.FIRST_SEEN, custom_stop_words=()))
    found = {(r["question"], r["rank"]): (r["term"], r["freq_sum"]) for r in table.collect()}
    # Responses in the order of their ids, those without one first; within one by place.
    firsts = {("Q", 1): ("kiwi", 2), ("Q", 2): ("plum", 2), ("Q", 3): ("fig", 2), ("Q", 4): ("date", 1), ("Q", 5): ("lime", 1), ("Q", 6): ("pear", 1)}
    assert found == firsts | {("P", 1): ("fig", 1)}
    assert "SortAggregate" not in table._jdf.queryExecution().toString()
