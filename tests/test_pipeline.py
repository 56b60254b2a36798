from dataclasses import replace
import os
import random
import time

from pyspark.sql import functions as F

from commentloom.config import ClusteringSettings, EmbeddingSettings, InputSettings, Settings, TermSettings
from commentloom import runtime
from commentloom.operators import enrich
from commentloom.plans import pipeline
from commentloom.sources.tables import read_clusters
from commentloom.streaming import files

QUESTIONS = ("Q4.2", "Q4.10")
SETTINGS = Settings(
    input=InputSettings(comment_cols=QUESTIONS),
    embeddings=EmbeddingSettings(expected_dim=24),
    clustering=ClusteringSettings(max_kmeans_k=3, n_start=2),
    terms=TermSettings(question_ids=(2,)),
)


def survey_file(folder, n=40):
    rng = random.Random(1)
    topics = (["staff friendly helpful nurses", "il personale era gentile"], ["parking car far expensive", "le parking est loin"])
    path = os.path.join(folder, "comments.tsv")
    with open(path, "w", encoding="utf-8") as out:
        out.write("ResponseId\tUserLanguage\tQ4.2\tQ4.10\n")
        for i in range(n):
            words = topics[i % 2][0].split()
            rng.shuffle(words)
            second = ("", "NA", "tiny")[i % 3] if i % 5 == 0 else topics[(i + 1) % 2][1] + f" {i}"
            out.write(f"r{i:03d}\ten\t\"the {' '.join(words)}\nand {rng.choice(words)}\"\t{second}\n")
    return path


def test_all_stages(spark, tmp_path):
    path = survey_file(tmp_path)
    out = str(tmp_path / "out")
    pipeline.run(spark, path, out, SETTINGS)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("issues").agg(F.sum("n")).first()[0] == 40
    assert read("translated").columns == ["response_id", "user_language", "Q4.2_translated", "Q4.10_translated"]
    assert read("translated").count() == 40
    vectors = read("embeddings")
    assert vectors.count() == 80
    ids = vectors.where("question = 'Q4.2'").orderBy("response_id").select("row_id").collect()
    assert [r["row_id"] for r in ids] == list(range(1, 41))
    summary = {r["question"]: r for r in read("embedding_summary").collect()}
    assert summary["Q4.2"]["valid_rows"] == 40 and summary["Q4.10"]["valid_rows"] == 32
    clusters = read_clusters(spark, f"{out}/clusters")
    assert clusters.count() == 72
    assert clusters.where("cluster_label IS NULL").count() == 0
    assert read("cluster_summary").where("cluster = 0").count() == 2
    assert {r["question"] for r in read("terms").select("question").distinct().collect()} == {"Q4.2"}
    assert read("term_audit").first()["tokens_before"] > 0


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    survey_file(folder)
    stream = files.clean_comments(files.survey_stream(spark, str(folder), QUESTIONS), SETTINGS)
    query = files.enrich_batches(
        stream, enrich.detect_language, str(tmp_path / "out"), str(tmp_path / "checkpoint")
    )
    assert query.awaitTermination(120)
    _, clean, _ = pipeline.check(pipeline.load(spark, str(folder), SETTINGS), SETTINGS)
    expected = files.clean_comments(clean.drop("total_issues", *[c for c in clean.columns if "_is_" in c]), SETTINGS)
    columns = ["response_id", "question", "clean_text", "detected_lang"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    batch = enrich.detect_language(expected).select(*columns)
    assert batch.count() > 0
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    survey = pipeline.load(spark, survey_file(tmp_path), SETTINGS)
    _, clean, _ = pipeline.check(survey, SETTINGS)
    results = []
    for parts in (1, 16):
        wide = pipeline.translate(clean.repartition(parts), SETTINGS)
        assigned, _ = pipeline.themes(pipeline.embed(wide, SETTINGS), replace(SETTINGS))
        results.append(sorted(map(tuple, assigned.select("question", "response_id", "cluster", "cluster_label").collect())))
    assert results[0] == results[1]


def test_scratch_tables_go(spark):
    import os

    from commentloom.runtime import cut, scratch, shared_folder

    outside = cut(spark.range(3))
    with scratch(spark):
        inside = cut(spark.range(5))
        folder = os.path.dirname(inside.inputFiles()[0].removeprefix("file://"))
        assert inside.count() == 5 and os.path.exists(folder)
    assert not os.path.exists(folder) and outside.count() == 3 and shared_folder(spark)


def test_a_table_frees_the_shuffle_files_behind_it(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]

    def held():
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}

    before, setting = held(), spark.conf.get(runtime.SHUFFLE_CLEANUP)
    table = runtime.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
    assert table.count() == 7 and spark.conf.get(runtime.SHUFFLE_CLEANUP) == setting
