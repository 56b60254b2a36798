import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType
import pytest

from commentloom.config import RetrySettings
from commentloom.operators import enrich
from commentloom.operators import providers
from commentloom.operators.providers import with_retry
from commentloom.sources.store import ResultStore, missing

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUICK = RetrySettings(max_attempts=2, wait=0.0)


class Upper:
    """Writes a file per call, so that calls in the workers can be counted."""

    provider_id = "upper-1"

    def __init__(self, folder, fail_on="!"):
        self.folder, self.fail_on = str(folder), fail_on

    def __call__(self, texts, lang):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            out.write("\n".join(texts))
        if any(self.fail_on in t for t in texts):
            raise RuntimeError("refused")
        return [f"{lang}:{t.upper()}" for t in texts]

    def calls(self):
        return [open(os.path.join(self.folder, f)).read().split("\n") for f in os.listdir(self.folder)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, clean_text string, source_lang string")


def test_translate_once_per_distinct_text(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider = Upper(tmp_path / "calls")
    store = ResultStore(spark, str(tmp_path / "store"), provider.provider_id, StringType())
    rows = [(1, "a", "it"), (2, "a", "it"), (3, "a", "de"), (4, None, "it"), (5, "b", None)]
    out = {r["id"]: r["translated"] for r in enrich.translate_with(frame(spark, rows), provider, store, retry=QUICK).collect()}
    assert out == {1: "it:A", 2: "it:A", 3: "de:A", 4: None, 5: None}
    assert sum(len(c) for c in provider.calls()) == 2
    before = len(provider.calls())
    enrich.translate_with(frame(spark, rows), provider, store, retry=QUICK).collect()
    assert len(provider.calls()) == before
    enrich.translate_with(frame(spark, rows + [(6, "c", "it")]), provider, store, retry=QUICK).collect()
    assert len(provider.calls()) == before + 1


def test_failed_batch_leaves_others_and_is_tried_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider = Upper(tmp_path / "calls")
    store = ResultStore(spark, str(tmp_path / "store"), provider.provider_id, StringType())
    rows = [(1, "ok", "it"), (2, "bad!", "de")]
    out = {r["id"]: r["translated"] for r in enrich.translate_with(frame(spark, rows), provider, store, retry=QUICK).collect()}
    assert out == {1: "it:OK", 2: ""}
    assert len(provider.calls()) == 3  # one good call, two attempts
    provider.fail_on = "never"
    again = {r["id"]: r["translated"] for r in enrich.translate_with(frame(spark, rows), provider, store, retry=QUICK).collect()}
    assert again == {1: "it:OK", 2: "de:BAD!"}


def test_batches_are_full_and_of_one_language(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider = Upper(tmp_path / "calls")
    store = ResultStore(spark, str(tmp_path / "store"), provider.provider_id, StringType())
    rows = [(i, f"text {i}", "it" if i % 4 else "de") for i in range(250)]
    enrich.translate_with(frame(spark, rows).coalesce(1), provider, store, 10, retry=QUICK).collect()
    assert max(len(c) for c in provider.calls()) == 10
    assert sum(len(c) for c in provider.calls()) == 250


def test_embedding_store_and_gaps(spark, tmp_path):
    class Length:
        provider_id = "length"

        def __call__(self, texts, lang):
            return [None if t == "gap" else [float(len(t)), 1.0] for t in texts]

    store = ResultStore(spark, str(tmp_path / "store"), "length", ArrayType(DoubleType()))
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "gap")], "id int, text string")
    out = {r["id"]: r["embedding"] for r in enrich.embed_with(df, Length(), store, dim=2, retry=QUICK).collect()}
    assert out == {1: [3.0, 1.0], 2: None, 3: None, 4: [None, None]}


def test_detect_with_provider(spark, tmp_path):
    class First:
        provider_id = "first"

        def __call__(self, texts, lang):
            assert len(texts) == 1
            return [texts[0][:2]] if texts[0] != "fail" else [None]

    store = ResultStore(spark, str(tmp_path / "store"), "first", StringType())
    df = spark.createDataFrame([(1, "it text"), (2, "fail")], "id int, clean_text string")
    out = {r["id"]: r["detected_lang"] for r in enrich.detect_with(df, First(), store, retry=QUICK).collect()}
    assert out == {1: "it", 2: ""}


def test_retry_waits_and_raises():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise ValueError("last")

    with pytest.raises(ValueError, match="last"):
        with_retry(fail, 3, 2.0, waits.append)
    assert len(calls) == 3 and waits == [2.0, 4.0]


def test_offline_detection(spark):
    texts = ["the cat is on the mat", "le chat est dans la maison avec les enfants", "xyz", None, "de la"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, clean_text string")
    out = {r["id"]: r["detected_lang"] for r in enrich.detect_language(df).collect()}
    assert out == {0: "en", 1: "fr", 2: "", 3: "", 4: "es"}  # a tie falls to the first code


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None), (4, "!!")], "id int, text string")
    out = {r["id"]: r["embedding"] for r in enrich.embed_hashed(df, 16).collect()}
    assert out[2] is None and out[3] is None and out[4] == [0.0] * 16
    assert abs(sum(v * v for v in out[1]) - 1) < 1e-12


def test_predictions_without_values(spark):
    raw = '{"predictions": [{"embeddings": {"values": [1, 2]}}, {}]}'
    df = spark.createDataFrame([(1, raw)], "id int, response string")
    rows = enrich.parse_predictions(df, dim=2).orderBy("position").collect()
    assert [(r["position"], r["embedding"]) for r in rows] == [(1, [1.0, 2.0]), (2, [None, None])]


def test_summary_counts_valid_rows(spark):
    df = spark.createDataFrame(
        [("q", [1.0, 2.0]), ("q", None), ("q", [None, None])], "question string, embedding array<double>"
    )
    assert tuple(enrich.embedding_summary(df).first()) == ("q", 3, 1, 2)


def test_missing_ignores_failures(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "request_key string")
    stored = spark.createDataFrame([("a", "ok"), ("b", "failed")], "request_key string, status string")
    assert {r[0] for r in missing(requests, stored, ["request_key"]).collect()} == {"b", "c"}


def test_calls_run_in_parallel_with_full_batches(spark, tmp_path):
    """10,000 requests use all allowed tasks, and leave one part-filled batch per task and language."""
    (tmp_path / "calls").mkdir()
    provider = Upper(tmp_path / "calls")
    rows = [(f"k{i}", f"text {i}", ["it", "de"][i % 2]) for i in range(10_000)]
    requests = spark.createDataFrame(rows, "request_key string, text string, lang string")
    retry = RetrySettings(max_attempts=1, wait=0.0, max_parallel_calls=6)
    done = providers.run_batches(requests, provider, 100, "string", retry)
    assert done.rdd.getNumPartitions() == 6 and done.where("status = 'ok'").count() == 10_000
    assert len(provider.calls()) <= 2 * (50 + 6)


def test_target_language_is_asked_for_and_kept_apart(spark, tmp_path):
    class ToTarget:
        provider_id = "to-target"

        def __call__(self, texts, lang, target):
            return [f"{target}:{t}" for t in texts]

    store = ResultStore(spark, str(tmp_path / "s"), "to-target", StringType())
    df = frame(spark, [(1, "a", "it")])
    for target in ("en", "fr", "en"):
        out = enrich.translate_with(df, ToTarget(), store, retry=QUICK, target=target).first()["translated"]
        assert out == f"{target}:a"
    (tmp_path / "calls").mkdir()
    upper = Upper(tmp_path / "calls")
    with pytest.raises(ValueError, match="target"):
        enrich.translate_with(df, upper, ResultStore(spark, str(tmp_path / "u"), "upper-1", StringType()), retry=QUICK, target="fr")


def test_compaction_keeps_results(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    provider = Upper(tmp_path / "calls")
    store = ResultStore(spark, str(tmp_path / "s"), provider.provider_id, StringType())
    for texts in ("ab", "bc", "cd"):
        enrich.translate_with(frame(spark, [(i, t, "it") for i, t in enumerate(texts)]), provider, store, retry=QUICK).collect()
    before, calls = {tuple(r) for r in store.load().collect()}, len(provider.calls())
    store.compact()
    assert {tuple(r) for r in store.load().collect()} == before and len(before) == store.load().count() == 4
    enrich.translate_with(frame(spark, [(1, "a", "it"), (2, "d", "it")]), provider, store, retry=QUICK).collect()
    assert len(provider.calls()) == calls


def keyed(spark, keys):
    return spark.createDataFrame([(k, k.upper()) for k in keys], "request_key string, text string")


def stored(df):
    return df.select("request_key", F.lit("ok").alias("status"), F.col("text").alias("value"))


def test_readers_keep_their_snapshot(spark, tmp_path):
    """A plan made before a compaction and later commits still reads what it saw; vacuum deletes old commits."""
    store = ResultStore(spark, str(tmp_path / "s"), "any/provider id", StringType())
    store.ensure(keyed(spark, "abc"), stored)
    store.ensure(keyed(spark, "bcde"), stored)
    reader = store.load()
    assert len(store.commits()) == 2 and store.snapshots() == [1, 2]
    store.compact()
    store.ensure(keyed(spark, "xy"), stored)
    assert sorted(r["request_key"] for r in reader.collect()) == list("abcde")
    assert len(store.commits()) == 2 and sorted(r["request_key"] for r in store.load().collect()) == list("abcdexy")
    store.vacuum()
    assert store.snapshots() == [4] and sorted(r["request_key"] for r in store.load().collect()) == list("abcdexy")
    assert len([p for p in (tmp_path / "s").glob("*/commit=*")]) == 2


def test_commits_of_two_runs_both_count(spark, tmp_path, monkeypatch):
    one, two = (ResultStore(spark, str(tmp_path / "s"), "p", StringType()) for _ in range(2))
    seen = one.snapshots
    calls = []

    def late():
        before = seen()
        if not calls:
            calls.append(1)
            two.ensure(keyed(spark, "b"), stored)
        return before

    monkeypatch.setattr(one, "snapshots", late)
    one._commit([one._write(stored(keyed(spark, "a")).withColumn("provider", F.lit("p")))], [])
    assert {r["request_key"] for r in two.load().collect()} == {"a", "b"}


def test_only_asked_buckets_are_read(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), "p", StringType())
    store.ensure(keyed(spark, [f"key{i}" for i in range(200)]), stored)
    asked = keyed(spark, ["key7"])
    plan = store.load(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({f.split("bucket=")[1][0] for f in store.load().inputFiles()}) == 16
    found = store.results(asked).collect()
    assert [(r["request_key"], r["value"]) for r in found] == [("key7", "KEY7")]
