from pyspark.sql import functions as F
import pytest

from commentloom.functions import text as tx
from commentloom.operators import reshape, validate
from commentloom.runtime import name, numbered


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def test_flags(spark):
    rows = [("a", "   "), ("b", None), ("c", "abc       "), ("d", "long enough"), ("e", "  ")]
    df = spark.createDataFrame(rows, "response_id string, `Q4.2` string")
    out = {r["response_id"]: r for r in validate.flag_issues(df, ["Q4.2"]).collect()}
    assert {k: r["total_issues"] for k, r in out.items()} == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 2}
    assert out["b"]["Q4.2_is_missing"] and not out["b"]["Q4.2_is_short"]


def test_flagged_and_clean_overlap(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "id string, total_issues int")
    assert {r["id"] for r in validate.flagged_rows(df).collect()} == {"b", "c", "d"}
    assert {r["id"] for r in validate.clean_rows(df).collect()} == {"a", "b", "c"}


def test_only_generated_flags_are_summed(spark):
    df = spark.createDataFrame([("x", 7)], "q string, other_is_flag int")
    assert validate.flag_issues(df, ["q"]).first()["total_issues"] == 1


@pytest.mark.parametrize(
    "given, expected",
    [("a\r\nb", "a  b"), ("\n x y \r", "x y"), (" x　", "x"), (None, None)],
)
def test_clean_text(spark, given, expected):
    assert one(spark, tx.clean_text(F.col("t")), t=given) == expected


def test_trim_agrees_with_its_pattern(spark):
    for given in ("\t a b ", " x ", "  ", "\x0bx\x0c"):
        by_pattern = one(spark, F.regexp_replace("t", tx.EDGE_SPACE, ""), t=given)
        assert one(spark, tx.utrim(F.col("t")), t=given) == by_pattern


@pytest.mark.parametrize(
    "text, detected, user, expected",
    [
        ("x", "it", None, None), ("x", "", "de", "de"), ("x", None, "de", "de"),
        ("x", "it", "en", "it"), ("", "it", "en", None), (None, "it", "en", None),
    ],
)
def test_source_language(spark, text, detected, user, expected):
    got = one(spark, tx.source_language(F.col("t"), F.col("d"), F.col("u")), t=text, d=detected, u=user)
    assert got == expected


def test_sanitize_keeps_tag_names(spark):
    assert one(spark, tx.sanitize(F.col("t")), t="a<b>c &amp; d") == "a b c   d"
    assert one(spark, tx.sanitize(F.col("t"), strip_tags=True), t="a<b>c") == "a c"


def test_tokens(spark):
    assert one(spark, tx.words(F.col("t")), t="Don't stop-me, 3.5 times!") == ["don't", "stop", "me", "3.5", "times"]
    assert one(spark, tx.terms(F.col("t")), t="well-being + cost $5") == ["well-being", "+", "cost", "$", "5"]


def test_request_key_tells_null_from_empty(spark):
    a = one(spark, tx.request_key(F.col("a"), F.col("b")), a="x", b=None)
    b = one(spark, tx.request_key(F.col("a"), F.col("b")), a="x", b="")
    c = one(spark, tx.request_key(F.col("a"), F.col("b")), a="x1:", b="")
    assert len({a, b, c}) == 3


def test_long_and_wide(spark):
    df = spark.createDataFrame(
        [("r1", "en", "first answer", None), ("r2", None, "short", "second answer")],
        "response_id string, user_language string, `Q4.2` string, `Q4.3` string",
    )
    long = reshape.to_long(df, ["Q4.2", "Q4.3"])
    assert long.count() == 4
    done = reshape.comments(long).withColumn("translated", F.col("clean_text"))
    wide = reshape.to_wide(done, ["Q4.2", "Q4.3", "Q4.4"])
    rows = {r["response_id"]: r.asDict() for r in wide.collect()}
    assert rows["r1"]["Q4.2_translated"] == "first answer" and rows["r1"]["Q4.3_translated"] is None
    assert rows["r2"]["Q4.2_translated"] is None and rows["r2"]["Q4.4_translated"] is None
    assert wide.columns[-1] == "Q4.4_translated"


def test_response_without_text_is_absent(spark):
    df = spark.createDataFrame([("r1", "en", "tiny")], "response_id string, user_language string, `Q4.2` string")
    done = reshape.comments(reshape.to_long(df, ["Q4.2"])).withColumn("translated", F.col("clean_text"))
    assert reshape.to_wide(done, ["Q4.2"]).count() == 0


def test_padded_text_is_not_translatable(spark):
    df = spark.createDataFrame([("r", "en", "abc       ")], "response_id string, user_language string, q string")
    assert reshape.comments(reshape.to_long(df, ["q"])).count() == 0


def test_wide_rejects_duplicates(spark):
    df = spark.createDataFrame(
        [("r", "en", "q", "a"), ("r", "en", "q", "b")],
        "response_id string, user_language string, question string, translated string",
    )
    with pytest.raises(Exception, match="two rows for q"):
        reshape.to_wide(df, ["q"]).collect()


def test_failed_rows_survive_and_null_rows_go(spark):
    df = spark.createDataFrame(
        [("a", None, None), ("b", "", None)], "id string, `Q4.2_translated` string, `Q4.3_translated` string"
    )
    kept = reshape.blank_nulls(reshape.drop_untranslated(df)).collect()
    assert [tuple(r) for r in kept] == [("b", "", "")]


def test_numbered_spans_partitions(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 5003).alias("k")
    )
    out = numbered(df.repartition(7), "g", ["k"], "n").toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values("k")
        assert part["n"].tolist() == list(range(1, len(part) + 1))


def test_exact_names(spark):
    df = spark.createDataFrame([("x",)], "`a.b` string")
    assert df.select(name("a.b")).first()[0] == "x"
