import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
import pytest

from commentloom.plans import catalog
from commentloom.sources import survey, tables
from commentloom.sources.records import _by_block, _cut_up

HEAD = "ResponseId\tUserLanguage\tQ4.3\tQ4.2\textra\n"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_read_survey(spark, tmp_path):
    path = write(tmp_path / "c.tsv", HEAD + 'r1\ten\tNA\t"two\nlines"\tx\nr2\tit\t  padded \t42\t\n')
    rows = survey.read_survey(spark, path, ["Q4.2", "Q4.3"]).collect()
    assert [tuple(r) for r in rows] == [("r1", "en", "two\nlines", None), ("r2", "it", "42", "padded")]


def test_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "ResponseId\tUserLanguage\nr1\ten\n")
    with pytest.raises(Exception, match="Q4.2"):
        survey.read_survey(spark, path, ["Q4.2"])


@pytest.mark.parametrize("encoding", ["windows-1252", "iso-8859-1", "utf-16", "utf-8", "iso-8859-15"])
def test_charsets_are_read(spark, tmp_path, encoding):
    text = "Tornerò però" + (" – €" if encoding == "windows-1252" else "") + (" €" if encoding == "iso-8859-15" else "")
    path = write(tmp_path / "c.tsv", f"ResponseId\tUserLanguage\tQ4.2\nr1\tit\t{text}\n", encoding)
    assert survey.read_survey(spark, path, ["Q4.2"], encoding).first()["Q4.2"] == text


def test_multi_byte_charset_is_decoded(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "ResponseId\tUserLanguage\tQ4.2\nr1\tja\tとても良いサービス\n", "shift_jis")
    assert survey.read_survey(spark, path, ["Q4.2"], "shift_jis").first()["Q4.2"] == "とても良いサービス"


def test_unknown_charset_is_refused(spark, tmp_path):
    path = write(tmp_path / "c.tsv", HEAD)
    for encoding in ("no-such-charset", "cp037"):
        with pytest.raises(ValueError):
            survey.read_survey(spark, path, ["Q4.2"], encoding)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("encoding", ["utf-8", "shift_jis"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, encoding):
    """Quoted line breaks, tabs and quotes, also in a cell over several blocks, as one task for the file reads them."""
    rng = random.Random(3)
    odd = ["plain", '"two\nlines"', '"a ""quoted"" word"', '"tab\there"', '5" screen', "", "NA", '"\r\nend"', "  pad ", '"良い\n\n\"\"x"'.replace('\\"', '"')]
    body = [HEAD.rstrip("\n").replace("\n", "")]
    for i in range(12_000):
        cells = [rng.choice(odd) for _ in range(3)]
        if i in (4000, 9000):
            cells[1] = '"' + "\n".join(f'long ""line"" {j}\t良い' for j in range(9000)) + '"'
        body.append("\t".join([f"r{i}", "en", *cells]))
    path = write(tmp_path / "c.tsv", "\n".join(body) + "\n", encoding)
    chosen = survey.read_survey(spark, path, ["Q4.2", "Q4.3"], encoding)
    assert chosen.rdd.getNumPartitions() > 4
    plain = write(tmp_path / "plain.tsv", "\n".join(body) + "\n")
    whole = survey._whole_files(spark, plain, ["ResponseId", "UserLanguage", "Q4.2", "Q4.3"], "utf-8", 0)
    whole = whole.select(*[survey.nulled(survey.name(c)).alias(c) for c in whole.columns])
    found, expected = (sorted(map(tuple, df.collect()), key=str) for df in (chosen, whole))
    assert len(found) == 12_000 and found == expected


def test_label_rows_beyond_the_first_block(spark, tmp_path, small_splits):
    """The second label row ends in a later block; a file with one row keeps it."""
    long = '"' + "x\n" * 60_000 + '"'
    write(tmp_path / "a.tsv", f"ResponseId\tUserLanguage\tQ4.2\nl1\ta\tb\nl2\ta\t{long}\nr1\ten\tx\n")
    write(tmp_path / "b.tsv", "ResponseId\tUserLanguage\tQ4.2\nr2\ten\ty")
    write(tmp_path / "c.tsv", "ResponseId\tUserLanguage\tQ4.2\n\nl1\ta\tb\nl2\ta\tb\n")
    rows = survey.read_survey(spark, [f"{tmp_path}/{c}.tsv" for c in "abc"], ["Q4.2"], label_rows=2)
    assert sorted(map(tuple, rows.collect())) == [("r1", "en", "x"), ("r2", "en", "y")]


SAMPLES = {
    "windows-1251": "Очень хорошее обслуживание, спасибо большое", "koi8-r": "Очень хорошее обслуживание, спасибо",
    "windows-1253": "Πολύ καλή εξυπηρέτηση και καθαρά δωμάτια", "windows-1254": "Çok iyi hizmet, teşekkür ederim, ışık güzeldi",
    "windows-1250": "Bardzo miła obsługa, pokój był czysty, dziękuję", "shift_jis": "とても良いサービスでした。ありがとうございます",
    "euc_jp": "とても良いサービスでした。ありがとう", "gb18030": "服务很好，房间很干净，谢谢你们", "big5": "服務很好，房間很乾淨，謝謝你們",
    "euc_kr": "서비스가 아주 좋았고 방이 깨끗했습니다", "ISO-8859-1": "La stanza era pulita però un po' rumorosa, così così",
    "windows-1252": "Das Zimmer war schön – nur 5 € für Frühstück",
}


@pytest.mark.parametrize("encoding", list(SAMPLES))
def test_each_file_in_its_own_charset(encoding):
    votes = list(survey._candidates(SAMPLES[encoding].encode(encoding)))
    best = max(votes, key=lambda v: (v[1], v[0]))[0]
    assert SAMPLES[encoding].encode(encoding).decode(best) == SAMPLES[encoding]


def test_folder_of_files(spark, tmp_path):
    """Charset, column order and label rows are those of each file."""
    labels = "l1\tx\tx\tx\nl2\tx\tx\tx\n"
    (tmp_path / "in").mkdir()
    for i, encoding in enumerate(["utf-8", "windows-1251", "shift_jis", "windows-1252"]):
        text = {"windows-1251": SAMPLES["windows-1251"], "shift_jis": SAMPLES["shift_jis"]}.get(encoding, SAMPLES["windows-1252"])
        columns = ["Q4.2", "Q4.3"] if i % 2 else ["Q4.3", "Q4.2"]
        cells = {"Q4.2": text, "Q4.3": f"third {i}"}
        body = "\t".join(["ResponseId", "UserLanguage", *columns]) + "\n" + labels + "\t".join([f"r{i}", "xx", *(cells[c] for c in columns)]) + "\n"
        write(tmp_path / "in" / f"{i}.tsv", body, encoding)
    rows = survey.read_files(spark, str(tmp_path / "in"), ["Q4.2", "Q4.3"], label_rows=2).collect()
    found = {r["ResponseId"]: (r["Q4.2"], r["Q4.3"]) for r in rows}
    assert found == {
        "r0": (SAMPLES["windows-1252"], "third 0"), "r1": (SAMPLES["windows-1251"], "third 1"),
        "r2": (SAMPLES["shift_jis"], "third 2"), "r3": (SAMPLES["windows-1252"], "third 3"),
    }


def test_charset_vote(spark, tmp_path):
    samples = {
        "a.tsv": ("plain text", "utf-8", "UTF-8"), "b.tsv": ("però " * 3000, "utf-8", "UTF-8"),
        "c.tsv": ("però così", "latin-1", "ISO-8859-1"), "d.tsv": ("costs 5 € – però", "windows-1252", "windows-1252"),
        "e.tsv": ("però", "utf-16", "UTF-16"),
    }
    for file, (text, encoding, _) in samples.items():
        write(tmp_path / file, text, encoding)
    found = {r["path"].rsplit("/", 1)[-1]: r["encoding"] for r in survey.detect_charsets(spark, f"{tmp_path}/*.tsv").collect()}
    assert found == {file: expected for file, (_, _, expected) in samples.items()}


def test_drop_label_rows(spark, tmp_path):
    path = write(tmp_path / "c.tsv", "ResponseId\tUserLanguage\tQ4.2\n" + "".join(f"r{i}\ten\tx\n" for i in range(5)))
    df = survey.read_survey(spark, path, ["Q4.2"])
    assert [r[0] for r in survey.drop_label_rows(df).orderBy("ResponseId").collect()] == ["r2", "r3", "r4"]
    assert survey.drop_label_rows(df.limit(1)).count() == 1


def test_read_or_empty(spark, tmp_path):
    schema = StructType([StructField("a", StringType())])
    assert survey.read_or_empty(spark, str(tmp_path / "none.csv"), schema).count() == 0
    path = write(tmp_path / "t.csv", "a\nNA\nx\n")
    assert [r["a"] for r in survey.read_or_empty(spark, path, schema).collect()] == [None, "x"]


def test_csv_sink_shows_null_as_na(spark, tmp_path):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    tables.write_table(df, str(tmp_path / "out"), "csv")
    tables.write_table(df, str(tmp_path / "out"), "csv")
    assert spark.read.text(str(tmp_path / "out")).collect()[1]["value"] == "NA,x"


def test_partitioned_export_and_question_set(spark, tmp_path):
    rows = [(f"Q4.{i}", f"r{i}", "t", 1, "l") for i in (2, 3, 5, 10)] + [("Q4.2", "r", None, 0, "Noise")]
    df = spark.createDataFrame(rows, "question string, response_id string, text string, cluster int, cluster_label string")
    tables.export_per_question(df, str(tmp_path / "c"))
    held = tables.read_clusters(spark, str(tmp_path / "c"))
    chosen = tables.select_questions(held, [2, 10])
    assert {(r["question"], r["response_id"]) for r in chosen.collect()} == {("Q4.2", "r2"), ("Q4.10", "r10")}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_read_clusters_needs_its_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x"))
    assert tables.read_clusters(spark, str(tmp_path / "x")) is None
    assert tables.read_clusters(spark, str(tmp_path / "absent")) is None


def test_a_block_is_not_held():
    def batches():
        for _ in range(3):
            yield pa.record_batch({"path": ["f"] * 3, "at": [0] * 3, "line": [b"a\tb", b'c\t"d', b'e"']})
        pytest.fail("the block was read to its end before its first record")

    key, lines = next(_by_block(batches(), ["path", "at"]))
    pieces = _cut_up(lines, False, 1)
    assert key == ("f", 0)
    assert [next(pieces) for _ in range(3)] == [("whole", b"a\tb", False), ("whole", b'c\t"d\ne"', True), ("whole", b"a\tb", True)]


def test_blocks_next_to_each_other():
    batch = pa.record_batch({"path": ["f", "f", "f", "g"], "at": [0, 0, 7, 7], "line": [b"a", b"b", b"c", b"d"]})
    assert [(key, list(lines)) for key, lines in _by_block([batch, batch.slice(3)], ["path", "at"])] == [
        (("f", 0), [b"a", b"b"]), (("f", 7), [b"c"]), (("g", 7), [b"d", b"d"]),
    ]


def test_label_rows_without_python(spark):
    # Three tasks with the rows 0 and 1, 2, and none.
    rows = spark.range(0, 6, 1, 3).where("id < 3").select(
        F.concat(F.lit("r"), "id").alias("ResponseId"), F.lit("x").alias("Q4.2"), F.lit(None).cast("string").alias("Q4.3")
    )
    labelled = catalog._with_label_rows(rows)
    label = ("label",) * 3
    assert labelled.columns == rows.columns
    assert [tuple(r) for r in labelled.collect()] == [label, label, ("r0", "x", None), ("r1", "x", None), label, label, ("r2", "x", None)]
    assert "MapInPandas" not in labelled._jdf.queryExecution().toString()
