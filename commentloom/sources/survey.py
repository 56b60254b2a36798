"""Reading survey exports: tab separated, quoted line breaks, any charset, any number of files."""

from __future__ import annotations

import codecs
import csv
import logging
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from commentloom.config import DEFAULT_QUESTIONS
from commentloom.functions.text import utrim
from commentloom.runtime import name
from commentloom.sources.records import records

log = logging.getLogger(__name__)

ID_COLUMNS = ("ResponseId", "UserLanguage")
SAMPLE_BYTES = 10_000


def survey_schema(questions: Sequence[str] = DEFAULT_QUESTIONS) -> StructType:
    """Strings throughout: inference could turn an all-digit answer into a number."""
    return StructType([StructField(c, StringType()) for c in (*ID_COLUMNS, *questions)])


def nulled(col: Column) -> Column:
    """Trim, then empty text and the token NA are null."""
    trimmed = utrim(col)
    return F.when((trimmed != "") & (trimmed != "NA"), trimmed)


def read_survey(
    spark: SparkSession,
    path: str | list[str],
    questions: Sequence[str] = DEFAULT_QUESTIONS,
    encoding: str = "UTF-8",
    label_rows: int = 0,
) -> DataFrame:
    """Survey export as strings, chosen columns only; a missing column is an error.

    Columns are found by header name, so exports may carry other columns. Several files must have
    one charset and one header; `read_files` takes any. A file is read by as many tasks as it has blocks. The first `label_rows` rows of each file
    that has as many are left out.
    """
    try:
        kind = codecs.lookup(encoding).name
    except LookupError as problem:
        raise ValueError(f"unknown charset {encoding!r}") from problem
    wanted = [*ID_COLUMNS, *questions]
    if kind.startswith(("utf-16", "utf-32")):
        chosen = _whole_files(spark, path, wanted, encoding, label_rows)
    else:
        if bytes(range(0x80)).decode(kind, errors="replace") != bytes(range(0x80)).decode("ascii"):
            raise ValueError(f"charset {encoding!r} does not hold ASCII")
        header = next(iter(file_heads(spark, path, kind).select("header").take(1)), [[]])[0]
        missing = [c for c in wanted if c not in header]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {path}")
        # Header names may repeat or be empty; only the wanted ones need names of their own.
        named = [c if c in wanted and header.index(c) == i else f"_{i}" for i, c in enumerate(header)]
        schema = StructType([StructField(c, StringType()) for c in named])
        # The settings of Spark's parser for whole files, here for one record at a time.
        options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true"}
        cells = F.from_csv("record", ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names), options)
        parsed = records(spark, path, kind, label_rows).select(cells.alias("c"))
        chosen = parsed.select(*[F.col("c").getField(c).alias(c) for c in wanted])
    return chosen.select(*[nulled(name(c)).alias(c) for c in wanted])


def _whole_files(spark: SparkSession, path: str | list[str], wanted: list[str], encoding: str, label_rows: int) -> DataFrame:
    """Files whose line ends take several bytes, each read by one task."""
    raw = spark.read.options(
        sep="\t", header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding=encoding
    ).csv(path)
    wanted = [name(c) for c in wanted]
    if not label_rows:
        return raw.select(*wanted)
    # A file is read by one task, so its rows have consecutive numbers.
    placed = raw.select(*wanted, F.col("_metadata.file_path").alias("_file")).withColumn("_row", F.monotonically_increasing_id())
    firsts = placed.groupBy("_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    label = (F.col("_row") - F.col("_first") < label_rows) & (F.col("_n") >= label_rows)
    return placed.join(firsts, "_file").where(~label).select(*wanted)


def drop_label_rows(df: DataFrame, n: int = 2) -> DataFrame:
    """Remove the first `n` rows of a one-file scan, if there are that many.

    Only the ids of the first rows are gathered (a top-n), never the table.
    """
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    first = placed.select("_row").orderBy("_row").limit(n)
    count = Window.partitionBy(F.lit(1))
    labels = first.withColumn("_n", F.count("*").over(count)).where(F.col("_n") >= n).select("_row")
    return placed.join(F.broadcast(labels), "_row", "left_anti").drop("_row")


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Table at `path`, or an empty one when it is missing or not readable."""
    try:
        reader = spark.read.schema(schema).format(fmt)
        if fmt == "csv":
            reader = reader.options(header=True, multiLine=True, quote='"', escape='"', nullValue="NA")
        return reader.load(path)
    except AnalysisException as problem:
        log.error("Failed to read %s: %s", path, problem)
        return spark.createDataFrame([], schema)


def read_files(
    spark: SparkSession, path: str | list[str], questions: Sequence[str] = DEFAULT_QUESTIONS, label_rows: int = 0
) -> DataFrame:
    """Survey exports of any number of files, each in its own charset and column order.

    Files that agree in both are read as one scan. The first `label_rows` rows of each file
    that has as many are left out.
    """
    found = file_heads(spark, path).orderBy("path").collect()  # one row per file
    groups: dict[tuple, list[str]] = {}
    for r in found:
        groups.setdefault((r["encoding"], tuple(r["header"])), []).append(r["path"])
    if not groups:
        raise FileNotFoundError(f"no survey file at {path}")
    scans = []
    for (encoding, _), files in groups.items():
        scans.append(read_survey(spark, files, questions, encoding, label_rows))
    return reduce(DataFrame.unionByName, scans)


def file_heads(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """`path, encoding, confidence, header` of each file, from its first 10,000 bytes; `encoding` if it is known."""

    def inspect(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        head = bytes(frame["head"].iloc[0])
        confidence, found = (100, encoding) if encoding else max((c, e) for e, c in _candidates(head))
        first = next(csv.reader(codecs.decode(head, found, "ignore").lstrip("\ufeff").splitlines(True), delimiter="\t"), [])
        return pd.DataFrame([(key[0], found, confidence, first)], columns=["path", "encoding", "confidence", "header"])

    return _heads(spark, path).groupBy("path").applyInPandas(
        inspect, "path string, encoding string, confidence int, header array<string>"
    )


def _heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path, head`: the first bytes of each file. Lines are streamed, never whole files held."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("line"),
    )

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, bytearray] = {}
        for batch in batches:
            for file, line in zip(batch["path"], batch["line"]):
                head = held.setdefault(file, bytearray())
                if len(head) < SAMPLE_BYTES:
                    head += bytes(line)[:SAMPLE_BYTES] + b"\n"
        if held:
            yield pd.DataFrame({"path": list(held), "head": [bytes(h[:SAMPLE_BYTES]) for h in held.values()]})

    # Lines of a file's first block are in one task, in order.
    return lines.where("at = 0").select("path", "line").mapInPandas(first, "path string, head binary")


def detect_charsets(spark: SparkSession, path: str) -> DataFrame:
    """`path, encoding, confidence`: the likeliest charset of each file.

    The vote looks at the first 10,000 bytes of every file, files in parallel.
    """
    return file_heads(spark, path).drop("header")


def _candidates(head: bytes) -> Iterable[tuple[str, int]]:
    marks = [
        (codecs.BOM_UTF32_LE, "UTF-32"), (codecs.BOM_UTF8, "UTF-8"),
        (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16"),
    ]
    for mark, encoding in marks:
        if head.startswith(mark):
            return [(encoding, 100)]
    try:
        # Not final: the sample may end inside a character.
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return [("UTF-8", 100 if any(b >= 0x80 for b in head) else 90), *_wide(head)]
    except UnicodeDecodeError:
        pass
    votes = [(encoding, round(80 * _plausible(head, encoding)) - rank) for rank, encoding in enumerate(CHARSETS)]
    return [*votes, *_wide(head)]


def _wide(head: bytes) -> list[tuple[str, int]]:
    return [
        (encoding, 101)
        for encoding, zeros in (("UTF-16LE", head[1::2]), ("UTF-16BE", head[::2]))
        if zeros and zeros.count(0) * 2 > len(zeros)
    ]


# Tried in this order; the earlier one wins where two are as plausible.
CHARSETS = (
    "ISO-8859-1", "windows-1252", "windows-1254", "windows-1250", "windows-1251", "koi8-r", "windows-1253",
    "shift_jis", "euc_jp", "euc_kr", "gb18030", "big5",
)
# Letters and signs that hardly stand in running text, if a charset has them at the places of others.
SELDOM = set("ðþýţÐÞÝŢ¹³¿¾¼½¶§¤¦¨¬¯±²´µ¸¥£ª¡")
SIGNS = set("–—‘’“”„…€«»°·©®™  ")


def _plausible(head: bytes, encoding: str) -> float:
    """Share of the non-ASCII characters that stand as they would in text, 0 to 1.

    Letters count if their word keeps to one script and one pattern of cases, and, in Latin
    script, is not mostly accents; East Asian characters count if they are common ones.
    """
    text = codecs.getincrementaldecoder(encoding)("replace").decode(head)
    good = total = 0.0
    if encoding in ("shift_jis", "euc_jp") and not any(_script(c) == "HIRAGANA" for c in text):
        return 0.5  # Japanese is hardly written without
    for word in text.split():
        marked = [c for c in word if ord(c) >= 0x80]
        if not marked:
            continue
        letters = [c for c in word if c.isalpha()]
        scripts = {_script(c) for c in letters}
        cased = "".join(c for c in letters if c.lower() != c.upper())
        regular = cased in (cased.lower(), cased.upper(), cased.capitalize())
        latin = scripts == {"LATIN"}
        mostly_accents = latin and len(letters) >= 3 and sum(ord(c) >= 0x80 for c in letters) * 2 > len(letters)
        for c in marked:
            total += 1
            if c == "\ufffd" or "\x80" <= c < "\xa0":
                good -= 1
            elif not c.isalpha():
                good += 1.0 if c in SIGNS or unicodedata.name(c, "").startswith(("IDEOGRAPHIC", "FULLWIDTH")) else 0.0
            elif _script(c) in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"):
                good += 1.0 if _common(c) and not {"HANGUL", "CJK"} <= scripts else 0.3
            elif c in SELDOM or len(scripts - {"CJK", "HIRAGANA", "KATAKANA"}) > 1 or not regular or mostly_accents:
                good += 0.2
            else:
                good += 1.0
    return max(0.0, good / total) if total else 0.0


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def _common(c: str) -> bool:
    """Whether an East Asian character is a usual one: kana, Hangul, or in both older standards."""
    if _script(c) in ("HIRAGANA", "KATAKANA"):
        return not unicodedata.name(c).startswith("HALFWIDTH")
    try:
        if _script(c) == "HANGUL":
            return bool(c.encode("euc_kr"))
        # First levels of the national sets, which are ordered by use.
        lead = [c.encode(e)[0] for e, low, high in (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF)) if _held(c, e, low, high)]
        return bool(lead) or _held(c, "big5", 0xA4, 0xC6)
    except UnicodeEncodeError:
        return False


def _held(c: str, encoding: str, low: int, high: int) -> bool:
    try:
        return low <= c.encode(encoding)[0] <= high
    except UnicodeEncodeError:
        return False
