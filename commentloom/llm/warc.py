"""Content-addressed web archive.

Payload bytes are kept once, by SHA-256, in a table of their own; exact record headers are kept in
another. A record is header, payload and two line ends, put together by a join on the digest and
verified against it. Of captures with equal payloads of `REVISIT_BYTES` or more, the one with the
largest page id is a response and the others revisit it; smaller payloads are always responses.

Null html counts as empty. A null page id counts as the smallest; captures that repeat page id
and payload of the response are responses too. A null url leaves out the header line; line ends
in a url are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from commentloom.runtime import cut

REVISIT_BYTES = 1000
END = "\r\n"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload bytes, its length and both digests."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload",
        F.octet_length("payload").cast("long").alias("n"),
        F.sha1("payload").alias("sha1"),
        F.unhex(F.sha2("payload", 256)).alias("strong"),
    )


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _identity(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(revisit: Column) -> Column:
    """Exact header of a record, blank line included; over page_id, url, n, sha1 and winner."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _identity(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _identity(F.col("winner")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(END),
    )


def archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Writes both tables: headers (header, strong, n) and payloads (strong, payload).

    Payload bytes are exchanged once, by page id and digest, and only where a page is the one
    that holds its digest's bytes, so that copies of one payload are no hot key.
    """
    rows = captures(pages)
    facts = cut(rows.drop("payload"))
    held = cut(facts.groupBy("strong").agg(F.max("page_id").alias("winner")))
    revisit = (F.col("n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    headers = cut(facts.join(held, "strong").select(header(revisit).alias("header"), "strong", "n"))
    # Plain keys, so that the join's exchange also serves to drop repeated rows.
    known = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)).cast("long"))
    payloads = (
        rows.select(known("page_id").alias("holder"), "strong", "payload")
        .join(held.select(known("winner").alias("holder"), "strong"), ["holder", "strong"], "left_semi")
        .dropDuplicates(["holder", "strong"])
        .select("strong", "payload")
    )
    return headers, cut(payloads)


def field(name: str, of: str = "header") -> Column:
    """Value of a header line, or null."""
    return F.nullif(F.regexp_extract(of, f"(?m)^{name}: ([^\\r\\n]*)", 1), F.lit(""))


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The original records: header, block, and what the header and the verified payload say.

    A payload whose bytes do not have the digest they are kept under, or a block whose length is
    not the one in the header, raises an error.
    """
    verified = payloads.select(
        "payload",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("strong"), F.col("strong"))
        .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
        .alias("key"),
        F.sha1("payload").alias("payload_sha1"),
        F.octet_length("payload").cast("long").alias("payload_n"),
    )
    revisit = field("WARC-Type") == "revisit"
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    joined = headers.join(verified, F.col("strong") == F.col("key")).withColumn("block", block)
    right = (F.octet_length("block") == field("Content-Length").cast("long")) & (
        field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_sha1"))
    )
    return joined.select(
        F.when(right, F.col("header")).otherwise(F.raise_error(F.lit("a record does not fit its header"))).alias("header"),
        "block", "payload_sha1", "payload_n",
    )


def read_back(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def number(name: str):
        digits = F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
        return F.nullif(digits, F.lit("")).cast("long")

    return records(headers, payloads).select(
        number("WARC-Record-ID").alias("page_id"),
        F.col("payload_n").alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


def write_files(found: DataFrame, folder: str) -> None:
    """Records as archive files: Spark's line separator is the two line ends that close a record."""
    text = F.concat("header", F.decode("block", "UTF-8"))
    found.select(text.alias("value")).write.option("lineSep", END * 2).text(folder)


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    return read_back(*archive(pages, revisit_bytes))
