"""Column expressions on text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns without look-around, so that other regex engines accept them unchanged.
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
VISIBLE = r"[^\s\p{Z}]"
MARKUP = r"[\p{Cc}<>]|<[^>]*>|&[a-zA-Z0-9#]+;"
TAG = r"<[^>]*>"
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
TERM = r"[\p{L}\p{M}\p{N}_]+(?:['’.-][\p{L}\p{M}\p{N}_]+)*|[\p{Sm}\p{Sc}\p{Sk}\p{So}]"


# The characters of the class [\s\p{Z}].
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utrim(col: Column) -> Column:
    """Strip any Unicode white space from both ends (plain `trim` strips U+0020 only)."""
    return F.btrim(col, F.lit(SPACES))


def is_missing(col: Column) -> Column:
    """Null, or nothing but white space: the search ends at the first visible character."""
    return col.isNull() | ~col.rlike(VISIBLE)


def is_short(col: Column, min_length: int) -> Column:
    """Untrimmed code-point length below the minimum; false for null."""
    return col.isNotNull() & (F.length(col) < min_length)


def clean_text(col: Column) -> Column:
    """One space for each CR or LF, then trim."""
    return utrim(F.translate(col, "\r\n", "  "))


def is_translatable(col: Column, min_length: int) -> Column:
    """Trimmed length reaches the minimum; false for null."""
    return col.isNotNull() & (F.length(utrim(col)) >= min_length)


def blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def source_language(text: Column, detected: Column, user: Column) -> Column:
    """Language to translate from.

    No text gives null; no detection gives the respondent's language; a
    detection without a respondent's language gives null; else the detection.
    """
    return (
        F.when(blank(text), F.lit(None).cast("string"))
        .when(blank(detected), user)
        .when(user.isNull(), F.lit(None).cast("string"))
        .otherwise(detected)
    )


def sanitize(col: Column, strip_tags: bool = False) -> Column:
    """Control characters, angle brackets and entities become spaces; lower case; trim.

    Tag names survive unless `strip_tags` is set.
    """
    if strip_tags:
        col = F.regexp_replace(col, TAG, " ")
    return utrim(F.lower(F.regexp_replace(col, MARKUP, " ")))


def words(col: Column) -> Column:
    """Lower-case words, punctuation dropped: the tokens of cluster labels."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def terms(col: Column) -> Column:
    """Tokens of term tables: hyphenated words stay whole, symbols are kept."""
    return F.regexp_extract_all(col, F.lit(TERM), F.lit(0))


def request_key(*cols: Column) -> Column:
    """Content key of an enrichment request; nulls and empty strings differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)
