"""Weighted term tables per question: the data behind word clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from commentloom.config import TermSettings
from commentloom.functions.text import sanitize, terms
from commentloom.runtime import cut, numbered

# Question name of the stop words that hold for every question.
EVERY = "*"
# Value of `TermSettings.ties` for order of appearance.
FIRST_SEEN = "first_seen"


def stopword_table(spark: SparkSession, settings: TermSettings = TermSettings()) -> DataFrame:
    """`question, term`: lower-case, unique; global words under the question '*'."""
    rows = {(EVERY, w.lower()) for w in (*settings.stop_words, *settings.custom_stop_words)}
    shared = {w for _, w in rows}
    for question, listed in settings.question_stop_words.items():
        rows |= {(question, w.lower()) for w in listed if w.lower() not in shared}
    return spark.createDataFrame(sorted(rows), "question string, term string")


def _matches_pattern(term: Column, settings: TermSettings) -> Column:
    if not settings.regex_stop_words:
        return F.lit(False)
    return term.rlike("(?i)(?:" + "|".join(settings.regex_stop_words) + ")")


def kept_terms(df: DataFrame, settings: TermSettings = TermSettings(), by: tuple[str, ...] = ()) -> DataFrame:
    """`question, *by, term`, one row per kept token of `question, text`.

    With ties by first appearance also `seen`: response and place of the token. The stop-word
    table is as large as the settings, so it is broadcast.
    """
    found = terms(sanitize(F.col("text")))
    if settings.ties == FIRST_SEEN:
        placed = df.select("question", *by, "response_id", F.posexplode(found).alias("_at", "term"))
        tokens = placed.withColumn("seen", F.struct("response_id", "_at")).drop("response_id", "_at")
    else:
        tokens = df.select("question", *by, F.explode(found).alias("term"))
    stop = F.broadcast(stopword_table(df.sparkSession, settings))
    everywhere = stop.where(F.col("question") == EVERY).select("term")
    by_question = stop.where(F.col("question") != EVERY)
    return (
        tokens.where(~_matches_pattern(F.col("term"), settings))
        .join(everywhere, "term", "left_anti")
        .join(by_question, ["question", "term"], "left_anti")
    )


def _in_order(df: DataFrame) -> DataFrame:
    """`df` with the place of each response in their order for its `response_id`."""
    # A table, as the bounds of the ranges are sampled from it first.
    ids = cut(df.select("response_id").distinct()).withColumn("_all", F.lit(0))
    places = numbered(ids, "_all", ["response_id"], "_place").select(F.col("response_id").alias("_id"), "_place")
    return df.join(places, F.col("response_id").eqNullSafe(F.col("_id"))).drop("_id", "response_id").withColumnRenamed("_place", "response_id")


def term_table(df: DataFrame, settings: TermSettings = TermSettings(), by: tuple[str, ...] = ()) -> DataFrame:
    """`question, *by, term, freq_sum, rank, weight`: the most frequent terms.

    At most `max_words` terms of at least `min_freq`; ties fall to the term, or, as set, to the one
    that appears first in the order of the responses. The weight is frequency to the power
    `weight_power`, the largest being 100.
    """
    group = ("question", *by)
    tie = "seen" if settings.ties == FIRST_SEEN else "term"
    more = []
    if tie == "seen":
        df = _in_order(df.select(*group, "response_id", "text"))
        # One long, as the least of it is kept in a hash table; for that of a struct all tokens would be sorted.
        more = [F.min(F.shiftleft("seen.response_id", 31) + F.col("seen._at")).alias("seen")]
    counts = (
        kept_terms(df, settings, by)
        .groupBy(*group, "term")
        .agg(F.count("*").alias("freq_sum"), *more)
        .where(F.col("freq_sum") >= settings.min_freq)
    )
    order = Window.partitionBy(*group).orderBy(F.desc("freq_sum"), tie)
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.max_words).drop("seen")
    power = F.pow("freq_sum", F.lit(settings.weight_power))
    # Only the kept terms are left here, so the window is small.
    return top.withColumn("weight", power / F.max(power).over(Window.partitionBy(*group)) * 100)


def term_tables_by_cluster(df: DataFrame, settings: TermSettings = TermSettings()) -> DataFrame:
    """Styled term tables of the clusters of each question."""
    return term_style(term_table(df, settings, ("cluster",)), settings, ("cluster",))


def term_style(table: DataFrame, settings: TermSettings = TermSettings(), by: tuple[str, ...] = ()) -> DataFrame:
    """Add `angle` and `color` to a term table.

    The last round(n * rotate_ratio) ranks are upright; the palette is cycled over the terms
    in alphabetical order.
    """
    per_question = Window.partitionBy("question", *by)
    upright = F.bround(F.count("*").over(per_question) * F.lit(settings.rotate_ratio))
    angle = F.when(F.col("rank") > F.count("*").over(per_question) - upright, 90).otherwise(0)
    if settings.color == "random-dark":
        at = (F.row_number().over(per_question.orderBy("term")) - 1) % len(settings.palette)
        color = F.element_at(F.array(*[F.lit(c) for c in settings.palette]), at + 1)
    else:
        color = F.lit(settings.color or "black")
    return table.withColumn("angle", angle).withColumn("color", color)


def term_audit(df: DataFrame, settings: TermSettings = TermSettings()) -> DataFrame:
    """Characters and tokens before and after stop words, with the sizes of the lists.

    One pass and one aggregate: tokens are counted inside each row.
    """
    table: dict[str, set[str]] = {}
    shared = {w.lower() for w in (*settings.stop_words, *settings.custom_stop_words)}
    for question, listed in settings.question_stop_words.items():
        table[question] = {w.lower() for w in listed} - shared
    own = F.array().cast("array<string>")
    for question, listed in table.items():
        if listed:
            own = F.when(F.col("question") == question, F.array(*[F.lit(w) for w in sorted(listed)])).otherwise(own)

    clean = df.where(F.col("text").isNotNull()).select("question", sanitize(F.col("text")).alias("_t"))
    tokens = clean.withColumn("_all", terms(F.col("_t"))).withColumn("_own", own)
    left = F.filter(
        "_all",
        lambda t: ~t.isin(sorted(shared)) & ~F.array_contains("_own", t) & ~_matches_pattern(t, settings),
    )
    return tokens.groupBy("question").agg(
        F.sum(F.length("_t")).alias("chars"),
        F.sum(F.size("_all")).alias("tokens_before"),
        F.sum(F.size(left)).alias("tokens_after"),
        F.lit(len(shared)).alias("n_global_sw"),
        F.max(F.size("_own")).alias("n_question_sw"),
        F.lit(len(settings.regex_stop_words)).alias("n_regex"),
    )
