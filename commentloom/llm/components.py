"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from commentloom.runtime import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v of a large star: each node links its larger neighbours to the least node it sees.

    As u > v, that is its least v, or itself if it has none.
    """
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges of a small star: each node links its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    made = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return edges.join(least, "u").select(F.inline(made)).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and no larger one, or no smaller one: then the edges are stars."""
    end = lambda x, up: F.struct(F.col(x).alias("x"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = F.array(end("u", 1), end("v", 0))
    nodes = edges.select(F.inline(ends)).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up + down > 1 AND up > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; the component is its least node.

    `edges` has long columns u and v. No round gathers the neighbours of a node: minima are
    partial aggregates, and joins have one row per node on one side. Rounds go on until the edges are stars: in each,
    more nodes of a component become neighbours of its least one, and when all are, the next round leaves these edges only.
    Each star is a query of its own, as the driver plans and follows small plans with far less memory than one of both.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        # Nothing reads the edges of a star that is over.
        for star in (_large_star, _small_star):
            last, now = now, cut(star(now))
            drop(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def members(links: DataFrame) -> DataFrame:
    """(row, component) of all rows with a link, the least row of each component included."""
    found = components(links)
    least = found.select(F.col("component").alias("row"), "component").distinct()
    return found.select(F.col("node").alias("row"), "component").unionByName(least)


def numbered(docs: DataFrame) -> DataFrame:
    """A table of `docs` with columns c0, c1, … and a number of each row, `row`."""
    return cut(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id()))


def least_rows(rows: DataFrame, found: DataFrame, names: list[str], id_column: str) -> DataFrame:
    """The rows of `numbered` that stay, under their `names`.

    Of each component of `found` (row, component) exactly one row stays: that with the smallest id,
    one without an id only if no other has one. Rows that are in no component stay.
    """
    named = cut(rows.select("row", F.col(f"c{names.index(id_column)}").alias("id")).join(found, "row"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"))
    gone = named.select("row").join(least.select("least.row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
