from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentloom.config import ClusteringSettings
from commentloom.operators import cluster, contraction, density, forest, kmeans, layout, neighbours, silhouette, vectors
from commentloom.runtime import cut, running, shared_folder

SETTINGS = ClusteringSettings()
RNG = np.random.default_rng(3)
POINTS = np.vstack(
    [
        RNG.normal(0, 0.3, (50, 3)), RNG.normal(4, 0.3, (40, 3)), RNG.normal([0, 5, 0], 0.5, (30, 3)),
        RNG.uniform(-5, 8, (20, 3)),
    ]
)
# A fifth of the rows are copies of one vector.
POINTS = np.vstack([POINTS, np.repeat(POINTS[:1], 30, axis=0)])


def frame(spark, parts, ids=int):
    kind = "bigint" if ids is int else "string"
    rows = [(q, ids(i), [float(v) for v in x]) for q, points in parts.items() for i, x in enumerate(points)]
    return spark.createDataFrame(rows, f"question string, response_id {kind}, embedding array<double>")


@pytest.fixture(scope="module")
def rows(spark):
    return cut(frame(spark, {"Q4.2": POINTS, "Q4.3": POINTS[::2]}))


def all_distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_standardise(spark):
    df = frame(spark, {"q": np.array([[1.0, 5.0], [3.0, 5.0]])})
    out = sorted(tuple(r["embedding"]) for r in vectors.standardise(df).collect())
    assert np.allclose(out, [(-(0.5**0.5), 0), (0.5**0.5, 0)])


def test_partly_null_vector_is_an_error(spark):
    df = spark.createDataFrame([("q", 1, [1.0, None])], "question string, response_id int, embedding array<double>")
    with pytest.raises(Exception, match="null components"):
        vectors.standardise(df).collect()


def test_few_documents_are_skipped(spark):
    df = frame(spark, {"a": POINTS[:4], "b": POINTS[:5]})
    assert {r["question"] for r in vectors.enough_docs(df).collect()} == {"b"}


def test_components(spark, rows):
    out = vectors.reduce_dimensions(rows.repartition(3), 2).where("question = 'Q4.2'").orderBy("response_id").toPandas()
    scores = np.vstack(out["embedding"].to_list())
    z = (POINTS - POINTS.mean(0)) / POINTS.std(0, ddof=1)
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    assert scores.shape == (len(POINTS), 2)
    assert np.allclose(np.abs(scores), np.abs(z @ axes.T[:, :2]), atol=1e-8)
    assert np.allclose(scores.T @ scores, np.diag(s[:2] ** 2), atol=1e-6)


def test_no_more_components_than_rows(spark):
    df = frame(spark, {"q": RNG.normal(size=(5, 8))})
    assert len(vectors.reduce_dimensions(df, 50).first()["embedding"]) == 5


@pytest.mark.parametrize("block_rows", [2048, 60])
def test_neighbours(rows, block_rows):
    k = 4
    out = neighbours.knn(rows, k, block_rows).toPandas()
    for q, x in (("Q4.2", POINTS), ("Q4.3", POINTS[::2])):
        d = all_distances(x)
        np.fill_diagonal(d, np.inf)
        expected = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d.round(9)), axis=1)[:, :k]
        part = out[out["question"] == q].sort_values(["response_id", "rank"])
        assert len(part) == k * len(x)
        assert np.allclose(part["distance"].to_numpy().reshape(-1, k), np.take_along_axis(d, expected, 1))
        assert (part["neighbour_id"].to_numpy().reshape(-1, k) == expected).all()


def test_bottlenecks():
    link = np.array([[0, 1, 9], [1, 0, 4], [9, 4, 0.0]])
    assert (forest.bottlenecks(link) == np.array([[0, 1, 4], [1, 0, 4], [4, 4, 0]])).all()


def tree_weight(x, min_pts):
    d = all_distances(x)
    core = np.sort(d, axis=1)[:, min_pts - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    left, near, total = set(range(1, len(x))), reach[0].copy(), 0.0
    while left:
        at = min(left, key=lambda i: near[i])
        left.remove(at)
        total += near[at]
        near = np.minimum(near, reach[at])
    return total


@pytest.fixture(scope="module")
def edges(rows):
    return cut(density.spanning_tree(rows, SETTINGS))


@pytest.mark.parametrize("block_rows", [2048, 60])
def test_tree_weight(rows, block_rows):
    tree = density.spanning_tree(rows, replace(SETTINGS, block_rows=block_rows))
    found = {r["question"]: r for r in tree.groupBy("question").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    for q, x in (("Q4.2", POINTS), ("Q4.3", POINTS[::2])):
        assert found[q]["n"] == len(x) - 1
        assert np.isclose(found[q]["w"], tree_weight(x, SETTINGS.min_pts))


def test_forest_by_rounds_equals_forest_in_one_task(spark):
    pairs = RNG.integers(0, 60, (300, 2))
    data = [("q", float(w), int(min(p)), int(max(p))) for w, p in zip(RNG.integers(0, 9, 300), pairs) if p[0] != p[1]]
    df = spark.createDataFrame(data, "question string, weight double, lo bigint, hi bigint").dropDuplicates(["lo", "hi"])
    df = cut(df)
    one, components = forest.spanning_forest(df, 10**6)
    many, components_too = forest.spanning_forest(df, 0)
    assert set(map(tuple, one.collect())) == set(map(tuple, many.collect()))
    groups = lambda c: {frozenset(r["m"]) for r in c.groupBy("component").agg(F.collect_set("node").alias("m")).collect()}
    assert groups(components) == groups(components_too)


def test_clusters_by_joins_equal_clusters_in_one_task(edges):
    label = lambda limit: [tuple(r) for r in density.flat_clusters(edges, SETTINGS.min_pts, limit).orderBy("question", "response_id").collect()]
    inside = label(10**6)
    assert len({c for _, _, c in inside}) > 2
    assert label(0) == inside


def chain_of_blobs(rng, blobs, order):
    """Edges of a tree: small stars in a chain whose links grow by `order`."""
    edges, first = [], 0
    for i in range(blobs):
        n = int(rng.integers(5, 9))
        edges += [("q", float(rng.integers(1, 5)) / 10, first, first + j) for j in range(1, n)]
        if i:
            edges.append(("q", 1.0 + float(order[i]), last, first))
        last, first = first + n - 1, first + n
    return edges


@pytest.mark.parametrize("shape", ["rising", "falling", "mixed"])
def test_contraction_of_a_chain(spark, monkeypatch, shape):
    """As in one task, in no more rounds than twice the logarithm of the number of splits."""
    rng = np.random.default_rng(7)
    n = 40
    order = {"rising": np.arange(n), "falling": np.arange(n)[::-1], "mixed": rng.permutation(n)}[shape]
    schema = "question string, weight double, lo bigint, hi bigint"
    edges = cut(spark.createDataFrame(chain_of_blobs(rng, n, order), schema))
    rounds = []
    monkeypatch.setattr(contraction, "join_nearest", lambda live, real=contraction.join_nearest: rounds.append(1) or real(live))
    label = lambda limit: [tuple(r) for r in density.flat_clusters(edges, 5, limit).orderBy("response_id").collect()]
    inside = label(10**6)
    assert len({c for _, _, c in inside}) > 2 and not rounds
    assert label(0) == inside
    assert 0 < len(rounds) <= 2 * np.log2(n)


def test_running_totals_across_partitions(spark):
    """Sums and greatest values of groups that lie in several range partitions, nulls left out."""
    rng = np.random.default_rng(1)
    rows = [("a" if i < 700 else None, i, None if i % 7 == 0 else float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(5)
    found = running(df, ["g"], ["i"], {"total": ("sum", F.col("x")), "top": ("max", F.col("x"))})
    for r in found.collect():
        own = [x for g, i, x in rows if g == r["g"] and i <= r["i"] and x is not None]
        assert (r["total"] is None) == (not own)
        assert not own or np.isclose(r["total"], sum(own)) and r["top"] == max(own)


def test_two_blobs_and_outliers(spark):
    blobs = np.vstack([RNG.normal(0, 0.1, (12, 2)), RNG.normal(9, 0.1, (10, 2)), [[50, 50], [-40, 70], [80, -30]]])
    order = RNG.permutation(len(blobs))
    for ids, parts in ((int, 1), (lambda i: f"r{i:03d}", 16)):
        df = frame(spark, {"q": blobs}, ids).repartition(parts)
        out = [r["cluster"] for r in density.hdbscan(df).orderBy("response_id").collect()]
        assert out == [1] * 12 + [2] * 10 + [0] * 3
    shuffled = frame(spark, {"q": blobs[order]})
    again = np.array([r["cluster"] for r in density.hdbscan(shuffled).orderBy("response_id").collect()])
    where = {i: c for i, c in zip(order, again)}
    assert len({where[i] for i in range(12)}) == 1 and len({where[i] for i in range(12, 22)}) == 1
    assert [where[i] for i in (22, 23, 24)] == [0, 0, 0]


def mean_silhouette(x, c):
    d, out = all_distances(x), []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block_rows, per_pass", [(2048, 8192), (30, 3)])
def test_silhouette(rows, block_rows, per_pass):
    labelled = rows.withColumn("cluster", F.pmod(F.xxhash64("embedding"), F.lit(7)).cast("int"))
    found = {r["question"]: r["silhouette"] for r in silhouette.silhouette(labelled, block_rows, per_pass).collect()}
    for q in found:
        part = labelled.where(F.col("question") == q).orderBy("response_id").toPandas()
        expected = mean_silhouette(np.vstack(part["embedding"].to_list()), part["cluster"].to_numpy())
        assert np.isclose(found[q], expected)


def test_silhouette_edges(spark):
    df = frame(spark, {"one": POINTS[:6], "alone": POINTS[:2]})
    df = df.withColumn("cluster", F.when(F.col("question") == "one", 0).otherwise(F.col("response_id")).cast("int"))
    found = {r["question"]: r["silhouette"] for r in silhouette.silhouette(df).collect()}
    assert found == {"one": None, "alone": 0.0}


def test_best_k_breaks_ties_downwards(spark):
    scores = spark.createDataFrame(
        [("q", 2, 0.5), ("q", 3, None), ("q", 4, 0.5), ("q", 5, 0.1)], "question string, k int, silhouette double"
    )
    assert tuple(cluster.best_k(scores).first()) == ("q", 2, 0.5)


def test_kmeans(spark):
    blobs = np.vstack([RNG.normal(m, 0.1, (15, 2)) for m in (0, 5, 10)])
    rows = cut(frame(spark, {"q": blobs, "few": blobs[:3]}))
    models = kmeans.kmeans(rows, [2, 3, 4], n_start=5)
    found = models.where("question = 'q' and k = 3").orderBy("response_id").toPandas()["cluster"].to_numpy()
    assert all(len(set(found[i : i + 15])) == 1 for i in (0, 15, 30)) and set(found) == {1, 2, 3}
    assert {r["k"] for r in models.where("question = 'few'").select("k").distinct().collect()} == {2}
    chosen, best = cluster.choose_k(rows.where("question = 'q'"), replace(SETTINGS, max_kmeans_k=4, n_start=5))
    assert best.first()["k"] == 3 and chosen.count() == 45


def within(x, parts):
    return sum(((x[list(p)] - x[list(p)].mean(axis=0)) ** 2).sum() for p in parts)


def partitions(n, k):
    """All partitions of range(n) into k parts."""
    def grow(i, parts):
        if i == n:
            if len(parts) == k:
                yield [list(p) for p in parts]
            return
        for p in parts:
            p.append(i)
            yield from grow(i + 1, parts)
            p.pop()
        if len(parts) < k:
            parts.append([i])
            yield from grow(i + 1, parts)
            parts.pop()
    return grow(0, [])


@pytest.mark.parametrize("task_rows", [100, 0])
def test_kmeans_against_all_partitions(spark, task_rows):
    """The least within-sum there is, in one task and by passes over the table."""
    rng = np.random.default_rng(6)
    sets = {f"q{i}": rng.normal(size=(8, 2)) for i in range(3)}
    rows = cut(frame(spark, sets))
    models = kmeans.kmeans(rows, [2, 3], n_start=6, task_rows=task_rows).toPandas()
    for q, x in sets.items():
        for k in (2, 3):
            of = models[(models["question"] == q) & (models["k"] == k)].groupby("cluster")["response_id"].apply(list)
            assert len(of) == k
            assert within(x, of) <= min(within(x, p) for p in partitions(8, k)) * (1 + 1e-9)


def test_single_moves_go_on_where_passes_rest():
    """A start at which every row is next to its own centre, and one row still gains by a move."""
    x = np.array([[0.0], [1.0], [2.4], [9.0]]) * 1.0
    run = lambda m: {q: kmeans._lines(x, held) for q, held in m.items()}
    moves = lambda m, sums: {q: kmeans._best_moves(x, held, sums[q]) for q, held in m.items()}
    rested, _ = kmeans._improve({"q": [(2, 0, np.array([[0.0], [4.0]]))]}, 50, run)
    best = kmeans._fit({"q": [(2, 0, np.array([[0.0], [4.0]]))]}, 50, run, moves)
    assert run(best)["q"][:, 1].sum() <= run(rested)["q"][:, 1].sum()
    assert np.isclose(sorted(best["q"][0][2].ravel()), [3.4 / 3, 9.0]).all()


def test_models_at_rest_take_part_in_no_further_pass():
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=(400, 4)), "b": np.repeat(np.eye(4) * 50, 5, axis=0) + rng.normal(size=(20, 4))}
    starts = {q: [(k, 0, held[:k].copy()) for k in (2, 3, 7)] for q, held in x.items()}
    asked = []

    def run(models):
        asked.append({q: [k for k, _, _ in held] for q, held in models.items()})
        return {q: kmeans._lines(x[q], held) for q, held in models.items()}

    found, live = kmeans._improve(starts, 200, run)
    assert not live and asked[0] == {"a": [2, 3, 7], "b": [2, 3, 7]}
    assert "b" not in asked[-1] and len(asked[-1]["a"]) < 3
    for q in x:
        for i, (k, _, centres) in enumerate(starts[q]):
            alone, _ = kmeans._improve({q: [(k, 0, centres)]}, 200, run)
            assert np.array_equal(found[q][i][2], alone[q][0][2])


@pytest.mark.parametrize("block_rows", [16_384, 25])
def test_scores_of_all_k_in_one_pass(spark, rows, block_rows):
    """As one silhouette for each k, copies included, in one block and in many."""
    models = cut(kmeans.labels(rows, [2, 3, 5], n_start=2))
    found = {(r["question"], r["k"]): r["silhouette"] for r in silhouette.sweep(models, block_rows).collect()}
    for i, k in enumerate((2, 3, 5)):
        one = models.select("question", "response_id", "embedding", F.col("labels")[i].alias("cluster"))
        for r in silhouette.silhouette(one).collect():
            assert np.isclose(found[r["question"], k], r["silhouette"])
    assert len(found) == 6


def test_copies_of_a_row_grow_with_the_root_of_the_blocks(spark):
    """36 blocks that all meet: twelve copies of a row at most, not 36; and the neighbours are those of one block."""
    points = np.random.default_rng(9).normal(size=(288, 8))
    df = cut(frame(spark, {"q": points}))
    rows = df.select("*", F.lit(0).alias("cell"), (F.col("response_id") % 36).cast("int").alias("sub"))
    cells = spark.createDataFrame([("q", 0, 0, 36, 36)], "question string, a int, b int, n_sub_a int, n_sub_b int")
    left, right = neighbours.grid(rows, cut(neighbours.block_pairs(cells, ordered=True)))
    of = lambda side: side.where(F.col("response_id").isNotNull()).groupBy("response_id").count().agg(F.max("count")).first()[0]
    assert of(left) + of(right) <= 2 * 36**0.5
    near = lambda block: set(map(tuple, neighbours.knn(df, 4, block).collect()))
    assert near(16_384) == near(8)


def test_pairs_of_blocks_give_cross_edges_only(spark):
    rng = np.random.default_rng(2)
    import pandas as pd

    side = lambda first: pd.DataFrame({"question": "q", "response_id": np.arange(first, first + 20) * 7 % 41, "embedding": list(rng.normal(size=(20, 3))), "core": rng.random(20), "cell": 0})
    left, right = side(0), side(20)
    edges = forest._cross_tree(left, right)
    mine = set(left["response_id"])
    assert len(edges) == 39 and all((a in mine) != (b in mine) for a, b in zip(edges["lo"], edges["hi"]))


def test_small_blocks_share_tasks_and_calls(spark):
    """1,296 pairs of small blocks: one task, one copy of a row on each side, one call for each block."""
    df = cut(frame(spark, {"q": np.random.default_rng(9).normal(size=(288, 8))}))
    rows = df.select("*", F.lit(0).alias("cell"), (F.col("response_id") % 36).cast("int").alias("sub"))
    cells = spark.createDataFrame([("q", 0, 0, 36, 36)], "question string, a int, b int, n_sub_a int, n_sub_b int")
    pairs = cut(neighbours.block_pairs(cells, ordered=True))
    left, right = neighbours.grid(rows, pairs)
    assert left.where("response_id IS NOT NULL").count() == right.count() == 288

    def sizes(mine, theirs):
        return mine.iloc[:1][["question"]].assign(mine=len(mine), theirs=len(theirs))

    calls = neighbours.on_pairs(rows, pairs, sizes, "question string, mine int, theirs int").collect()
    assert [(r["mine"], r["theirs"]) for r in calls] == [(8, 280)] * 36


@pytest.mark.parametrize("piece", [8192, 40])
def test_small_bins_do_not_copy_rows(spark, monkeypatch, piece):
    """Blocks of four rows: a row goes to each task that holds its targets, not to each of its 50 bins."""
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(c, 1.0, (80, 4)) for c in range(4)])
    labelled = cut(frame(spark, {"q": points}).withColumn("cluster", F.floor(F.col("response_id") / 80).cast("int")))
    copies = []

    def counted(points, clusters, asked, real=silhouette._distance_sums):
        copies.append(asked.select(F.explode("sides")).count())
        return real(points, clusters, asked)

    monkeypatch.setattr(silhouette, "PIECE_ROWS", piece)
    monkeypatch.setattr(silhouette, "_distance_sums", counted)
    scores = [silhouette.silhouette(labelled, *limits).first()["silhouette"] for limits in ((4, 2), (4,), (16_384,))]
    assert np.allclose(scores, scores[2])
    assert copies[0] == copies[1] <= 320 * -(-320 // piece) and copies[2] == 320


@pytest.mark.parametrize("bounded", [True, False])
def test_forest_between_sides_looks_at_near_pairs_only(monkeypatch, bounded):
    """Rows on both sides, ties on a lattice, two far groups: with the known edges it holds the tree of all pairs."""
    import pandas as pd

    grid = np.array([(a, b) for a in range(6) for b in range(5)], float)
    points = np.concatenate([grid, grid + 100.0])
    n = len(points)
    ids, core = np.random.default_rng(4).permutation(n) + 10, np.ones(n)
    rows = pd.DataFrame({"question": "q", "response_id": ids, "embedding": list(points), "core": core, "cell": 0, "sub": np.arange(n) // 10})
    blocks = [rows[rows["sub"] == b] for b in range(6)]
    known = [forest._local_tree(b) for b in blocks] + [forest._local_tree(pd.concat([b.iloc[:1] for b in blocks]))]
    known = pd.concat(known)[["question", *forest.EDGE]].drop_duplicates()
    steps = forest._rounds(known)
    rows = rows.merge(steps[["response_id", "joined", "longest"]], on="response_id")
    if not bounded:
        rows[["joined", "longest"]] = None
    named = [(np.arange(b * 10, b * 10 + 10), [np.arange(c * 10, c * 10 + 10) for c in range(b + 1, 6)]) for b in range(5)]
    seen = []
    monkeypatch.setattr(forest, "_forest", lambda w, lo, hi, real=forest._forest: seen.append(len(w)) or real(w, lo, hi))
    between = forest._between(rows, rows, named)
    both = pd.concat([known, between]).drop_duplicates()
    found = set(zip(*forest._forest(*(both[c].to_numpy() for c in forest.EDGE))))
    whole = forest._local_tree(rows)
    assert found == set(whole[list(forest.EDGE)].itertuples(index=False, name=None))
    # Within a group by steps of the group, not by those that link the two.
    assert not bounded or seen[0] < 600


def test_fallback_when_all_is_noise(spark):
    line = np.column_stack([np.arange(12) ** 2.0, np.zeros(12)])
    blobs = np.vstack([RNG.normal(0, 0.1, (12, 2)), RNG.normal(9, 0.1, (12, 2))])
    scores = cut(frame(spark, {"noise": line, "dense": blobs}))
    found, methods = cluster.cluster_scores(scores, replace(SETTINGS, max_kmeans_k=3, n_start=3))
    by_question = {r["question"]: r for r in methods.collect()}
    assert by_question["noise"]["method"] == "KMeans" and by_question["dense"]["method"] == "HDBSCAN"
    assert round(by_question["dense"]["silhouette"], 3) == by_question["dense"]["silhouette"]
    assert found.where("question = 'noise'").agg(F.min("cluster")).first()[0] == 1
    assert found.count() == 36


@pytest.mark.parametrize("rows_per_task", [4096, 48])
def test_layout_keeps_neighbourhoods(spark, monkeypatch, rows_per_task):
    """In one group, and in groups that exchange their borders: five blobs of 60 rows, 200 epochs in few jobs."""
    rng = np.random.default_rng(5)
    blobs = np.vstack([rng.normal(0, 0.4, (60, 5)) + np.eye(5)[i] * 8 for i in range(5)])
    blobs = np.vstack([blobs, blobs[:10]])
    scores = cut(frame(spark, {"q": blobs}))
    moves = []
    monkeypatch.setattr(layout, "_moved", lambda *args, real=layout._moved: moves.append(args) or real(*args))
    settings = replace(SETTINGS, n_neighbors=8, layout_rows=rows_per_task, max_pivots=8)
    out = layout.embed_plane(scores, settings).orderBy("response_id").toPandas()
    assert len(moves) == (1 if rows_per_task > 400 else settings.layout_exchanges)
    assert sum(args[3] - args[2] for args in moves) == settings.layout_epochs
    plane = out[["x", "y"]].to_numpy()
    assert len(out) == 310 and np.isfinite(plane).all() and (plane[:10] == plane[300:]).all()
    plane, blobs = plane[:300], blobs[:300]

    def nearest(x):
        d = all_distances(x)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :8]

    found, true = nearest(plane), nearest(blobs)
    assert (found // 60 == np.arange(300)[:, None] // 60).mean() > 0.95
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, true)]) > 8 * 0.25


def test_spectral_start_orders_a_ring():
    n = 60
    head = np.repeat(np.arange(n), 2)
    tail = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1).ravel()
    plane = layout.spectral(n, head, tail, np.ones(2 * n), rounds=4000)
    step = np.sqrt(((plane - np.roll(plane, 1, axis=0)) ** 2).sum(axis=1))
    assert step.max() < 0.25 and np.abs(plane).max() > 0.9


def test_weights_count_each_list_once(spark):
    """A row that all others list has no more edges than its own list."""
    star = np.vstack([np.zeros((1, 12)), np.eye(12)])
    near = neighbours.knn(frame(spark, {"q": star}), 3)
    edges = layout.neighbour_weights(near, 3).groupBy("response_id").count().collect()
    assert {r["count"] for r in edges} == {3}


def small(spark, groups):
    rows = [(f"q{g}", g * 1000 + i, [float(x) for x in v]) for g, vs in enumerate(groups) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "question string, response_id long, embedding array<double>")


def test_copies_do_not_lose_a_question(spark):
    """Twelve equal vectors admit no k; three distinct ones with four copies each have k = 3."""
    three = [v for v in ([0, 0], [9, 0], [0, 9]) for _ in range(4)]
    rows = small(spark, [[[1, 2]] * 12, three])
    chosen, best = cluster.choose_k(rows, replace(SETTINGS, n_start=3))
    assert chosen.count() == rows.count()
    found = {r["question"]: (r["k"], r["silhouette"]) for r in best.collect()}
    assert found["q0"] == (1, None) and found["q1"][0] == 3 and abs(found["q1"][1] - 1) < 1e-9
    clusters, methods = cluster.cluster(rows, replace(SETTINGS, min_pts=5, n_start=3))
    assert clusters.count() == rows.count() and methods.count() == 2


def test_scores_of_copies_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 24))
    rows = small(spark, [[base[i % 5] for i in range(400)]])
    seen = [
        {tuple(r["embedding"]) for r in vectors.reduce_dimensions(rows.repartition(n), 4).collect()} for n in (1, 7, 37)
    ]
    assert [len(s) for s in seen] == [5, 5, 5]


def test_rounds_of_tasks_copy_few_rows(spark, monkeypatch):
    """Many small super-blocks: no round has more than a few copies of the rows, and the neighbours and the tree are those of one block."""
    points = np.random.default_rng(12).normal(size=(400, 4))
    df = cut(frame(spark, {"q": points, "r": points[:150]}))
    edges = lambda **how: set(map(tuple, density.spanning_tree(df, replace(SETTINGS, **how)).select("question", "weight", "lo", "hi").collect()))
    near = lambda block: set(map(tuple, neighbours.knn(df, 4, block).collect()))
    one = near(16_384), edges(block_rows=16_384)
    sides = []

    def counted(rows, dealt, *how, real=neighbours._met):
        held = [side.where("response_id IS NOT NULL").count() for side in neighbours._filled(rows, dealt)]
        sides.append((sum(held), dealt.where("row_side > column_side").count()))
        return real(rows, dealt, *how)

    monkeypatch.setattr(neighbours, "PIECE_ROWS", 30)
    monkeypatch.setattr(neighbours, "_met", counted)
    assert (near(8), edges(block_rows=8)) == one
    assert len(sides) > 6 and max(n for n, _ in sides) <= 6 * 550
    # Of the tree, a pair of super-blocks is one task.
    assert not sides[-1][1] and sides[0][1]


def test_steps_leave_only_their_result(spark):
    """The clusters hold no table of the vectors once they are found."""
    import glob

    points = np.vstack([np.random.default_rng(3).normal(c, 0.2, (40, 6)) for c in (0, 5)])
    df = cut(frame(spark, {"q": points}))
    held = lambda: {p for p in glob.glob(f"{shared_folder(spark).removeprefix('file:')}/**/*.parquet", recursive=True) if p.endswith(".parquet")}
    before = held()
    found, methods = cluster.cluster(df, replace(SETTINGS, pca_dims=3))
    assert found.count() == 80 and methods.count() == 1
    left = spark.read.option("mergeSchema", "true").parquet(*sorted(held() - before))
    assert "embedding" not in left.columns


def test_trees_beyond_the_limit_look_at_near_pairs_only(spark, monkeypatch):
    """Two far groups, ties and copies: the bounds hold for the known tree, and few pairs get distances; the tree is that of one task."""
    import pandas as pd

    rng = np.random.default_rng(21)
    points = np.concatenate([rng.normal(c, 1.0, (120, 8)) for c in (0, 50)] + [np.round(rng.normal(0, 1.0, (60, 8)))])
    df = cut(frame(spark, {"q": points, "r": points[::3]}))
    edges = lambda **how: set(map(tuple, density.spanning_tree(df, replace(SETTINGS, **how)).select("question", "weight", "lo", "hi").collect()))
    seen = []

    def kept(known, real=forest._levels):
        levels = real(known)
        seen.append([t.where("question = 'q'").toPandas() for t in (known, levels)])
        return levels

    monkeypatch.setattr(forest, "_levels", kept)
    assert edges(block_rows=16, tree_limit=0) == edges(block_rows=16_384)
    known, levels = seen[0]
    steps = forest._rounds(known).set_index("response_id")
    levels = levels.set_index("response_id")
    rows = pd.DataFrame({"question": "q", "response_id": levels.index, "embedding": list(points[levels.index]), "core": 0.0, "cell": 0, "joined": None})
    a, b = np.triu_indices(len(levels), 1)
    place, longest = np.concatenate(steps["joined"].loc[levels.index].to_list()), np.stack(steps["longest"].loc[levels.index].to_list())
    exact = forest._longest(place[a], longest[a], place[b], longest[b])
    label, far = np.stack(levels["labels"].to_list()), np.stack(levels["far"].to_list())
    same = label[a] == label[b]
    assert same.any(axis=1).all()
    level = same.argmax(axis=1)
    assert (np.maximum(far[a, level], far[b, level]) >= exact).all()
    measured = []
    monkeypatch.setattr(forest, "pair_distances", lambda x, i, y, j, real=forest.pair_distances: measured.append(len(i)) or real(x, i, y, j))
    rows["labels"], rows["far"] = list(label), list(far)
    half = np.arange(len(rows)) % 2
    found = forest._between(rows, rows, [(np.flatnonzero(half == 0), [np.flatnonzero(half == 1)])])
    assert sum(measured) < 0.4 * (half == 0).sum() * (half == 1).sum() and len(found)
