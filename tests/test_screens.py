"""Screens by small floats: neighbours and trees are the exact ones, with few distances taken."""

import numpy as np
import pandas as pd
import pytest

from commentloom.operators import forest, neighbours


def table(x, ids):
    return pd.DataFrame({"question": "q", "response_id": ids, "embedding": list(x), "cell": 0})


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (1e18, 0.0), (1e-25, 0.0)])
def test_screen_is_below_the_limit(scale, offset):
    x = np.random.default_rng(1).normal(size=(90, 7)) * scale + offset
    left, right = neighbours.screens(x[:40], x[40:])
    d = neighbours.distances(x[:40], x[40:])
    assert (left @ right <= neighbours.limits(d)).all()


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("bound", [np.nan, 1.5])
def test_neighbours_between_blocks(ties, bound):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (700, 6)).astype(float) if ties else rng.normal(size=(700, 6))
    rows = table(x, rng.permutation(700)).assign(bound=bound)
    left, right = rows[:300].reset_index(drop=True), rows[300:].reset_index(drop=True)
    named = [(np.arange(300), [np.arange(200), np.arange(200, 400)])]
    keys = ["response_id", "distance", "neighbour_id"]
    near = lambda f: f[f["distance"] <= np.nan_to_num(bound, nan=np.inf)].sort_values(keys)[keys].to_numpy().tolist()
    assert near(neighbours._top_between(left, right, named, 4)) == near(neighbours._top(left, right, 4))


def test_bounded_rows_take_few_distances(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    rows = table(x, np.arange(4000))
    own = neighbours._top(rows[:1000], rows[:1000], 4).groupby("response_id")["bound"].max()
    left = rows[:1000].assign(bound=own.to_numpy())
    pairs = []
    monkeypatch.setattr(neighbours, "pair_distances", lambda x, i, y, j, real=neighbours.pair_distances: pairs.append(len(i)) or real(x, i, y, j))
    neighbours._top_between(left, rows[1000:].reset_index(drop=True), [(np.arange(1000), [np.arange(3000)])], 4)
    assert 0 < sum(pairs) < 1000 * 3000 / 100


def test_longest_steps_are_those_of_the_tree(monkeypatch):
    """A chain whose last row is far off: its step counts for that row only, not for all rows on the way to it."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 8)), rng.normal(size=(1, 8)) + 50.0, rng.normal(size=(149, 8))])
    rows = table(x, np.arange(300)).assign(core=0.0)
    whole = forest._local_tree(rows)
    steps = forest._rounds(whole[["question", *forest.EDGE]])
    place, longest = np.concatenate(steps["joined"].to_list()), np.stack(steps["longest"].to_list())
    link = np.full((300, 300), np.inf)
    link[whole["lo"], whole["hi"]] = link[whole["hi"], whole["lo"]] = whole["weight"]
    i, j = np.nonzero(~np.eye(300, dtype=bool))
    assert (forest._longest(place[i], longest[i], place[j], longest[j]) == forest.bottlenecks(link)[i, j]).all()
    pairs = []
    monkeypatch.setattr(forest, "pair_distances", lambda x, i, y, j, real=neighbours.pair_distances: pairs.append(len(i)) or real(x, i, y, j))
    rows = rows.merge(steps[["response_id", "joined", "longest"]], on="response_id")
    between = forest._between(rows, rows, [(np.arange(150), [np.arange(150, 300)])])
    found = set(zip(*forest._forest(*(pd.concat([whole, between]).drop_duplicates(forest.EDGE)[c].to_numpy() for c in forest.EDGE))))
    assert found == set(whole[list(forest.EDGE)].itertuples(index=False, name=None))
    # Only edges of the tree are no longer than the longest step between their ends.
    assert sum(pairs) < 300


def test_sums_over_many_clusters_take_one_step_a_distance():
    """4,096 clusters of two rows: right sums, without a table of all rows by all clusters (268 MB)."""
    import tracemalloc

    from commentloom.operators import silhouette

    rng = np.random.default_rng(5)
    y, weight = rng.normal(size=(8192, 4)), rng.integers(1, 4, 8192)
    target = rng.permutation(8192) // 2
    others = pd.DataFrame({"question": "q", "target": target, "weight": weight, "y": list(y), "size": 2})
    rows = table(y[:64], np.arange(64)).assign(cluster=target[:64], copies=1, targets=[[int(t), (int(t) + 7) % 4096] for t in target[:64]])
    tracemalloc.start()
    found = silhouette._add_up(rows, others)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 128 and peak < 60e6
    d = neighbours.distances(y, y[:64]) * weight[:, None]
    expected = [d[target == t, i].sum() for i, t in zip(found["response_id"], found["target"])]
    assert np.allclose(found["total"], expected)
