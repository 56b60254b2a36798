"""Registered queries against their SQL twins, over the smallest shared tables."""

import math
import os

import duckdb
import pytest

from commentloom.plans.catalog import QUERIES
from commentloom.plans.twins import TWINS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def lines(rows):
    def shown(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted("|".join(shown(v) for v in row) for row in rows)


def test_twins_are_of_registered_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("query", sorted(TWINS))
def test_twin(spark, duck, query):
    result = QUERIES[query](spark, FOLDER)
    order = sorted(result.columns)
    expected = duck.execute(f"SELECT {', '.join(order)} FROM ({TWINS[query]})").fetchall()
    assert expected
    assert lines(tuple(r[c] for c in order) for r in result.collect()) == lines(expected)


def test_layout_query_runs_the_operator_as_it_is(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("commentloom.operators.layout.embed_plane", lambda scores, settings, epochs=None: asked.append((settings.layout_epochs, epochs)))
    QUERIES["layout"](spark, FOLDER)
    assert asked in ([(200, None)], [(200, 200)])
