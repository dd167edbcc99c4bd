"""Queries of the subpackage against their SQL. Where the search is approximate, recall counts."""

import duckdb  # noqa: F401
import pytest
from compare import duck, same

from cinegrid.llm import queries

EXACT = sorted(set(queries.SQL) - {"p1_found"})


@pytest.mark.parametrize("name", EXACT)
def test_agrees(spark, data, name):
    ok, why = same(queries.QUERIES[name](spark, data), data, queries.SQL[name])
    assert ok, why


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.01"
    true = set(duck(folder, queries.SQL["p1_found"]).itertuples(index=False, name=None))
    mine = {tuple(r) for r in queries.QUERIES["p1_found"](spark, folder).collect()}
    assert len(true & mine) >= 0.95 * len(true) and len(mine - true) <= 0.02 * len(true)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0


def test_nearest_without_a_bound(spark):
    """p1_neighbours is exact: each asking vector has its ten nearest, near copies or not."""
    ok, why = same(queries.QUERIES["p1_neighbours"](spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.SQL["p1_neighbours"])
    assert ok, why
