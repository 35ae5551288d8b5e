"""Every query of the engine with SQL gives the same rows on DuckDB; the others run and repeat themselves."""

from __future__ import annotations

import pytest

from barloom.plans import registry
from tests.oracle import connect, difference

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf).sql(SQL[name])) == ""


@pytest.mark.parametrize("name", ["backtest_overlapping", "label_validated_levels", "markov_regimes", "kmeans_vote", "trial_grid", "change_point_guard"])
def test_repeatable_without_sql(spark, sf, name):
    once, again = (sorted(map(repr, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert once == again and once


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
