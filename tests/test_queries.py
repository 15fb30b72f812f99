"""Every query with SQL against DuckDB."""

import pytest
from conftest import SF_DIR, shown

from wayfold.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_no_nested_loops(spark):
    for name in ("asof_nearest", "radius_join", "interval_best", "point_in_interval", "project_polyline"):
        plan = catalogue.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
