"""Every registered query next to its SQL on the small tables."""

import pytest

from forewarn.plans import load
from tests.oracle import compare

QUERIES = load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf, name):
    ok, note = compare(spark, duck, QUERIES[name], sf)
    assert ok, note


def test_entry_points_agree():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


NO_SQL = {"x20b_return_levels_mle", "x33b_station_importances",
          "x31_sparse_logistic", "x31b_coefficients", "x31c_strength_path", "x33_boosted_trees", "x34_tuned_trees", "x35_loss_tree",
          "x36_importances", "x37_classifier_comparison"}


def test_only_iterative_queries_lack_sql():
    assert {n for n, q in QUERIES.items() if q.sql is None} == NO_SQL
