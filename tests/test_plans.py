"""Plan shape: no nested-loop joins anywhere, few exchanges, pushdown into the scans."""

import re

import pytest

from forewarn.operators import triggers as X
from forewarn.plans import domain as D
from forewarn.plans import load

QUERIES = load()
SKIP = re.compile(r"^(t0|x3[1-7])")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not SKIP.match(n)))
def test_no_nested_loop_join(spark, sf, name):
    text = plan(QUERIES[name].run(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_peak_ranges_share_one_exchange(spark, sf):
    days = spark.createDataFrame([(1, "2020-01-01", 1.0)], "zone int, date string, exceeds double")
    text = plan(X.peak_ranges(days.selectExpr("zone", "to_date(date) date", "cast(exceeds as int) exceeds"), ["zone"], "exceeds", 3))
    assert text.count("Exchange hashpartitioning") == 1


def test_trigger_table_adds_no_exchange_to_its_series(spark, sf):
    from forewarn.plans import pipelines as P
    flagged = D.station_flagged(spark, sf)
    series = plan(P.lead_series(flagged, [3, 7])).count("Exchange hashpartitioning")
    table = plan(P.warning_table(flagged, [3, 7], [80, 90], 40)).count("Exchange hashpartitioning")
    assert table <= series + 2  # the two small histograms


def test_scans_are_pruned_and_filters_pushed(spark, sf):
    text = plan(D.station_days(spark, sf))
    assert "l_comment" not in text and "l_tax" not in text
    text = plan(D.events(spark, sf))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_hazard_scan_is_read_once(spark, sf):
    assert plan(D.zone_flagged(spark, sf)).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["x02_either_hazard", "x07_period_skill", "x28_classification_metrics", "w10_cooldown"])
def test_one_pass_over_the_hazard(spark, sf, name):
    text = plan(QUERIES[name].run(spark, sf))
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem.parquet", text)) == 1
