"""What Catalyst makes of the queries: filters and columns reach the scan, and no Python runs on executors."""

import os
import re

import pytest

from tidewater.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Its source is a Python reader; all that follows it is not.
BY_PYTHON = {"key_scan"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - BY_PYTHON))
def test_no_python_on_executors(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan(df)), name


def test_filters_and_columns_reach_the_scan(spark):
    q = registry.queries()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.5)]" in plan(q["count_gt"](spark, DATA))
    assert "ReadSchema: struct<o_totalprice:double>" in plan(q["count_gt"](spark, DATA))
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThanOrEqual\(ts,2024-01-18T15:00", plan(q["backup_default_offset"](spark, DATA)))
    assert "ReadSchema: struct<>" in plan(q["count_all"](spark, DATA))


def test_replays_aggregate_before_the_shuffle(spark):
    p = plan(registry.queries()["cdc_replay"](spark, DATA))
    assert "partial_max_by" in p and len(re.findall(r"\bExchange\b", p)) == 1
