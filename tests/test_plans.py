"""Plan shape: every query stays JVM-side, joins on keys and prunes its scans."""

from __future__ import annotations

import os
import re
import sys

import pytest

from seatwise.plans.catalog import OPERATORS, queries
from seatwise.sources import testdata as T

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_summary import files_read, scans  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")

def formatted_plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin", "Python UDF")


@pytest.mark.parametrize("name", sorted(queries()))
def test_plan_shape(spark, name):
    df = queries()[name](spark, SF)
    plan = formatted_plan(df)
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"
    # no scan reads every column of the wide source tables
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "props" not in schema and "value:" not in schema, f"{name} reads unused event columns"
        assert "o_orderstatus" not in schema and "c_name" not in schema, f"{name} reads unused columns"


DATE_PUSHED = (r"measurement_date(#\d+)? = 2024-01-15|EqualTo\(measurement_date,2024-01-15\)"
               r"|GreaterThanOrEqual\(ts,2024-01-15")


def pushes_the_date(df) -> bool:
    pushed = re.findall(r"(?:PushedFilters|PartitionFilters): \[[^\n]*\]", formatted_plan(df))
    return any(re.search(DATE_PUSHED, p) for p in pushed)


def test_one_date_queries_push_the_date_into_stored_inputs(spark, tmp_path):
    inputs = T.Inputs(spark, SF, store=str(tmp_path))
    for name in ("segment_addon_exposure", "account_utilisation", "segment_breadth", "segment_trend_volatility"):
        assert pushes_the_date(OPERATORS[name](inputs)), name


def test_one_date_queries_open_the_files_of_that_date(spark, tmp_path):
    """Stored inputs have a folder for each date; the plans filter partitions and read one of 30."""
    inputs = T.Inputs(spark, SF, store=str(tmp_path), files_per_date=2)
    for name in ("account_utilisation", "segment_addon_exposure", "segment_breadth", "segment_trend_volatility", "segment_retention"):
        df = OPERATORS[name](inputs)
        filters = re.findall(r"PartitionFilters: \[[^\n]*\]", formatted_plan(df))
        assert any(re.search(DATE_PUSHED, f) for f in filters), name
        for table, n in files_read(df).items():
            if table in ("user_days", "health"):
                assert 0 < n <= 2 * (2 if name == "segment_breadth" and table == "user_days" else 1), (name, table, n)
    assert files_read(OPERATORS["segment_seat_penetration"](inputs))["user_days"] > 20


def test_one_date_queries_push_the_date_into_events(spark):
    # Over lazy inputs those that read a day's activity do; which users there
    # are, and the trend before that day, need the other dates too.
    for name in ("account_utilisation", "segment_breadth"):
        assert pushes_the_date(queries()[name](spark, SF)), name


def test_one_pass_over_events(spark):
    """Each input reads the events once; what branches share runs once."""
    for name, most in (("user_days", 1), ("health_daily", 1), ("feature_objects", 1), ("retention_risk", 2),
                       ("risk_quality", 2), ("account_utilisation", 1), ("segment_breadth", 4)):
        assert 1 <= scans(queries()[name](spark, SF))["events"] <= most, name
    assert scans(queries()["retention_monthly"](spark, SF))["orders"] <= 2


def test_the_user_days_of_a_date(spark, tmp_path):
    """Read by the date, stored or not, they are those of the whole table; a date without events has none."""
    inputs = T.Inputs(spark, SF)
    stored = T.Inputs(spark, SF, store=str(tmp_path))
    for date in (T.AS_OF, "2024-01-30", "1999-01-01"):
        want = sorted(map(str, inputs.user_days.filter(f"measurement_date = DATE'{date}'").collect()))
        assert sorted(map(str, inputs.user_days_on(date).collect())) == want
        assert sorted(map(str, stored.user_days_on(date).collect())) == want
        assert bool(want) == (date != "1999-01-01")


def test_events_without_a_user_or_a_time(spark):
    """A null user is inactive on every date; an event without a time is on none."""
    ev = spark.createDataFrame(
        [(1, 3, "view", "2024-01-01"), (2, None, "click", "2024-01-02"), (4, 4, "click", "2024-01-03")],
        "event_id long, user_id long, event_type string, day string").selectExpr(
        "event_id", "user_id", "event_type", "cast(day as date) as measurement_date")
    histories = T._histories(T._user_event_days(ev))
    rows = {(r.user_id, r.measurement_date.day): r.is_active for r in T._user_days(histories, spark, SF).collect()}
    assert len(rows) == 9 and {k for k, v in rows.items() if v} == {(3, 1), (4, 3)}
    days = T._account_days(histories).collect()
    assert {(r.account_no, r.measurement_date.day): (r.n_users, r.n_active, r.n_events) for r in days if r.n_events} == {
        (1, 1): (2, 1, 1), (1, 3): (2, 1, 1)}
    assert len(days) == 6 and {r.n_users for r in days if r.account_no is None} == {1}
