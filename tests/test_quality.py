"""Data-quality suite: one failing row per check kind, nulls pass."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from seatwise.operators.quality import (
    ADOPTION_CHECKS,
    HEALTH_CHECKS,
    RISK_CHECKS,
    ObservedChecks,
    in_range,
    in_values,
    not_null,
    run_checks,
    unique_key,
)


def _df(spark, rows):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("d", T.IntegerType()),
                           T.StructField("x", T.DoubleType()), T.StructField("t", T.StringType())])
    return spark.createDataFrame(rows, schema)


def test_each_kind_counts_one_bad_row(spark):
    df = _df(spark, [(1, 1, 0.5, "High"), (2, 1, None, "Low"), (3, 1, 1.5, "Medium"),
                     (3, 1, 0.1, "Bogus"), (4, 1, 0.2, None)])
    checks = [not_null("x"), in_range("x", 0, 1), in_values("t", ["High", "Medium", "Low"]),
              unique_key("k", "d"), not_null("t")]
    got = {(r.check_name, r.column_name): r.failing_rows for r in run_checks(df, checks).collect()}
    assert got == {("not_null", "x"): 1, ("accepted_range", "x"): 1, ("accepted_values", "t"): 1,
                   ("unique_combination", "k,d"): 1, ("not_null", "t"): 1}


def test_open_ended_ranges_and_no_unique(spark):
    df = _df(spark, [(1, 1, -1.0, "a"), (0, 1, 5.0, "b")])
    rows = run_checks(df, [in_range("x", 0), in_range("k", 1), in_range("x", None, 4)]).collect()
    assert [r.failing_rows for r in rows] == [1, 1, 1]


def test_second_unique_key(spark):
    df = _df(spark, [(1, 1, 0.0, "a"), (1, 2, 0.0, "a"), (2, 2, 0.0, "a")])
    got = {(r.check_name, r.column_name): r.failing_rows
           for r in run_checks(df, [unique_key("k", "d"), unique_key("k"), unique_key("t")]).collect()}
    assert got == {("unique_combination", "k,d"): 0, ("unique_combination", "k"): 1, ("unique_combination", "t"): 1}


def test_declared_suites_have_23_checks():
    assert len(ADOPTION_CHECKS) == 11 and len(RISK_CHECKS) == 12


def test_empty_input_reports_zero_failures(spark):
    df = _df(spark, [])
    rows = run_checks(df, [not_null("x"), in_range("x", 0, 1), unique_key("k", "d")]).collect()
    assert [r.failing_rows for r in rows] == [0, 0, 0]


def test_checks_in_the_write_itself(spark, tmp_path):
    """Counted by the job that writes; the same results as over the written table, which is read for its keys alone."""
    rows = [(1, 1, 0.5, "High"), (2, 1, None, "Low"), (3, 1, 1.5, "Medium"), (3, 1, 0.1, "Bogus"), (4, 1, 0.2, None)]
    checks = [not_null("x"), in_range("x", 0, 1), in_values("t", ["High", "Medium", "Low"]), unique_key("k", "d"), unique_key("t")]
    for part, n in ((rows, 2), ([], 1)):
        observed, path = ObservedChecks(checks), str(tmp_path / str(len(part)))
        observed.observe(_df(spark, part).repartition(n)).write.parquet(path)
        written = spark.read.parquet(path)
        got = observed.results(written)
        assert sorted(got.collect()) == sorted(run_checks(written, checks).collect())
        plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert "x:double" not in plan


def test_health_rows_that_repeat_a_key_are_reported(spark, health):
    rows = [dict(account_id=a, measurement_date=dt.date(2024, 1, 5)) for a in "AAB"]
    assert [r.failing_rows for r in run_checks(health(rows), HEALTH_CHECKS).collect()] == [1]
    assert [r.failing_rows for r in run_checks(health(rows[1:]), HEALTH_CHECKS).collect()] == [0]
