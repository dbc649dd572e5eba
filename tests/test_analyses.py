"""Views for SQL access to the models and analyses."""

from __future__ import annotations

import os

import pytest

from seatwise.plans.analyses import register_views, segment_summaries
from seatwise.sources import testdata as T

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def test_views_answer_sql(spark):
    inputs = T.load(spark, SF)
    names = register_views(spark, inputs, T.AS_OF)
    assert {"account_day_adoption", "retention_risk", "segment_breadth"} <= set(names)
    n = spark.sql("SELECT count(*) AS n FROM retention_risk WHERE risk_tier IN ('High','Medium','Low')").first().n
    assert n == 150
    a = spark.sql("SELECT segment, avg_seat_penetration FROM segment_seat_penetration").collect()
    b = segment_summaries(inputs.user_days, inputs.health, inputs.retention, T.AS_OF)["segment_seat_penetration"]
    assert sorted(a) == sorted(b.select("segment", "avg_seat_penetration").collect())


def test_header_csv_with_one_date_name_for_all_tables(spark, tmp_path, capsys):
    """All tables call their day or month ``measurement_date``; retention's contract calls it a month."""
    import json

    from seatwise.plans import analyses, models
    from seatwise.sources.io import write_csv

    inputs = T.load(spark, SF)
    paths = {n: str(tmp_path / n) for n in ("user_days", "health", "retention", "objects", "models")}
    write_csv(inputs.user_days, paths["user_days"])
    write_csv(inputs.health, paths["health"])
    write_csv(inputs.objects, paths["objects"])
    write_csv(inputs.retention.withColumnRenamed("measurement_month", "measurement_date"), paths["retention"])
    want = {n: df.collect() for n, df in segment_summaries(inputs.user_days, inputs.health, inputs.retention, T.AS_OF).items()}
    for columns in ({"measurement_date": "measurement_month"}, {"retention": {"measurement_date": "measurement_month"}}):
        from seatwise.sources import contracts as C
        from seatwise.sources.io import columns_of, read_csv
        tables = {n: read_csv(spark, paths[n], schema, columns_of(columns, n, schema))
                  for n, schema in (("user_days", C.USER_DAYS), ("health", C.HEALTH), ("retention", C.RETENTION))}
        got = segment_summaries(tables["user_days"], tables["health"], tables["retention"], T.AS_OF)
        assert {n: df.collect() for n, df in got.items()} == want
        args = ["--user-days", paths["user_days"], "--health", paths["health"], "--format", "csv", "--columns", json.dumps(columns)]
        assert analyses.main([*args, "--retention", paths["retention"], "--as-of", T.AS_OF]) == 0
        assert models.main([*args, "--objects", paths["objects"], "--out", paths["models"]]) in (0, 1)
        assert "segment_retention" in capsys.readouterr().out
