"""Results do not depend on how the data is split.

Runs the inputs and a set of operators over lazy (non-materialised) inputs
with many small scan splits, an odd shuffle-partition count and AQE
coalescing off, and requires exact equality with the DuckDB oracle.
"""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from seatwise.plans.catalog import OPERATORS
from seatwise.plans.oracle import oracle_sql
from seatwise.sources import testdata as T

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")

CONF = {"spark.sql.shuffle.partitions": "37", "spark.sql.files.maxPartitionBytes": "65536",
        "spark.sql.files.openCostInBytes": "4096", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
NAMES = ["retention_risk", "segment_breadth", "segment_retention", "segment_seat_penetration",
         "activity_baseline", "adoption_quality"]


def test_many_partitions_same_results(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        inputs = T.Inputs(spark, SF)
        sql = oracle_sql()
        con: duckdb.DuckDBPyConnection = duck(SF)
        checks = {"user_days": inputs.user_days, "health_daily": inputs.health,
                  "retention_monthly": inputs.retention, "feature_objects": inputs.objects}
        checks.update({n: OPERATORS[n](inputs) for n in NAMES})
        assert inputs.user_days.rdd.getNumPartitions() > 1
        for name, df in checks.items():
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            rel = con.execute(sql[name])
            want = rows_of([c[0] for c in rel.description], rel.fetchall())
            assert got == want, name
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_ansi_off_same_results(spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        inputs = T.Inputs(spark, SF)
        sql = oracle_sql()
        con = duck(SF)
        for name in ("retention_risk", "segment_addon_exposure", "segment_retention", "risk_quality"):
            df = OPERATORS[name](inputs)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            rel = con.execute(sql[name])
            assert got == rows_of([c[0] for c in rel.description], rel.fetchall()), name
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
