"""The incremental daily build equals the batch models."""

from __future__ import annotations

import os
import tempfile

from seatwise.operators import account_day_adoption, retention_risk
from seatwise.sources import contracts as C
from seatwise.sources import testdata as T
from seatwise.sources.io import read_model
from seatwise.streaming import start

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    inp = T.load(spark, SF)
    root = tempfile.mkdtemp(prefix="seatwise-stream-")
    paths = {k: os.path.join(root, k) for k in ("ud", "health", "objects", "adoption", "risk", "ckpt")}
    inp.health.write.partitionBy("measurement_date").parquet(paths["health"])
    inp.objects.write.partitionBy("measurement_date").parquet(paths["objects"])
    ud = inp.user_days
    first, second = ud.filter("measurement_date <= date'2024-01-12'"), ud.filter("measurement_date > date'2024-01-12'")
    first.write.partitionBy("measurement_date").parquet(paths["ud"])

    q = start(spark, paths["ud"], paths["health"], paths["objects"], paths["adoption"], paths["risk"],
              checkpoint=paths["ckpt"])
    q.awaitTermination(300)
    assert read_model(spark, paths["risk"], C.RETENTION_RISK).count() == 12 * 5

    second.write.mode("append").partitionBy("measurement_date").parquet(paths["ud"])
    q = start(spark, paths["ud"], paths["health"], paths["objects"], paths["adoption"], paths["risk"],
              checkpoint=paths["ckpt"])
    q.awaitTermination(300)

    got_a = read_model(spark, paths["adoption"], C.ACCOUNT_DAY_ADOPTION)
    want_a = account_day_adoption(ud)
    assert sorted(got_a.collect()) == sorted(want_a.collect())
    got = read_model(spark, paths["risk"], C.RETENTION_RISK)
    want = retention_risk(ud, inp.health, inp.objects)
    assert sorted(got.collect()) == sorted(want.collect())


def test_late_health_row_reaches_later_dates(spark):
    inp = T.load(spark, SF)
    root = tempfile.mkdtemp(prefix="seatwise-late-")
    paths = {k: os.path.join(root, k) for k in ("ud", "health", "objects", "adoption", "risk", "ckpt")}
    late = "measurement_date = date'2024-01-10' AND account_id LIKE '%1'"
    inp.user_days.write.partitionBy("measurement_date").parquet(paths["ud"])
    inp.objects.write.partitionBy("measurement_date").parquet(paths["objects"])
    inp.health.filter(f"NOT ({late})").write.partitionBy("measurement_date").parquet(paths["health"])

    def run():
        start(spark, paths["ud"], paths["health"], paths["objects"], paths["adoption"], paths["risk"],
              checkpoint=paths["ckpt"], rows=5).awaitTermination(300)

    run()
    inp.health.filter(late).write.mode("append").partitionBy("measurement_date").parquet(paths["health"])
    run()
    got = read_model(spark, paths["risk"], C.RETENTION_RISK)
    want = retention_risk(inp.user_days, inp.health, inp.objects, rows=5)
    assert sorted(got.collect()) == sorted(want.collect())
