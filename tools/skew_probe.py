"""Skew experiment: one account holds a third of all user rows.

Derives the inputs from the driver's tables with users 0-499 mapped to one
account (a third of all users at sf0.1), runs operators with broadcasts off
and 16 shuffle partitions, and reports for each the largest share of a
multi-task stage's records read by a single task (from Spark's event log,
written to a fresh scratch folder).  Not a registered query: an experiment.

Usage: python tools/skew_probe.py [sf_dir]
"""

from __future__ import annotations

import collections
import glob
import json
import sys
import tempfile
import time

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from seatwise.plans.catalog import OPERATORS  # noqa: E402
from seatwise.session import local_session  # noqa: E402
from seatwise.sources import testdata as T  # noqa: E402

NAMES = ["account_day_adoption", "retention_risk", "segment_breadth", "segment_addon_exposure",
         "segment_seat_penetration", "risk_quality"]


def main(sf_dir: str) -> None:
    log_dir = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    spark = local_session(8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
        "spark.eventLog.dir": f"file://{log_dir}",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    base_events = T._events

    def hot_events(spark_, d):
        ev = base_events(spark_, d)
        hot = F.when(F.col("user_id") < 500, F.lit(0).cast("long")).otherwise(F.col("account_no"))
        return ev.withColumn("account_no", hot)

    T._events = hot_events
    inputs = T.Inputs(spark, sf_dir, True)
    ud = inputs.user_days
    total, hot = ud.count(), ud.filter("account_id = 'ACC_000000'").count()
    print(f"user_days {total} rows; hot account {hot} ({hot / total:.0%})")
    marks = {}
    for name in NAMES:
        t0 = time.time() * 1000
        OPERATORS[name](inputs).write.format("noop").mode("overwrite").save()
        marks[name] = (t0, time.time() * 1000)
    spark.stop()

    tasks = collections.defaultdict(list)
    for path in glob.glob(f"{log_dir}/*/*"):
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                m = e["Task Metrics"]
                recs = m["Shuffle Read Metrics"]["Total Records Read"] + m["Input Metrics"]["Records Read"]
                tasks[e["Stage ID"]].append((recs, e["Task Info"]["Launch Time"]))
    for name, (a, b) in marks.items():
        worst = (0.0, 0, 0)
        for ts in tasks.values():
            if len(ts) < 2 or not a <= ts[0][1] <= b:
                continue
            tot, mx = sum(r for r, _ in ts), max(r for r, _ in ts)
            if tot >= 500 and mx / tot > worst[0]:
                worst = (mx / tot, mx, tot)
        print(f"{name:26s} largest single-task share of a stage: {worst[0]:.0%} ({worst[1]} of {worst[2]} records)")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
