"""Every operator query against brute-force SQL on a small, hostile fixture.

The fixture is random but seeded: one account holds over a third of all user
rows, flags and activity have nulls, seats drift within an account-day, one
account has zero ARR and one a null add-on, renewals are overdue, dates have
gaps and one account has 400 days of health history (the 364-row frame
fills).  The Spark plans (pre-aggregated, weighted, O(n) windows) must equal
the plain fan-out SQL run by DuckDB over the same Parquet files.
"""

from __future__ import annotations

import datetime as dt
import os
import random
import sys
import tempfile
from decimal import Decimal
from types import SimpleNamespace

import duckdb
import pytest

from seatwise.plans.catalog import AS_OF, OPERATORS
from seatwise.plans.oracle import oracle_sql
from seatwise.sources import contracts as C

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import rows_of  # noqa: E402

D0 = dt.date(2024, 1, 1)
AS_OF_DATE = dt.date.fromisoformat(AS_OF)


def _money(rnd, lo, hi):
    return Decimal(rnd.randint(lo * 100, hi * 100)) / 100


def _maybe(rnd, v, p=0.1):
    return None if rnd.random() < p else v


def build_fixture(rnd: random.Random):
    segments = ["North", "South", "East", None]
    dates = sorted({D0 + dt.timedelta(days=d) for d in rnd.sample(range(0, 30), 18)} | {AS_OF_DATE})
    accounts = []
    for a in range(12):
        users = 70 if a == 0 else rnd.randint(1, 8)
        seats = None if a == 9 else max(1, users + rnd.randint(-3, 5))
        addons = [_money(rnd, 0, 5000) if rnd.random() < 0.5 else Decimal("0.00") for _ in range(5)]
        if a == 7:
            addons[2] = None
        if a == 2:
            addons = [Decimal("9000.00")] * 5      # add-on share well above 0.2
        accounts.append(dict(
            account_id=f"ACC_{a:06d}", n=users, seats=seats,
            segment=segments[a % 4] if a != 0 else "North",
            arr=Decimal("0.00") if a == 4 else _money(rnd, 2000, 90000),
            addons=addons,
            renewal=D0 + dt.timedelta(days=30 if a == 2 else rnd.randint(-40, 200)),
            p_active=0.2 if a == 0 else 0.6,        # the hot account is thinly used
        ))
    ud = []
    for acc in accounts:
        plat = (acc["arr"] * Decimal("0.7")).quantize(Decimal("0.01"))
        for u in range(acc["n"]):
            uid = int(acc["account_id"][4:]) * 1000 + u
            for d in dates:
                if rnd.random() < 0.1:
                    continue
                seats = acc["seats"]
                if acc["account_id"] == "ACC_000005" and d == AS_OF_DATE and u == 0:
                    seats = (seats or 1) + 4          # drifting seats on one day
                active = _maybe(rnd, rnd.random() < acc["p_active"], 0.05)
                flags = [_maybe(rnd, bool(active) and rnd.random() < 0.6) for _ in range(6)]
                ud.append((d, acc["account_id"], uid, acc["segment"], seats, acc["arr"], plat,
                           *acc["addons"], active, *flags, acc["renewal"]))
    health, objects = [], []
    for acc in accounts:
        span = [D0 + dt.timedelta(days=x) for x in range(-400, 30, 1) if rnd.random() < 0.97] \
            if acc["account_id"] == "ACC_000001" else dates
        for d in sorted(set(span) | {AS_OF_DATE}):
            pct = _maybe(rnd, Decimal(rnd.randint(2000, 9500)) / 100, 0.05)
            cats = rnd.randint(1, 3)
            npp = rnd.randint(-8, 10)
            score = Decimal(rnd.randint(0, 2000)) / 100
            health.append((d, acc["account_id"], acc["segment"], score, float(cats), pct, cats, npp))
        for d in dates:
            tot = [rnd.randint(0, 30) for _ in range(3)]
            if rnd.random() < 0.05:
                tot = [0, 0, 0]
            act = [rnd.randint(0, t) for t in tot]
            objects.append((d, acc["account_id"], tot[0], act[0], tot[1], act[1], tot[2], act[2]))
    retention = []
    for acc in accounts[:-2]:
        for m in rnd.sample(range(1, 13), rnd.randint(1, 3)):
            py, cy = _money(rnd, 1000, 50000), _money(rnd, 1000, 50000)
            retention.append((dt.date(1997, m, 1), acc["account_id"], py, cy, min(py, cy)))
    return ud, health, retention, objects


@pytest.mark.parametrize("seed", [20241203, 7, 99])
def test_operators_equal_bruteforce_sql(spark, seed):
    rnd = random.Random(seed)
    ud, health, retention, objects = build_fixture(rnd)
    hot = sum(1 for r in ud if r[1] == "ACC_000000")
    assert hot * 3 > len(ud)

    folder = tempfile.mkdtemp(prefix="seatwise-fixture-")
    frames = {}
    for name, rows, schema in (("user_days", ud, C.USER_DAYS), ("health", health, C.HEALTH),
                               ("retention", retention, C.RETENTION), ("objects", objects, C.OBJECTS)):
        path = os.path.join(folder, name)
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
        frames[name] = spark.read.schema(schema).parquet(path)
    inputs = SimpleNamespace(**frames)

    con = duckdb.connect()
    for name in frames:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}/*.parquet')")

    sql = oracle_sql(derive_inputs=False)
    assert set(sql) == set(OPERATORS)
    bad = {}
    for name, op in OPERATORS.items():
        df = op(inputs)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        rel = con.execute(sql[name])
        cols = [c[0] for c in rel.description]
        want = rows_of(cols, rel.fetchall())
        if sorted(df.columns) != sorted(cols) or got != want:
            bad[name] = (len(got), len(want), [(a, b) for a, b in zip(got, want) if a != b][:1])
    assert not bad, bad
