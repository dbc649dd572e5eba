"""Deterministic derivation rules and calendar/panel operators."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from seatwise.functions import derive as G
from seatwise.operators.panel import calendar, expand_users, fill_inactive, panel


def test_health_score_parts(spark):
    r = spark.createDataFrame([(0.667, 3.0, -2)], "f double, c double, t int").select(
        G.activity_score("f").alias("a"), G.percent_active("f").alias("p"),
        G.health_score(G.activity_score("f"), "c", "t").alias("h")).first()
    assert (r.a, r.p, r.h) == (6.67, 66.7, 7.67)


def test_retention_base_and_platform_share(spark):
    df = spark.createDataFrame([(Decimal("100.00"), Decimal("90.50")), (Decimal("80.00"), None)],
                               "py decimal(18,2), cy decimal(18,2)")
    got = [(r.g, r.p) for r in df.select(G.gross_retention_base("py", "cy").alias("g"),
                                         G.platform_share("py").alias("p")).collect()]
    assert got == [(Decimal("90.50"), Decimal("70.00")), (Decimal("80.00"), Decimal("56.00"))]
    r = spark.range(1).select(G.platform_share(F.lit(Decimal("10.05")).cast("decimal(18,2)")).alias("p")).first()
    assert r.p == Decimal("7.04")  # 7.035 -> half-up


def test_deal_type_split(spark):
    df = spark.createDataFrame([("upsell", Decimal("5.00"))], "t string, arr decimal(18,2)")
    r = df.select(*[c.alias(n) for n, c in G.arr_by_deal_type("t", "arr").items()]).first().asDict()
    assert r == {"new_arr": 0, "renewal_arr": 0, "upsell_arr": Decimal("5.00"), "expansion_arr": 0, "downsell_arr": 0}


def test_labels_and_ids(spark):
    df = spark.createDataFrame([(s,) for s in G.SEGMENTS] + [("Other",)], "s string")
    got = {r.s: (r.team, r.kind) for r in df.select("s", G.service_team("s").alias("team"),
                                                   G.business_type("s").alias("kind")).collect()}
    assert got["Enterprise Brand"] == ("Enterprise CS", "Brand")
    assert got["Mid-Market Brand"] == ("Mid-Market CS", "Brand")
    assert got["Emerging Brand"] == ("SMB CS", "Brand")
    assert got["Solo Agency"] == ("Agency CS", "Agency")
    assert got["Other"] == ("SMB CS", "Brand")
    r = spark.range(7, 8).select(G.padded_id("CUS_", "id").alias("x")).first()
    assert r.x == "CUS_0007"
    r = spark.range(1).select(G.id_number(F.lit("CUS_0042"), "CUS_").alias("n")).first()
    assert r.n == 42


def test_truncated_share(spark):
    df = spark.createDataFrame([(10, 0.37), (7, 0.99), (5, -0.5)], "n int, r double")
    assert [r.x for r in df.select(G.truncated_share("n", "r").alias("x")).collect()] == [3, 6, 0]


def test_calendar_days_and_months(spark):
    days = [r.measurement_date for r in calendar(spark, dt.date(2024, 11, 1), dt.date(2024, 11, 30)).collect()]
    assert len(days) == 30 and days[0] == dt.date(2024, 11, 1)
    months = [r.m for r in calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 1), "1 month", "m").collect()]
    assert months == [dt.date(2024, m, 1) for m in range(1, 13)]


def test_panel_keeps_calendar_gaps(spark):
    keys = spark.createDataFrame([("A",), ("B",)], "k string")
    dates = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 3),), (dt.date(2024, 1, 3),)],
                                  "measurement_date date")
    got = sorted((r.k, r.measurement_date.day) for r in panel(keys, dates).collect())
    assert got == [("A", 1), ("A", 3), ("B", 1), ("B", 3)]


def test_expand_users_and_fill_inactive(spark):
    acc = spark.createDataFrame([(3, 2), (12, 1)], "no int, n int")
    users = expand_users(acc, F.col("n"), F.col("no"))
    assert sorted(r.user_id for r in users.collect()) == [3000, 3001, 12000]
    p = users.select("user_id", F.lit(dt.date(2024, 1, 1)).alias("d"))
    act = spark.createDataFrame([(3000, dt.date(2024, 1, 1), True)], "user_id long, d date, is_active boolean")
    got = {r.user_id: r.is_active for r in fill_inactive(p, act, ["user_id", "d"], ["is_active"]).collect()}
    assert got == {3000: True, 3001: False, 12000: False}


def test_expand_users_in_chunks(spark):
    acc = spark.createDataFrame([(1, 23), (2, 0), (3, 5)], "no int, n int")
    users = expand_users(acc, F.col("n"), F.col("no"), chunk=4)
    got = sorted((r.no, r.user_index) for r in users.collect())
    assert got == [(1, i) for i in range(23)] + [(3, i) for i in range(5)]


def test_seat_roster_has_every_paid_seat(user_days):
    from types import SimpleNamespace

    from seatwise.plans.catalog import OPERATORS
    rows = user_days([
        dict(account_id="ACC_000002", user_id=6, paid_seats=3),
        dict(account_id="ACC_000002", user_id=6, paid_seats=3, measurement_date=dt.date(2024, 1, 2)),
        dict(account_id="ACC_000002", user_id=7, paid_seats=3),
        dict(account_id="ACC_000005", user_id=15, paid_seats=1),
    ])
    got = OPERATORS["seat_roster"](SimpleNamespace(user_days=rows))
    assert got.columns == ["account_id", "user_index", "user_id"]
    assert sorted(map(tuple, got.collect())) == [
        ("ACC_000002", 0, 2000), ("ACC_000002", 1, 2001), ("ACC_000002", 2, 2002), ("ACC_000005", 0, 5000)]


def test_account_ids_are_never_cut(spark):
    from seatwise.sources.testdata import account_id
    numbers = [7, 99999, 100000, 1000000, 1000001, 12345678901]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(account_id(F.col("n"))).collect()]
    assert got == ["ACC_000007", "ACC_099999", "ACC_100000", "ACC_1000000", "ACC_1000001", "ACC_12345678901"]


def test_padded_ids_hold_long_numbers(spark):
    from seatwise.functions.derive import padded_id
    row = spark.createDataFrame([(1 << 40,)], "n long").select(padded_id("CUS_", "n")).first()
    assert row[0] == f"CUS_{1 << 40}"


def test_large_trends_survive(spark):
    import datetime as dt

    from seatwise.sources import testdata as T
    days = spark.createDataFrame([(0, dt.date(2024, 1, d), 1, 1, 0, 0, 0, n) for d, n in ((1, 1), (2, 12_001))],
                                 "account_no long, measurement_date date, n_users long, n_active long, research int, "
                                 "monitoring int, relationship int, n_events long")
    rows = {r.measurement_date.day: r for r in T._health(days, spark, "/root/testdata/sf0.001").collect()}
    assert rows[2].net_positive_periods == 12_000 and rows[2].health_score > 12_000


def test_panel_takes_stray_dates(spark):
    import datetime as dt

    from seatwise.operators.panel import panel
    dates = spark.createDataFrame([(dt.date(y, 1, 1),) for y in (1, 2024, 9999)], "measurement_date date")
    assert panel(spark.range(3), dates).count() == 9
