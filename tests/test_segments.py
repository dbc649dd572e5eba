"""Segment summaries, including the user-row and retention-month weighting."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from seatwise.operators import (
    segment_addon_exposure,
    segment_breadth,
    segment_retention,
    segment_seat_penetration,
    segment_trend_volatility,
)
from seatwise.sources import contracts as C

from builders import D0, day, money


def test_seat_penetration_skips_days_without_activity(user_days):
    df = user_days([
        dict(account_id="A", user_id=1, paid_seats=4, measurement_date=day(0)),
        dict(account_id="A", user_id=2, paid_seats=4, measurement_date=day(0)),
        dict(account_id="A", user_id=1, paid_seats=4, measurement_date=day(1), is_active=False),
        dict(account_id="B", user_id=3, paid_seats=1, measurement_date=day(0)),
    ])
    r = segment_seat_penetration(df).collect()
    assert len(r) == 1 and r[0].avg_seat_penetration == 0.75 and r[0].accounts == 2


def test_addon_exposure_weighted_by_user_rows(user_days):
    rows = [dict(account_id="A", user_id=i, arr=1000, addon_a=100) for i in range(3)]
    rows += [dict(account_id="B", user_id=9, arr=3000, addon_a=900)]
    df = user_days(rows)
    r = segment_addon_exposure(df, D0).first()
    # user rows: (3*1000 + 3000)/4 = 1500; add-ons (300 + 900)/4 = 300
    assert (r.accounts, r.avg_arr, r.avg_addon_arr, r.addon_share) == (2, 1500.0, 300.0, 0.2)
    a = segment_addon_exposure(df, D0, weight="account").first()
    assert (a.avg_arr, a.avg_addon_arr, a.addon_share) == (2000.0, 500.0, 0.25)


def test_trend_volatility_single_account_has_null_stddev(health):
    df = health([
        dict(account_id="A", segment="X", net_positive_periods=-2, percent_days_active=Decimal("50.00")),
        dict(account_id="B", segment="Y", net_positive_periods=-2, percent_days_active=Decimal("40.00")),
        dict(account_id="C", segment="Y", net_positive_periods=4, percent_days_active=Decimal("90.00")),
        dict(account_id="C", segment="Y", measurement_date=day(1), net_positive_periods=-9),
    ])
    got = {r.segment: r for r in segment_trend_volatility(df, D0).collect()}
    assert got["X"].stddev_trend is None and got["X"].active_but_declining == 1
    y = got["Y"]
    assert (y.accounts, y.avg_trend, y.stddev_trend, y.avg_percent_days_active, y.active_but_declining) == (2, 1.0, 4.24, 65.0, 0)


def test_retention_sums_all_months_and_weights_health(spark, health):
    h = health([dict(account_id="A", segment="X", health_score=Decimal("10.00")),
                dict(account_id="B", segment="X", health_score=Decimal("20.00")),
                dict(account_id="C", segment="X", health_score=Decimal("99.00"))])  # no retention rows
    ret = spark.createDataFrame([
        (dt.date(1997, 1, 1), "A", money(100), money(90), money(90)),
        (dt.date(1997, 2, 1), "A", money(100), money(130), money(100)),
        (dt.date(1997, 1, 1), "B", money(200), money(200), money(200)),
    ], C.RETENTION)
    r = segment_retention(h, ret, D0).first()
    # health weighted by retention rows: (10 + 10 + 20) / 3 = 13.33
    assert (r.accounts, r.avg_health_score, r.nrr, r.gross_retention) == (2, 13.33, 1.05, 0.98)
    m = segment_retention(h, ret, D0, month=dt.date(1997, 1, 1)).first()
    assert (m.avg_health_score, m.nrr, m.gross_retention) == (15.0, 0.97, 0.97)


def test_breadth_fan_out_weighting(user_days, health):
    full = dict(did_search=True, did_view_report=True, did_create_list=True)
    rows = [dict(account_id="A", user_id=i, paid_seats=4, **full) for i in range(3)]        # 3 active, all full
    rows += [dict(account_id="A", user_id=3, paid_seats=4, is_active=False)]              # inactive row still weighs
    rows += [dict(account_id="B", user_id=9, paid_seats=2, did_search=True)]               # 1 active, not full
    h = health([dict(account_id="A", feature_score=3.0), dict(account_id="B", feature_score=3.0)])
    r = segment_breadth(user_days(rows), h, D0).collect()
    assert len(r) == 1
    r = r[0]
    # A: util 0.75, breadth 1.0, 4 user rows; B: util 0.5, breadth 0.0, 1 row
    assert r.avg_seat_utilization == round((4 * 0.75 + 0.5) / 5, 3)
    assert r.avg_full_breadth_penetration == 0.8
    assert r.accounts == 2


def test_sorts_put_nulls_where_the_warehouse_does(user_days, health):
    # descending: nulls first (an account with null seats has a null ratio)
    df = user_days([
        dict(account_id="A", user_id=1, segment="S1", paid_seats=2),
        dict(account_id="B", user_id=2, segment="S2", paid_seats=1),
        dict(account_id="C", user_id=3, segment="S3", paid_seats=None),
    ])
    assert [r.segment for r in segment_seat_penetration(df).collect()] == ["S3", "S2", "S1"]
    # ascending on (segment, feature score): nulls last
    ud = user_days([dict(account_id="A", user_id=1, segment=None), dict(account_id="B", user_id=2, segment="Z"),
                    dict(account_id="C", user_id=3, segment="Z")])
    h = health([dict(account_id="A", feature_score=1.0), dict(account_id="B", feature_score=None),
                dict(account_id="C", feature_score=2.0)])
    got = [(r.segment, r.feature_score) for r in segment_breadth(ud, h, D0).collect()]
    assert got == [("Z", 2.0), ("Z", None), (None, 1.0)]


def test_sorts_of_the_one_date_summaries(spark, user_days, health):
    """Descending, nulls first: volatility (one account: no deviation), add-on share (no ARR) and health score."""
    h = health([dict(account_id="A", segment="S1", net_positive_periods=1, health_score=Decimal("3.00")),
                dict(account_id="B", segment="S1", net_positive_periods=2, health_score=Decimal("3.00")),
                dict(account_id="C", segment="S2", net_positive_periods=9, health_score=None),
                dict(account_id="D", segment="S3", net_positive_periods=1, health_score=Decimal("8.00")),
                dict(account_id="E", segment="S3", net_positive_periods=7, health_score=Decimal("8.00"))])
    got = [(r.segment, r.stddev_trend) for r in segment_trend_volatility(h, D0).collect()]
    assert got == [("S2", None), ("S3", 4.24), ("S1", 0.71)]
    df = user_days([dict(account_id="A", segment="S1", arr=money(1000), addon_a=money(100)),
                    dict(account_id="B", segment="S2", arr=money(0), addon_a=money(5)),
                    dict(account_id="C", segment="S3", arr=money(1000), addon_a=money(300))])
    assert [(r.segment, r.addon_share) for r in segment_addon_exposure(df, D0).collect()] == [("S2", None), ("S3", 0.3), ("S1", 0.1)]
    months = spark.createDataFrame([(D0, x, money(10), money(10), money(10)) for x in "ABCDE"], C.RETENTION)
    assert [(r.segment, r.avg_health_score) for r in segment_retention(h, months, D0).collect()] == [
        ("S2", None), ("S3", 8.0), ("S1", 3.0)]


def test_reason_texts_keep_the_em_dash():
    from seatwise.operators.risk import REASON_ADDON, REASON_BREADTH
    assert "—" in REASON_ADDON and "—" in REASON_BREADTH
