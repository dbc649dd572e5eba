"""Risk mart: rule order, tiers, reasons, nulls falling through."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from seatwise.operators import retention_risk
from seatwise.operators.risk import (
    REASON_ACTIVITY,
    REASON_ADDON,
    REASON_BREADTH,
    REASON_SEATS,
    RiskThresholds,
)
from seatwise.sources import contracts as C

from builders import D0, day

FULL = dict(did_search=True, did_view_report=True, did_create_list=True)


def _mart(user_days, health, objects, users, hrows=None, orows=None, **kw):
    h = health(hrows if hrows is not None else [dict()])
    o = objects(orows if orows is not None else [dict()])
    return retention_risk(user_days(users), h, o, **kw)


def test_mart_schema(user_days, health, objects):
    m = _mart(user_days, health, objects, [dict(user_id=1, **FULL)])
    C.check_contract(m, C.RETENTION_RISK)


def test_low_when_nothing_fires(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, **FULL) for i in range(3)]
    r = _mart(user_days, health, objects, users).first()
    assert r.risk_tier == "Low" and r.primary_risk_reason is None


def test_rule1_addon_near_renewal_including_overdue(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, arr=1000, addon_a=201, next_renewal_date=D0 - dt.timedelta(days=5), **FULL)
             for i in range(3)]
    r = _mart(user_days, health, objects, users).first()
    assert r.days_to_renewal == -5 and r.addon_arr_pct == 0.201
    assert r.risk_tier == "High" and r.primary_risk_reason == REASON_ADDON


def test_rule1_boundary_is_strict(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, arr=1000, addon_a=200, next_renewal_date=D0 + dt.timedelta(days=89), **FULL)
             for i in range(3)]
    r = _mart(user_days, health, objects, users).first()
    assert r.addon_arr_pct == 0.2 and r.primary_risk_reason is None


def test_arr_zero_silences_rule1(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, arr=0, addon_a=500, next_renewal_date=D0, **FULL) for i in range(3)]
    r = _mart(user_days, health, objects, users).first()
    assert r.addon_arr_pct is None and r.risk_tier == "Low"


def test_no_active_user_fires_seat_and_breadth_rules(user_days, health, objects):
    users = [dict(user_id=1, paid_seats=20, arr=60000, is_active=False)]
    r = _mart(user_days, health, objects, users).first()
    assert r.seat_penetration == 0.0 and r.full_breadth_penetration == 0.0
    assert r.risk_tier == "High" and r.primary_risk_reason == REASON_SEATS


def test_rule3_breadth(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=10, arr=60000, did_search=True) for i in range(10)]
    r = _mart(user_days, health, objects, users).first()
    assert r.primary_risk_reason == REASON_BREADTH


def test_rules_2_and_4_reason_is_rule_2(user_days, health, objects):
    users = [dict(user_id=1, paid_seats=20, measurement_date=d, **FULL) for d in (day(0), day(1))]
    hrows = [dict(measurement_date=day(0), percent_days_active=Decimal("80.00")),
             dict(measurement_date=day(1), percent_days_active=Decimal("60.00"))]
    rows = {r.measurement_date: r for r in _mart(user_days, health, objects, users, hrows, []).collect()}
    assert rows[day(1)].activity_vs_baseline == -20.0
    assert rows[day(1)].primary_risk_reason == REASON_SEATS


def test_rule4_only_with_baseline(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, measurement_date=d, **FULL) for i in range(3) for d in (day(0), day(1))]
    hrows = [dict(measurement_date=day(0), percent_days_active=Decimal("80.00")),
             dict(measurement_date=day(1), percent_days_active=Decimal("60.00"))]
    rows = {r.measurement_date: r for r in _mart(user_days, health, objects, users, hrows, []).collect()}
    assert rows[day(0)].trailing_activity_baseline is None and rows[day(0)].risk_tier == "Low"
    assert rows[day(1)].risk_tier == "High" and rows[day(1)].primary_risk_reason == REASON_ACTIVITY


def test_medium_needs_two_signals_and_has_no_reason(user_days, health, objects):
    # seat penetration 0.333 (< 0.40) and object ratio 0.2 (< 0.30); seats 9 so rule 2 is silent
    users = [dict(user_id=i, paid_seats=9, **FULL) for i in range(3)]
    orows = [dict(active_report_count=2, active_dashboard_count=2, active_list_count=2)]
    r = _mart(user_days, health, objects, users, orows=orows).first()
    assert r.seat_penetration == 0.333 and r.active_object_ratio == 0.2
    assert r.risk_tier == "Medium" and r.primary_risk_reason is None
    # one signal only -> Low
    r = _mart(user_days, health, objects, users).first()
    assert r.risk_tier == "Low"


def test_missing_health_and_objects_are_not_risk(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, **FULL) for i in range(3)]
    r = _mart(user_days, health, objects, users, hrows=[], orows=[]).first()
    assert r.health_score is None and r.active_object_ratio is None and r.activity_vs_baseline is None
    assert r.risk_tier == "Low"


def test_custom_thresholds(user_days, health, objects):
    users = [dict(user_id=i, paid_seats=3, **FULL) for i in range(3)]
    t = RiskThresholds(medium_object_ratio=0.9, medium_seat_penetration=1.5)
    r = _mart(user_days, health, objects, users, thresholds=t).first()
    assert r.risk_tier == "Medium"


def test_mart_columns_carry_comments(user_days, health, objects):
    m = _mart(user_days, health, objects, [dict(user_id=1, **FULL)])
    assert m.schema["risk_tier"].metadata.get("comment") == "High, Medium or Low"
