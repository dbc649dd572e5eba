"""Account-day adoption: activity, attribute spine, the left join, utilisation."""

from __future__ import annotations

from seatwise.operators import (
    account_day_activity,
    account_day_adoption,
    account_day_attributes,
    account_utilisation,
)
from seatwise.operators.quality import ADOPTION_CHECKS, run_checks

from builders import D0, day

FULL = dict(did_search=True, did_view_report=True, did_create_list=True)


def test_activity_counts_distinct_active_users(user_days):
    df = user_days([
        dict(user_id=1, **FULL), dict(user_id=1, **FULL),          # duplicate user row
        dict(user_id=2, did_search=True),
        dict(user_id=3, is_active=False, **FULL),                   # inactive: ignored
        dict(user_id=4, is_active=None, **FULL),                    # null active: dropped
    ])
    r = account_day_activity(df).collect()
    assert len(r) == 1
    r = r[0]
    assert r.active_users == 2
    assert r.full_breadth_users == 2          # sum over rows, as specified (user 1 twice)
    assert r.seat_penetration == 0.2
    assert r.full_breadth_penetration == 1.0


def test_no_active_user_keeps_row_with_zeros(user_days):
    df = user_days([dict(user_id=1, is_active=False), dict(user_id=2, is_active=None)])
    rows = account_day_adoption(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.active_users, r.full_breadth_users, r.seat_penetration, r.full_breadth_penetration) == (0, 0, 0.0, 0.0)


def test_spine_includes_inactive_and_days_to_renewal(user_days):
    df = user_days([dict(user_id=1, is_active=False, measurement_date=day(3), addon_a=5, addon_b=7)])
    r = account_day_attributes(df).collect()[0]
    assert r.measurement_date == day(3)
    assert str(r.addon_arr) == "12.00"
    assert r.days_to_renewal == (r.next_renewal_date - day(3)).days


def test_drifting_seats_give_two_rows_and_fail_uniqueness(user_days):
    df = user_days([dict(user_id=1, paid_seats=10), dict(user_id=2, paid_seats=20)])
    adoption = account_day_adoption(df)
    rows = sorted(adoption.collect(), key=lambda r: r.paid_seats)
    assert [r.paid_seats for r in rows] == [10, 20]
    # activity uses max(seats) = 20 for both spine rows
    assert all(r.active_users == 2 and r.seat_penetration == 0.1 for r in rows)
    checks = {(c.check_name, c.column_name): c.failing_rows for c in run_checks(adoption, ADOPTION_CHECKS).collect()}
    assert checks[("unique_combination", "account_id,measurement_date")] == 1


def test_seat_penetration_rounded_before_threshold(user_days):
    # 2996 of 10000 seats -> 0.2996 -> 0.300
    rows = [dict(user_id=i, paid_seats=10000) for i in range(2996)]
    r = account_day_activity(user_days(rows)).collect()[0]
    assert r.seat_penetration == 0.3


def test_account_utilisation_one_date(user_days):
    df = user_days([
        dict(user_id=1, **FULL), dict(user_id=2, did_search=True), dict(user_id=3, is_active=False),
        dict(user_id=1, measurement_date=day(1), **FULL),
    ])
    r = account_utilisation(df, D0).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.active_users, r.seat_utilization, r.full_breadth_users, r.breadth_penetration) == (2, 0.2, 1, 0.5)
