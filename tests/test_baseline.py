"""Trailing activity baseline: rows frame (mean / median) and day-range frame."""

from __future__ import annotations

import random
import statistics
from decimal import Decimal

import pytest

from seatwise.operators import activity_baseline
from seatwise.operators.baseline import OrderStatistics, activity_vs_baseline

from builders import day


def _history(health, n: int, gaps: bool, seed: int = 7):
    rnd = random.Random(seed)
    dates, d = [], 0
    for _ in range(n):
        d += rnd.choice([1, 1, 2, 5]) if gaps else 1
        dates.append(d)
    vals = [Decimal(rnd.randint(2000, 9500)) / 100 for _ in range(n)]
    rows = [dict(account_id="A", measurement_date=day(x), percent_days_active=v) for x, v in zip(dates, vals)]
    rows += [dict(account_id="B", measurement_date=day(0), percent_days_active=Decimal("40.00"))]
    return health(rows), dates, vals


def test_mean_over_previous_364_rows_whatever_the_dates(health):
    df, dates, vals = _history(health, 400, gaps=True)
    got = {r.measurement_date: r for r in activity_baseline(df).withColumn("gap", activity_vs_baseline())
           .filter("account_id = 'A'").collect()}
    for i, x in enumerate(dates):
        r = got[day(x)]
        frame = vals[max(0, i - 364):i]
        if not frame:
            assert r.trailing_activity_baseline is None and r.gap is None
            continue
        want = float(sum(frame)) / len(frame)
        assert r.trailing_activity_baseline == want
    # first row of another account has no baseline
    b = activity_baseline(df).filter("account_id = 'B'").first()
    assert b.trailing_activity_baseline is None


def test_nulls_are_skipped_in_the_frame(health):
    df = health([
        dict(measurement_date=day(0), percent_days_active=Decimal("10.00")),
        dict(measurement_date=day(1), percent_days_active=None),
        dict(measurement_date=day(2), percent_days_active=Decimal("30.00")),
        dict(measurement_date=day(3), percent_days_active=Decimal("0.00")),
    ])
    got = [r.trailing_activity_baseline for r in activity_baseline(df).orderBy("measurement_date").collect()]
    assert got == [None, 10.0, 10.0, 20.0]


def test_median_option(health):
    df, dates, vals = _history(health, 380, gaps=False, seed=3)
    got = {r.measurement_date: r.trailing_activity_baseline
           for r in activity_baseline(df, method="median").filter("account_id = 'A'").collect()}
    for i, x in enumerate(dates):
        frame = [float(v) for v in vals[max(0, i - 364):i]]
        if not frame:
            assert got[day(x)] is None
        else:
            assert abs(got[day(x)] - statistics.median(frame)) < 1e-9


def test_day_range_option(health):
    df, dates, vals = _history(health, 300, gaps=True, seed=11)
    got = {r.measurement_date: r.trailing_activity_baseline
           for r in activity_baseline(df, frame="range", days=365).filter("account_id = 'A'").collect()}
    for x in dates:
        frame = [v for y, v in zip(dates, vals) if x - 365 <= y <= x - 1]
        want = float(sum(frame)) / len(frame) if frame else None
        assert got[day(x)] == want


def test_gap_is_rounded_to_two_places(health):
    df = health([
        dict(measurement_date=day(0), percent_days_active=Decimal("10.00")),
        dict(measurement_date=day(1), percent_days_active=Decimal("20.00")),
        dict(measurement_date=day(2), percent_days_active=Decimal("10.00")),
    ])
    got = [r.gap for r in activity_baseline(df).withColumn("gap", activity_vs_baseline())
           .orderBy("measurement_date").collect()]
    assert got == [None, 10.0, -5.0]


@pytest.mark.parametrize("frame,size", [("rows", 1), ("rows", 5), ("rows", 40), ("range", 1), ("range", 12)])
def test_medians_against_sorting_each_frame(health, frame, size):
    rnd = random.Random(size)
    rows = []
    for a in range(6):
        d = 0
        for _ in range(rnd.randrange(60)):
            d += rnd.choice([1, 1, 1, 3, 9])
            v = rnd.choice([None, Decimal("0.00"), Decimal("100.00"), Decimal(rnd.randint(0, 10000)) / 100])
            rows.append(dict(account_id=f"A{a}", measurement_date=day(d), percent_days_active=v))
    got = {(r.account_id, r.measurement_date): r.trailing_activity_baseline for r in activity_baseline(
        health(rows), method="median", frame=frame, rows=size, days=size).collect()}
    assert len(got) == len(rows)
    for a in {r["account_id"] for r in rows}:
        own = [(r["measurement_date"], r["percent_days_active"]) for r in rows if r["account_id"] == a]
        for i, (d, _) in enumerate(own):
            before = own[max(0, i - size):i] if frame == "rows" else [x for x in own if 1 <= (d - x[0]).days <= size]
            values = [float(v) for _, v in before if v is not None]
            want = statistics.median(values) if values else None
            assert got[a, d] == want or abs(got[a, d] - want) < 1e-12


def test_order_statistics():
    rnd, held, s = random.Random(1), [], OrderStatistics(-50, 70)
    for _ in range(2000):
        if held and rnd.random() < 0.45:
            x = held.pop(rnd.randrange(len(held)))
            s.add(x, -1)
        else:
            x = rnd.randint(-50, 70)
            held.append(x)
            s.add(x)
        own = sorted(held)
        assert s.median() == ((own[(len(own) - 1) // 2], own[len(own) // 2]) if own else None)


def test_the_median_needs_bounded_decimals(spark):
    df = spark.createDataFrame([("A", day(0), 1.0)], "account_id string, measurement_date date, percent_days_active double")
    with pytest.raises(ValueError, match="decimal"):
        activity_baseline(df, method="median")
    with pytest.raises(ValueError, match="frame"):
        activity_baseline(df, frame="days")


def test_years_exercise_the_frame(spark):
    """On the driver's tables the frame of 364 rows is full, and rows and days give other baselines."""
    from seatwise.plans.catalog import queries
    sf = "/root/testdata/sf0.01"
    rows, days = ({(r.account_id, r.measurement_date): r.trailing_activity_baseline for r in queries()[n](spark, sf).collect()}
                  for n in ("activity_baseline_years", "activity_baseline_years_range"))
    counts = {}
    for account, _ in rows:
        counts[account] = counts.get(account, 0) + 1
    assert min(counts.values()) > 364
    assert sum(rows[k] != days[k] for k in rows) > 0.5 * len(rows)
