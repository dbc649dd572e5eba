"""The roll-up of bitmaps: the counts of the user rows, without reading them again."""

from __future__ import annotations

import random

from builders import day

from seatwise.operators import adoption as A
from seatwise.operators import rollup as R
from seatwise.operators import segments as S


def _rows(seed=3):
    rnd = random.Random(seed)
    ids = [1, 2, 3, 32_768, 32_769, 70_000, 10**12, 0, -5, 65_536]
    return [dict(measurement_date=day(rnd.randrange(5)), account_id=f"A{rnd.randrange(4)}", user_id=rnd.choice(ids),
                 segment=rnd.choice(["S", "T", None]), paid_seats=rnd.choice([4, 4, 9]), is_active=rnd.choice([True, True, False, None]),
                 did_search=True, did_pitch=rnd.choice([True, None]), did_view_report=rnd.random() < 0.6) for _ in range(300)]


def _same(a, b):
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_counts_equal_those_of_the_user_rows(spark, user_days, tmp_path):
    users = user_days(_rows())
    R.activity_rollup(users).write.parquet(str(tmp_path / "rollup"))
    rollup = spark.read.parquet(str(tmp_path / "rollup"))
    _same(R.account_utilisation(rollup, day(2)), A.account_utilisation(users, day(2)))
    _same(R.account_day_activity(rollup), A.account_day_activity(users))
    _same(R.segment_seat_penetration(rollup), S.segment_seat_penetration(users))


def test_any_keys_and_dates(spark, user_days):
    rows = _rows(5)
    rollup = R.activity_rollup(user_days(rows))
    got = {r.segment: r.active_users for r in R.distinct_users(rollup, ["segment"], day(1), day(3)).collect()}
    want = {}
    for r in rows:
        if r["is_active"] and day(1) <= r["measurement_date"] <= day(3):
            want.setdefault(r["segment"], set()).add(r["user_id"])
    assert got == {k: len(v - {None}) for k, v in want.items()}
    every = {r["user_id"] for r in rows if r["is_active"]} - {None}
    assert R.distinct_users(rollup, []).first().active_users == len(every)


def test_parts_merge(spark, user_days):
    """Roll-ups of parts of the rows, put together, count as one of all rows."""
    rows = _rows(8)
    parts = R.activity_rollup(user_days(rows[:100])).unionByName(R.activity_rollup(user_days(rows[100:])))
    _same(R.account_day_activity(parts), A.account_day_activity(user_days(rows)))


def test_empty(user_days):
    rollup = R.activity_rollup(user_days([]))
    assert rollup.collect() == [] and R.segment_seat_penetration(rollup).collect() == []
