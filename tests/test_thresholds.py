"""Every risk threshold at its boundary, on already-rounded metrics, and the
rounding that decides which side of a threshold a raw ratio lands on."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.functions.rounding import round_half_up
from seatwise.operators.risk import (
    REASON_ACTIVITY,
    REASON_ADDON,
    REASON_BREADTH,
    REASON_SEATS,
    medium_signal_count,
    risk_reason,
    risk_tier,
)

SCHEMA = T.StructType([
    T.StructField("addon_arr_pct", T.DoubleType()), T.StructField("days_to_renewal", T.IntegerType()),
    T.StructField("seat_penetration", T.DoubleType()), T.StructField("paid_seats", T.IntegerType()),
    T.StructField("full_breadth_penetration", T.DoubleType()), T.StructField("arr", T.DecimalType(18, 2)),
    T.StructField("activity_vs_baseline", T.DoubleType()), T.StructField("active_object_ratio", T.DoubleType()),
])
QUIET = dict(addon_arr_pct=0.0, days_to_renewal=400, seat_penetration=1.0, paid_seats=1,
             full_breadth_penetration=1.0, arr=Decimal("1000.00"), activity_vs_baseline=0.0,
             active_object_ratio=1.0)

CASES = [
    # (overrides, expected reason, expected medium count)
    (dict(addon_arr_pct=0.201, days_to_renewal=89), REASON_ADDON, 1),
    (dict(addon_arr_pct=0.2, days_to_renewal=89), None, 1),          # 0.20 is not > 0.20
    (dict(addon_arr_pct=0.201, days_to_renewal=90), None, 1),        # 90 is not < 90
    (dict(addon_arr_pct=0.15), None, 0),                             # 0.15 is not > 0.15
    (dict(seat_penetration=0.299, paid_seats=16), REASON_SEATS, 1),
    (dict(seat_penetration=0.3, paid_seats=16), None, 1),            # 0.300 not < 0.30, but < 0.40
    (dict(seat_penetration=0.299, paid_seats=15), None, 1),          # 15 seats is not large
    (dict(seat_penetration=0.4), None, 0),
    (dict(full_breadth_penetration=0.249, arr=Decimal("50000.01")), REASON_BREADTH, 0),
    (dict(full_breadth_penetration=0.25, arr=Decimal("50000.01")), None, 0),
    (dict(full_breadth_penetration=0.249, arr=Decimal("50000.00")), None, 0),
    (dict(activity_vs_baseline=-15.01), REASON_ACTIVITY, 1),
    (dict(activity_vs_baseline=-15.0), None, 1),
    (dict(activity_vs_baseline=-8.0), None, 0),
    (dict(activity_vs_baseline=-8.01), None, 1),
    (dict(active_object_ratio=0.299), None, 1),
    (dict(active_object_ratio=0.3), None, 0),
    (dict(activity_vs_baseline=None, addon_arr_pct=None, seat_penetration=None,
          full_breadth_penetration=None, active_object_ratio=None), None, 0),   # nulls never risk
]


@pytest.mark.parametrize("overrides,reason,medium", CASES)
def test_threshold(spark, overrides, reason, medium):
    row = dict(QUIET, **overrides)
    df = spark.createDataFrame([tuple(row[f.name] for f in SCHEMA.fields)], SCHEMA)
    r = df.select(risk_reason().alias("reason"), risk_tier().alias("tier"),
                  medium_signal_count().alias("m")).first()
    assert r.reason == reason and r.m == medium
    assert r.tier == ("High" if reason else "Medium" if medium >= 2 else "Low")


def test_two_medium_signals_make_medium(spark):
    row = dict(QUIET, addon_arr_pct=0.151, active_object_ratio=0.29)
    df = spark.createDataFrame([tuple(row[f.name] for f in SCHEMA.fields)], SCHEMA)
    assert df.select(risk_tier().alias("t")).first().t == "Medium"


@pytest.mark.parametrize("num,den,digits,want", [
    (401, 2000, 3, 0.201),     # 0.2005 -> 0.201: rule 1 fires
    (4009, 20000, 3, 0.2),     # 0.20045 -> 0.200: rule 1 silent
    (599, 2000, 3, 0.3),       # 0.2995 -> 0.300: rule 2 silent
    (5989, 20000, 3, 0.299),   # 0.29945 -> 0.299: rule 2 fires
    (499, 2000, 3, 0.25),      # 0.2495 -> 0.250: rule 3 silent
    (-30009, 2000, 2, -15.0),  # -15.0045 -> -15.00: rule 4 silent
    (-3001, 200, 2, -15.01),   # -15.005 -> -15.01: rule 4 fires
])
def test_rounding_decides_the_side(spark, num, den, digits, want):
    got = spark.range(1).select(round_half_up(F.lit(num) / F.lit(den), digits).alias("x")).first().x
    assert got == want


def test_dataframe_wrappers(spark):
    from seatwise.operators import with_high_risk, with_medium_signals, with_risk_reason, with_risk_tier
    rows = [dict(QUIET, seat_penetration=0.2, paid_seats=20), dict(QUIET, addon_arr_pct=0.16, active_object_ratio=0.1),
            dict(QUIET)]
    df = spark.createDataFrame([tuple(r[f.name] for f in SCHEMA.fields) for r in rows], SCHEMA)
    out = with_risk_reason(with_risk_tier(with_medium_signals(with_high_risk(df)))).collect()
    assert [(r.is_high_risk, r.medium_signal_count, r.risk_tier) for r in out] == [
        (1, 1, "High"), (0, 2, "Medium"), (0, 0, "Low")]
    assert [r.primary_risk_reason for r in out] == [REASON_SEATS, None, None]
