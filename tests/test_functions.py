"""Column helpers: rounding, flags, add-on exposure, renewal, object ratio."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seatwise.functions import (
    active_object_ratio,
    addon_arr_pct,
    addon_total,
    days_to_renewal,
    round_half_up,
    with_breadth,
)
from seatwise.functions.stats import exact_stddev

from builders import money


def exact_half_up(q: Fraction, n: int) -> float:
    k = 10 ** n
    m = abs(q) * k
    r = int(m + Fraction(1, 2))  # floor(m + 1/2) for m >= 0
    return (r if q >= 0 else -r) / k


def test_round_half_up_matches_exact_fractions(spark):
    pairs = [(a, b) for b in (3, 7, 8, 16, 40, 400, 1000, 2000) for a in range(-60, 61)]
    pairs += [(201, 400), (1, 8), (5, 8), (2996, 10000), (-1, 2000), (2675, 1000)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", *[round_half_up(F.col("a") / F.col("b"), n).alias(f"r{n}") for n in (0, 2, 3)]).collect()
    for row in got:
        q = Fraction(row.a, row.b)
        for n in (0, 2, 3):
            assert row[f"r{n}"] == exact_half_up(q, n), (row.a, row.b, n)


def test_round_half_up_threshold_and_no_negative_zero(spark):
    row = spark.range(1).select(
        round_half_up(F.lit(0.2996), 3).alias("a"),
        round_half_up(F.lit(-0.0001), 3).alias("b"),
        round_half_up(F.lit(None).cast("double"), 2).alias("c"),
    ).first()
    assert row.a == 0.3 and not row.a < 0.30
    assert row.b == 0.0 and str(row.b) == "0.0"
    assert row.c is None


def test_category_flags_null_is_zero(user_days):
    df = user_days([
        dict(user_id=1, did_search=None, did_view_report=None, did_view_dashboard=False,
             did_create_alert=None, did_create_list=None, did_pitch=False),
        dict(user_id=2, did_search=True, did_view_report=None, did_view_dashboard=True,
             did_create_alert=None, did_create_list=None, did_pitch=True),
    ])
    rows = {r.user_id: r for r in with_breadth(df).collect()}
    assert (rows[1].research, rows[1].monitoring, rows[1].relationship) == (0, 0, 0)
    assert rows[1].categories_used == 0 and rows[1].full_breadth == 0
    assert (rows[2].research, rows[2].monitoring, rows[2].relationship) == (1, 1, 1)
    assert rows[2].categories_used == 3 and rows[2].full_breadth == 1


def test_addon_total_and_share(user_days):
    df = user_days([
        dict(user_id=1, arr=1000, addon_a=100, addon_b=50.5, addon_e=49.5),
        dict(user_id=2, arr=0, addon_a=100),
        dict(user_id=3, arr=1000, addon_c=None),
        dict(user_id=4, arr=1000, addon_a=2996),
    ])
    out = {r.user_id: r for r in df.withColumn("addon_arr", addon_total())
           .withColumn("pct", addon_arr_pct()).collect()}
    assert out[1].addon_arr == money(200) and out[1].pct == 0.2
    assert out[2].pct is None                      # ARR = 0
    assert out[3].addon_arr is None and out[3].pct is None   # null component
    assert out[4].pct == 2.996                     # share above 1 is kept


def test_days_to_renewal_negative_when_overdue(user_days):
    df = user_days([dict(user_id=1, measurement_date=dt.date(2024, 3, 10), next_renewal_date=dt.date(2024, 3, 1)),
                    dict(user_id=2, measurement_date=dt.date(2024, 3, 1), next_renewal_date=dt.date(2024, 5, 30))])
    got = {r.user_id: r.d for r in df.select("user_id", days_to_renewal().alias("d")).collect()}
    assert got == {1: -9, 2: 90}


def test_active_object_ratio_zero_objects_is_null(objects):
    df = objects([
        dict(account_id="A", report_count=0, active_report_count=0, dashboard_count=0,
             active_dashboard_count=0, list_count=0, active_list_count=0),
        dict(account_id="B", report_count=3, active_report_count=1, dashboard_count=0,
             active_dashboard_count=0, list_count=0, active_list_count=0),
    ])
    got = {r.account_id: r.x for r in df.select("account_id", active_object_ratio().alias("x")).collect()}
    assert got == {"A": None, "B": 0.333}


def test_rounding_twins_agree_on_random_fractions(spark):
    """Spark's helper and its DuckDB SQL twin give the same double, equal to
    exact half-up rounding of the fraction, on random num/den pairs."""
    import random

    import duckdb

    from seatwise.plans.oracle import r as sql_round

    rnd = random.Random(11)
    pairs = [(rnd.randint(-10**6, 10**6), rnd.randint(1, 10**4)) for _ in range(600)]
    pairs += [(k * 5 + 1, 2000) for k in range(-50, 50)] + [(2 * k + 1, 200) for k in range(-50, 50)]
    df = spark.createDataFrame(pairs, "a long, b long")
    digits = (0, 2, 3)
    got = df.select("a", "b", *[round_half_up(F.col("a") / F.col("b"), n).alias(f"r{n}") for n in digits]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    sql = ", ".join(f"{sql_round('a / b', n)} AS r{n}" for n in digits)
    duck = {(a, b): rest for a, b, *rest in con.execute(f"SELECT a, b, {sql} FROM t").fetchall()}
    for row in got:
        q = Fraction(row.a, row.b)
        for k, n in enumerate(digits):
            spark_v, duck_v = row[f"r{n}"], duck[(row.a, row.b)][k]
            assert spark_v == duck_v, (row.a, row.b, n, spark_v, duck_v)
            if abs(q) * 10 ** n < 10 ** 6:   # the helper's documented range
                assert spark_v == exact_half_up(q, n), (row.a, row.b, n)


@pytest.mark.parametrize("parts", [1, 8, 37])
def test_stddev_does_not_depend_on_partitions(spark, parts):
    rnd = random.Random(2)
    values = [rnd.choice([None, rnd.randint(-10**9, 10**9), 3]) for _ in range(500)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(9, 4), (8, None)], "g int, x int").repartition(parts)
    got = {r.g: r.s for r in df.groupBy("g").agg(exact_stddev("x").alias("s")).collect()}
    assert got[9] is None and got[8] is None
    for g in range(3):
        own = [v for i, v in enumerate(values) if i % 3 == g and v is not None]
        n = len(own)
        spread = n * sum(v * v for v in own) - sum(own) ** 2
        assert got[g] == math.sqrt(float(spread) / float(n * (n - 1)))
