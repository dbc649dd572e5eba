"""A mergeable roll-up of active users: one bitmap of user ids per account-day, so distinct counts over any
dates, accounts or segments follow from it without the user rows.

A bitmap covers 32,768 consecutive ids (a bucket) in 4 KB; an account-day has a row for each bucket that its
users fall into. Counts are exact: bitmaps of the same bucket are joined by or, then their bits counted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.rounding import round_half_up
from seatwise.functions.stats import exact_mean, ratio
from seatwise.operators.adoption import active_user_days, on_date

KEYS = ("measurement_date", "account_id", "segment", "paid_seats")


def activity_rollup(user_days: DataFrame) -> DataFrame:
    """One row per (date, account, segment, seats, bucket) with active users: ``users`` (a bitmap), ``full_breadth_users``.

    Rows without a user id have a bucket of their own, null, and an empty bitmap.
    """
    active = active_user_days(user_days)
    user = F.col("user_id")
    return active.groupBy(*KEYS, F.bitmap_bucket_number(user).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users"),
        F.sum("full_breadth").cast("long").alias("full_breadth_users"))


def _counted(rollup: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """``active_users, full_breadth_users`` by ``by``, and ``more`` aggregates of them over the buckets."""
    merged = rollup.groupBy(*by, "bucket").agg(
        F.bitmap_or_agg("users").alias("users"), F.sum("full_breadth_users").alias("full_breadth_users"),
        *[c for c in more])
    names = [c for c in merged.columns if c not in (*by, "bucket", "users", "full_breadth_users")]
    return merged.groupBy(*by).agg(
        F.sum(F.bitmap_count("users")).alias("active_users"), F.sum("full_breadth_users").cast("long").alias("full_breadth_users"),
        *[F.max(c).alias(c) for c in names])


def distinct_users(rollup: DataFrame, by: list[str], since: str | dt.date | None = None, until: str | dt.date | None = None) -> DataFrame:
    """Distinct active users by any of the roll-up's keys (or none), over the dates from ``since`` to ``until``."""
    if since is not None:
        rollup = rollup.filter(F.col("measurement_date") >= F.lit(since).cast("date"))
    if until is not None:
        rollup = rollup.filter(F.col("measurement_date") <= F.lit(until).cast("date"))
    return _counted(rollup, by).select(*by, "active_users")


def account_utilisation(rollup: DataFrame, as_of: str | dt.date) -> DataFrame:
    """As the operator of that name over user rows."""
    out = _counted(on_date(rollup, as_of), ["account_id", "paid_seats"])
    return out.select(
        "account_id", "paid_seats", "active_users",
        round_half_up(F.col("active_users").cast("double") / F.col("paid_seats"), 3).alias("seat_utilization"),
        "full_breadth_users", round_half_up(ratio("full_breadth_users", "active_users"), 3).alias("breadth_penetration"))


def account_day_activity(rollup: DataFrame) -> DataFrame:
    """As the operator of that name over user rows."""
    out = _counted(rollup, ["measurement_date", "account_id"], F.max("paid_seats").alias("paid_seats"))
    return out.select(
        "measurement_date", "account_id", "paid_seats", "active_users", "full_breadth_users",
        round_half_up(ratio("active_users", "paid_seats"), 3).alias("seat_penetration"),
        round_half_up(ratio("full_breadth_users", "active_users"), 3).alias("full_breadth_penetration"))


def segment_seat_penetration(rollup: DataFrame) -> DataFrame:
    """As the operator of that name over user rows."""
    share = ratio("active_users", "paid_seats").cast("decimal(28,12)")
    out = _counted(rollup, list(KEYS)).groupBy("segment").agg(
        round_half_up(exact_mean(share), 3).alias("avg_seat_penetration"), F.count_distinct("account_id").alias("accounts"))
    return out.orderBy(F.col("avg_seat_penetration").desc_nulls_first())
