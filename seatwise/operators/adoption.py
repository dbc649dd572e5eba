"""User-day -> account-day adoption operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.adoption import (
    addon_arr_pct,
    addon_total,
    days_to_renewal,
    with_breadth,
)
from seatwise.functions.rounding import round_half_up
from seatwise.functions.stats import ratio
from seatwise.sources.contracts import ACCOUNT_DAY_ADOPTION, conform


def on_date(df: DataFrame, as_of: str | dt.date, col: str = "measurement_date") -> DataFrame:
    """Equality filter on a date column (pushed to the Parquet scan)."""
    return df.filter(F.col(col) == F.lit(as_of).cast("date"))


def active_user_days(user_days: DataFrame) -> DataFrame:
    """Active user-days with category flags and breadth; a null ``is_active`` is dropped."""
    return with_breadth(user_days.filter(F.col("is_active")))


def account_utilisation(user_days: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Per (account, seats) on one date: active users, seat utilisation,
    full-breadth users and breadth penetration.

    Seat utilisation divides by seats without a guard (a zero seat count is
    an error under ANSI mode, as the source metric intends no guard).
    """
    active = active_user_days(on_date(user_days, as_of))
    users = F.count_distinct("user_id")
    fb = F.sum("full_breadth")
    out = active.groupBy("account_id", "paid_seats").agg(
        users.alias("active_users"),
        fb.cast("long").alias("full_breadth_users"),
    )
    return out.select(
        "account_id", "paid_seats", "active_users",
        round_half_up(F.col("active_users").cast("double") / F.col("paid_seats"), 3).alias("seat_utilization"),
        "full_breadth_users",
        round_half_up(ratio("full_breadth_users", "active_users"), 3).alias("breadth_penetration"),
    )


def account_day_activity(user_days: DataFrame) -> DataFrame:
    """Per account-day over active users: max seats, distinct active users,
    full-breadth users, seat penetration and full-breadth penetration (3 dp)."""
    active = active_user_days(user_days)
    out = active.groupBy("measurement_date", "account_id").agg(
        F.max("paid_seats").alias("paid_seats"),
        F.count_distinct("user_id").alias("active_users"),
        F.sum("full_breadth").cast("long").alias("full_breadth_users"),
    )
    return out.select(
        "measurement_date", "account_id", "paid_seats", "active_users", "full_breadth_users",
        round_half_up(ratio("active_users", "paid_seats"), 3).alias("seat_penetration"),
        round_half_up(ratio("full_breadth_users", "active_users"), 3).alias("full_breadth_penetration"),
    )


ATTRIBUTE_COLUMNS = ("measurement_date", "account_id", "segment", "paid_seats", "arr", "platform_arr",
                     "addon_arr", "addon_a", "addon_b", "next_renewal_date", "days_to_renewal")


def account_day_attributes(user_days: DataFrame) -> DataFrame:
    """Distinct account-day attributes over all user-days (active or not),
    with the add-on total and days to renewal.  An account-day whose user rows
    disagree on an attribute yields one row per variant (the uniqueness check
    reports it)."""
    # days to renewal is a function of two key columns, so it is added after
    # the distinct (one column fewer in the map-side hash key); the add-on
    # total must stay inside: it depends on parts that are not in the spine
    spine = user_days.select(
        "measurement_date", "account_id", "segment", "paid_seats", "arr", "platform_arr",
        addon_total().alias("addon_arr"), "addon_a", "addon_b", "next_renewal_date",
    ).distinct()
    return spine.withColumn("days_to_renewal", days_to_renewal())


def account_day_adoption(user_days: DataFrame) -> DataFrame:
    """The account-day adoption model: attributes left join activity;
    an account-day without active users gets zeros."""
    spine = account_day_attributes(user_days)
    activity = account_day_activity(user_days).drop("paid_seats")
    j = spine.join(activity, ["measurement_date", "account_id"], "left")
    zero = F.lit(0)
    return conform(j.select(
        "measurement_date", "account_id", "segment", "paid_seats", "arr", "platform_arr",
        "addon_arr", "addon_a", "addon_b",
        addon_arr_pct().alias("addon_arr_pct"),
        "next_renewal_date", "days_to_renewal",
        F.coalesce("active_users", zero.cast("long")).alias("active_users"),
        F.coalesce("full_breadth_users", zero.cast("long")).alias("full_breadth_users"),
        F.coalesce("seat_penetration", F.lit(0.0)).alias("seat_penetration"),
        F.coalesce("full_breadth_penetration", F.lit(0.0)).alias("full_breadth_penetration"),
    ), ACCOUNT_DAY_ADOPTION)
