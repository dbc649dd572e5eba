"""Segment-level summaries.

The source metrics average over *fan-out* rows (one per user row, or one per
retention month).  Rather than materialise the fan-out, each query
pre-aggregates the many-side to one row per account with a row count ``n``
and takes weighted means ``sum(x * n) / sum(n)``.  The results are the same
(exactly so for decimals), but no join ever carries all rows of a hot
account into one task, and every aggregate has a map-side partial step.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.adoption import addon_total
from seatwise.functions.rounding import round_half_up
from seatwise.functions.stats import exact_mean, exact_stddev, ratio
from seatwise.operators.adoption import account_utilisation, on_date


def _weighted_mean(x: str, w: str) -> Column:
    """Mean of ``x``, of at most 3 decimals, as if each row were repeated ``w`` times (nulls skipped).

    The sum is over decimals, so it does not depend on the order of rows.
    """
    weight = F.when(F.col(x).isNotNull(), F.col(w))
    return F.sum(F.col(x).cast("decimal(18,3)") * F.col(w)).cast("double") / F.nullif(F.sum(weight), F.lit(0))


def segment_seat_penetration(user_days: DataFrame) -> DataFrame:
    """Per segment over all dates: mean of daily distinct active users / seats
    and distinct accounts.  Account-days with no active user are absent."""
    daily = (user_days.filter(F.col("is_active"))
             .groupBy("measurement_date", "account_id", "segment", "paid_seats")
             .agg(F.count_distinct("user_id").alias("active_users")))
    out = daily.groupBy("segment").agg(
        round_half_up(exact_mean(ratio("active_users", "paid_seats").cast("decimal(28,12)")), 3).alias("avg_seat_penetration"),
        F.count_distinct("account_id").alias("accounts"),
    )
    return out.orderBy(F.col("avg_seat_penetration").desc_nulls_first())


def segment_trend_volatility(health: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Per segment on one date: accounts, mean and sample stddev of the trend,
    mean percent active, and the count of accounts declining but active
    (trend < 0 and percent active > 40)."""
    h = on_date(health, as_of)
    npp, pda = F.col("net_positive_periods"), F.col("percent_days_active")
    out = h.groupBy("segment").agg(
        F.count_distinct("account_id").alias("accounts"),
        round_half_up(exact_mean(npp), 2).alias("avg_trend"),
        round_half_up(exact_stddev(npp), 2).alias("stddev_trend"),
        round_half_up(exact_mean(pda), 2).alias("avg_percent_days_active"),
        F.sum(F.when((npp < 0) & (pda > 40), 1).otherwise(0)).cast("long").alias("active_but_declining"),
    )
    return out.orderBy(F.col("stddev_trend").desc_nulls_first())


def segment_addon_exposure(user_days: DataFrame, as_of: str | dt.date,
                           weight: str = "user") -> DataFrame:
    """Per segment on one date: accounts, mean ARR, mean add-on ARR and the
    ratio of the two means.

    ``weight='user'`` (default) averages over user rows, so large accounts
    weigh more; ``weight='account'`` averages one row per account-day
    attribute set.

    Money is summed per (segment, account) as exact ``long`` cents (codegen'd
    arithmetic on every user row, bounded per account), and those partials
    are added across accounts as ``decimal(38,0)``, so nothing overflows and
    the mean equals ``double(sum(x)) / count(x)`` over the rows.
    """
    u = on_date(user_days, as_of).select("segment", "account_id", "arr",
                                         addon_total().alias("addon_arr"))
    if weight == "account":
        u = u.distinct()
    elif weight != "user":
        raise ValueError(f"unknown weight {weight!r}")

    def cents(c: str) -> Column:
        return (F.col(c) * 100).cast("long")

    per_account = u.groupBy("segment", "account_id").agg(
        F.sum(cents("arr")).alias("arr_c"), F.count("arr").alias("arr_n"),
        F.sum(cents("addon_arr")).alias("addon_c"), F.count("addon_arr").alias("addon_n"),
    )

    def mean(c: str, n: str) -> Column:
        total = F.sum(F.col(c).cast("decimal(38,0)")) * F.lit(Decimal("0.01"))
        return total.cast("double") / F.nullif(F.sum(n), F.lit(0))

    mean_arr, mean_addon = mean("arr_c", "arr_n"), mean("addon_c", "addon_n")
    out = per_account.groupBy("segment").agg(
        F.count("account_id").alias("accounts"),
        round_half_up(mean_arr, 0).alias("avg_arr"),
        round_half_up(mean_addon, 0).alias("avg_addon_arr"),
        round_half_up(mean_addon / F.nullif(mean_arr, F.lit(0.0)), 3).alias("addon_share"),
    )
    return out.orderBy(F.col("addon_share").desc_nulls_first())


def segment_retention(health: DataFrame, retention: DataFrame, as_of: str | dt.date,
                      month: str | dt.date | None = None) -> DataFrame:
    """Per segment: accounts, mean health score on ``as_of``, net revenue
    retention and gross retention (ratios of sums, 2 dp).

    Retention is matched on account only, so every month counts (and each
    health row is weighted by its account's retention rows), unless ``month``
    picks one month.
    """
    r = retention if month is None else on_date(retention, month, "measurement_month")
    per_account = r.groupBy("account_id").agg(
        F.sum("arr_current").alias("cy"), F.sum("arr_prior").alias("py"),
        F.sum("arr_retained").alias("kept"), F.count(F.lit(1)).alias("n"),
    )
    h = on_date(health, as_of).select("segment", "account_id", "health_score")
    j = h.join(per_account, "account_id")
    out = j.groupBy("segment").agg(
        F.count_distinct("account_id").alias("accounts"),
        round_half_up(_weighted_mean("health_score", "n"), 2).alias("avg_health_score"),
        round_half_up(ratio(F.sum("cy"), F.sum("py")), 2).alias("nrr"),
        round_half_up(ratio(F.sum("kept"), F.sum("py")), 2).alias("gross_retention"),
    )
    return out.orderBy(F.col("avg_health_score").desc_nulls_first())


def segment_breadth(user_days: DataFrame, health: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Per (segment, feature score) on one date: mean seat utilisation and
    mean full-breadth penetration of accounts (both already rounded to 3 dp,
    rounded again), weighted by each account's user rows that day (active or
    not), plus distinct accounts."""
    acct = account_utilisation(user_days, as_of)
    rows = (on_date(user_days, as_of).groupBy("account_id", "segment")
            .agg(F.count(F.lit(1)).alias("n")))
    h = on_date(health, as_of).select("account_id", "feature_score")
    j = acct.join(rows, "account_id").join(h, "account_id")
    out = j.groupBy("segment", "feature_score").agg(
        round_half_up(_weighted_mean("seat_utilization", "n"), 3).alias("avg_seat_utilization"),
        round_half_up(_weighted_mean("breadth_penetration", "n"), 3).alias("avg_full_breadth_penetration"),
        F.count_distinct("account_id").alias("accounts"),
    )
    return out.orderBy(F.col("segment").asc_nulls_last(), F.col("feature_score").asc_nulls_last())
