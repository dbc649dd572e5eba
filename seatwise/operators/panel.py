"""Calendar spines and key x calendar panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, start: dt.date, end: dt.date, step: str = "1 day",
             name: str = "measurement_date") -> DataFrame:
    """Consecutive dates (or month starts with ``step='1 month'``) from start to end."""
    seq = F.sequence(F.lit(start), F.lit(end), F.expr(f"interval {step}"))
    return spark.range(1).select(F.explode(seq).alias(name))


def panel(keys: DataFrame, dates: DataFrame, date_col: str = "measurement_date") -> DataFrame:
    """Every row of ``keys`` paired with every date in ``dates`` — no cross join.

    The distinct dates, as many as there are days with data, come as one
    scalar subquery; each key row explodes them.  Gaps survive, a stray date
    adds one row per key, and the work is linear in the output.
    """
    days = dates.agg(F.array_sort(F.collect_set(date_col))).scalar()
    return keys.select("*", F.explode(days).alias(date_col))


def expand_users(accounts: DataFrame, n_users: Column, account_no: Column,
                 users_per_account: int = 1000, chunk: int = 100_000) -> DataFrame:
    """One row per user of each account: ``user_id = account_no * k + index``.

    An account with no users (or a null count) yields no rows.  The index
    range is cut into chunks of at most ``chunk`` indices; the chunk rows (a
    few per account) are spread by hash before the second explode, so a huge
    account's users are generated by many tasks, never one array in one task.
    """
    first = accounts.select(
        "*", F.explode(F.when(n_users > 0, F.sequence(F.lit(0), ((n_users - 1) / chunk).cast("int"))))
        .alias("_chunk"), n_users.alias("_n"))
    spread = first.repartition(account_no, F.col("_chunk"))
    lo = F.col("_chunk") * chunk
    hi = F.least(lo + chunk, F.col("_n")) - 1
    out = spread.select("*", F.explode(F.sequence(lo, hi)).alias("user_index")).drop("_chunk", "_n")
    return out.withColumn("user_id", (account_no.cast("long") * users_per_account + F.col("user_index")))


def fill_inactive(panel_df: DataFrame, activity: DataFrame, keys: list[str],
                  flags: list[str]) -> DataFrame:
    """Left join activity onto a panel; a missing user-day gets every flag false."""
    joined = panel_df.join(activity, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
