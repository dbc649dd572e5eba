"""User-day and account-day column helpers (feature categories, add-on exposure,
renewal distance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.rounding import round_half_up
from seatwise.functions.stats import ratio

MONEY = "decimal(18,2)"
ADDON_COLUMNS = ("addon_a", "addon_b", "addon_c", "addon_d", "addon_e")


def _flag(cond: Column) -> Column:
    # three-valued: a null condition falls to 0
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def category_flags() -> dict[str, Column]:
    """0/1 flags for the three feature categories of a user-day.

    research = search; monitoring = report view OR dashboard view OR alert;
    relationship = list creation OR pitch.  A null activity flag counts as 0.
    """
    return {
        "research": _flag(F.col("did_search")),
        "monitoring": _flag(F.col("did_view_report") | F.col("did_view_dashboard")
                            | F.col("did_create_alert")),
        "relationship": _flag(F.col("did_create_list") | F.col("did_pitch")),
    }


def with_category_flags(user_days: DataFrame) -> DataFrame:
    return user_days.withColumns(category_flags())


def breadth_columns() -> dict[str, Column]:
    """Categories used (0-3) and the full-breadth flag (all three used)."""
    used = F.col("research") + F.col("monitoring") + F.col("relationship")
    return {"categories_used": used, "full_breadth": _flag(used == 3)}


def with_breadth(df: DataFrame) -> DataFrame:
    """Adds ``categories_used`` and ``full_breadth``; adds the flags if missing."""
    if "research" not in df.columns:
        df = with_category_flags(df)
    return df.withColumns(breadth_columns())


def addon_total() -> Column:
    """Sum of the five add-on ARR columns; any null component nulls the total."""
    total = F.col(ADDON_COLUMNS[0])
    for c in ADDON_COLUMNS[1:]:
        total = total + F.col(c)
    return total.cast(MONEY)


def addon_arr_pct(addon: Column | str = "addon_arr", arr: Column | str = "arr") -> Column:
    """Add-on share of ARR, rounded to 3 places; null when ARR is 0 or null."""
    return round_half_up(ratio(addon, arr), 3)


def with_addon_exposure(df: DataFrame) -> DataFrame:
    df = df.withColumn("addon_arr", addon_total())
    return df.withColumn("addon_arr_pct", addon_arr_pct())


def days_to_renewal() -> Column:
    """Renewal date minus measurement date in days (negative when overdue)."""
    return F.datediff(F.col("next_renewal_date"), F.col("measurement_date"))


def with_days_to_renewal(df: DataFrame) -> DataFrame:
    return df.withColumn("days_to_renewal", days_to_renewal())
