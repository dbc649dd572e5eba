"""Explicit schemas for the four inputs and the two models.  Never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    doc = COLUMN_DOCS.get(name)
    return T.StructField(name, dtype, nullable, {"comment": doc} if doc else None)


# Column documentation for the two models (Spark field comments).
COLUMN_DOCS = {
    "measurement_date": "day the row describes",
    "account_id": "account (customer) identifier",
    "segment": "customer segment",
    "paid_seats": "licensed seats",
    "arr": "annual recurring revenue",
    "platform_arr": "platform part of ARR",
    "addon_arr": "sum of the five add-on ARR parts; null if any part is null",
    "addon_a": "first add-on ARR part",
    "addon_b": "second add-on ARR part",
    "addon_arr_pct": "add-on ARR / ARR, 3 dp; null when ARR is 0",
    "next_renewal_date": "next contract renewal",
    "days_to_renewal": "renewal date minus measurement date; negative when overdue",
    "active_users": "distinct users active that day (0 when none)",
    "full_breadth_users": "active users that used all three feature categories",
    "seat_penetration": "active users / seats, 3 dp (0 when none active)",
    "full_breadth_penetration": "full-breadth users / active users, 3 dp (0 when none active)",
    "health_score": "daily health score",
    "percent_days_active": "percent of days active, 0-100",
    "feature_categories_used": "feature categories used by the account (0-3)",
    "net_positive_periods": "trend score; negative when declining",
    "trailing_activity_baseline": "mean percent active over the account's previous 364 rows",
    "activity_vs_baseline": "percent active minus the baseline, 2 dp",
    "active_object_ratio": "active / total dashboards, reports and lists, 3 dp",
    "risk_tier": "High, Medium or Low",
    "primary_risk_reason": "first High condition that holds; null below High",
}


USER_DAYS = T.StructType([
    _f("measurement_date", T.DateType(), False),
    _f("account_id", T.StringType(), False),
    _f("user_id", T.LongType(), False),
    _f("segment", T.StringType()),
    _f("paid_seats", T.IntegerType()),
    _f("arr", MONEY),
    _f("platform_arr", MONEY),
    _f("addon_a", MONEY),
    _f("addon_b", MONEY),
    _f("addon_c", MONEY),
    _f("addon_d", MONEY),
    _f("addon_e", MONEY),
    _f("is_active", T.BooleanType()),
    _f("did_search", T.BooleanType()),
    _f("did_create_list", T.BooleanType()),
    _f("did_pitch", T.BooleanType()),
    _f("did_view_report", T.BooleanType()),
    _f("did_view_dashboard", T.BooleanType()),
    _f("did_create_alert", T.BooleanType()),
    _f("next_renewal_date", T.DateType()),
])

HEALTH = T.StructType([
    _f("measurement_date", T.DateType(), False),
    _f("account_id", T.StringType(), False),
    _f("segment", T.StringType()),
    _f("health_score", MONEY),
    _f("feature_score", T.DoubleType()),
    _f("percent_days_active", T.DecimalType(5, 2)),
    _f("feature_categories_used", T.IntegerType()),
    _f("net_positive_periods", T.LongType()),
])

RETENTION = T.StructType([
    _f("measurement_month", T.DateType(), False),
    _f("account_id", T.StringType(), False),
    _f("arr_prior", MONEY),
    _f("arr_current", MONEY),
    _f("arr_retained", MONEY),
])

OBJECTS = T.StructType([
    _f("measurement_date", T.DateType(), False),
    _f("account_id", T.StringType(), False),
    _f("report_count", T.LongType()),
    _f("active_report_count", T.LongType()),
    _f("dashboard_count", T.LongType()),
    _f("active_dashboard_count", T.LongType()),
    _f("list_count", T.LongType()),
    _f("active_list_count", T.LongType()),
])

ACCOUNT_DAY_ADOPTION = T.StructType([
    _f("measurement_date", T.DateType()),
    _f("account_id", T.StringType()),
    _f("segment", T.StringType()),
    _f("paid_seats", T.IntegerType()),
    _f("arr", MONEY),
    _f("platform_arr", MONEY),
    _f("addon_arr", MONEY),
    _f("addon_a", MONEY),
    _f("addon_b", MONEY),
    _f("addon_arr_pct", T.DoubleType()),
    _f("next_renewal_date", T.DateType()),
    _f("days_to_renewal", T.IntegerType()),
    _f("active_users", T.LongType()),
    _f("full_breadth_users", T.LongType()),
    _f("seat_penetration", T.DoubleType()),
    _f("full_breadth_penetration", T.DoubleType()),
])

RETENTION_RISK = T.StructType([
    _f("measurement_date", T.DateType()),
    _f("account_id", T.StringType()),
    _f("segment", T.StringType()),
    _f("arr", MONEY),
    _f("platform_arr", MONEY),
    _f("addon_arr", MONEY),
    _f("addon_arr_pct", T.DoubleType()),
    _f("addon_a", MONEY),
    _f("addon_b", MONEY),
    _f("paid_seats", T.IntegerType()),
    _f("active_users", T.LongType()),
    _f("seat_penetration", T.DoubleType()),
    _f("full_breadth_users", T.LongType()),
    _f("full_breadth_penetration", T.DoubleType()),
    _f("next_renewal_date", T.DateType()),
    _f("days_to_renewal", T.IntegerType()),
    _f("health_score", MONEY),
    _f("percent_days_active", T.DecimalType(5, 2)),
    _f("feature_categories_used", T.IntegerType()),
    _f("net_positive_periods", T.LongType()),
    _f("trailing_activity_baseline", T.DoubleType()),
    _f("activity_vs_baseline", T.DoubleType()),
    _f("active_object_ratio", T.DoubleType()),
    _f("risk_tier", T.StringType()),
    _f("primary_risk_reason", T.StringType()),
])

INPUTS = {"user_days": USER_DAYS, "health": HEALTH, "retention": RETENTION, "objects": OBJECTS}


class ContractError(ValueError):
    pass


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the contract's columns in contract order, cast to contract types.

    Raises ``ContractError`` when a column is missing.  Extra columns are
    dropped, so Catalyst prunes them from the scan.
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata or {})
                      for f in schema.fields])


def check_contract(df: DataFrame, schema: T.StructType) -> None:
    """Raise ``ContractError`` unless names and types match exactly (nullability ignored)."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in schema.fields]
    if got != want:
        raise ContractError(f"schema mismatch:\n got  {got}\n want {want}")
