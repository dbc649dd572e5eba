"""The account-day retention-risk mart: enrichment, rules, tier and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.objects import active_object_ratio
from seatwise.operators.adoption import account_day_adoption
from seatwise.operators.baseline import activity_baseline, activity_vs_baseline
from seatwise.sources.contracts import RETENTION_RISK, conform

# ---- fixed values: reason texts and tier labels --------------------------------
REASON_ADDON = "Add-on ARR at risk — renewal within 90 days"
REASON_SEATS = "Low seat penetration on large account"
REASON_BREADTH = "Workflow not embedded — power user dependency"
REASON_ACTIVITY = "Activity significantly below own baseline"
TIERS = ("High", "Medium", "Low")
# ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class RiskThresholds:
    """Rule thresholds (defaults are the reference values).  Every comparison
    is made on the already-rounded metric."""
    high_addon_share: float = 0.20
    high_renewal_days: int = 90
    high_seat_penetration: float = 0.30
    large_account_seats: int = 15
    high_breadth_penetration: float = 0.25
    large_account_arr: int = 50000
    high_activity_drop: float = -15.0
    medium_addon_share: float = 0.15
    medium_seat_penetration: float = 0.40
    medium_activity_drop: float = -8.0
    medium_object_ratio: float = 0.30
    medium_min_signals: int = 2


DEFAULT = RiskThresholds()

HEALTH_COLUMNS = ("health_score", "percent_days_active", "feature_categories_used",
                  "net_positive_periods", "trailing_activity_baseline", "activity_vs_baseline")


def high_rules(t: RiskThresholds = DEFAULT) -> list[tuple[Column, str]]:
    """The four High conditions in priority order, with their reason text.
    A null input fails its condition."""
    c = F.col
    return [
        ((c("addon_arr_pct") > t.high_addon_share) & (c("days_to_renewal") < t.high_renewal_days),
         REASON_ADDON),
        ((c("seat_penetration") < t.high_seat_penetration) & (c("paid_seats") > t.large_account_seats),
         REASON_SEATS),
        ((c("full_breadth_penetration") < t.high_breadth_penetration) & (c("arr") > t.large_account_arr),
         REASON_BREADTH),
        (c("activity_vs_baseline") < t.high_activity_drop, REASON_ACTIVITY),
    ]


def _first_match(rules: list[tuple[Column, str]], value=None) -> Column:
    expr = None
    for cond, reason in rules:
        out = F.lit(reason if value is None else value)
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr


def high_risk_flag(t: RiskThresholds = DEFAULT) -> Column:
    """1 when any High condition holds, else 0."""
    return _first_match(high_rules(t), 1).otherwise(F.lit(0))


def medium_signal_count(t: RiskThresholds = DEFAULT) -> Column:
    """Number (0-4) of the soft signals that hold."""
    c = F.col
    signals = [c("addon_arr_pct") > t.medium_addon_share,
               c("seat_penetration") < t.medium_seat_penetration,
               c("activity_vs_baseline") < t.medium_activity_drop,
               c("active_object_ratio") < t.medium_object_ratio]
    total = None
    for s in signals:
        one = F.when(s, F.lit(1)).otherwise(F.lit(0))
        total = one if total is None else total + one
    return total


def with_high_risk(df: DataFrame, t: RiskThresholds = DEFAULT) -> DataFrame:
    return df.withColumn("is_high_risk", high_risk_flag(t))


def with_medium_signals(df: DataFrame, t: RiskThresholds = DEFAULT) -> DataFrame:
    return df.withColumn("medium_signal_count", medium_signal_count(t))


def risk_tier(t: RiskThresholds = DEFAULT) -> Column:
    return (F.when(high_risk_flag(t) == 1, F.lit(TIERS[0]))
            .when(medium_signal_count(t) >= t.medium_min_signals, F.lit(TIERS[1]))
            .otherwise(F.lit(TIERS[2])))


def risk_reason(t: RiskThresholds = DEFAULT) -> Column:
    """Text of the first High condition that holds; null otherwise."""
    return _first_match(high_rules(t))


def with_risk_tier(df: DataFrame, t: RiskThresholds = DEFAULT) -> DataFrame:
    return df.withColumn("risk_tier", risk_tier(t))


def with_risk_reason(df: DataFrame, t: RiskThresholds = DEFAULT) -> DataFrame:
    return df.withColumn("primary_risk_reason", risk_reason(t))


def health_with_baseline(health: DataFrame, **baseline_options) -> DataFrame:
    """Health signals plus the trailing baseline and the gap to it, computed on
    the health side so the mart joins health once (one exchange, one scan)."""
    h = health.select("account_id", "measurement_date", "health_score", "percent_days_active",
                      "feature_categories_used", "net_positive_periods")
    h = activity_baseline(h, **baseline_options)
    return h.withColumn("activity_vs_baseline", activity_vs_baseline())


def enrich(adoption: DataFrame, health: DataFrame, objects: DataFrame,
           health_baseline: DataFrame | None = None, **baseline_options) -> DataFrame:
    """Adoption left join (health + baseline) left join object ratio on
    (account, date).  Missing health or objects leave nulls, never risk.

    ``health_baseline`` may supply health rows that already carry
    ``trailing_activity_baseline`` (e.g. from an incremental build); then
    ``health`` is not used."""
    keys = ["account_id", "measurement_date"]
    if health_baseline is not None:
        h = health_baseline.withColumn("activity_vs_baseline", activity_vs_baseline())
    else:
        h = health_with_baseline(health, **baseline_options)
    o = objects.select(*keys, active_object_ratio().alias("active_object_ratio"))
    return adoption.join(h, keys, "left").join(o, keys, "left")


MART_COLUMNS = (
    "measurement_date", "account_id", "segment", "arr", "platform_arr", "addon_arr", "addon_arr_pct",
    "addon_a", "addon_b", "paid_seats", "active_users", "seat_penetration", "full_breadth_users",
    "full_breadth_penetration", "next_renewal_date", "days_to_renewal", "health_score",
    "percent_days_active", "feature_categories_used", "net_positive_periods",
    "trailing_activity_baseline", "activity_vs_baseline", "active_object_ratio",
)


def retention_risk(user_days: DataFrame | None, health: DataFrame | None, objects: DataFrame,
                   thresholds: RiskThresholds = DEFAULT, adoption: DataFrame | None = None,
                   health_baseline: DataFrame | None = None, **baseline_options) -> DataFrame:
    """The retention-risk mart: one row per account-day, 25 columns.

    ``adoption`` may be passed pre-built (e.g. read back from Parquet);
    otherwise it is derived from ``user_days``.  ``health_baseline`` may pass
    health rows with the baseline already computed (see ``enrich``).
    """
    a = adoption if adoption is not None else account_day_adoption(user_days)
    j = enrich(a, health, objects, health_baseline, **baseline_options)
    return conform(j.select(*MART_COLUMNS, risk_tier(thresholds).alias("risk_tier"),
                            risk_reason(thresholds).alias("primary_risk_reason")), RETENTION_RISK)
