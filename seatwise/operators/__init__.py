"""DataFrame-level operators."""

from seatwise.operators.adoption import (
    account_day_activity,
    account_day_adoption,
    account_day_attributes,
    account_utilisation,
    active_user_days,
    on_date,
)
from seatwise.operators.baseline import activity_baseline, activity_vs_baseline
from seatwise.operators.panel import calendar, expand_users, fill_inactive, panel
from seatwise.operators.quality import (
    ADOPTION_CHECKS,
    RISK_CHECKS,
    in_range,
    in_values,
    not_null,
    run_checks,
    unique_key,
)
from seatwise.operators.risk import (
    RiskThresholds,
    enrich,
    retention_risk,
    with_high_risk,
    with_medium_signals,
    with_risk_reason,
    with_risk_tier,
)
from seatwise.operators.segments import (
    segment_addon_exposure,
    segment_breadth,
    segment_retention,
    segment_seat_penetration,
    segment_trend_volatility,
)

__all__ = [
    "account_day_activity", "account_day_adoption", "account_day_attributes", "account_utilisation",
    "active_user_days", "on_date", "activity_baseline", "activity_vs_baseline", "calendar",
    "expand_users", "fill_inactive", "panel", "ADOPTION_CHECKS", "RISK_CHECKS", "in_range",
    "in_values", "not_null", "run_checks", "unique_key", "RiskThresholds", "enrich",
    "retention_risk", "with_high_risk", "with_medium_signals", "with_risk_reason",
    "with_risk_tier", "segment_addon_exposure", "segment_breadth", "segment_retention",
    "segment_seat_penetration", "segment_trend_volatility",
]
