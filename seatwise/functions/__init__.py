"""Column-level helpers: each returns a ``pyspark.sql.Column`` (or adds columns)."""

from seatwise.functions.rounding import round_half_up
from seatwise.functions.adoption import (
    addon_arr_pct,
    addon_total,
    breadth_columns,
    category_flags,
    days_to_renewal,
    with_addon_exposure,
    with_breadth,
    with_category_flags,
    with_days_to_renewal,
)
from seatwise.functions.objects import active_object_ratio, with_active_object_ratio
from seatwise.functions.stats import exact_mean, ratio

__all__ = [
    "round_half_up", "addon_arr_pct", "addon_total", "breadth_columns", "category_flags",
    "days_to_renewal", "with_addon_exposure", "with_breadth", "with_category_flags",
    "with_days_to_renewal", "active_object_ratio", "with_active_object_ratio",
    "exact_mean", "ratio",
]
