"""Object-engagement column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.rounding import round_half_up
from seatwise.functions.stats import ratio


def active_object_ratio() -> Column:
    """(active dashboards + reports + lists) / (all of the same three),
    rounded to 3 places; null when there are no objects."""
    active = F.col("active_dashboard_count") + F.col("active_report_count") + F.col("active_list_count")
    total = F.col("dashboard_count") + F.col("report_count") + F.col("list_count")
    return round_half_up(ratio(active, total), 3)


def with_active_object_ratio(objects: DataFrame) -> DataFrame:
    return objects.withColumn("active_object_ratio", active_object_ratio())
