"""seatwise — account-health analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from built-in
``pyspark.sql.functions`` expressions, so Catalyst plans it and the work runs on
the executors.  Sub-packages:

* ``sources``    input/output contracts, Parquet/CSV IO, testdata adapters
* ``functions``  Column-level helpers (flags, ratios, rounding, derivations)
* ``operators``  DataFrame-level operators (adoption, baseline, risk, segments,
                 data quality, calendar panels)
* ``plans``      the named query catalog and its DuckDB oracle SQL
* ``streaming``  incremental (micro-batch) build of the daily models
"""

__version__ = "0.1.0"

from seatwise.operators import (  # noqa: E402
    ADOPTION_CHECKS,
    RISK_CHECKS,
    RiskThresholds,
    account_day_activity,
    account_day_adoption,
    account_day_attributes,
    account_utilisation,
    activity_baseline,
    retention_risk,
    run_checks,
    segment_addon_exposure,
    segment_breadth,
    segment_retention,
    segment_seat_penetration,
    segment_trend_volatility,
)
from seatwise.sources import contracts  # noqa: E402
from seatwise.sources.io import read_csv, read_parquet, write_model  # noqa: E402

__all__ = [
    "ADOPTION_CHECKS", "RISK_CHECKS", "RiskThresholds", "account_day_activity", "account_day_adoption",
    "account_day_attributes", "account_utilisation", "activity_baseline", "retention_risk", "run_checks",
    "segment_addon_exposure", "segment_breadth", "segment_retention", "segment_seat_penetration",
    "segment_trend_volatility", "contracts", "read_csv", "read_parquet", "write_model",
]
