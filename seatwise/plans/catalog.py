"""The named query catalog: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry reads the driver's tables through the adapters in
``seatwise.sources.testdata`` and applies one operator (or the whole model).
The same names key the DuckDB oracle in ``seatwise.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from seatwise.functions import derive as G
from seatwise.functions.adoption import with_breadth
from seatwise.functions.objects import active_object_ratio
from seatwise.operators import adoption as A
from seatwise.operators import baseline as B
from seatwise.operators import quality as Q
from seatwise.operators import risk as R
from seatwise.operators import rollup as U
from seatwise.operators import segments as S
from seatwise.operators.panel import expand_users
from seatwise.sources import testdata as T

AS_OF = T.AS_OF
ROLLUP_SINCE = "2024-01-09"
RETENTION_MONTH = "1997-06-01"

Query = Callable[[SparkSession, str], DataFrame]


def _user_days_on(i, date: str) -> DataFrame:
    """The user-days of a date; inputs that can read a date by itself offer ``user_days_on``."""
    return i.user_days_on(date) if hasattr(i, "user_days_on") else i.user_days


def _user_category_breadth(i) -> DataFrame:
    return with_breadth(i.user_days).select(
        "measurement_date", "account_id", "user_id", "research", "monitoring", "relationship",
        "categories_used", "full_breadth")


def _active_object_ratio(i) -> DataFrame:
    return i.objects.select("measurement_date", "account_id",
                            active_object_ratio().alias("active_object_ratio"))


def _baseline(**opts) -> Callable:
    def run(i) -> DataFrame:
        h = i.health.select("account_id", "measurement_date", "percent_days_active")
        h = B.activity_baseline(h, **opts)
        return h.withColumn("activity_vs_baseline", B.activity_vs_baseline())
    return run


def _health_score_rebuild(i) -> DataFrame:
    fraction = F.col("percent_days_active").cast("double") / 100
    rebuilt = G.health_score(G.activity_score(fraction), "feature_score", "net_positive_periods")
    return i.health.select(
        "account_id", "measurement_date",
        G.activity_score(fraction).alias("activity_score"),
        G.percent_active(fraction).alias("percent_active"),
        rebuilt.alias("health_score_rebuilt"),
        (rebuilt == F.col("health_score").cast("double")).alias("score_matches"),
    )


def _account_directory(i) -> DataFrame:
    return i.user_days.select(
        "account_id", "segment",
        G.service_team("segment").alias("service_team"),
        G.business_type("segment").alias("business_type"),
        G.padded_id("CUS_", G.id_number("account_id", "ACC_")).alias("customer_code"),
        "arr",
        G.platform_share("arr").alias("platform_arr_rebuilt"),
    ).distinct()


def _retention_rebuild(i) -> DataFrame:
    return i.retention.select(
        "measurement_month", "account_id",
        G.gross_retention_base("arr_prior", "arr_current").cast("decimal(18,2)").alias("arr_retained_rebuilt"),
        G.platform_share("arr_prior").alias("platform_arr_prior"),
        G.platform_share("arr_current").alias("platform_arr_current"),
    )


def _object_automation(i) -> DataFrame:
    return i.objects.select("measurement_date", "account_id",
                            G.truncated_share("report_count", 0.4).alias("automated_report_count"))


def _seat_roster(i) -> DataFrame:
    """One row per paid seat of each account, with the user number that the seat gets."""
    seats = i.user_days.select("account_id", "paid_seats").distinct()
    roster = expand_users(seats, F.col("paid_seats"), G.id_number("account_id", "ACC_"))
    return roster.select("account_id", "user_index", "user_id")


def _rollup(i) -> DataFrame:
    return i.rollup if hasattr(i, "rollup") else U.activity_rollup(i.user_days)


def _retention_risk(i) -> DataFrame:
    return R.retention_risk(i.user_days, i.health, i.objects)


# Operator queries: functions of the four inputs (anything with attributes
# user_days, health, retention, objects).
OPERATORS: dict[str, Callable] = {
    # user-day and account-day operators
    "user_category_breadth": _user_category_breadth,
    "account_utilisation": lambda i: A.account_utilisation(_user_days_on(i, AS_OF), AS_OF),
    "account_day_activity": lambda i: A.account_day_activity(i.user_days),
    "account_day_attributes": lambda i: A.account_day_attributes(i.user_days),
    "account_day_adoption": lambda i: A.account_day_adoption(i.user_days),
    "active_object_ratio": _active_object_ratio,
    "activity_baseline": _baseline(),
    "activity_baseline_median": _baseline(method="median"),
    "activity_baseline_range": _baseline(frame="range"),
    # the same counts from one roll-up of bitmaps
    "rollup_account_utilisation": lambda i: U.account_utilisation(_rollup(i), AS_OF),
    "rollup_account_day_activity": lambda i: U.account_day_activity(_rollup(i)),
    "rollup_segment_seat_penetration": lambda i: U.segment_seat_penetration(_rollup(i)),
    "rollup_segment_active_users": lambda i: U.distinct_users(_rollup(i), ["segment"]),
    "rollup_account_active_users": lambda i: U.distinct_users(_rollup(i), ["account_id"], ROLLUP_SINCE, AS_OF),
    # the mart
    "retention_risk": _retention_risk,
    # segment summaries
    "segment_seat_penetration": lambda i: S.segment_seat_penetration(i.user_days),
    "segment_trend_volatility": lambda i: S.segment_trend_volatility(i.health, AS_OF),
    "segment_addon_exposure": lambda i: S.segment_addon_exposure(i.user_days, AS_OF),
    "segment_retention": lambda i: S.segment_retention(i.health, i.retention, AS_OF),
    "segment_retention_one_month": lambda i: S.segment_retention(i.health, i.retention, AS_OF,
                                                                 month=RETENTION_MONTH),
    "segment_addon_exposure_by_account": lambda i: S.segment_addon_exposure(i.user_days, AS_OF,
                                                                            weight="account"),
    "segment_breadth": lambda i: S.segment_breadth(_user_days_on(i, AS_OF), i.health, AS_OF),
    # deterministic derivation rules
    "health_score_rebuild": _health_score_rebuild,
    "account_directory": _account_directory,
    "retention_rebuild": _retention_rebuild,
    "object_automation": _object_automation,
    "seat_roster": _seat_roster,
    # data quality
    "adoption_quality": lambda i: Q.run_checks(A.account_day_adoption(i.user_days), Q.ADOPTION_CHECKS),
    "risk_quality": lambda i: Q.run_checks(_retention_risk(i), Q.RISK_CHECKS),
}


def _years(**opts) -> Query:
    """The baseline over years of account-days, where its frame is full and rows and days differ."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.activity_baseline(T.yearly_activity(spark, sf_dir), **opts)
        return rows.withColumn("activity_vs_baseline", B.activity_vs_baseline())
    return run


def _arr_by_deal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's ARR in the columns of its deals' types."""
    split = T.deals(spark, sf_dir).select("account_id", *[c.alias(n) for n, c in G.arr_by_deal_type("deal_type", "arr").items()])
    names = [c for c in split.columns if c != "account_id"]
    return split.groupBy("account_id").agg(*[F.sum(c).cast("decimal(18,2)").alias(c) for c in names])


def _service_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.labelled_accounts(spark, sf_dir).select(
        "account_id", "segment", G.service_team("segment").alias("service_team"), G.business_type("segment").alias("business_type"))


def _over_testdata(op: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(T.load(spark, sf_dir))
    return run


QUERIES: dict[str, Query] = {
    # inputs derived from the driver's tables
    "user_days": T.user_days,
    "health_daily": T.health,
    "retention_monthly": T.retention,
    "feature_objects": T.objects,
    **{name: _over_testdata(op) for name, op in OPERATORS.items()},
    # years of account-days, deals and labels of their own
    "activity_baseline_years": _years(),
    "activity_baseline_years_median": _years(method="median"),
    "activity_baseline_years_range": _years(frame="range"),
    "activity_baseline_years_range_median": _years(method="median", frame="range"),
    "arr_by_deal_type": _arr_by_deal_type,
    "service_teams": _service_teams,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
