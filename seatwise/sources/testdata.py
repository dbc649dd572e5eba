"""Adapters: the driver's generic tables -> the four account-health inputs.

The account-health inputs (user-days, daily health, monthly retention, daily
object counts) are derived from ``events``, ``customer`` and ``orders`` with
rules that both Spark and DuckDB evaluate identically (integer steps instead of
rounding, exact decimals for money).  Every rule is a DataFrame expression; the
work grows with the source tables.

Rules (fixed; the oracle SQL in ``seatwise.plans.oracle`` states the same):

* account number ``a = user_id div 3``; ``account_id`` = ``ACC_`` and a, filled to six digits
* segment = ``c_mktsegment`` of ``c_custkey = a``; seats = ``3 + a % 20``
* arr = ``(decimal(c_acctbal) + 1000) * 10``; platform share = ``arr * 0.7``
* add-ons a..e = orders of ``o_custkey = a`` by priority 1-URGENT..5-LOW:
  ``(cents(sum(o_totalprice)) div 400) * 0.01``, missing -> 0
* renewal = 2024-01-20 + ``(a * 37) % 365`` days
* user-day panel = every user x every event date; flags from that day's events:
  active = any non-error event, search = click, report/dashboard = view with
  even/odd ``event_id``, alert = signup, list/pitch = purchase with even/odd id
* health per account-day: percent active from the integer ``10000*active div
  users``; categories = research + monitoring + relationship (max over users);
  trend = events today - events on the previous panel date (0 on the first)
* retention per customer and month, from the second order year on: current =
  that month's orders, prior = the same month's a year before, retained = least
  of the two; rows where either has orders
* objects per account-day: total = 1 + running event count (view -> dashboard,
  signup -> report, purchase -> list); active = count over the last 7 panel rows
"""

from __future__ import annotations

import datetime as dt
import threading
from functools import cached_property
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatwise.functions.derive import DEAL_TYPES, SEGMENTS
from seatwise.sources import contracts as C
from seatwise.sources.contracts import conform
from seatwise.sources.io import write_model

# ---- fixed values of the adapter rules -------------------------------------
USERS_PER_ACCOUNT = 3
SEAT_BASE, SEAT_SPREAD = 3, 20
ARR_OFFSET, ARR_FACTOR = 1000, 10
PLATFORM_SHARE = Decimal("0.7")
ADDON_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ADDON_DIVISOR = 400
RENEWAL_START = dt.date(2024, 1, 20)
RENEWAL_STEP, RENEWAL_CYCLE = 37, 365
ACTIVE_OBJECT_ROWS = 7
OBJECT_EVENTS = (("report", "signup"), ("dashboard", "view"), ("list", "purchase"))
AS_OF = "2024-01-15"
# -----------------------------------------------------------------------------

CENTS = Decimal("0.01")

# Declared source schemas (only the columns the adapters read), so no scan
# runs a schema-inference job and every scan reads exactly these columns.
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
CUSTOMER_SCHEMA = "c_custkey bigint, c_acctbal double, c_mktsegment string"
LINEITEM_SCHEMA = "l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz"
ORDERS_SCHEMA = "o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _source(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def _cents(c: str) -> Column:
    """Money as exact integer cents.  Per-key sums of cents stay in ``long``
    arithmetic (a decimal(18,2) sum buffers as decimal(28,2), the slow
    BigDecimal path) and convert back exactly."""
    return (F.col(c).cast(C.MONEY) * 100).cast("long")


def account_id(no: Column) -> Column:
    """At least six digits; longer numbers keep all of theirs."""
    digits = no.cast("string")
    return F.concat(F.lit("ACC_"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time; one without it falls on no date."""
    ev = _source(spark, sf_dir, "events", EVENTS_SCHEMA).filter(F.col("ts").isNotNull())
    return ev.select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("measurement_date"))


def _with_attributes(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the static attributes of each row's ``account_no``."""
    cust = _source(spark, sf_dir, "customer", CUSTOMER_SCHEMA).select(
        F.col("c_custkey").alias("account_no"),
        F.col("c_mktsegment").alias("segment"),
        ((F.col("c_acctbal").cast(C.MONEY) + ARR_OFFSET) * ARR_FACTOR).cast(C.MONEY).alias("arr"),
    )
    orders = _source(spark, sf_dir, "orders", ORDERS_SCHEMA)
    sums = orders.groupBy(F.col("o_custkey").alias("account_no")).agg(*[
        F.sum(F.when(F.col("o_orderpriority") == p, _cents("o_totalprice"))).alias(f"_s{i}")
        for i, p in enumerate(ADDON_PRIORITIES)
    ])
    addons = {
        name: F.coalesce(
            (F.expr(f"_s{i} div {ADDON_DIVISOR}") * F.lit(CENTS)).cast(C.MONEY),
            F.lit(Decimal("0.00")).cast(C.MONEY),
        )
        for i, name in enumerate(("addon_a", "addon_b", "addon_c", "addon_d", "addon_e"))
    }
    no = F.col("account_no")
    joined = rows.join(cust, "account_no", "left").join(sums, "account_no", "left")
    return joined.withColumns({
        "account_id": account_id(no),
        "paid_seats": (F.lit(SEAT_BASE) + no % SEAT_SPREAD).cast("int"),
        "platform_arr": (F.col("arr") * F.lit(PLATFORM_SHARE)).cast(C.MONEY),
        **addons,
        "next_renewal_date": F.date_add(F.lit(RENEWAL_START), ((no * RENEWAL_STEP) % RENEWAL_CYCLE).cast("int")),
    })


FLAG_COLUMNS = ("is_active", "did_search", "did_create_list", "did_pitch",
                "did_view_report", "did_view_dashboard", "did_create_alert")
COUNT_COLUMNS = ("n_events", "n_view", "n_signup", "n_purchase")


def _user_event_days(ev: DataFrame) -> DataFrame:
    """One row per (user, date) with events: the flags and the counts of that day.

    The only pass over ``events``: all inputs follow from these rows.
    """
    t, odd = F.col("event_type"), (F.col("event_id") % 2) == 1
    return ev.groupBy("user_id", "measurement_date").agg(
        F.bool_or(t != "error").alias("is_active"),
        F.bool_or(t == "click").alias("did_search"),
        F.bool_or((t == "purchase") & ~odd).alias("did_create_list"),
        F.bool_or((t == "purchase") & odd).alias("did_pitch"),
        F.bool_or((t == "view") & ~odd).alias("did_view_report"),
        F.bool_or((t == "view") & odd).alias("did_view_dashboard"),
        F.bool_or(t == "signup").alias("did_create_alert"),
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(t == "view", 1)).alias("n_view"),
        F.count(F.when(t == "signup", 1)).alias("n_signup"),
        F.count(F.when(t == "purchase", 1)).alias("n_purchase"),
    ).withColumn("account_no", F.expr(f"user_id div {USERS_PER_ACCOUNT}"))


def _histories(days: DataFrame) -> DataFrame:
    """One row per user: its days with events, as many as there are dates at most.

    Every branch that needs users, accounts or the calendar reads this row whole, so Spark finds the same
    exchange under each and runs it once.
    """
    day = F.struct("measurement_date", *FLAG_COLUMNS, *COUNT_COLUMNS)
    return days.groupBy("user_id", "account_no").agg(F.collect_list(day).alias("days"))


def _calendar(histories: DataFrame) -> Column:
    """The dates with events, in order, as one scalar."""
    dates = histories.select(F.explode(_dates("days")).alias("measurement_date"))
    return dates.agg(F.array_sort(F.collect_set("measurement_date"))).scalar()


def _dates(days: Column | str) -> Column:
    return F.transform(days, lambda d: d["measurement_date"])


def _user_days(histories: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, account, user), inactive user-days included.

    Each user's days, and the dates of the calendar that it lacks with all flags false, come from its own
    row. Events without a user make nobody active.
    """
    users = histories.select("user_id", "account_no", "days", F.array_except(_calendar(histories), _dates("days")).alias("gaps"))
    known = F.col("user_id").isNotNull()
    seen = F.transform("days", lambda d: F.struct(
        d["measurement_date"].alias("measurement_date"), *[(F.coalesce(d[c], F.lit(False)) & known).alias(c) for c in FLAG_COLUMNS]))
    unseen = F.transform("gaps", lambda d: F.struct(d.alias("measurement_date"), *[F.lit(False).alias(c) for c in FLAG_COLUMNS]))
    # attributes join at user grain, before the calendar multiplies the rows
    rows = _with_attributes(users, spark, sf_dir).withColumn("d", F.explode(F.concat(seen, unseen)))
    return conform(rows.withColumns({c: F.col("d")[c] for c in ("measurement_date", *FLAG_COLUMNS)}), C.USER_DAYS)


def _user_days_on(date: str, days: DataFrame, histories: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one date: that day's events, read by the date, and the users without any."""
    day = F.lit(date).cast("date")
    seen = days.filter((F.col("measurement_date") == day) & F.col("user_id").isNotNull()).select(
        "user_id", "account_no", "measurement_date", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAG_COLUMNS])
    absent = ~F.array_contains(_dates("days"), day) | F.col("user_id").isNull()
    unseen = histories.filter(absent).filter(F.array_contains(_calendar(histories), day)).select(
        "user_id", "account_no", day.alias("measurement_date"), *[F.lit(False).alias(c) for c in FLAG_COLUMNS])
    return conform(_with_attributes(seen.unionByName(unseen), spark, sf_dir), C.USER_DAYS)


def _account_days(histories: DataFrame) -> DataFrame:
    """One row per (account, date of the calendar): its users, how many were active, flags and counts.

    Each user adds a row without a date, so the number of an account's users comes with the same sums. Sums
    by (account, date) come before the account's days meet, so a large account is added up where its users are.
    """
    kind = histories.schema["days"].dataType
    entry = F.lit(None).cast(kind.elementType)
    own = F.when(F.col("user_id").isNotNull(), F.col("days")).otherwise(F.array().cast(kind))
    each = histories.select("account_no", F.explode(F.concat(own, F.array(entry))).alias("d"))
    as_int = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    sums = each.groupBy("account_no", F.col("d.measurement_date").alias("measurement_date")).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count(F.when(F.col("d.is_active"), 1)).alias("n_active"),
        as_int(F.col("d.did_search")).alias("research"),
        as_int(F.col("d.did_view_report") | F.col("d.did_view_dashboard") | F.col("d.did_create_alert")).alias("monitoring"),
        as_int(F.col("d.did_create_list") | F.col("d.did_pitch")).alias("relationship"),
        *[F.coalesce(F.sum(f"d.{c}"), F.lit(0)).alias(c) for c in COUNT_COLUMNS])
    values = ("n_active", "research", "monitoring", "relationship", *COUNT_COLUMNS)
    dated = F.col("measurement_date").isNotNull()
    whole = sums.groupBy("account_no").agg(
        F.max(F.when(~dated, F.col("n_users"))).alias("n_users"),
        F.collect_list(F.when(dated, F.struct("measurement_date", *values))).alias("days"))
    nothing = lambda d: F.struct(d.alias("measurement_date"), *[F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in values])
    gaps = whole.select("account_no", "n_users", "days", F.array_except(_calendar(histories), _dates("days")).alias("gaps"))
    return gaps.select("account_no", "n_users", F.explode(F.concat("days", F.transform("gaps", nothing))).alias("d")).select(
        "account_no", "n_users", "d.measurement_date", *[f"d.{c}" for c in values])


def _health(account_days: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One health row per account-day."""
    segments = _source(spark, sf_dir, "customer", CUSTOMER_SCHEMA).select(
        F.col("c_custkey").alias("account_no"), F.col("c_mktsegment").alias("segment"))
    w = Window.partitionBy("account_no").orderBy("measurement_date")
    n = F.col("n_events")
    out = account_days.select(
        "account_no", "measurement_date",
        F.expr("(10000 * n_active) div n_users").alias("pct_int"),
        (F.col("research") + F.col("monitoring") + F.col("relationship")).cast("int").alias("cats"),
        F.coalesce(n - F.lag(n, 1).over(w), F.lit(0)).alias("trend"),
    ).join(segments, "account_no", "left")
    score_cents = F.expr("(pct_int + 5) div 10") + (F.col("cats") + F.col("trend")) * 100
    return conform(out.select(
        "measurement_date", account_id(F.col("account_no")).alias("account_id"), "segment",
        (score_cents * F.lit(CENTS)).cast(C.MONEY).alias("health_score"),
        F.col("cats").cast("double").alias("feature_score"),
        (F.col("pct_int") * F.lit(CENTS)).cast("decimal(5,2)").alias("percent_days_active"),
        F.col("cats").alias("feature_categories_used"),
        F.col("trend").alias("net_positive_periods"),
    ), C.HEALTH)


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (month, customer) with that month's orders and those of a year before."""
    d = F.col("o_orderdate")
    orders = _source(spark, sf_dir, "orders", ORDERS_SCHEMA).filter(F.col("o_custkey").isNotNull() & d.isNotNull())
    years = orders.agg(F.struct(F.min(F.year(d)).alias("first"), F.max(F.year(d)).alias("last"))).scalar()
    first, last = years["first"], years["last"]
    monthly = orders.groupBy("o_custkey", F.year(d).alias("y"), F.month(d).alias("m")).agg(
        F.sum(_cents("o_totalprice")).alias("cents"))
    # each month's orders count for its own year and, as the prior ones, for the next
    both = monthly.select("o_custkey", "m", "cents", F.explode(F.array(F.lit(0), F.lit(1))).alias("later"), "y")
    paired = (both.groupBy("o_custkey", (F.col("y") + F.col("later")).alias("year"), "m").agg(
        *[(F.coalesce(F.sum(F.when(F.col("later") == k, F.col("cents"))), F.lit(0)) * F.lit(CENTS)).cast(C.MONEY).alias(name)
          for name, k in (("arr_prior", 1), ("arr_current", 0))])
        .filter((F.col("year") > first) & (F.col("year") <= last)))
    return conform(paired.select(
        F.make_date("year", "m", F.lit(1)).alias("measurement_month"),
        account_id(F.col("o_custkey")).alias("account_id"),
        "arr_prior", "arr_current",
        F.least("arr_prior", "arr_current").alias("arr_retained"),
    ), C.RETENTION)


def _objects(account_days: DataFrame) -> DataFrame:
    """One object-count row per account-day."""
    w = Window.partitionBy("account_no").orderBy("measurement_date")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = w.rowsBetween(-(ACTIVE_OBJECT_ROWS - 1), Window.currentRow)
    columns = [(F.lit(1) + F.sum(f"n_{event}").over(running)).alias(f"{kind}_count") for kind, event in OBJECT_EVENTS]
    columns += [F.sum(f"n_{event}").over(recent).alias(f"active_{kind}_count") for kind, event in OBJECT_EVENTS]
    return conform(account_days.select(
        "measurement_date", account_id(F.col("account_no")).alias("account_id"), *columns), C.OBJECTS)


def yearly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-days over all years of ``lineitem``: suppliers as accounts, ship dates as dates, gaps kept.

    The percentage is the mean quantity of a day's lines, of at most 50, in whole hundredths.
    """
    lines = _source(spark, sf_dir, "lineitem", LINEITEM_SCHEMA).filter("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL")
    daily = lines.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("measurement_date")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("l_quantity").alias("n"))
    percent = F.expr("200 * quantity div nullif(n, 0)") * F.lit(CENTS)
    return daily.select(account_id(F.col("l_suppkey")).alias("account_id"), "measurement_date",
                        percent.cast("decimal(5,2)").alias("percent_days_active"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``account_id, deal_type, arr``; the five priorities stand for the five deal types."""
    orders = _source(spark, sf_dir, "orders", ORDERS_SCHEMA)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in zip(ADDON_PRIORITIES, DEAL_TYPES) for x in pair]), F.col("o_orderpriority"))
    return orders.select(account_id(F.col("o_custkey")).alias("account_id"), kind.alias("deal_type"),
                         F.col("o_totalprice").cast(C.MONEY).alias("arr"))


def labelled_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: ``account_id, segment``; nations in turn stand for the six segment names."""
    customers = _source(spark, sf_dir, "customer", "c_custkey bigint, c_nationkey int")
    name = F.get(F.array(*map(F.lit, SEGMENTS)), F.col("c_nationkey") % len(SEGMENTS))
    return customers.select(account_id(F.col("c_custkey")).alias("account_id"), name.alias("segment"))


class Inputs:
    """The four inputs over one data folder.

    They are lazy plans over the source tables.  With ``store``, a folder that
    all executors share, each input is derived once and written there as
    Parquet, the daily ones in a folder for each date (``files_per_date`` files
    of it, dealt out by account); queries then scan those tables, as they would
    scan the real input tables, and those of one date open its files only.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: str | None = None, files_per_date: int = 1):
        self.spark, self.sf_dir, self.store, self.files_per_date = spark, sf_dir, store, files_per_date
        self._done: dict[str, DataFrame] = {}
        self._lock = threading.RLock()   # queries may run from several threads

    def _stored(self, name: str, build, schema, partition_by: str | None = None) -> DataFrame:
        if self.store is None:
            return build()
        with self._lock:
            if name not in self._done:
                path = f"{self.store.rstrip('/')}/{name}"
                df = build()
                if partition_by:
                    write_model(df, path, partition_by, files_per_date=self.files_per_date)
                else:
                    df.write.mode("overwrite").parquet(path)
                self._done[name] = (conform(self.spark.read.schema(schema).parquet(path), schema) if schema is not None
                                    else self.spark.read.schema(df.schema).parquet(path).select(*df.columns))
            return self._done[name]

    @cached_property
    def event_days(self) -> DataFrame:
        return _user_event_days(_events(self.spark, self.sf_dir))

    @cached_property
    def histories(self) -> DataFrame:
        return _histories(self.event_days)

    @cached_property
    def account_days(self) -> DataFrame:
        return _account_days(self.histories)

    @cached_property
    def user_days(self) -> DataFrame:
        return self._stored("user_days", lambda: _user_days(self.histories, self.spark, self.sf_dir), C.USER_DAYS,
                            "measurement_date")

    def user_days_on(self, date: str) -> DataFrame:
        """The user-days of one date: the same rows as ``user_days`` has, with the date in every scan that can use it."""
        if self.store is not None:
            return self.user_days.filter(F.col("measurement_date") == F.lit(date).cast("date"))
        return _user_days_on(date, self.event_days, self.histories, self.spark, self.sf_dir)

    @cached_property
    def rollup(self) -> DataFrame:
        """The bitmaps of active users by account-day."""
        from seatwise.operators.rollup import activity_rollup  # the operators import this package's contracts
        return self._stored("rollup", lambda: activity_rollup(self.user_days), None, "measurement_date")

    @cached_property
    def health(self) -> DataFrame:
        return self._stored("health", lambda: _health(self.account_days, self.spark, self.sf_dir), C.HEALTH,
                            "measurement_date")

    @cached_property
    def retention(self) -> DataFrame:
        return self._stored("retention", lambda: _retention(self.spark, self.sf_dir), C.RETENTION)

    @cached_property
    def objects(self) -> DataFrame:
        return self._stored("objects", lambda: _objects(self.account_days), C.OBJECTS,
                            "measurement_date")


def load(spark: SparkSession, sf_dir: str, store: str | None = None) -> Inputs:
    """The inputs over ``sf_dir``: lazy, or written once under ``store``."""
    return Inputs(spark, sf_dir, store)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).user_days


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).health


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).retention


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).objects
