"""Data-quality checks as one aggregation.

A check passes when it finds no failing rows.  Nulls pass range and value
checks (a null comparison is not a failure).  ``run_checks`` evaluates every
check in one pass: when there is a uniqueness check, rows are first grouped
by its key (one shuffle, with map-side partial counts; none at all when the
input is already partitioned by that key) and every other check's failing
count rides along as a partial sum; a final global aggregate adds them up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    kind: str                  # not_null | accepted_range | accepted_values | unique_combination
    columns: tuple[str, ...]
    min_value: float | None = None
    max_value: float | None = None
    values: tuple = field(default_factory=tuple)

    @property
    def column_label(self) -> str:
        return ",".join(self.columns)

    def failing(self) -> Column:
        """Boolean that is true on a failing row (row-level checks only)."""
        c = F.col(self.columns[0])
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "accepted_range":
            ok = F.lit(True)
            if self.min_value is not None:
                ok = ok & (c >= F.lit(self.min_value))
            if self.max_value is not None:
                ok = ok & (c <= F.lit(self.max_value))
            return ~ok
        if self.kind == "accepted_values":
            return ~c.isin(list(self.values))
        raise ValueError(f"{self.kind} is not a row-level check")


def not_null(col: str) -> Check:
    return Check("not_null", (col,))


def in_range(col: str, lo: float | None = None, hi: float | None = None) -> Check:
    return Check("accepted_range", (col,), lo, hi)


def in_values(col: str, values) -> Check:
    return Check("accepted_values", (col,), values=tuple(values))


def unique_key(*cols: str) -> Check:
    return Check("unique_combination", tuple(cols))


# ---- fixed values: the declared checks of the two models -------------------------
ADOPTION_CHECKS = (
    not_null("account_id"), not_null("measurement_date"),
    not_null("seat_penetration"), in_range("seat_penetration", 0, 1),
    in_range("full_breadth_penetration", 0, 1),
    in_range("addon_arr_pct", 0, 1),
    not_null("arr"), in_range("arr", 0),
    not_null("paid_seats"), in_range("paid_seats", 1),
    unique_key("account_id", "measurement_date"),
)
RISK_CHECKS = (
    not_null("account_id"), not_null("measurement_date"),
    not_null("risk_tier"), in_values("risk_tier", ("High", "Medium", "Low")),
    not_null("arr"), in_range("arr", 0),
    in_range("addon_arr_pct", 0, 1),
    in_range("seat_penetration", 0, 1),
    in_range("full_breadth_penetration", 0, 1),
    in_range("active_object_ratio", 0, 1),
    not_null("days_to_renewal"),
    unique_key("account_id", "measurement_date"),
)
# the mart joins health once by this key; two rows of a key would give two mart rows
HEALTH_CHECKS = (unique_key("account_id", "measurement_date"),)
# -----------------------------------------------------------------------------------


def run_checks(df: DataFrame, checks=ADOPTION_CHECKS) -> DataFrame:
    """One row per check: ``(check_name, column_name, failing_rows)``.

    For a uniqueness check ``failing_rows`` is the number of key combinations
    that occur more than once.
    """
    row_checks = [c for c in checks if c.kind != "unique_combination"]
    uniques = [c for c in checks if c.kind == "unique_combination"]
    parts: list[DataFrame] = []
    names = [f"_c{i}" for i in range(len(row_checks))]
    counts = [F.count(F.when(c.failing(), 1)).alias(n) for c, n in zip(row_checks, names)]

    if uniques:
        first, rest = uniques[0], uniques[1:]
        per_key = df.groupBy(*first.columns).agg(F.count(F.lit(1)).alias("_n"), *counts)
        totals = per_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names],
                             F.count(F.when(F.col("_n") > 1, 1)).alias("_u0"))
        labels = [(c.kind, c.column_label, n) for c, n in zip(row_checks, names)]
        labels.append((first.kind, first.column_label, "_u0"))
        parts.append(_unpivot(totals, labels))
        for u in rest:
            dup = (df.groupBy(*u.columns).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("_u")))
            parts.append(_unpivot(dup, [(u.kind, u.column_label, "_u")]))
    else:
        totals = df.agg(*counts)
        parts.append(_unpivot(totals, [(c.kind, c.column_label, n) for c, n in zip(row_checks, names)]))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unpivot(one_row: DataFrame, labels: list[tuple[str, str, str]]) -> DataFrame:
    """Turn a one-row frame of counts into one row per check."""
    entries = F.array(*[
        F.struct(F.lit(kind).alias("check_name"), F.lit(col).alias("column_name"),
                 F.col(name).cast("long").alias("failing_rows"))
        for kind, col, name in labels
    ])
    return one_row.select(F.inline(entries))


class ObservedChecks:
    """Row-level checks that ride along with the job that writes a table; only uniqueness reads it again.

    ``observe`` the frame, write what it returns, then ask for ``results`` with the written table: its key
    columns alone are read, for the uniqueness checks.
    """

    def __init__(self, checks=ADOPTION_CHECKS):
        self.checks = tuple(checks)
        self.row_checks = [c for c in self.checks if c.kind != "unique_combination"]
        self.counts = Observation()

    def observe(self, df: DataFrame) -> DataFrame:
        return df.observe(self.counts, F.count(F.lit(1)).alias("n_rows"),
                          *[F.count(F.when(c.failing(), 1)).alias(f"_c{i}") for i, c in enumerate(self.row_checks)])

    def results(self, written: DataFrame) -> DataFrame:
        """As :func:`run_checks`; waits for the write whose frame was observed."""
        counts = self.counts.get
        rows = [(c.kind, c.column_label, int(counts[f"_c{i}"])) for i, c in enumerate(self.row_checks)]
        out = written.sparkSession.createDataFrame(rows, "check_name string, column_name string, failing_rows long")
        uniques = [c for c in self.checks if c.kind == "unique_combination"]
        for u in uniques:
            out = out.unionByName(run_checks(written.select(*u.columns), [u]))
        return out
