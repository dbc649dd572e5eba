"""The five segment analyses at one date, as DataFrames or SQL views.

``register_views`` exposes the inputs, both models and the five summaries
as temporary views, so the analyses can also be queried with ``spark.sql``::

    register_views(spark, inputs, as_of="2024-11-01")
    spark.sql("SELECT * FROM segment_seat_penetration ORDER BY avg_seat_penetration DESC")

Command line (prints each summary; each is a handful of segment rows)::

    python -m seatwise.plans.analyses --format parquet --as-of 2024-11-01 \\
        --user-days ud/ --health health/ --retention retention/
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from seatwise.operators import segments as S
from seatwise.operators.adoption import account_day_adoption
from seatwise.operators.risk import retention_risk
from seatwise.sources import contracts as C
from seatwise.sources.io import columns_of, read_csv, read_parquet


def segment_summaries(user_days: DataFrame, health: DataFrame, retention: DataFrame,
                      as_of: str | dt.date) -> dict[str, DataFrame]:
    """The five summaries, keyed by name (lazy; nothing runs until an action)."""
    return {
        "segment_retention": S.segment_retention(health, retention, as_of),
        "segment_addon_exposure": S.segment_addon_exposure(user_days, as_of),
        "segment_breadth": S.segment_breadth(user_days, health, as_of),
        "segment_seat_penetration": S.segment_seat_penetration(user_days),
        "segment_trend_volatility": S.segment_trend_volatility(health, as_of),
    }


def register_views(spark: SparkSession, inputs, as_of: str | dt.date) -> list[str]:
    """Temp views over ``inputs`` (anything with user_days, health, retention,
    objects), the two models and the five summaries.  Returns the view names."""
    views = {
        "user_days": inputs.user_days, "health": inputs.health,
        "retention": inputs.retention, "objects": inputs.objects,
        "account_day_adoption": account_day_adoption(inputs.user_days),
        "retention_risk": retention_risk(inputs.user_days, inputs.health, inputs.objects),
        **segment_summaries(inputs.user_days, inputs.health, inputs.retention, as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description="Print the five segment analyses at one date.")
    ap.add_argument("--user-days", required=True)
    ap.add_argument("--health", required=True)
    ap.add_argument("--retention", required=True)
    ap.add_argument("--as-of", required=True)
    ap.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    ap.add_argument("--columns", help="JSON: source column -> contract column, for all tables or {table: {...}}", default=None)
    args = ap.parse_args(argv)
    columns = json.loads(args.columns) if args.columns else None
    spark = SparkSession.builder.getOrCreate()
    read = read_csv if args.format == "csv" else read_parquet
    def table(name: str, path: str, schema) -> DataFrame:
        return read(spark, path, schema, columns_of(columns, name, schema))

    out = segment_summaries(table("user_days", args.user_days, C.USER_DAYS), table("health", args.health, C.HEALTH),
                            table("retention", args.retention, C.RETENTION), args.as_of)
    for name, df in out.items():
        print(f"== {name}")
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
