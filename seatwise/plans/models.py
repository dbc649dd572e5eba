"""Build the two models and test them, as a scheduled model run would.

``build`` derives the adoption model from user-days, writes it partitioned by
date, derives the risk mart from the written adoption table plus health and
object counts, writes that too, and runs the declared data-quality checks on
the written outputs.  Usage from the command line::

    python -m seatwise.plans.models --format csv \\
        --user-days ud.csv --health health.csv --objects objects.csv --out models/
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.operators.adoption import account_day_adoption
from seatwise.operators.quality import ADOPTION_CHECKS, HEALTH_CHECKS, RISK_CHECKS, ObservedChecks, run_checks
from seatwise.operators.risk import DEFAULT, RiskThresholds, retention_risk
from seatwise.sources import contracts as C
from seatwise.sources.io import columns_of, read_csv, read_model, read_parquet, write_csv, write_model


@dataclass(frozen=True)
class Built:
    adoption: DataFrame
    risk: DataFrame
    checks: DataFrame


def build(spark: SparkSession, user_days: DataFrame, health: DataFrame, objects: DataFrame, out: str,
          thresholds: RiskThresholds = DEFAULT, output_format: str = "parquet", **baseline_options) -> Built:
    """Write ``{out}/account_day_adoption`` and ``{out}/retention_risk``; return
    both (read back) and the check results: 23 over the models, counted in the jobs that write them (only
    their keys are read again), and the uniqueness of the health rows that the mart joins.

    ``output_format='csv'`` writes header CSV (one file per task, in
    parallel) instead of date-partitioned Parquet."""
    adoption_path, risk_path = f"{out}/account_day_adoption", f"{out}/retention_risk"

    observed = {adoption_path: ObservedChecks(ADOPTION_CHECKS), risk_path: ObservedChecks(RISK_CHECKS)}

    def write(df: DataFrame, path: str, schema) -> DataFrame:
        df = observed[path].observe(df)
        if output_format == "csv":
            write_csv(df, path)
            return read_csv(spark, path, schema)
        write_model(df, path)
        return read_model(spark, path, schema)

    adoption = write(account_day_adoption(user_days), adoption_path, C.ACCOUNT_DAY_ADOPTION)
    risk = write(retention_risk(None, health, objects, thresholds, adoption=adoption, **baseline_options),
                 risk_path, C.RETENTION_RISK)
    checks = (observed[adoption_path].results(adoption).withColumn("model", F.lit("account_day_adoption"))
              .unionByName(observed[risk_path].results(risk).withColumn("model", F.lit("retention_risk")))
              .unionByName(run_checks(health, HEALTH_CHECKS).withColumn("model", F.lit("health"))))
    return Built(adoption, risk, checks.select("model", "check_name", "column_name", "failing_rows"))


def _read(spark: SparkSession, fmt: str, path: str, schema, columns: dict[str, str] | None) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, columns)
    return read_parquet(spark, path, schema, columns)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--user-days", required=True)
    ap.add_argument("--health", required=True)
    ap.add_argument("--objects", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    ap.add_argument("--output-format", choices=("csv", "parquet"), default="parquet")
    ap.add_argument("--columns", help="JSON: source column -> contract column, for all tables or {table: {...}}", default=None)
    args = ap.parse_args(argv)
    columns = json.loads(args.columns) if args.columns else None
    spark = SparkSession.builder.getOrCreate()
    def table(name: str, path: str, schema) -> DataFrame:
        return _read(spark, args.format, path, schema, columns_of(columns, name, schema))

    built = build(spark, table("user_days", args.user_days, C.USER_DAYS), table("health", args.health, C.HEALTH),
                  table("objects", args.objects, C.OBJECTS),
                  args.out, output_format=args.output_format)
    failing = 0
    for row in built.checks.collect():  # one row per declared check (24)
        print(f"{row.model:22s} {row.check_name:20s} {row.column_name:32s} {row.failing_rows}")
        failing += row.failing_rows > 0
    return 1 if failing else 0


if __name__ == "__main__":
    raise SystemExit(main())
