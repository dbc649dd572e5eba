"""Incremental daily build of the adoption and risk models.

New files of the three inputs (partitioned by ``measurement_date``) arrive as
file streams.  A micro-batch only names the dates that changed.  A changed
health row takes part in the baselines of its account's later rows, so both
models are rebuilt from the earliest changed date on: in the usual order of
arrival that is the newest date, and a late row reaches every date whose frame
holds it.  Dates are written with dynamic partition overwrite, so a batch that
is replayed after a failure gives the same output, and there is no state
besides the streams' own progress.

The baseline is the batch window over three columns of the health history;
user-days and objects are read from the earliest changed date on only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seatwise.operators.adoption import account_day_adoption
from seatwise.operators.baseline import activity_baseline
from seatwise.operators.risk import DEFAULT, RiskThresholds, retention_risk
from seatwise.sources import contracts as C
from seatwise.sources.io import read_parquet, write_model

DATE = "measurement_date"

HEALTH_COLUMNS = ["account_id", DATE, "health_score", "percent_days_active",
                  "feature_categories_used", "net_positive_periods"]


def rebuild_from(spark: SparkSession, first: dt.date, user_days_path: str, health_path: str,
                 objects_path: str, adoption_out: str, risk_out: str,
                 thresholds: RiskThresholds = DEFAULT, **baseline_options) -> None:
    """Rebuild both models for all dates from ``first`` on."""
    recent = F.col(DATE) >= F.lit(first)
    adoption = account_day_adoption(read_parquet(spark, user_days_path, C.USER_DAYS).filter(recent))
    write_model(adoption, adoption_out)
    adoption = read_parquet(spark, adoption_out, C.ACCOUNT_DAY_ADOPTION).filter(recent)
    health = read_parquet(spark, health_path, C.HEALTH).select(*HEALTH_COLUMNS)
    baseline = activity_baseline(health, **baseline_options).filter(recent)
    objects = read_parquet(spark, objects_path, C.OBJECTS).filter(recent)
    write_model(retention_risk(None, None, objects, thresholds, adoption=adoption, health_baseline=baseline), risk_out)


def _progress_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("name a checkpoint folder, or set spark.checkpoint.dir")
    return f"{named.rstrip('/')}/seatwise-daily-build"


def start(spark: SparkSession, user_days_path: str, health_path: str, objects_path: str,
          adoption_out: str, risk_out: str, checkpoint: str | None = None,
          available_now: bool = True, processing_time: str | None = None,
          max_files_per_trigger: int | None = None, **options) -> StreamingQuery:
    """Start the stream.  ``available_now`` processes what is there and stops;
    otherwise it polls every ``processing_time``."""

    def dates_of(path: str, schema) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path).select(DATE)

    stream = (dates_of(user_days_path, C.USER_DAYS).unionByName(dates_of(health_path, C.HEALTH))
              .unionByName(dates_of(objects_path, C.OBJECTS)))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        first = batch.agg(F.min(DATE)).first()[0]
        if first is not None:
            rebuild_from(batch.sparkSession, first, user_days_path, health_path, objects_path,
                         adoption_out, risk_out, **options)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint or _progress_folder(spark))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
