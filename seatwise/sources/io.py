"""Reading and writing tables with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatwise.sources.contracts import conform


def columns_of(columns: dict | None, table: str, schema: T.StructType) -> dict[str, str]:
    """One table's map, source name -> contract name.

    ``columns`` is one map for all tables, or a map for each table name; only
    names of the table's own contract are renamed to.
    """
    columns = columns or {}
    if any(isinstance(v, dict) for v in columns.values()):
        columns = columns.get(table, {})
    return {k: v for k, v in columns.items() if v in schema.names}


def source_schema(schema: T.StructType, columns: dict[str, str] | None) -> T.StructType:
    """The contract schema under the source's column names.

    ``columns`` maps source name -> contract name; unmapped contract columns
    keep their names.
    """
    if not columns:
        return schema
    back = {v: k for k, v in columns.items()}
    return T.StructType([T.StructField(back.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])


def _renamed(df: DataFrame, columns: dict[str, str] | None) -> DataFrame:
    if not columns:
        return df
    return df.withColumnsRenamed({k: v for k, v in columns.items() if k in df.columns})


def read_parquet(spark: SparkSession, path: str, schema: T.StructType,
                 columns: dict[str, str] | None = None) -> DataFrame:
    """Parquet scan with a declared schema; Catalyst prunes columns and pushes filters.

    ``columns`` renames source columns to the contract (source -> contract).
    """
    df = spark.read.schema(source_schema(schema, columns)).parquet(path)
    return conform(_renamed(df, columns), schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             columns: dict[str, str] | None = None) -> DataFrame:
    """Header CSV with a declared schema; malformed rows fail the job.

    The header line is read when this is called, not when a query runs.
    Columns are matched by header name (``enforceSchema`` off), so extra
    source columns are ignored and order does not matter.  Booleans are read
    from ``True``/``False`` (any case); dates as ISO ``yyyy-MM-dd``.
    ``columns`` renames source columns to the contract (source -> contract).
    """
    src = source_schema(schema, columns)
    header = spark.read.option("header", True).csv(path).columns
    typed = {f.name: f for f in src.fields}
    read_schema = T.StructType([typed.get(c, T.StructField(c, T.StringType(), True)) for c in header])
    df = (spark.read.schema(read_schema)
          .option("header", True)
          .option("enforceSchema", False)
          .option("mode", "FAILFAST")
          .option("dateFormat", "yyyy-MM-dd")
          .csv(path))
    return conform(_renamed(df, columns), schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; Spark writes one file per task and none for empty tasks."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_model(df: DataFrame, path: str, partition_by: str | None = "measurement_date",
                mode: str = "overwrite", files_per_date: int | None = None,
                bucket_column: str = "account_id") -> None:
    """Materialise a model as Parquet, partitioned by date so readers prune.

    With ``partitionOverwriteMode=dynamic`` only the dates present in ``df``
    are replaced, so a daily rebuild does not erase history.

    ``files_per_date`` (for backfills of many dates): shuffle rows by
    (date, hash(account) mod n) first, so each date gets about n files instead
    of one per writing task, and no date is funnelled into a single task.
    """
    if files_per_date and partition_by:
        bucket = F.pmod(F.xxhash64(F.col(bucket_column)), F.lit(files_per_date))
        df = df.repartition(F.col(partition_by), bucket)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def read_model(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a model written by ``write_model`` (partition column restored)."""
    return conform(spark.read.schema(schema).parquet(path), schema)
