"""Helpers that the training-data operators share: scratch tables, salted lookups, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every word rule in this package (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Salts that a hot key's rows are spread over in a lookup.
SALTS = 16

#: Bytes of one of Spark's bitmaps.
BITMAP_BYTES = 4096

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; any other master must name one, as
    executors do not share local folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="seatwise-llm-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` to ``values`` (one row for each key), nulls equal.

    The rows of a hot key go to ``salts`` tasks, chosen by ``spread``; each value is copied to all.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).alias("l")
    right = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    on = F.col("l._salt") == F.col("r._salt")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    own = [F.col(f"l.`{c}`") for c in rows.columns]
    return left.join(right, on, "left").select(*own, *[F.col(f"r.`{c}`") for c in values.columns if c not in keys])


def sieve(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits places, a bit each, with the place of every key set; keys are hashes and may share a place.

    Its size is fixed, whatever the number of keys: where keys crowd it, it lets more pass, never less.
    """
    place = F.shiftrightunsigned(key, 64 - bits) + 1
    rows = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = np.zeros(max(1, (1 << bits) // (8 * BITMAP_BYTES)) * BITMAP_BYTES, dtype=np.uint8)
    for row in rows.collect():  # 2 ** bits / 8 bytes at most
        at = (row["bucket"] - 1) * BITMAP_BYTES
        out[at:at + BITMAP_BYTES] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return out


def in_sieve(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys (64-bit) have their place set."""
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node id.

    Alternating large-star and small-star rounds, each a minimum over neighbours and a join, until the
    edges no longer change; every edge then points from a node to its component. Nodes that no edge joins
    to another have no row. Each round is written to the shared folder.
    """
    e = (edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a"))
         .filter("a <> b").select("a", "b").distinct())
    e = stage(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = (small.select("a", F.col("low").alias("b"))
                 .unionByName(small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
                 .distinct())
        e = stage(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                roots.withColumn("component", F.col("node")))
        seen = now


def quoted(name: str) -> str:
    """The name as one column, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_ids(df: DataFrame, name: str = "_row") -> DataFrame:
    """A distinct number for each row; stable once the result is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


def least_row(*order: str) -> Column:
    """The smallest struct of ``order`` (nulls last in the first column)."""
    return F.min(F.struct(F.col(order[0]).isNull().alias("_null"), *order))


def rank_small(dimension: DataFrame, *order: Column) -> DataFrame:
    """Rank from 1 over a dimension table (sources), not over rows of data."""
    return dimension.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
