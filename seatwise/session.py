"""Session helpers for tests, the bench and local runs.

Library operators never change session configuration; only these helpers
(used by tests and ``bench.py``) build a local session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "seatwise", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with AQE on and the web UI off.

    ``spark.checkpoint.dir`` is taken from the environment's Spark defaults
    when present; only when it is unset do we point it at a fresh scratch
    folder (this is the local-test case, never a cluster).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEATWISE_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stream state.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names it);
    sets a scratch folder only when it is unset, as in local tests.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seatwise-ckpt-"))
    return sc.getCheckpointDir()
