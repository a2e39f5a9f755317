"""Session helpers: building a session for tests/bench and locating the
shared folder used for stage tables and checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "seqorbit", driver_memory: str = "16g") -> SparkSession:
    """Session for local runs (tests, bench).  On a cluster, pass an existing
    session to the library functions instead."""
    master = master or os.environ.get("SEQORBIT_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and stage tables.

    Read from ``spark.checkpoint.dir`` (or an already set checkpoint dir).  Only
    in local mode, and only when nothing is configured, a private folder under
    the system temp dir is created (tests)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="seqorbit-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a stage table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/stage-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a zstd Parquet stage table under the shared folder and
    read it back: cuts lineage (survives executor loss), is a barrier for the
    optimizer, and later scans get column pruning and filter pushdown."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def broadcast_if_small(df: DataFrame, bound_rows: int | None = None,
                       max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint only for a side whose row count is bounded by
    construction (``bound_rows``: e.g. one row per group of a known small
    domain, or a board-sized table) and under ``max_rows``.  Without a proven
    bound the join is left to AQE, which switches to a broadcast at run time
    only when the measured side is below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and shuffles otherwise."""
    from pyspark.sql import functions as F
    if bound_rows is not None and bound_rows <= max_rows:
        return F.broadcast(df)
    return df
