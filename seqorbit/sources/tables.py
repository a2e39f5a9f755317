"""Reading the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def task_count(spark: SparkSession) -> int:
    """Tasks that rows are dealt to where the work on a row outweighs its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Tasks for each core once an input has a split for every core.
TASKS_A_CORE = 4


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Rows dealt out to at least a task for each core.  The number of splits does not say
    how rows lie in them: a row group is read by one split whole, so a file with one has one split
    with all rows and the others empty.  Inputs of many splits get more tasks, so none is long."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(want if splits < want else max(splits, TASKS_A_CORE * want))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str,
               spread_input: bool = True) -> DataFrame:
    """``name`` from ``sf_dir`` with only ``columns`` (pruned at the scan)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df) if spread_input else df
