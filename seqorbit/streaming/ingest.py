"""T-1: incremental unique ingestion with Structured Streaming.

Tours arrive as Parquet files from many producers.  Each micro-batch is
canonicalised, deduplicated within the batch (hash aggregate), checked
against everything already stored (anti join on the canonical key) and
appended.  The store is partitioned by a hash bucket of the key, so a batch
reads only the buckets its own keys fall in.  A re-delivered batch after a
failure finds its keys already stored and appends nothing: the sink is
idempotent by canonical key, and state lives in the table, not in memory.

With ``within_watermark`` the stream instead deduplicates by event time
(``dropDuplicatesWithinWatermark``), bounded state for late copies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.board import DEFAULT_BOARD, TOUR_TYPE, Board, is_valid_tour, tour_key, with_canonical
from ..session import materialize, stage_path
from ..sources.tables import task_count

N_BUCKETS = 64

TOUR_STREAM_SCHEMA = T.StructType([
    T.StructField("tour_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("tour", TOUR_TYPE),
    T.StructField("ts", T.TimestampNTZType()),
])


def _bucket(key_col: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key_col)), F.lit(N_BUCKETS)).cast("int")


def canonical_rows(df: DataFrame, board: Board = DEFAULT_BOARD, valid_only: bool = True) -> DataFrame:
    d = df.where(is_valid_tour("tour", board)) if valid_only else df
    d = with_canonical(d, board=board)
    return d.withColumn("canon_key", tour_key("canon", board)).withColumn("bucket", _bucket("canon_key"))


def _store_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def ingest_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """One micro-batch: dedup within, anti join against the store, append.  The batch is
    canonicalised once: its first rows are staged."""
    spark = batch.sparkSession
    first = (batch.groupBy("bucket", "canon_key")
                  .agg(F.min(F.struct("tour_id", "source")).alias("_f"))
                  .select("bucket", "canon_key", F.col("_f.tour_id").alias("tour_id"),
                          F.col("_f.source").alias("source")))
    first = materialize(first, "ingest-first")
    if _store_exists(spark, store):
        # the buckets present in this batch: at most N_BUCKETS values
        buckets = [r[0] for r in first.select("bucket").distinct().collect()]
        seen = spark.read.parquet(store).where(F.col("bucket").isin(buckets)).select("bucket", "canon_key")
        first = first.join(seen, ["bucket", "canon_key"], "left_anti")
    (first.withColumn("batch_id", F.lit(batch_id).cast("long"))
          .write.mode("append").partitionBy("bucket").parquet(store))


def start_unique_ingest(spark: SparkSession, source_dir: str, store: str, checkpoint: str,
                        board: Board = DEFAULT_BOARD, max_files_per_trigger: int = 1,
                        available_now: bool = True, within_watermark: str | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(TOUR_STREAM_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    # a file of few row groups is read by few tasks: its rows are dealt out before the work on them
    rows = canonical_rows(stream.repartition(task_count(spark)), board)
    if within_watermark:
        # event-time operators need TIMESTAMP; the tables carry TIMESTAMP_NTZ
        # (session time zone is UTC), so the cast keeps the wall-clock value
        rows = (rows.withColumn("ts", F.col("ts").cast("timestamp"))
                    .withWatermark("ts", within_watermark).dropDuplicatesWithinWatermark(["canon_key"]))
    w = (rows.select("tour_id", "source", "canon_key", "bucket").writeStream
         .foreachBatch(lambda df, bid: ingest_batch(df, bid, store))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_unique_ingest(spark: SparkSession, tours: DataFrame, n_files: int = 4,
                      board: Board = DEFAULT_BOARD) -> DataFrame:
    """Land ``tours`` (with an event time ``ts``) as ``n_files`` files in event
    time order under the shared folder, stream them through the ingest, and
    return the store."""
    src = stage_path(spark, "stream-src")
    (tours.select("tour_id", "source", "tour", "ts")
          .repartitionByRange(n_files, "ts", "tour_id").sortWithinPartitions("ts", "tour_id")
          .write.parquet(src))
    store = stage_path(spark, "stream-store")
    q = start_unique_ingest(spark, src, store, stage_path(spark, "stream-ckpt"), board)
    q.awaitTermination()
    if not _store_exists(spark, store):
        return spark.createDataFrame([], "tour_id long, source string, canon_key string, batch_id long, bucket int")
    return spark.read.parquet(store)
