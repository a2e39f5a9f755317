"""T-1 on a versioned store: incremental unique ingestion that keeps the tours.

Tours arrive as Parquet files from many producers.  Each micro-batch is canonicalised,
deduplicated within the batch, checked against everything already stored (anti join on a
16-byte key of the canonical form) and appended to a ``VersionedStore``, which opens only the
buckets that hold one of the batch's keys and merges its commits as it grows.  The tour that
arrived first is kept.  Commits carry the name of their stream and batch: a re-delivered batch is
in the store's log and adds nothing, and a batch that failed half-way was never committed and
is written again.

With ``late_after`` rows whose event time lies that far behind the latest event of the batches
before go to a side table instead, where they can be looked at and added later; none is lost."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, Board, is_valid_tour, tour_key, with_canonical
from ..session import materialize, stage_path
from ..sources.store import BUCKET_ROWS, VersionedStore, key_of
from ..sources.tables import task_count
from .ingest import TOUR_STREAM_SCHEMA

STORED = "tour_id long, source string, tour array<tinyint>, ts timestamp_ntz, canon_key string"


def canonical_rows(df: DataFrame, board: Board = DEFAULT_BOARD, valid_only: bool = True) -> DataFrame:
    d = df.where(is_valid_tour("tour", board)) if valid_only else df
    d = with_canonical(d, board=board)
    return d.withColumn("canon_key", tour_key("canon", board)).withColumn("key", key_of("canon")).drop("canon")


def ingest_batch(batch: DataFrame, batch_id: int, store: VersionedStore, late_after: str | None = None,
                 stream: str = "stream") -> int:
    """One micro-batch of ``stream``: set late rows aside, dedup, anti join against the store,
    append, merge.  Returns the rows added."""
    name = f"{stream}-{batch_id}"
    if name in store.names():
        return 0
    high = store.high_mark()
    rows = materialize(batch.select("key", "tour_id", "source", "tour", "ts", "canon_key"), "ingest-batch")
    ts = F.col("ts").cast("timestamp")
    on_time = F.lit(True)
    if late_after and high is not None:
        on_time = F.coalesce(ts >= F.lit(high) - F.expr(f"INTERVAL {late_after}"), F.lit(True))
    newest, n_late = rows.agg(F.max(ts), F.count_if(~on_time)).first()
    if n_late:
        # one folder for each batch, so a second try overwrites the first
        rows.where(~on_time).write.mode("overwrite").parquet(f"{store.path}/late/{name}")
        rows = rows.where(on_time)
    high = max(x for x in (high, newest) if x is not None) if (high or newest) else None
    n = store.add_new(rows, name, batch_id=batch_id, n_late=n_late, high=high)
    store.compact()
    return n


def late_rows(store: VersionedStore) -> DataFrame:
    """The side table of all committed batches."""
    paths = [f"{store.path}/late/{r['name']}" for r in store.log() if r["n_late"]]
    schema = "key binary, " + STORED
    return store.spark.read.schema(schema).parquet(*paths) if paths else store.spark.createDataFrame([], schema)


def start_store_ingest(spark: SparkSession, source_dir: str, store: VersionedStore, checkpoint: str,
                        board: Board = DEFAULT_BOARD, max_files_per_trigger: int = 1,
                        available_now: bool = True, late_after: str | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``.  Batch numbers belong to a
    checkpoint, so the checkpoint names the stream."""
    name = "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    stream = (spark.readStream.schema(TOUR_STREAM_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, late_after, name)

    # a file of few row groups is read by few tasks: its rows are dealt out before the work on them
    dealt = stream.repartition(task_count(spark))
    w = canonical_rows(dealt, board).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_store_ingest(spark: SparkSession, tours: DataFrame, n_files: int = 4, board: Board = DEFAULT_BOARD,
                      late_after: str | None = None, bucket_rows: int = BUCKET_ROWS) -> VersionedStore:
    """Land ``tours`` (with an event time ``ts``) as ``n_files`` files in event
    time order under the shared folder, stream them through the ingest, and
    return the store."""
    src = stage_path(spark, "stream-src")
    (tours.select("tour_id", "source", "tour", "ts")
          .repartitionByRange(n_files, "ts", "tour_id").sortWithinPartitions("ts", "tour_id")
          .write.parquet(src))
    store = VersionedStore(spark, stage_path(spark, "stream-store"), bucket_rows)
    q = start_store_ingest(spark, src, store, stage_path(spark, "stream-ckpt"), board, late_after=late_after)
    q.awaitTermination()
    return store


def stored_tours(store: VersionedStore) -> DataFrame:
    """The store's rows; an empty store gives none."""
    rows = store.read()
    names = [f.split()[0] for f in STORED.split(", ")]
    return rows.select(*names) if rows is not None else store.spark.createDataFrame([], STORED)
