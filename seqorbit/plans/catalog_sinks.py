"""Registered queries: sinks, adapters, packing, manifest and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..session import stage_path
from ..sources import parquet as PQ
from ..streaming.ingest import run_unique_ingest
from ..streaming.store_ingest import late_rows, run_store_ingest, stored_tours
from . import sqltext as Q
from .catalog import BOARD, N, PRE, canon, register
from .catalog_splits import HOLD, _nested_sql, event_tours, parts, NESTED, SEED
from ..operators import split as S


@register("wide_roundtrip", "S-1 S-7 S-8 F-8 F-9 O-1",
          PRE + " SELECT tour_id, canon AS canon_key, start FROM vcanon")
def q_wide_roundtrip(spark, sf):
    c = canon(spark, sf)
    wide = PQ.to_wide(c.select("tour_id", F.col("canon").alias("tour"), F.col("start").cast("tinyint").alias("start")),
                      "tour", N, keep=("tour_id", "start"))
    path = stage_path(spark, "wide")
    PQ.write_clustered(wide.withColumn("tour", F.array(*[F.col(f"move_{i}") for i in range(N)])),
                       path, tour="tour", start="start")
    back = PQ.from_wide(spark.read.parquet(path), N, keep=("tour_id",))
    return back.select("tour_id", B.tour_key("tour", BOARD).alias("canon_key"),
                       F.col("start").cast("int").alias("start"))


def _packed_sql():
    base = _nested_sql()
    head, _ = base.rsplit("SELECT image_key, split, CASE", 1)
    arms = " ".join(f"WHEN r <= floor(n * {f}) THEN CAST({f} AS DOUBLE)" for f in NESTED)
    return (head + f"SELECT image_key AS input_ids, image_key AS labels, split FROM "
            f"(SELECT image_key, split, CASE {arms} END AS mf FROM rk) WHERE mf <= 0.1")


@register("packed_samples", "F-10 H-6 M-5 S-13", _packed_sql())
def q_packed_samples(spark, sf):
    sp = parts(spark, sf)["split"]
    lv = S.nested_levels(sp, "image_key", NESTED, SEED, by=("split",), tie=("tour_id", "sym_id"),
                         max_groups=2)
    sub = lv.where(F.col("min_fraction") <= 0.1)
    packed = sub.select("split", F.col("image_key").alias("k"))
    return packed.select(F.col("k").alias("input_ids"), F.col("k").alias("labels"), "split")


@register("manifest", "S-11 A-19 A-1",
          HOLD + "SELECT split AS dataset, count(*) AS rows, '8x8' AS board, 42 AS seed, "
          "CAST((count(*) // 256) * 1 // 1 AS BIGINT) AS train_steps FROM sp GROUP BY split")
def q_manifest(spark, sf):
    m = PQ.manifest(parts(spark, sf)["split"], "split", BOARD, SEED)
    return m.select("dataset", "rows", "board", "seed", "train_steps")


@register("stream_unique_ingest", "T-1 J-3 S-9 S-10 A-3",
          "WITH " + Q.fixture_tours_cte("events", "event_id", "user_id", "event_type", "et") +
          f" SELECT DISTINCT {Q.canon_key('tour')} AS canon_key FROM et "
          f"WHERE {Q.legal('tour')} AND {Q.unique('tour')}")
def q_stream_unique_ingest(spark, sf):
    store = run_unique_ingest(spark, event_tours(spark, sf), n_files=4, board=BOARD)
    return store.select("canon_key")


# How far behind the newest event a row is late, and rows of a bucket here.
LATE_AFTER = "1 DAY"
SMALL_BUCKET = 64


@register("stream_store_tours", "T-1 S-9 J-3 V-1",
          "WITH " + Q.fixture_tours_cte("events", "event_id", "user_id", "event_type", "et") +
          f", k AS (SELECT tour_id, {Q.canon_key('tour')} AS canon_key FROM et WHERE {Q.legal('tour')} AND {Q.unique('tour')}) "
          "SELECT canon_key, CAST(1 AS BIGINT) AS n_kept, true AS kept_is_of_key, true AS kept_arrived FROM k GROUP BY canon_key")
def q_stream_store_tours(spark, sf):
    """Stored and late rows of a stream: each canonical key once, with a tour that arrived
    and whose canonical form it is; nothing is lost to lateness."""
    arrived = event_tours(spark, sf)
    store = run_store_ingest(spark, arrived, n_files=6, board=BOARD, late_after=LATE_AFTER, bucket_rows=SMALL_BUCKET)
    late = late_rows(store).select("key", "tour_id", "source", "tour", "ts", "canon_key")
    # what came late is added in the end, as a commit of its own
    store.add_new(late, "late", "late")
    kept = B.with_canonical(stored_tours(store), board=BOARD)
    came = arrived.select("tour_id", F.col("tour").alias("sent"))
    return kept.join(came, "tour_id").groupBy("canon_key").agg(
        F.count("*").alias("n_kept"),
        F.bool_and(B.tour_key("canon", BOARD) == F.col("canon_key")).alias("kept_is_of_key"),
        F.bool_and(F.col("sent") == F.col("tour")).alias("kept_arrived"))
