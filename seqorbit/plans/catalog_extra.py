"""Registered queries: approximate split, provenance from file paths, strict
casts, hashed start choice, rectangular boards, global quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import board_graph as G
from ..operators import split as S
from ..session import materialize, stage_path
from ..sources import parquet as PQ
from ..sources.tables import read_table
from . import sqltext as Q
from .catalog import BOARD, PRE, _MOVES_SQL, canon, register, tours

SEED = 42
# The approximate train share of the md5 split (M-4) and the
# global quota of the hash-ordered pick (O-7).
APPROX_FRACTION = 0.93
GLOBAL_QUOTA = 100


@register("approx_split", "M-4",
          PRE + f" SELECT canon AS canon_key, substr(md5(canon || ':{SEED}'), 1, 8) < "
          f"'{S.approx_threshold(APPROX_FRACTION)}' AS picked FROM vcanon")
def q_approx_split(spark, sf):
    c = canon(spark, sf).select(B.tour_key("canon", BOARD).alias("canon_key"))
    return S.approx_fraction(c, "canon_key", APPROX_FRACTION, SEED)


@register("numbered_sources", "S-2 S-12 S-5 S-7",
          PRE + " SELECT start, count(*) AS n_rows FROM vcanon GROUP BY start")
def q_numbered_sources(spark, sf):
    """Write the canonical set as one folder per start square, read it back
    and recover the provenance from each file's path (``_metadata``)."""
    c = canon(spark, sf).select("tour_id", F.col("canon").alias("tour"), "start")
    path = stage_path(spark, "by-start")
    c.write.partitionBy("start").option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"start=(\d+)", 1).cast("int").alias("start"))
    return back.groupBy("start").agg(F.count("*").alias("n_rows"))


# Modulus that makes part of the values overflow TINYINT (F-1).
CAST_MODULUS = 200


@register("strict_downcast", "F-1 F-5",
          f"SELECT count_if(l_partkey % {CAST_MODULUS} <= 127) AS n_ok, "
          f"count_if(l_partkey % {CAST_MODULUS} > 127) AS n_quarantined FROM lineitem")
def q_strict_downcast(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_partkey").select(
        (F.col("l_partkey") % CAST_MODULUS).alias("v"))
    fits = PQ.fits_tinyint(["v"])
    return li.agg(F.count_if(fits).alias("n_ok"), F.count_if(~fits).alias("n_quarantined"))


@register("hashed_starts", "M-8 G-1",
          f"SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'), 1, 4))::INTEGER "
          f"% {BOARD.n_squares} AS INTEGER) AS start, count(*) AS n_orders FROM orders GROUP BY 1")
def q_hashed_starts(spark, sf):
    """A reproducible, uniform start square per order (all squares possible)."""
    o = read_table(spark, sf, "orders", "o_orderkey")
    h = F.conv(F.substring(S.hash_hex("o_orderkey", SEED), 1, 4), 16, 10).cast("int")
    return o.groupBy((h % BOARD.n_squares).cast("int").alias("start")).agg(F.count("*").alias("n_orders"))


RECT = B.Board(8, 5)

_RECT_EDGES_SQL = (
    "edges AS (SELECT CAST(s.i AS INTEGER) AS src, CAST((s.i // {w} + o.dr) * {w} + s.i % {w} + o.dc "
    "AS INTEGER) AS dst FROM range({n}) s(i) CROSS JOIN (SELECT unnest({drs}) AS dr, "
    "unnest({dcs}) AS dc) o WHERE s.i // {w} + o.dr BETWEEN 0 AND {h1} "
    "AND s.i % {w} + o.dc BETWEEN 0 AND {w1})").format(
    w=RECT.width, n=RECT.n_squares, h1=RECT.height - 1, w1=RECT.width - 1,
    drs=str([a for a, _ in RECT.offsets]), dcs=str([b for _, b in RECT.offsets]))


@register("rect_board_usage", "G-7 S-3 Y-1 J-4",
          PRE + ", " + _RECT_EDGES_SQL + ", " + _MOVES_SQL +
          f", u AS (SELECT pos, nxt, count(*) AS n FROM mv WHERE pos < {RECT.n_squares} AND nxt < {RECT.n_squares} "
          "GROUP BY pos, nxt) SELECT e.src, e.dst, coalesce(u.n, 0) AS n_uses FROM edges e "
          "LEFT JOIN u ON u.pos = e.src AND u.nxt = e.dst")
def q_rect_board_usage(spark, sf):
    """Moves of the 8x8 corpus that stay inside the top 8x5 sub-board,
    counted on the edges of that rectangular board."""
    edges = G.board_edges(spark, RECT)
    mv = G.moves(tours(spark, sf), "tour", BOARD, keep=())
    inside = mv.where((F.col("pos") < RECT.n_squares) & (F.col("nxt") < RECT.n_squares))
    used = inside.groupBy("pos", "nxt").agg(F.count("*").alias("n_uses"))
    e = edges.select(F.col("src").alias("pos"), F.col("dst").alias("nxt"))
    return (e.join(F.broadcast(used), ["pos", "nxt"], "left")  # at most n_squares ** 2 rows
            .select(F.col("pos").alias("src"), F.col("nxt").alias("dst"),
                    F.coalesce("n_uses", F.lit(0)).alias("n_uses")))


@register("global_quota", "O-7 O-5 M-2",
          PRE + f", r AS (SELECT tour_id, tkey, row_number() OVER (ORDER BY md5(tkey || ':{SEED}'), tour_id) AS rn "
          f"FROM tv WHERE valid) SELECT tour_id, tkey AS tour_key FROM r WHERE rn <= {GLOBAL_QUOTA}")
def q_global_quota(spark, sf):
    # checks and keys once: the cut evaluates its input twice
    t = materialize(tours(spark, sf).where(B.is_valid_tour("tour", BOARD)).select(
        "tour_id", B.tour_key("tour", BOARD).alias("tour_key")), "valid-keys")
    return (S.exact_quota(t, "tour_key", GLOBAL_QUOTA, SEED, tie=("tour_id",))
            .where("picked").select("tour_id", "tour_key"))
