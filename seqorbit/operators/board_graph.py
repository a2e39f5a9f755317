"""The board as a graph (S-3/S-4/J-4/J-5) and tours in long form (F-13/V-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, Board, col_of, is_step, row_of


def board_edges(spark: SparkSession, board: Board = DEFAULT_BOARD) -> DataFrame:
    """``edges(src, dst)``: every legal move.  Squares come from ``range``; each
    square's candidate targets are generated by the offsets and filtered by
    the bounds (the square x offset theta join, written as a generator)."""
    sq = spark.range(board.n_squares).select(F.col("id").cast("int").alias("src"))
    r, c = row_of("src", board), col_of("src", board)
    cands = F.array(*[
        F.when((r + dr).between(0, board.height - 1) & (c + dc).between(0, board.width - 1),
               (r + dr) * board.width + (c + dc))
        for dr, dc in board.offsets])
    return (sq.select("src", F.explode(cands).alias("dst"))
              .where(F.col("dst").isNotNull())
              .select("src", F.col("dst").cast("int").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """S-4: ``(src, nbrs ARRAY<INT>)`` sorted neighbour lists."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("pos")).agg(F.count("*").alias("degree"))


def moves(df: DataFrame, tour: str = "tour", board: Board = DEFAULT_BOARD,
          keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """F-13: one row per consecutive pair: ``move_no`` (1-based index of the
    square moved to), ``pos``, ``nxt``, ``dr``, ``dc`` and ``legal``.  Built
    by exploding an index sequence: no window, no shuffle."""
    t = F.col(tour)
    idx = F.when(F.size(t) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), F.size(t)))
    out = df.select(*keep, t.alias("_t"), F.explode(idx).alias("move_no"))
    pos = F.element_at("_t", F.col("move_no") - 1).cast("int")
    nxt = F.element_at("_t", F.col("move_no")).cast("int")
    return out.select(
        *keep, F.col("move_no").cast("int").alias("move_no"), pos.alias("pos"), nxt.alias("nxt"),
        (row_of(nxt, board) - row_of(pos, board)).alias("dr"),
        (col_of(nxt, board) - col_of(pos, board)).alias("dc"),
        is_step(pos, nxt, board).alias("legal"))


def steps_to_tours(steps: DataFrame, key: str = "tour_id", order: str = "move_no",
                   value: str = "pos") -> DataFrame:
    """V-8: long form back to one array per key, ordered by ``order`` (ties
    by value).  Groups are single sequences (bounded by the board size)."""
    agg = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return (steps.groupBy(key).agg(agg.alias("_s"))
                 .select(key, F.transform("_s", lambda x: x["v"].cast("tinyint")).alias("tour")))


def edge_usage(df: DataFrame, edges: DataFrame, tour: str = "tour",
               board: Board = DEFAULT_BOARD) -> DataFrame:
    """J-4: how often each edge is used by the corpus.  Moves are counted
    per (pos, nxt) first (partial aggregation, at most n_squares**2 groups),
    then joined to the edge list, whose size is fixed by the board."""
    used = (moves(df, tour, board, keep=()).groupBy("pos", "nxt")
            .agg(F.count("*").alias("n_uses")))
    e = edges.select(F.col("src").alias("pos"), F.col("dst").alias("nxt"))
    return (e.join(F.broadcast(used), ["pos", "nxt"], "left")
            .select(F.col("pos").alias("src"), F.col("nxt").alias("dst"),
                    F.coalesce("n_uses", F.lit(0)).alias("n_uses")))


def illegal_moves(df: DataFrame, edges: DataFrame, tour: str = "tour",
                  board: Board = DEFAULT_BOARD, keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """J-4 as an anti join: moves that are not an edge of the board."""
    e = edges.select(F.col("src").alias("pos"), F.col("dst").alias("nxt"))
    m = moves(df, tour, board, keep=keep).drop("legal")
    return m.join(F.broadcast(e), ["pos", "nxt"], "left_anti")
