"""Corpus audit, canonical dedup, per-start profiles and validity reports.

All aggregations are hash aggregations with a partial (map-side) step, so a
key that holds a large share of the rows is collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.board import (
    DEFAULT_BOARD, Board, all_in_board, is_closed, is_complete, is_legal, is_unique,
    with_canonical,
)


def with_checks(df: DataFrame, tour: str = "tour", board: Board = DEFAULT_BOARD) -> DataFrame:
    """Add ``legal``, ``uniq``, ``closed``, ``complete``, ``in_range`` and ``valid``."""
    t = F.col(tour)
    return (df.withColumn("legal", is_legal(t, board))
              .withColumn("uniq", is_unique(t))
              .withColumn("closed", is_closed(t, board))
              .withColumn("complete", is_complete(t, board))
              .withColumn("in_range", all_in_board(t, board))
              .withColumn("valid", F.col("legal") & F.col("uniq")))


def dup_audit(tours: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    """A-1/A-2: rows, distinct sequences, distinct canonical forms, and the
    same two counts among valid tours; one row."""
    # copies collapse first, so checks and canonical forms are computed and
    # shuffled once per distinct sequence (no Expand for the distinct counts)
    seqs = tours.groupBy("tour").agg(F.count("*").alias("n"))
    df = with_checks(with_canonical(seqs, board=board), board=board)
    orbits = df.groupBy("canon").agg(
        F.sum("n").alias("n"), F.count("tour").alias("n_distinct"),
        F.sum(F.when(F.col("valid"), F.col("n"))).alias("n_valid"))
    return orbits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("n_distinct"),
        F.count("canon").alias("n_canonical"),
        F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid"),
        F.count_if(F.col("canon").isNotNull() & F.col("n_valid").isNotNull()).alias("n_valid_canonical"))


def canonical_unique(tours: DataFrame, board: Board = DEFAULT_BOARD, valid_only: bool = True,
                     extra: tuple[str, ...] = ("source",)) -> DataFrame:
    """A-3/A-6: one row per canonical form: ``canon``, ``start`` (its first
    square), the smallest ``tour_id`` holding it, the ``extra`` columns of
    that row, and ``n_copies``.  Deterministic whatever the input order."""
    cols = ["tour_id", "tour", *extra]
    df = with_canonical(tours.select(*cols), board=board)
    if valid_only:
        df = df.where(is_legal("tour", board) & is_unique("tour"))
    if not extra:
        # fixed-width buffers only: Spark plans a hash aggregate
        out = df.groupBy("canon").agg(F.min("tour_id").alias("tour_id"), F.count("*").alias("n_copies"))
        return out.select("canon", F.try_element_at("canon", F.lit(1)).cast("int").alias("start"),
                          "tour_id", "n_copies")
    # a struct buffer (to carry the extra columns of the kept row) makes it
    # a sort-based aggregate, still with a partial map-side step
    first = F.min(F.struct("tour_id", *extra))
    out = df.groupBy("canon").agg(first.alias("_first"), F.count("*").alias("n_copies"))
    return out.select(
        "canon", F.try_element_at("canon", F.lit(1)).cast("int").alias("start"),
        F.col("_first.tour_id").alias("tour_id"),
        *[F.col(f"_first.{c}").alias(c) for c in extra], "n_copies")


def per_start_counts(canon: DataFrame, start: str = "start") -> DataFrame:
    """A-5/O-2: rows per start square, most frequent first (ties by square)."""
    return (canon.groupBy(F.col(start).cast("int").alias("start"))
                 .agg(F.count("*").alias("n_tours"))
                 .orderBy(F.desc("n_tours"), "start"))


def rescaled_counts(counts: DataFrame, value: str = "n_tours", out: str = "scaled") -> DataFrame:
    """F-14: min-max rescale of a count column (null when all are equal).
    The global min/max come from a one-row aggregate, broadcast and joined
    back, so no window pulls the rows into one partition."""
    stats = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.lit(1).alias("_j"))
    return (counts.withColumn("_j", F.lit(1)).join(F.broadcast(stats), "_j").drop("_j")
                  .withColumn(out, (F.col(value) - F.col("_lo"))
                              / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)))
                  .drop("_lo", "_hi"))


# The squares a canonical 8x8 start may have (lexicographic
# orbit minima): rows/cols 0-3 on or above the diagonal.
CANONICAL_STARTS_8X8 = (0, 1, 2, 3, 9, 10, 11, 18, 19, 27)


def canonical_starts(board: Board = DEFAULT_BOARD) -> list[int]:
    """Squares that are the smallest in their orbit (Y-6), from the rule."""
    return sorted({min(board.image_of(k, p) for k in board.symmetries)
                   for p in range(board.n_squares)})


def start_set_check(canon: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    """Y-6/A-4: each distinct canonical start and whether it is an orbit minimum."""
    allowed = F.lit(canonical_starts(board))
    return (canon.select(F.col("start").cast("int").alias("start")).distinct()
                 .withColumn("is_orbit_min", F.array_contains(allowed, F.col("start"))))


def validity_report(tours: DataFrame, by: str = "source", board: Board = DEFAULT_BOARD) -> DataFrame:
    """V-5: one row per group with the counts of each failed check."""
    df = with_checks(tours.select(by, "tour"), board=board)
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.count_if("legal").alias("n_legal"),
        F.count_if(~F.col("legal")).alias("n_illegal"),
        F.count_if(~F.col("uniq")).alias("n_repeated"),
        F.count_if(~F.col("complete")).alias("n_short"),
        F.count_if(~F.col("in_range")).alias("n_out_of_range"),
        F.count_if(F.col("closed") & F.col("valid")).alias("n_closed_valid"),
        F.count_if("valid").alias("n_valid"),
        F.bool_and(F.coalesce("valid", F.lit(False))).alias("all_valid"))


def visit_histogram(canon: DataFrame, first_m: int, tour: str = "canon") -> DataFrame:
    """A-9: how often each square occurs in the first ``m`` moves."""
    return (canon.select(F.explode(F.slice(tour, 1, first_m)).alias("pos"))
                 .groupBy(F.col("pos").cast("int").alias("pos")).agg(F.count("*").alias("n_visits")))


def prefix_blacklist(df: DataFrame, squares: list[int], first_m: int = 4,
                     tour: str = "canon") -> DataFrame:
    """F-4: drop sequences whose first ``m`` squares touch ``squares``."""
    bad = F.array(*[F.lit(s).cast("tinyint") for s in squares])
    return df.where(~F.arrays_overlap(F.slice(tour, 1, first_m), bad))


def source_contributions(tours: DataFrame, by: str = "source", board: Board = DEFAULT_BOARD) -> DataFrame:
    """U-4: for each canonical form of a valid tour, every source that holds it,
    with its rows and its smallest ``tour_id`` (one row per form and source)."""
    df = with_canonical(tours.select("tour_id", "tour", by), board=board)
    df = df.where(is_legal("tour", board) & is_unique("tour"))
    return df.groupBy("canon", by).agg(F.count("*").alias("n_copies"), F.min("tour_id").alias("first_tour_id"))


def top_by(df: DataFrame, order_cols: list, n: int) -> DataFrame:
    """F-12/M-9: the first ``n`` rows by a total order (a top-k, not a scan cap)."""
    return df.orderBy(*order_cols).limit(n)
