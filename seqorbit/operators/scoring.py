"""Scoring model completions against the rules of movement (E-1..E-5, J-8,
A-13..A-15, A-18) and building prompt sets (E-4, F-6).

A completion row is ``(model, case_id, given_len, given, tour)``.  All checks
are column expressions on the row; reports are hash aggregations (``rollup``
for totals in the same pass).  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.board import (
    DEFAULT_BOARD, TOUR_TYPE, Board, first_illegal_step, is_legal, is_unique, n_illegal_steps,
    onward_moves,
)


def score(completions: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    """Per completion: ``legal`` (the reference's only criterion, kept as
    ``legal_only``), ``uniq``, ``complete``, ``prefix_kept`` (J-8: the given
    squares are reproduced) and ``solved`` = all four; plus ``n_moves``,
    ``n_illegal``, ``first_bad`` and the start square."""
    t = F.col("tour")
    return completions.select(
        "*",
        F.try_element_at("given", F.lit(1)).cast("int").alias("start"),
        is_legal(t, board).alias("legal"),
        is_unique(t).alias("uniq"),
        (F.size(t) == board.n_squares).alias("complete"),
        (F.slice(t, 1, F.col("given_len")) == F.col("given")).alias("prefix_kept"),
        (F.greatest(F.size(t) - 1, F.lit(0))).alias("n_moves"),
        n_illegal_steps(t, board).alias("n_illegal"),
        first_illegal_step(t, board).alias("first_bad"),
    ).withColumn("legal_only", F.col("legal")).withColumn(
        "solved", F.col("legal") & F.col("uniq") & F.col("complete") & F.col("prefix_kept"))


def _counts():
    return [F.count("*").alias("n_cases"), F.count_if("legal").alias("n_legal"),
            F.count_if("solved").alias("n_solved")]


def by_start(scored: DataFrame) -> DataFrame:
    """E-1: success per model and start square."""
    return scored.groupBy("model", "start").agg(*_counts())


def by_given_len(scored: DataFrame) -> DataFrame:
    """E-2: success per model and number of given squares."""
    return scored.groupBy("model", "given_len").agg(*_counts())


def case_set(scored: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    """Tag each case by the row of its last given square (E-3/F-6 subsets)."""
    last = F.try_element_at("given", F.lit(-1)).cast("int")
    row = (last / board.width).cast("int")
    return scored.withColumn("case_set", F.when(row == 4, "row4").when(row == 3, "row3")
                             .otherwise("other"))


def rollup_report(scored: DataFrame) -> DataFrame:
    """A-13: per model and case set, with per-model and grand totals (rollup)."""
    return scored.rollup("model", "case_set").agg(*_counts())


def outcomes(scored: DataFrame) -> DataFrame:
    """A-15: distinct outcomes per model."""
    return scored.groupBy("model", "legal_only", "solved").agg(F.count("*").alias("n_cases"))


def move_error_rate(scored: DataFrame) -> DataFrame:
    """A-18: per-move error rate and completions with at least one bad move."""
    return scored.groupBy("model").agg(
        F.sum("n_moves").cast("long").alias("n_moves"),
        F.sum("n_illegal").cast("long").alias("n_illegal_moves"),
        F.round(F.sum("n_illegal") / F.sum("n_moves"), 8).alias("error_rate"),
        F.count_if(F.col("n_illegal") > 0).alias("n_tours_with_error"))


def dead_ends(scored: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    """E-5: at the first illegal move, how many legal unvisited moves the
    previous square still had; 0 means the error was forced (a dead end)."""
    bad = scored.where(F.col("first_bad").isNotNull())
    before = F.slice("tour", 1, F.col("first_bad") - 1)
    free = F.size(onward_moves(before, board))
    return bad.select("model", "case_id", F.col("first_bad").cast("int").alias("first_bad"),
                      free.alias("free_moves"), (free == 0).alias("dead_end"))


def prompts_by_len(tours: DataFrame, tour: str, max_len: int, case_set_name: str,
                   keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """E-4: one prompt per tour and prefix length 1..max_len (explode of a
    sequence: narrow, no join)."""
    return (tours.select(*keep, tour, F.explode(F.sequence(F.lit(1), F.lit(max_len))).alias("given_len"))
                 .select(*keep, F.lit(case_set_name).alias("case_set"),
                         F.col("given_len").cast("int").alias("given_len"),
                         F.slice(tour, 1, F.col("given_len")).alias("given")))


def prompt_set(partials: DataFrame, board: Board = DEFAULT_BOARD, tour: str = "tour") -> DataFrame:
    """E-4: every valid partial tour as a prompt, and every square of the board as a
    prompt of one square (``tour_id`` is then the square)."""
    given = partials.where(is_legal(tour, board) & is_unique(tour)).select(
        F.col("tour_id").cast("long").alias("tour_id"), F.lit("partial").alias("case_set"),
        F.size(tour).alias("given_len"), F.col(tour).alias("given"))
    squares = partials.sparkSession.range(board.n_squares).select(
        F.col("id").alias("tour_id"), F.lit("every_start").alias("case_set"), F.lit(1).alias("given_len"),
        F.array("id").cast(TOUR_TYPE).alias("given"))
    return given.unionByName(squares)


def continuable(partials: DataFrame, board: Board = DEFAULT_BOARD, by: str = "source") -> DataFrame:
    """F-6: valid partial tours whose last square lies in rows 3-4, 4, or 3,
    counted in one pass (the reference's three subsets)."""
    last = F.try_element_at("tour", F.lit(-1)).cast("int")
    w = board.width
    valid = partials.where(is_legal("tour", board) & is_unique("tour"))
    return valid.groupBy(by).agg(
        F.count("*").alias("n_partials"),
        F.count_if(last.between(3 * w, 5 * w - 1)).alias("n_rows_3_4"),
        F.count_if(last.between(4 * w, 5 * w - 1)).alias("n_row_4"),
        F.count_if(last.between(3 * w, 4 * w - 1)).alias("n_row_3"))
