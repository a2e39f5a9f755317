"""Y-4: eight-fold symmetric augmentation.

Each row becomes one row per board symmetry through ``posexplode`` of the
image array: a narrow, lazy ``Generate`` (no shuffle, no join), so the x8
output is streamed straight into the next stage or the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, Board, array_literal, tour_images


def augment(df: DataFrame, tour: str = "tour", board: Board = DEFAULT_BOARD,
            keep: tuple[str, ...] | None = None, distinct: bool = False) -> DataFrame:
    """``(keep…, sym_id, image)``: the images of ``tour`` in symmetry order.

    ``distinct=True`` drops repeated images of one row (sequences with a
    non-trivial stabiliser, e.g. length 1); legal tours of length >= 2 always
    have all images different."""
    keep = tuple(c for c in df.columns if c != tour) if keep is None else keep
    imgs = tour_images(tour, board)
    out = df.select(*keep, F.posexplode(imgs).alias("_slot", "image"))
    syms = F.lit(list(board.symmetries))
    out = out.withColumn("sym_id", F.element_at(syms, F.col("_slot") + 1)).drop("_slot")
    if distinct:
        # the first symmetry giving an image wins (deterministic)
        out = (out.groupBy(*keep, "image").agg(F.min("sym_id").alias("sym_id")))
    return out.select(*keep, "sym_id", "image")


def orbit_size(tour, board: Board = DEFAULT_BOARD) -> Column:
    """A-7: how many different images a sequence has, without building one: the
    number of symmetries over the number of those that fix it (orbit and stabiliser).  A
    symmetry fixes a sequence if it fixes each of its squares, so the sets of fixing
    symmetries of the squares, as bits, are cut along the sequence.  Null for null
    and for squares off the board; the empty sequence has one image."""
    t = F.col(tour) if isinstance(tour, str) else tour
    n = board.n_squares
    fixed = tuple(sum(1 << i for i, k in enumerate(board.symmetries) if board.image_of(k, p) == p) for p in range(n))
    table, every = array_literal(fixed, "int"), (1 << len(board.symmetries)) - 1
    kept = F.aggregate(t, F.lit(every), lambda acc, p: acc.bitwiseAND(F.when(
        p.cast("int").between(0, n - 1), F.try_element_at(table, p.cast("int") + 1))))
    return (F.lit(len(board.symmetries)) / F.bit_count(kept)).cast("int")


def orbit_counts(canonical: DataFrame, canon: str = "canon", board: Board = DEFAULT_BOARD) -> DataFrame:
    """A-7: ``(n_canonical, n_augmented, n_distinct_images)`` of a table with one row for
    each canonical form: one partial aggregate, nothing is augmented or compared."""
    return canonical.agg(
        F.count("*").alias("n_canonical"), (F.count("*") * len(board.symmetries)).alias("n_augmented"),
        F.coalesce(F.sum(orbit_size(canon, board)), F.lit(0)).cast("long").alias("n_distinct_images"))
