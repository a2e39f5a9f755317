"""Leakage-safe holdouts and the train/validation pool (H-1..H-7, A-16).

Input: one row per canonical tour (``tour_id``, ``canon``, ``start``).
Three test points of graded difficulty:

* point 1: every canonical tour whose start is ``p1`` (a whole orbit family);
* point 2: ``frac`` of the canonical tours starting at ``p2``, split on the
  canonical key, so all images of a tour fall on one side;
* point 3: ``frac`` of the *images* of the tours starting at ``p3``, split on
  the image key, so every orbit is partly seen in training.

Splits use ``exact_fraction`` (hash-threshold, no global sort); unions are
``unionByName`` of lazily augmented frames.  The only wide steps are the
split bookkeeping aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, Board, tour_key
from .augment import augment
from .split import exact_fraction


@dataclass(frozen=True)
class HoldoutSpec:
    # The reference's held-out starts and fractions.
    point1_start: int = 9
    point2_start: int = 11
    point3_start: int = 2
    point23_fraction: float = 0.5
    train_fraction: float = 0.93
    seed: int = 42


def with_keys(canon: DataFrame, board: Board = DEFAULT_BOARD) -> DataFrame:
    return canon.withColumn("canon_key", tour_key("canon", board))


def holdouts(canon: DataFrame, spec: HoldoutSpec = HoldoutSpec(),
             board: Board = DEFAULT_BOARD, stage=None) -> dict[str, DataFrame]:
    """All parts of the plan.

    Returns ``point1``, ``point2_test``, ``point2_train`` (canonical rows),
    ``point3_test``, ``point3_train`` (image rows), ``pool`` (image rows with a
    ``part`` column) and ``split`` (pool rows with ``split`` = train/val).

    ``stage(df, name) -> df`` (e.g. ``session.materialize``) writes the split
    decisions once, so the parts built on them do not recompute the hash
    bookkeeping; without it everything stays lazy."""
    stage = stage or (lambda df, name: df)
    c = with_keys(canon, board).select("tour_id", "canon", "canon_key", "start")
    p1 = c.where(F.col("start") == spec.point1_start)
    p2 = stage(exact_fraction(c.where(F.col("start") == spec.point2_start), "canon_key",
                              spec.point23_fraction, spec.seed, tie=("tour_id",), out="test"), "point2")
    rest = c.where(~F.col("start").isin(spec.point1_start, spec.point2_start, spec.point3_start))
    img3 = _images(c.where(F.col("start") == spec.point3_start), board)
    p3 = stage(exact_fraction(img3, "image_key", spec.point23_fraction, spec.seed,
                              tie=("tour_id", "sym_id"), out="test"), "point3")
    pool = (_images(rest, board).withColumn("part", F.lit("rest"))
            .unionByName(_images(p2.where(~F.col("test")).drop("test"), board)
                         .withColumn("part", F.lit("point2_train")))
            .unionByName(p3.where(~F.col("test")).drop("test").withColumn("part", F.lit("point3_train"))))
    split = stage(exact_fraction(pool, "image_key", spec.train_fraction, spec.seed,
                                 tie=("tour_id", "sym_id"), out="is_train"), "split")
    split = split.withColumn("split", F.when(F.col("is_train"), "train").otherwise("val")).drop("is_train")
    return {
        "point1": p1,
        "point2_test": p2.where("test").drop("test"),
        "point2_train": p2.where(~F.col("test")).drop("test"),
        "point3_test": p3.where("test").drop("test"),
        "point3_train": p3.where(~F.col("test")).drop("test"),
        "pool": pool,
        "split": split,
    }


def _images(c: DataFrame, board: Board) -> DataFrame:
    a = augment(c.select("tour_id", "canon_key", "canon"), "canon", board,
                keep=("tour_id", "canon_key"))
    return a.withColumn("image_key", tour_key("image", board)).drop("image")


def split_plan(canon: DataFrame, spec: HoldoutSpec = HoldoutSpec(),
               board: Board = DEFAULT_BOARD) -> DataFrame:
    """A-16: the planner's sizes from one conditional aggregation over the
    canonical set (exact decimal arithmetic, truncation as ``int()``)."""
    k = len(board.symmetries)
    s = F.col("start")
    half = F.lit(Decimal(str(spec.point23_fraction)))
    agg = canon.agg(
        F.count("*").alias("n"),
        F.count_if(s != spec.point1_start).alias("n_not_p1"),
        F.count_if(s.isin(spec.point2_start, spec.point3_start)).alias("n_p23"),
        F.count_if(s == spec.point1_start).alias("n_p1"),
        F.count_if(s == spec.point2_start).alias("n_p2"),
        F.count_if(s == spec.point3_start).alias("n_p3"))
    pool = F.floor(F.lit(k) * (F.col("n_not_p1") - half * F.col("n_p23"))).cast("long")
    tr = F.lit(Decimal(str(spec.train_fraction)))
    va = F.lit(Decimal(str(round(1 - spec.train_fraction, 10))))
    out = agg.select(
        pool.alias("pool_rows"),
        F.floor(tr * pool).cast("long").alias("train_rows"),
        F.floor(va * pool).cast("long").alias("val_rows"),
        (F.lit(k) * F.col("n")).cast("long").alias("augmented_rows"),
        (F.lit(k) * F.col("n_p1")).cast("long").alias("point1_rows"),
        F.floor(F.lit(k) * half * F.col("n_p2")).cast("long").alias("point2_rows"),
        F.floor(F.lit(k) * half * F.col("n_p3")).cast("long").alias("point3_rows"))
    out = out.withColumn("test_rows", F.col("augmented_rows") - F.col("train_rows") - F.col("val_rows"))
    return out.withColumn(
        "sizes_consistent",
        # same tolerance rule as numpy.isclose (rtol 1e-5, atol 1e-8)
        F.abs(F.col("test_rows") - (F.col("point1_rows") + F.col("point2_rows") + F.col("point3_rows")))
        <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("point1_rows") + F.col("point2_rows") + F.col("point3_rows")))


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """J-2/U-3: rows of ``left`` whose key is also in ``right`` (semi join)."""
    return left.select(*on).join(right.select(*on).distinct(), on, "left_semi")


def orbit_leakage(parts: dict[str, DataFrame], pairs: dict[str, tuple[str, list[str]]],
                  on: str = "canon_key") -> DataFrame:
    """H-7: for each named pair (a part, the parts it must not meet), the number of
    orbits on both sides.  One aggregate over all parts marks the parts that hold an
    orbit as bits, so each part is read once and no pair is joined."""
    bit = {name: 1 << i for i, name in enumerate(parts)}
    rows = None
    for name, df in parts.items():
        one = df.select(on, F.lit(bit[name]).alias("bits"))
        rows = one if rows is None else rows.unionByName(one)
    held = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.bit_or("bits").alias("bits"))

    def both(left: str, right: list[str]):
        other = sum(bit[r] for r in right)
        return F.count_if((F.col("bits").bitwiseAND(F.lit(bit[left])) != 0)
                          & (F.col("bits").bitwiseAND(F.lit(other)) != 0))
    one = held.agg(*[both(*sides).alias(pair) for pair, sides in pairs.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(pair).alias("pair"), F.col(pair).alias("n_shared_orbits")) for pair in pairs
    ])).alias("x")).select("x.pair", "x.n_shared_orbits")


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """J-1/U-2: set-like difference by key (anti join)."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def frames_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """A-11: order-insensitive bag equality: one row with both differences."""
    l_only = a.exceptAll(b).agg(F.count("*").alias("n_left_only"), F.lit(1).alias("_j"))
    r_only = b.exceptAll(a).agg(F.count("*").alias("n_right_only"), F.lit(1).alias("_j"))
    return (l_only.join(r_only, "_j").drop("_j")
            .withColumn("equal", (F.col("n_left_only") == 0) & (F.col("n_right_only") == 0)))
