"""Sequence tables derived from the driver's tables (FIXTURES.md).

The driver's tables hold no tours, so every row of ``orders`` (and of
``events`` for the stream) picks one of three closed base tours, an offset,
a direction and one of the eight board images.  Everything is a narrow
projection: one input row -> one output row, no shuffle, no driver work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, TOUR_TYPE, nested_array_literal

# Three closed 8x8 knight's tours (row-major squares), the
# seeds of the test corpus (FIXTURES.md section 3).
BASE_TOURS = (
    (0, 17, 32, 49, 59, 53, 63, 46, 61, 55, 38, 23, 6, 12, 2, 8, 25, 40, 57, 51, 34, 24, 9, 3,
     13, 7, 22, 39, 54, 60, 45, 62, 47, 30, 15, 5, 11, 1, 18, 28, 43, 58, 48, 33, 16, 26, 41, 56,
     50, 44, 29, 35, 52, 42, 36, 19, 4, 14, 31, 21, 27, 37, 20, 10),
    (0, 17, 32, 49, 59, 53, 63, 46, 61, 55, 38, 23, 6, 12, 2, 8, 25, 40, 57, 42, 48, 58, 52, 62,
     47, 30, 15, 5, 22, 7, 13, 3, 9, 24, 41, 56, 50, 60, 54, 39, 45, 51, 36, 19, 34, 44, 29, 35,
     18, 1, 11, 28, 43, 26, 16, 33, 27, 21, 31, 37, 20, 14, 4, 10),
    (0, 17, 2, 8, 25, 40, 57, 51, 61, 55, 38, 23, 6, 12, 22, 7, 13, 3, 9, 24, 41, 56, 50, 60,
     54, 39, 45, 62, 47, 30, 15, 5, 11, 1, 18, 28, 34, 44, 59, 49, 32, 26, 16, 33, 48, 58, 43, 53,
     63, 46, 29, 19, 36, 42, 52, 35, 20, 14, 31, 37, 27, 21, 4, 10),
)
# Recipe constants of the fixtures.
CORRUPT_EVERY = 50      # tour_key % 50 = 0 -> square 10 (0-based) bumped by one
CORRUPT_AT = 10
REVISIT_EVERY = 37      # completions: from square 20 on, bounce between squares 18 and 19
REVISIT_FROM = 20
TRUNCATE_EVERY = 23     # completions: cut to 40 squares
TRUNCATE_TO = 40
PARTIAL_BASE = 8        # partial tours keep 8 + key % 50 squares
PARTIAL_SPREAD = 50
PROMPT_SPREAD = 62      # completions are given 1 + key % 62 squares


def _rounds() -> Column:
    """Every base tour, forwards and backwards, under every image, written twice: a window
    of 64 squares is a rotation.  Slot ``(base * 2 + backwards) * 8 + image``."""
    b = DEFAULT_BOARD
    return nested_array_literal(tuple(tuple(b.image_of(k, p) for p in way * 2) for t in BASE_TOURS for way in (t, t[::-1])
                                      for k in b.symmetries), "tinyint")


def fixture_tour(key, cust, corrupt: bool = True) -> Column:
    """The fixture tour chosen by (key, cust), cut from a table of 48 rounds:
    base tour rotated by ``cust % 64``, reversed for odd ``key // 3``, mapped
    by image ``(key // 6) % 8``, square 10 bumped for ``key % 50 = 0``."""
    key = F.col(key) if isinstance(key, str) else key
    cust = F.col(cust) if isinstance(cust, str) else cust
    n = DEFAULT_BOARD.n_squares
    off = (cust % n).cast("int")
    back = (F.floor(key / 3) % 2).cast("int")
    sym = (F.floor(key / 6) % 8).cast("int")
    slot = ((key % 3).cast("int") * 2 + back) * 8 + sym + 1
    img = F.slice(F.element_at(_rounds(), slot), F.when(back == 1, F.lit(n + 1) - off).otherwise(off + 1), F.lit(n))
    if corrupt:
        img = F.when(key % CORRUPT_EVERY == 0,
                     F.transform(img, lambda x, i: F.when(i == CORRUPT_AT, (x + 1) % n).otherwise(x)))\
               .otherwise(img)
    return img.cast(TOUR_TYPE)


def _with_meta(df: DataFrame) -> DataFrame:
    b = DEFAULT_BOARD
    return df.select(
        "tour_id", "source",
        F.lit(b.width).alias("board_w"), F.lit(b.height).alias("board_h"),
        F.try_element_at("tour", F.lit(1)).alias("start"), "tour")


def tours_from_orders(orders: DataFrame) -> DataFrame:
    """Fixture A: ``tours(tour_id, source, board_w, board_h, start, tour)``."""
    df = orders.select(
        F.col("o_orderkey").alias("tour_id"),
        F.col("o_orderpriority").alias("source"),
        fixture_tour("o_orderkey", "o_custkey").alias("tour"))
    return _with_meta(df)


def tours_from_events(events: DataFrame) -> DataFrame:
    """Fixture E: one tour per event (key = event_id, offset from user_id),
    with the event time kept for streaming."""
    df = events.select(
        F.col("event_id").alias("tour_id"),
        F.col("event_type").alias("source"),
        F.col("ts"),
        fixture_tour("event_id", "user_id").alias("tour"))
    b = DEFAULT_BOARD
    return df.select("tour_id", "source", F.lit(b.width).alias("board_w"),
                     F.lit(b.height).alias("board_h"),
                     F.try_element_at("tour", F.lit(1)).alias("start"), "tour", "ts")


def partial_tours(orders: DataFrame) -> DataFrame:
    """Fixture B: the first ``8 + key % 50`` squares of each fixture tour."""
    ok = F.col("o_orderkey")
    n_keep = (F.lit(PARTIAL_BASE) + ok % PARTIAL_SPREAD).cast("int")
    df = orders.select(
        ok.alias("tour_id"), F.col("o_orderpriority").alias("source"),
        F.slice(fixture_tour(ok, F.col("o_custkey")), 1, n_keep).alias("tour"))
    return _with_meta(df)


def completions_from_orders(orders: DataFrame) -> DataFrame:
    """Fixture C: ``completions(model, case_id, given_len, given, tour)``.

    ``given`` is the clean prompt (first ``given_len`` squares of the
    uncorrupted tour); ``tour`` is what a model returned: the tour with the
    fixture corruption, a legal-but-revisiting bounce for key % 37 = 0, and
    a cut to 40 squares for key % 23 = 0."""
    ok = F.col("o_orderkey")
    n = DEFAULT_BOARD.n_squares
    given_len = (F.lit(1) + ok % PROMPT_SPREAD).cast("int")
    # first projection: the generated arrays become plain columns, so the
    # lambda below reads a column instead of re-running the generator
    base = orders.select(
        F.col("o_orderstatus").alias("model"), ok.alias("case_id"),
        given_len.alias("given_len"),
        fixture_tour(ok, F.col("o_custkey"), corrupt=False).alias("clean"),
        fixture_tour(ok, F.col("o_custkey"), corrupt=True).alias("out"),
        (ok % REVISIT_EVERY == 0).alias("bounce"),
        F.when(ok % TRUNCATE_EVERY == 0, F.lit(TRUNCATE_TO)).otherwise(F.lit(n)).alias("cut"))
    out = F.col("out")
    bounced = F.when(F.col("bounce"), F.transform(
        out, lambda x, i: F.when(i >= REVISIT_FROM,
                                 F.element_at(out, REVISIT_FROM - 1 + i % 2)).otherwise(x))
    ).otherwise(out)
    return base.select(
        "model", "case_id", "given_len",
        F.slice("clean", 1, F.col("given_len")).alias("given"),
        F.slice(bounced, 1, F.col("cut")).cast(TOUR_TYPE).alias("tour"))


def raw_steps_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Fixture D, long form: ``steps(tour_id, move_no, pos)``."""
    return lineitem.select(
        F.col("l_orderkey").alias("tour_id"),
        F.col("l_linenumber").cast("int").alias("move_no"),
        (F.col("l_partkey") % DEFAULT_BOARD.n_squares).cast("int").alias("pos"))
