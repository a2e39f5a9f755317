"""Registered queries: path expansion seeded by the corpus' partial tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import paths as P
from . import sqltext as Q
from ..operators.generate import fill_to_quota
from ..session import stage_path
from ..sources.store import VersionedStore
from ..sources.tables import read_table
from .catalog import BOARD, register, tours
from .catalog_scoring import PARTIAL_SQL, partials

# Expansion depth of the exhaustive continuation count, full tours
# per seed, and squares that late partial tours still miss.
CONTINUATION_LEVELS = 3
PER_SEED = 2
LATE_LEFT, LATE_SPREAD = 4, 9


def valid_partials(spark, sf):
    p = partials(spark, sf)
    return p.where(B.is_valid_tour("tour", BOARD)).select("tour_id", "tour")


def _levels_sql():
    parts = ["l0 AS (SELECT tour_id, tour AS path FROM pt WHERE "
             f"{Q.legal('tour')} AND {Q.unique('tour')})"]
    for d in range(1, CONTINUATION_LEVELS + 1):
        parts.append(f"l{d} AS (SELECT tour_id, list_append(path, CAST(q AS TINYINT)) AS path FROM l{d - 1}, "
                     f"LATERAL (SELECT unnest({Q.onward_list(f'l{d - 1}.path')}) AS q))")
    union = " UNION ALL ".join(f"SELECT tour_id, {d} AS depth FROM l{d}"
                               for d in range(1, CONTINUATION_LEVELS + 1))
    return (PARTIAL_SQL + ", " + ", ".join(parts) +
            f" SELECT tour_id, CAST(depth AS INTEGER) AS depth, count(*) AS n_paths FROM ({union}) "
            "GROUP BY tour_id, depth")


@register("continuation_paths", "G-6 G-2 G-1 J-7 V-6 V-7", _levels_sql())
def q_continuation_paths(spark, sf):
    return P.count_levels(valid_partials(spark, sf), CONTINUATION_LEVELS, "tour", BOARD)


def _near(board: B.Board) -> str:
    """Per square the targets of the moves in their order, -1 off the board."""
    return "[" + ", ".join("[" + ", ".join(
        str((r + dr) * board.width + c + dc) if 0 <= r + dr < board.height and 0 <= c + dc < board.width else "-1"
        for dr, dc in board.offsets) + "]" for r in range(board.height) for c in range(board.width)) + "]"


_NEAR = _near(BOARD)
_FREE = "list_filter(near[{}[len({})] + 1], lambda q: q >= 0 AND NOT list_contains({}, q))"
_DEGREE = "len(list_filter(near[{q} + 1], lambda x: x >= 0 AND NOT list_contains({p}, x)))"
_MD5 = "md5('42:' || tour_id || ':' || len({p}) || ':' || {q})"

WARNSDORFF_SQL = (
    PARTIAL_SQL.replace("WITH ", "WITH RECURSIVE ", 1) +
    f", nb AS (SELECT {_NEAR} AS near), "
    f"walk AS (SELECT tour_id, CAST(tour AS INTEGER[]) AS p FROM pt WHERE {Q.legal('tour')} AND {Q.unique('tour')} "
    "UNION ALL SELECT tour_id, list_append(p, CAST(right(best, 2) AS INTEGER)) FROM ("
    "SELECT tour_id, p, list_min(list_transform(" + _FREE.format("p", "p", "p") + ", lambda q: " +
    _DEGREE.format(q="q", p="p") + " || " + _MD5.format(q="q", p="p") + " || lpad(CAST(q AS VARCHAR), 2, '0'))) AS best "
    f"FROM walk, nb WHERE len(p) < {BOARD.n_squares}) WHERE best IS NOT NULL), "
    "ends AS (SELECT tour_id, max_by(p, len(p)) AS p FROM walk GROUP BY tour_id) "
    f"SELECT tour_id, len(p) = {BOARD.n_squares} AS complete, {Q.key('p')} AS path_key, "
    f"{Q.legal('p')} AND {Q.unique('p')} AS valid FROM ends")


@register("warnsdorff_paths", "G-3 O-3 G-1 P-4", WARNSDORFF_SQL)
def q_warnsdorff_paths(spark, sf):
    out = P.warnsdorff_complete(valid_partials(spark, sf), "tour", 42, BOARD)
    return out.select("tour_id", "complete", B.tour_key("path", BOARD).alias("path_key"),
                      B.is_valid_tour("path", BOARD).alias("valid"))


@register("bounded_paths_per_start", "G-4 G-5 O-4 O-6")
def q_bounded_paths(spark, sf):
    out = P.bounded_paths(valid_partials(spark, sf), PER_SEED, "tour", 42, BOARD)
    return out.select("tour_id", B.tour_key("path", BOARD).alias("path_key"),
                      B.is_valid_tour("path", BOARD).alias("valid"))


def late_partials(spark, sf):
    """Every valid tour without its last 4 to 12 squares."""
    t = tours(spark, sf)
    keep = F.lit(BOARD.n_squares - LATE_LEFT) - F.pmod("tour_id", F.lit(LATE_SPREAD))
    return t.select("tour_id", F.slice("tour", 1, keep.cast("int")).alias("tour")).where(B.is_valid_tour("tour", BOARD))


def _late_sql(tie: str, per_seed: int) -> str:
    """All completions by brute force, ranked by their moves' degrees and ties."""
    cut = f"tour[1:{BOARD.n_squares - LATE_LEFT} - tour_id % {LATE_SPREAD}]"
    return (
        "WITH RECURSIVE " + Q.fixture_tours_cte() + f", nb AS (SELECT {_NEAR} AS near), "
        f"late AS (SELECT tour_id, {cut} AS tour FROM tours), "
        f"walk AS (SELECT tour_id, CAST(tour AS INTEGER[]) AS p, '' AS rank FROM late WHERE {Q.legal('tour')} AND {Q.unique('tour')} "
        "UNION ALL SELECT tour_id, list_append(p, q), rank || " + _DEGREE.format(q="q", p="p") + f" || {tie} FROM ("
        "SELECT tour_id, p, rank, near, k, near[p[len(p)] + 1][k] AS q "
        f"FROM walk, nb, range(1, {len(BOARD.offsets) + 1}) g(k) WHERE len(p) < {BOARD.n_squares}) "
        "WHERE q >= 0 AND NOT list_contains(p, q)), "
        "ranked AS (SELECT tour_id, p, row_number() OVER (PARTITION BY tour_id ORDER BY rank) AS r "
        f"FROM walk WHERE len(p) = {BOARD.n_squares}) "
        f"SELECT tour_id, {Q.key('p')} AS path_key FROM ranked WHERE r <= {per_seed}")


@register("late_completions", "G-5 O-4 O-6", _late_sql(_MD5.format(q="q", p="p"), 3))
def q_late_completions(spark, sf):
    out = P.bounded_paths(late_partials(spark, sf), 3, "tour", 42, BOARD)
    return out.select("tour_id", B.tour_key("path", BOARD).alias("path_key"))


@register("late_first_completion", "G-4 O-5", _late_sql("k", 1))
def q_late_first_completion(spark, sf):
    out = P.bounded_paths(late_partials(spark, sf), 1, "tour", 42, BOARD, order="offset")
    return out.select("tour_id", B.tour_key("path", BOARD).alias("path_key"))


# The small board whose tours SQL can enumerate, tours for each quadrant start.
SMALL = B.Board(5, 4)
PER_QUADRANT_START = 3


def suppliers(spark, sf):
    return read_table(spark, sf, "supplier", "s_suppkey")


def ranked_paths_sql(seeds: str, tie: str, board: B.Board = SMALL) -> str:
    """CTE text ``ranked(tour_id, p, r, ...)``: all full tours of ``seeds(tour_id, start)`` by
    brute force, numbered by their moves' degrees and ties."""
    return (
        f"nb AS (SELECT {_near(board)} AS near), seeds AS ({seeds}), "
        "walk AS (SELECT tour_id, [start] AS p, '' AS rank FROM seeds "
        "UNION ALL SELECT tour_id, list_append(p, q), rank || " + _DEGREE.format(q="q", p="p") + f" || {tie} FROM ("
        "SELECT tour_id, p, rank, near, k, near[p[len(p)] + 1][k] AS q "
        f"FROM walk, nb, range(1, {len(board.offsets) + 1}) g(k) WHERE len(p) < {board.n_squares}) "
        "WHERE q >= 0 AND NOT list_contains(p, q)), "
        "ranked AS (SELECT tour_id, p, row_number() OVER (PARTITION BY tour_id ORDER BY rank) AS r "
        f"FROM walk WHERE len(p) = {board.n_squares})")


@register("every_start_paths", "G-1 G-4 G-5 O-5 O-6 G-7",
          "WITH RECURSIVE " + ranked_paths_sql(
              f"SELECT s_suppkey AS tour_id, CAST(s_suppkey % {SMALL.n_squares} AS INTEGER) AS start FROM supplier", "k")
          + f" SELECT tour_id, {Q.key('p', SMALL)} AS path_key FROM ranked WHERE r <= 1 + tour_id % 5")
def q_every_start_paths(spark, sf):
    """The first 1 to 5 tours (a number for each supplier) of a 5x4 board from every start
    square; squares without a tour are searched to the end."""
    s = suppliers(spark, sf).withColumn("tour_id", F.col("s_suppkey"))
    seeds = P.start_seeds(s, board=SMALL).where(F.col("start") == F.col("tour_id") % SMALL.n_squares)
    out = P.bounded_paths(seeds, 1 + F.col("tour_id") % 5, "tour", 42, SMALL, order="offset")
    return out.select("tour_id", B.tour_key("path", SMALL).alias("path_key"))


@register("quadrant_start_paths", "G-1 G-5 O-5 V-1 V-3",
          f"SELECT s_suppkey, CAST(r * {BOARD.width} + c AS INTEGER) AS start, CAST({PER_QUADRANT_START} AS BIGINT) AS n_tours, "
          f"CAST({PER_QUADRANT_START} AS BIGINT) AS n_valid, CAST({PER_QUADRANT_START} AS BIGINT) AS n_distinct "
          f"FROM supplier, range({BOARD.height // 2}) a(r), range({BOARD.width // 2}) b(c)")
def q_quadrant_start_paths(spark, sf):
    """Full 8x8 tours from the 16 quadrant squares for each supplier, by bounded search: how many
    were found, are valid and start where they should, and differ.  Ties go by a hash
    that depends on the supplier, so suppliers search different orders."""
    key = F.col("s_suppkey") * BOARD.n_squares + F.col("start")
    seeds = P.start_seeds(suppliers(spark, sf), P.quadrant(BOARD), BOARD).withColumn("tour_id", key)
    out = P.bounded_paths(seeds, PER_QUADRANT_START, "tour", 42, BOARD)
    start = F.col("path")[0].cast("int")
    good = B.is_valid_tour("path", BOARD) & (F.size("path") == BOARD.n_squares) & (start == F.col("tour_id") % BOARD.n_squares)
    per = out.groupBy("tour_id").agg(F.count("*").alias("n_tours"), F.count_if(good).alias("n_valid"),
                                     F.count_distinct("path").alias("n_distinct"))
    return per.select(F.floor(F.col("tour_id") / BOARD.n_squares).alias("s_suppkey"),
                      (F.col("tour_id") % BOARD.n_squares).cast("int").alias("start"), "n_tours", "n_valid", "n_distinct")


_STARTS_SQL = f"SELECT s_suppkey * {BOARD.n_squares} + q AS tour_id, [CAST(q AS TINYINT)] AS tour FROM supplier, range({BOARD.n_squares}) s(q)"


@register("every_start_walks", "G-1 G-3 O-3", WARNSDORFF_SQL.replace(
    WARNSDORFF_SQL[WARNSDORFF_SQL.index("RECURSIVE ") + len("RECURSIVE "):WARNSDORFF_SQL.index("nb AS")],
    f"pt AS ({_STARTS_SQL}), ", 1))
def q_every_start_walks(spark, sf):
    """One fewest-onward-moves walk from each of the 64 squares for each supplier."""
    seeds = P.start_seeds(suppliers(spark, sf), None, BOARD).withColumn("tour_id", F.col("s_suppkey") * BOARD.n_squares + F.col("start"))
    out = P.warnsdorff_complete(seeds, "tour", 42, BOARD)
    return out.select("tour_id", "complete", B.tour_key("path", BOARD).alias("path_key"), B.is_valid_tour("path", BOARD).alias("valid"))


# Tours each start adds in a turn, and the quota as a share of all that exist
# (per supplier, in hundredths of the suppliers' own number).
PER_TURN = 2
QUOTA_PER_SUPPLIER = 5


@register("filled_store", "G-8 J-3 S-9 G-5 U-2",
          "WITH RECURSIVE " + ranked_paths_sql(
              f"SELECT s_suppkey AS tour_id, CAST(s_suppkey % {SMALL.n_squares} AS INTEGER) AS start FROM supplier",
              _MD5.format(q="q", p="p"))
          + f", first AS (SELECT {Q.key('p', SMALL)} AS path_key, min((r - 1) // {PER_TURN}) AS turn FROM ranked GROUP BY 1), "
          f"quota AS (SELECT least({QUOTA_PER_SUPPLIER} * (SELECT count(*) FROM supplier), 100) AS q), "
          "asked AS (SELECT turn, count(*) AS n FROM first GROUP BY turn), "
          "run AS (SELECT turn, sum(n) OVER (ORDER BY turn) AS total, n, row_number() OVER (ORDER BY turn) - 1 AS nth FROM asked), "
          "live AS (SELECT turn, total, n FROM run WHERE turn = nth) "
          "SELECT CAST(turn AS INTEGER) AS turn, CAST(least(n, quota.q - (total - n)) AS BIGINT) AS added, "
          "CAST(least(total, quota.q) AS BIGINT) AS stored FROM live, quota WHERE total - n < quota.q")
def q_filled_store(spark, sf):
    """Tours of a 5x4 board, generated turn by turn (each supplier's next two in its own
    order), excluded against the store and appended until the quota or until no new
    ones come; a second run of the filled store must add nothing.  Rows: what each turn added."""
    s = suppliers(spark, sf).withColumn("tour_id", F.col("s_suppkey"))
    seeds = P.start_seeds(s, board=SMALL).where(F.col("start") == F.col("tour_id") % SMALL.n_squares)
    store = VersionedStore(spark, stage_path(spark, "filled"))
    quota = min(QUOTA_PER_SUPPLIER * s.count(), 100)

    def candidates(turn: int):
        found = P.bounded_paths(seeds, PER_TURN * (turn + 1), "tour", 42, SMALL)
        return found.select(F.col("path").alias("tour"))

    fill_to_quota(store, candidates, quota, SMALL)
    again = fill_to_quota(store, candidates, quota, SMALL)
    turns = [r for r in store.log() if r["kind"] == "turn"]
    rows, total = [], 0
    for turn, r in enumerate(turns[:len(turns) - len(again)]):
        total += r["n_rows"]
        rows.append((turn, r["n_rows"], total))
    rows = [r for r in rows if r[1]] + [(len(turns), n, total + n) for n in again if n]
    return spark.createDataFrame(rows, "turn int, added long, stored long")


# Levels counted from bare start squares, and a board of more than 128 squares.
DEEP_LEVELS = 7
BIG = B.Board(12, 12)
BIG_LEVELS = 5


def _from_starts_sql(board: B.Board, levels: int) -> str:
    """All simple paths from the start squares, one by one, without merging."""
    return (
        f"WITH RECURSIVE nb AS (SELECT {_near(board)} AS near), "
        f"own AS (SELECT o_orderkey AS tour_id, CAST(o_orderkey % {board.n_squares} AS INTEGER) AS start FROM orders), "
        "walk AS (SELECT start, [start] AS p FROM (SELECT DISTINCT start FROM own) "
        "UNION ALL SELECT start, list_append(p, q) FROM (SELECT start, p, near[p[len(p)] + 1][k] AS q "
        f"FROM walk, nb, range(1, {len(board.offsets) + 1}) g(k) WHERE len(p) <= {levels}) WHERE q >= 0 AND NOT list_contains(p, q)), "
        "per AS (SELECT start, len(p) - 1 AS depth, count(*) AS n_paths FROM walk WHERE len(p) > 1 GROUP BY ALL) "
        "SELECT tour_id, CAST(depth AS INTEGER) AS depth, n_paths FROM own JOIN per USING (start)")


def _from_starts(spark, sf, board: B.Board, levels: int):
    kind = "tinyint" if board.n_squares <= 128 else "int"
    o = read_table(spark, sf, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("tour_id"), F.array((F.col("o_orderkey") % board.n_squares).cast(kind)).alias("tour"))
    return P.count_by_states(o, levels, "tour", board)


@register("start_continuations", "G-6 G-2 G-1", _from_starts_sql(BOARD, DEEP_LEVELS))
def q_start_continuations(spark, sf):
    """Simple paths of 1 to 7 moves from each order's start square, counted by merged states."""
    return _from_starts(spark, sf, BOARD, DEEP_LEVELS)


@register("big_board_continuations", "G-7 G-6 G-2", _from_starts_sql(BIG, BIG_LEVELS))
def q_big_board_continuations(spark, sf):
    """The same on a board of 12 x 12 squares."""
    return _from_starts(spark, sf, BIG, BIG_LEVELS)


# A rectangular board of more than 64 squares.
RECT = B.Board(9, 8)


def _rect_walks_sql(board: B.Board) -> str:
    best = ("list_min(list_transform(" + _FREE.format("p", "p", "p") + ", lambda q: " + _DEGREE.format(q="q", p="p") + " || "
            + _MD5.format(q="q", p="p") + f" || lpad(CAST(q AS VARCHAR), {board.key_width}, '0')))")
    return (
        f"WITH RECURSIVE nb AS (SELECT {_near(board)} AS near), "
        f"walk AS (SELECT s_suppkey * {board.n_squares} + q AS tour_id, [CAST(q AS INTEGER)] AS p FROM supplier, range({board.n_squares}) s(q) "
        f"UNION ALL SELECT tour_id, list_append(p, CAST(right(best, {board.key_width}) AS INTEGER)) FROM ("
        f"SELECT tour_id, p, {best} AS best FROM walk, nb WHERE len(p) < {board.n_squares}) WHERE best IS NOT NULL), "
        "ends AS (SELECT tour_id, max_by(p, len(p)) AS p FROM walk GROUP BY tour_id) "
        f"SELECT tour_id, len(p) = {board.n_squares} AS complete, {Q.key('p', board)} AS path_key, {Q.canon_key('p', board)} AS canon_key, "
        f"{Q.legal('p', board)} AND {Q.unique('p')} AS valid FROM ends")


@register("rect_walks", "G-7 G-3 G-1 Y-1 Y-2 Y-3", _rect_walks_sql(RECT))
def q_rect_walks(spark, sf):
    """One fewest-onward-moves walk from each of the 72 squares of a 9 x 8 board for each
    supplier, with its canonical form among the four images of a rectangle."""
    seeds = P.start_seeds(suppliers(spark, sf), None, RECT).withColumn("tour_id", F.col("s_suppkey") * RECT.n_squares + F.col("start"))
    out = B.with_canonical(P.warnsdorff_complete(seeds, "tour", 42, RECT), "path", board=RECT)
    return out.select("tour_id", "complete", B.tour_key("path", RECT).alias("path_key"), B.tour_key("canon", RECT).alias("canon_key"),
                      B.is_valid_tour("path", RECT).alias("valid"))
