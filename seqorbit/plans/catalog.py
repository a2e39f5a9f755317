"""Registered queries: a Spark plan and a DuckDB oracle for each operator.

Every query reads the driver's tables (fixture tours are derived from
``orders``/``lineitem``/``events`` by Spark) and runs over the whole tables.
Array results are returned as zero-padded keys (``'00-17-…'``) so both sides
compare as plain strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import board_graph as G
from ..operators import corpus as C
from ..operators.prefix import prefix_diversity
from ..sources import fixtures as FX
from ..sources.tables import read_table
from ..sources.stages import STAGES
from . import sqltext as Q

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


BOARD = B.DEFAULT_BOARD
N = BOARD.n_squares
PRE = Q.tours_prelude()
# canonical tour key -> list of ints, DuckDB side
CANON_LIST = "list_transform(string_split(canon, '-'), lambda x: CAST(x AS INTEGER))"


# --------------------------------------------------------------------------
# shared Spark inputs
# --------------------------------------------------------------------------

def orders(spark, sf):
    return read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                      "o_orderstatus")


def staged(spark, sf, name: str, build) -> DataFrame:
    """A Spark-derived table, written to the shared folder once for the present input
    files of ``sf`` and scanned by every query that needs it; changed input is staged anew."""
    return STAGES.get(spark, sf, name, build)


def tours(spark, sf) -> DataFrame:
    """Fixture A over all of ``orders``, staged once."""
    return staged(spark, sf, "tours", lambda: FX.tours_from_orders(orders(spark, sf)))


def canon(spark, sf) -> DataFrame:
    """Valid tours, one row per canonical form (staged: the split operators
    read it several times)."""
    return staged(spark, sf, "canon", lambda: C.canonical_unique(tours(spark, sf), BOARD))


def _k(col: str, out: str):
    return B.tour_key(col, BOARD).alias(out)


# --------------------------------------------------------------------------
# slice 0 + corpus profile (A-1..A-6, Y-3, Y-6, F-14)
# --------------------------------------------------------------------------

@register("canonical_per_start", "A-5 A-6 Y-3 A-3 P-3 Y-1",
          PRE + " SELECT start, count(*) AS n_tours FROM vcanon GROUP BY start")
def q_canonical_per_start(spark, sf):
    return C.per_start_counts(canon(spark, sf))


@register("tours_dup_audit", "A-1 A-2 A-3 A-6",
          PRE + " SELECT count(*) AS n_rows, count(DISTINCT tkey) AS n_distinct, "
          "count(DISTINCT canon) AS n_canonical, count_if(valid) AS n_valid, "
          "count(DISTINCT CASE WHEN valid THEN canon END) AS n_valid_canonical FROM tv")
def q_dup_audit(spark, sf):
    return C.dup_audit(tours(spark, sf), BOARD)


@register("canonical_tours", "A-6 Y-3 U-4",
          PRE + " SELECT canon AS canon_key, CAST(substr(canon, 1, 2) AS INTEGER) AS start, "
          "min(tour_id) AS tour_id, arg_min(source, tour_id) AS source, count(*) AS n_copies "
          "FROM tv WHERE valid GROUP BY canon")
def q_canonical_tours(spark, sf):
    c = canon(spark, sf)
    return c.select(_k("canon", "canon_key"), "start", "tour_id", "source", "n_copies")


@register("start_set_check", "Y-6 A-4",
          PRE + " SELECT DISTINCT start, list_contains("
          + Q.CANONICAL_STARTS + ", start) AS is_orbit_min FROM vcanon")
def q_start_set_check(spark, sf):
    return C.start_set_check(canon(spark, sf), BOARD)


@register("start_counts_rescaled", "F-14 A-5 O-2",
          PRE + " , c AS (SELECT start, count(*) AS n_tours FROM vcanon GROUP BY start) "
          "SELECT start, n_tours, (n_tours - min(n_tours) OVER ()) / "
          "nullif(max(n_tours) OVER () - min(n_tours) OVER (), 0) AS scaled FROM c")
def q_start_counts_rescaled(spark, sf):
    return C.rescaled_counts(C.per_start_counts(canon(spark, sf)))


# Start-square sets used by the reference's filters (F-2/F-3).
START_SETS = {
    "in_9": ([9], False), "in_11": ([11], False), "in_2": ([2], False),
    "in_11_2": ([11, 2], False), "in_9_11_2": ([9, 11, 2], False),
    "in_8_17_26": ([8, 17, 26], False), "not_9": ([9], True), "not_9_11_2": ([9, 11, 2], True),
}


def _start_filter_sql():
    cols = []
    for name, (sq, neg) in START_SETS.items():
        cond = f"start IN ({', '.join(map(str, sq))})"
        cols.append(f"count_if({'NOT ' if neg else ''}{cond}) AS n_{name}")
    return PRE + " SELECT " + ", ".join(cols) + " FROM vcanon"


@register("start_filter", "F-2 F-3 A-1", _start_filter_sql())
def q_start_filter(spark, sf):
    c = canon(spark, sf)
    aggs = []
    for name, (sq, neg) in START_SETS.items():
        cond = F.col("start").isin(sq)
        aggs.append(F.count_if(~cond if neg else cond).alias(f"n_{name}"))
    return c.agg(*aggs)


@register("visit_histogram", "A-9 F-7",
          PRE + f" SELECT CAST(p AS INTEGER) AS pos, count(*) AS n_visits FROM "
          f"(SELECT unnest(({CANON_LIST})[1:50]) AS p FROM vcanon) GROUP BY p")
def q_visit_histogram(spark, sf):
    return C.visit_histogram(canon(spark, sf), 50)


@register("prefix_blacklist", "F-4",
          PRE + f" SELECT canon AS canon_key, start FROM vcanon WHERE NOT list_has_any("
          f"({CANON_LIST})[1:4], [0, 10, 16])")
def q_prefix_blacklist(spark, sf):
    kept = C.prefix_blacklist(canon(spark, sf), [0, 10, 16], 4)
    return kept.select(_k("canon", "canon_key"), "start")


# --------------------------------------------------------------------------
# validity (V-1..V-5, J-4) and the board graph (S-3, S-4, F-13, V-8)
# --------------------------------------------------------------------------

def _in_range_sql(t):
    return f"list_bool_and(list_transform({t}, lambda p: p BETWEEN 0 AND {N - 1}))"


@register("validity_report", "V-1 V-2 V-3 V-4 V-5 A-10",
          PRE + " SELECT source, count(*) AS n_rows, count_if(legal) AS n_legal, "
          "count_if(NOT legal) AS n_illegal, count_if(NOT uniq) AS n_repeated, "
          f"count_if(len(tour) <> {N}) AS n_short, "
          f"count_if(NOT {_in_range_sql('tour')}) AS n_out_of_range, "
          "count_if(closed AND valid) AS n_closed_valid, count_if(valid) AS n_valid, "
          "bool_and(coalesce(valid, false)) AS all_valid FROM tv GROUP BY source")
def q_validity_report(spark, sf):
    return C.validity_report(tours(spark, sf), "source", BOARD)


@register("repeat_check", "V-3 A-12",
          PRE + " SELECT tour_id, CAST(len(list_distinct(tour)) AS INTEGER) AS n_distinct_squares "
          "FROM tv WHERE NOT uniq")
def q_repeat_check(spark, sf):
    t = tours(spark, sf)
    return (t.where(~B.is_unique("tour"))
             .select("tour_id", F.size(F.array_distinct("tour")).alias("n_distinct_squares")))


@register("closed_tours", "V-4",
          PRE + " SELECT source, count_if(closed) AS n_closed, count_if(NOT closed) AS n_open, "
          "count(*) AS n_valid FROM tv WHERE valid GROUP BY source")
def q_closed_tours(spark, sf):
    t = C.with_checks(tours(spark, sf).select("source", "tour"), board=BOARD).where("valid")
    return t.groupBy("source").agg(F.count_if("closed").alias("n_closed"),
                                   F.count_if(~F.col("closed")).alias("n_open"),
                                   F.count("*").alias("n_valid"))


_EDGES_SQL = (
    "edges AS (SELECT CAST(s.i AS INTEGER) AS src, CAST((s.i // {w} + o.dr) * {w} + s.i % {w} + o.dc "
    "AS INTEGER) AS dst FROM range({n}) s(i) CROSS JOIN (SELECT unnest({drs}) AS dr, "
    "unnest({dcs}) AS dc) o WHERE s.i // {w} + o.dr BETWEEN 0 AND {h1} "
    "AND s.i % {w} + o.dc BETWEEN 0 AND {w1})").format(
    w=BOARD.width, n=N, h1=BOARD.height - 1, w1=BOARD.width - 1,
    drs=str([a for a, _ in BOARD.offsets]), dcs=str([b for _, b in BOARD.offsets]))

_MOVES_SQL = ("mv AS (SELECT tour_id, CAST(j + 1 AS INTEGER) AS move_no, "
              "CAST(tour[j] AS INTEGER) AS pos, CAST(tour[j + 1] AS INTEGER) AS nxt "
              "FROM tv, LATERAL (SELECT unnest(range(1, len(tv.tour))) AS j))")


@register("board_edges", "S-3 J-4 J-5",
          PRE + ", " + _EDGES_SQL + ", " + _MOVES_SQL +
          ", u AS (SELECT pos, nxt, count(*) AS n FROM mv GROUP BY pos, nxt) "
          "SELECT e.src, e.dst, coalesce(u.n, 0) AS n_uses FROM edges e "
          "LEFT JOIN u ON u.pos = e.src AND u.nxt = e.dst")
def q_board_edges(spark, sf):
    return G.edge_usage(tours(spark, sf), G.board_edges(spark, BOARD), "tour", BOARD)


@register("board_degree_hist", "S-3 S-4 V-7",
          PRE + ", " + _EDGES_SQL +
          ", deg AS (SELECT src AS pos, count(*) AS degree FROM edges GROUP BY src), "
          f"vis AS (SELECT CAST(p AS INTEGER) AS pos, count(*) AS n FROM "
          f"(SELECT unnest({CANON_LIST}) AS p FROM vcanon) GROUP BY p) "
          "SELECT CAST(degree AS INTEGER) AS degree, count(*) AS n_squares, "
          "CAST(sum(coalesce(vis.n, 0)) AS BIGINT) AS n_visits "
          "FROM deg LEFT JOIN vis USING (pos) GROUP BY degree")
def q_board_degree_hist(spark, sf):
    deg = G.degrees(G.board_edges(spark, BOARD))
    vis = C.visit_histogram(canon(spark, sf), N)
    return (F.broadcast(deg).join(vis, "pos", "left")
            .groupBy(F.col("degree").cast("int").alias("degree"))
            .agg(F.count("*").alias("n_squares"),
                 F.sum(F.coalesce("n_visits", F.lit(0))).cast("long").alias("n_visits")))


@register("adjacency_lists", "S-4",
          PRE + ", " + _EDGES_SQL +
          ", used AS (SELECT DISTINCT CAST(p AS INTEGER) AS src FROM "
          f"(SELECT unnest({CANON_LIST}) AS p FROM vcanon)) "
          "SELECT e.src, array_to_string(list(lpad(CAST(e.dst AS VARCHAR), 2, '0') ORDER BY e.dst), '-') "
          "AS nbrs FROM edges e JOIN used u ON u.src = e.src GROUP BY e.src")
def q_adjacency_lists(spark, sf):
    adj = G.adjacency(G.board_edges(spark, BOARD))
    used = (canon(spark, sf).select(F.explode("canon").alias("src"))
            .select(F.col("src").cast("int").alias("src")).distinct())
    return (F.broadcast(adj).join(used, "src")
            .select("src", _k("nbrs", "nbrs")))


@register("tour_steps", "F-13 F-11",
          PRE + f", ct AS (SELECT tour_id, {CANON_LIST} AS tour FROM vcanon) "
          "SELECT tour_id, CAST(j + 1 AS INTEGER) AS move_no, tour[j] AS pos, tour[j + 1] AS nxt, "
          f"tour[j + 1] // {BOARD.width} - tour[j] // {BOARD.width} AS dr, "
          f"tour[j + 1] % {BOARD.width} - tour[j] % {BOARD.width} AS dc "
          "FROM ct, LATERAL (SELECT unnest(range(1, len(ct.tour))) AS j)")
def q_tour_steps(spark, sf):
    return G.moves(canon(spark, sf), "canon", BOARD, keep=("tour_id",)).drop("legal")


@register("illegal_moves", "J-4 V-1",
          PRE + ", " + _EDGES_SQL + ", " + _MOVES_SQL +
          " SELECT tour_id, move_no, pos, nxt FROM mv WHERE NOT EXISTS "
          "(SELECT 1 FROM edges e WHERE e.src = mv.pos AND e.dst = mv.nxt)")
def q_illegal_moves(spark, sf):
    return G.illegal_moves(tours(spark, sf), G.board_edges(spark, BOARD), "tour", BOARD,
                           keep=("tour_id",)).select("tour_id", "move_no", "pos", "nxt")


def _raw_tours_sql():
    return (f"WITH st AS (SELECT l_orderkey AS tour_id, CAST(l_linenumber AS INTEGER) AS move_no, "
            f"CAST(l_partkey % {N} AS INTEGER) AS pos FROM lineitem), "
            "rt AS (SELECT tour_id, list(pos ORDER BY move_no, pos) AS tour FROM st GROUP BY tour_id) ")


@register("tour_moves", "V-8 V-1 V-3 V-4",
          _raw_tours_sql() +
          f"SELECT tour_id, CAST(len(tour) AS INTEGER) AS n_squares, {Q.key('tour')} AS walk, "
          f"{Q.legal('tour')} AS legal, {Q.unique('tour')} AS uniq, {Q.closed('tour')} AS closed, "
          f"CAST({Q.n_illegal('tour')} AS INTEGER) AS n_illegal FROM rt")
def q_tour_moves(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    rt = G.steps_to_tours(FX.raw_steps_from_lineitem(li))
    return rt.select("tour_id", F.size("tour").alias("n_squares"), _k("tour", "walk"),
                     B.is_legal("tour", BOARD).alias("legal"), B.is_unique("tour").alias("uniq"),
                     B.is_closed("tour", BOARD).alias("closed"),
                     B.n_illegal_steps("tour", BOARD).alias("n_illegal"))


# --------------------------------------------------------------------------
# symmetry (Y-2, Y-4, Y-5, A-7)
# --------------------------------------------------------------------------

def _images_sql():
    arms = " UNION ALL ".join(
        f"SELECT tour_id, {k} AS sym_id, {Q.key(Q.image_list('ct.tour', k))} AS image_key FROM ct"
        for k in BOARD.symmetries)
    return f", ct AS (SELECT tour_id, {CANON_LIST} AS tour FROM vcanon), img AS ({arms}) "


@register("symmetry_images", "Y-2 Y-4 J-6",
          PRE + _images_sql() + "SELECT tour_id, sym_id, image_key FROM img")
def q_symmetry_images(spark, sf):
    from ..operators.augment import augment
    return augment(canon(spark, sf), "canon", BOARD).select(
        "tour_id", "sym_id", _k("image", "image_key"))


@register("augmented_counts", "A-7 Y-4",
          PRE + _images_sql() + "SELECT count(DISTINCT tour_id) AS n_canonical, count(*) AS n_augmented, "
          "count(DISTINCT image_key) AS n_distinct_images, "
          "8 * count(DISTINCT tour_id) AS n_expected FROM img")
def q_augmented_counts(spark, sf):
    from ..operators.augment import orbit_counts
    # one row for each canonical form, which has one tour_id
    return orbit_counts(canon(spark, sf), "canon", BOARD).withColumn("n_expected", F.col("n_canonical") * len(BOARD.symmetries))


@register("image_preview", "Y-5 F-12 F-7",
          PRE + _images_sql() + ", first AS (SELECT tour_id FROM vcanon ORDER BY canon LIMIT 1) "
          "SELECT sym_id, substr(image_key, 1, 29) AS preview FROM img WHERE tour_id IN "
          "(SELECT tour_id FROM first)")
def q_image_preview(spark, sf):
    from ..operators.augment import augment
    first = C.top_by(canon(spark, sf).select("tour_id", "canon"), ["canon"], 1)
    a = augment(first, "canon", BOARD)
    return a.select("sym_id", _k(F.slice("image", 1, 10), "preview"))


# --------------------------------------------------------------------------
# prefix diversity (A-8, A-17, P-1)
# --------------------------------------------------------------------------

@register("prefix_diversity", "A-8 P-1",
          PRE + f" SELECT CAST(k AS INTEGER) AS k, count(DISTINCT {Q.prefix('canon', 'k')}) AS n_prefixes "
          f"FROM vcanon CROSS JOIN range(1, {N + 1}) r(k) GROUP BY k")
def q_prefix_diversity(spark, sf):
    return prefix_diversity(canon(spark, sf), "canon", N)


@register("prefix_diversity_by_source", "A-17 U-4",
          PRE + f", sc AS (SELECT DISTINCT source, canon FROM tv WHERE valid) "
          f"SELECT source, CAST(k AS INTEGER) AS k, count(DISTINCT {Q.prefix('canon', 'k')}) AS n_prefixes "
          f"FROM sc CROSS JOIN range(1, {N + 1}) r(k) GROUP BY source, k")
def q_prefix_diversity_by_source(spark, sf):
    t = B.with_canonical(tours(spark, sf).select("source", "tour"), board=BOARD)
    t = t.where(B.is_valid_tour("tour", BOARD)).select("source", "canon")
    return prefix_diversity(t, "canon", N, group="source")
