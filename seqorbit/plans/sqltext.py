"""SQL text (DuckDB dialect) for the oracle side of each registered query.

The oracle is a brute-force restatement over the same parquet tables: long
forms, ``list(... ORDER BY i)``, and keys compared as strings.  The eight
images and the canonical starts are written out here as SQL, so a wrong
symmetry on the Spark side shows up as a difference.
"""

from __future__ import annotations

from ..functions.board import DEFAULT_BOARD, Board
from ..sources import fixtures as fx


# Row and column of each image of square (r, c) on a board whose
# last row is h and last column is w; and the smallest starts of all orbits (8x8).
IMAGES = [
    ("{r}", "{c}"), ("{c}", "({h} - {r})"), ("({h} - {r})", "({w} - {c})"), ("({w} - {c})", "{r}"),
    ("{r}", "({w} - {c})"), ("({h} - {r})", "{c}"), ("{c}", "{r}"), ("({w} - {c})", "({h} - {r})"),
]
CANONICAL_STARTS = "[0, 1, 2, 3, 9, 10, 11, 18, 19, 27]"


def img(p: str, k: int, board: Board = DEFAULT_BOARD) -> str:
    at = dict(r=f"({p} // {board.width})", c=f"({p} % {board.width})", h=board.height - 1, w=board.width - 1)
    row, col = (x.format(**at) for x in IMAGES[k])
    return f"({row} * {board.width} + {col})" if k else f"({p})"


def img_by(p: str, k: str, board: Board = DEFAULT_BOARD) -> str:
    arms = " ".join(f"WHEN {s} THEN {img(p, s, board)}" for s in board.symmetries)
    return f"(CASE {k} {arms} END)"


def key(t: str, board: Board = DEFAULT_BOARD) -> str:
    return (f"array_to_string(list_transform({t}, lambda p: "
            f"lpad(CAST(p AS VARCHAR), {board.key_width}, '0')), '-')")


def image_list(t: str, k: int, board: Board = DEFAULT_BOARD) -> str:
    if k == 0:
        return t
    return f"list_transform({t}, lambda p: CAST({img('p', k, board)} AS TINYINT))"


def canon_key(t: str, board: Board = DEFAULT_BOARD) -> str:
    return "least(" + ", ".join(key(image_list(t, k, board), board) for k in board.symmetries) + ")"


def prefix(key_expr: str, k, board: Board = DEFAULT_BOARD) -> str:
    return f"substr({key_expr}, 1, ({k}) * {board.key_width + 1} - 1)"


def step(a: str, b: str, board: Board = DEFAULT_BOARD) -> str:
    n = board.n_squares
    w = board.width
    dr = f"abs({a} // {w} - {b} // {w})"
    dc = f"abs({a} % {w} - {b} % {w})"
    cls = " OR ".join(f"({dr} = {x} AND {dc} = {y})" for x, y in board.step_classes)
    return f"({a} BETWEEN 0 AND {n - 1} AND {b} BETWEEN 0 AND {n - 1} AND ({cls}))"


def legal(t: str, board: Board = DEFAULT_BOARD) -> str:
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN len({t}) < 2 THEN TRUE ELSE "
            f"list_bool_and(list_transform(range(1, len({t})), lambda j: "
            f"{step(f'{t}[j]', f'{t}[j + 1]', board)})) END)")


def n_illegal(t: str, board: Board = DEFAULT_BOARD) -> str:
    return (f"(CASE WHEN len({t}) < 2 THEN 0 ELSE len(list_filter(range(1, len({t})), lambda j: "
            f"NOT {step(f'{t}[j]', f'{t}[j + 1]', board)})) END)")


def unique(t: str) -> str:
    return f"(len({t}) > 0 AND len(list_distinct({t})) = len({t}))"


def closed(t: str, board: Board = DEFAULT_BOARD) -> str:
    return (f"(CASE WHEN len({t}) = 0 THEN NULL ELSE len({t}) >= 2 AND "
            f"{step(f'{t}[1]', f'{t}[len({t})]', board)} END)")


def _bases() -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, b)) + "]" for b in fx.BASE_TOURS) + "]"


def fixture_long(table: str, key: str, cust: str, cols: str) -> str:
    """Long form (row per square) of the fixture tours over ``table``."""
    n = DEFAULT_BOARD.n_squares
    p = (f"({_bases()})[({key} % 3) + 1]"
         f"[(({cust} + CASE WHEN ({key} // 3) % 2 = 1 THEN {n - 1} - g.i ELSE g.i END) % {n}) + 1]")
    return (f"SELECT {cols}, {key} AS _key, CAST(g.i AS INTEGER) AS i, "
            f"CAST({img_by('(' + p + ')', f'(({key} // 6) % 8)')} AS INTEGER) AS q "
            f"FROM {table} CROSS JOIN range({n}) g(i)")


def corrupt(q: str = "q", key: str = "_key", i: str = "i") -> str:
    n = DEFAULT_BOARD.n_squares
    return (f"(CASE WHEN {key} % {fx.CORRUPT_EVERY} = 0 AND {i} = {fx.CORRUPT_AT} "
            f"THEN ({q} + 1) % {n} ELSE {q} END)")


def fixture_tours_cte(table: str = "orders", key: str = "o_orderkey", cust: str = "o_custkey",
                      source: str = "o_orderpriority", name: str = "tours") -> str:
    """CTE body text: ``name(tour_id, source, start, tour)`` (fixture A)."""
    long = fixture_long(table, key, cust, f"{key} AS tour_id, {source} AS source")
    return (f"{name} AS (SELECT tour_id, source, "
            f"list(CAST({corrupt()} AS TINYINT) ORDER BY i) AS tour "
            f"FROM ({long}) GROUP BY tour_id, source)")


def tours_prelude(board: Board = DEFAULT_BOARD) -> str:
    """``WITH`` prelude defining fixture tours and their derived columns:

    tours(tour_id, source, tour), tk(+ key, start, legal, uniq, closed, valid,
    canon), vcanon(canonical keys of valid tours, one row each, with the
    smallest tour_id and its source)."""
    return (
        "WITH " + fixture_tours_cte() + ", "
        f"tk AS (SELECT tour_id, source, tour, {key('tour', board)} AS tkey, "
        f"CAST(tour[1] AS INTEGER) AS start, {legal('tour', board)} AS legal, "
        f"{unique('tour')} AS uniq, {closed('tour', board)} AS closed, "
        f"{canon_key('tour', board)} AS canon FROM tours), "
        "tv AS (SELECT *, legal AND uniq AS valid FROM tk), "
        "vcanon AS (SELECT canon, min(tour_id) AS tour_id, "
        "CAST(substr(canon, 1, 2) AS INTEGER) AS start "
        "FROM tv WHERE valid GROUP BY canon)"
    )


def completions_cte(board: Board = DEFAULT_BOARD) -> str:
    """CTE text: ``comp(model, case_id, given_len, given, tour)`` (fixture C)."""
    n = board.n_squares
    long = fixture_long("orders", "o_orderkey", "o_custkey",
                        "o_orderkey AS case_id, o_orderstatus AS model")
    r18 = fx.REVISIT_FROM - 1
    return (
        f"cl AS ({long}), "
        f"ca AS (SELECT case_id, model, any_value(_key) AS _key, list(q ORDER BY i) AS clean, "
        f"list({corrupt()} ORDER BY i) AS outl FROM cl GROUP BY case_id, model), "
        f"comp AS (SELECT model, case_id, CAST(1 + _key % {fx.PROMPT_SPREAD} AS INTEGER) AS given_len, "
        f"clean[1:1 + _key % {fx.PROMPT_SPREAD}] AS given, "
        f"(CASE WHEN _key % {fx.REVISIT_EVERY} = 0 THEN list_transform(range({n}), lambda i: "
        f"CASE WHEN i >= {fx.REVISIT_FROM} THEN outl[{r18} + i % 2] ELSE outl[i + 1] END) ELSE outl END)"
        f"[1:(CASE WHEN _key % {fx.TRUNCATE_EVERY} = 0 THEN {fx.TRUNCATE_TO} ELSE {n} END)] AS tour FROM ca)")


def first_bad(t: str, board: Board = DEFAULT_BOARD) -> str:
    return (f"(list_filter(range(1, len({t})), lambda j: NOT {step(f'{t}[j]', f'{t}[j + 1]', board)})[1] + 1)")


def onward_count(t: str, upto: str, board: Board = DEFAULT_BOARD) -> str:
    """Legal moves from ``t[upto]`` to squares not in ``t[1:upto]``."""
    w, h = board.width, board.height
    p = f"{t}[{upto}]"
    cands = ", ".join(
        f"CASE WHEN {p} // {w} + ({dr}) BETWEEN 0 AND {h - 1} AND {p} % {w} + ({dc}) BETWEEN 0 AND {w - 1} "
        f"THEN ({p} // {w} + ({dr})) * {w} + {p} % {w} + ({dc}) END" for dr, dc in board.offsets)
    return (f"len(list_filter([{cands}], lambda q: q IS NOT NULL AND NOT list_contains("
            f"{t}[1:{upto}], CAST(q AS TINYINT))))")


def onward_list(t: str, board: Board = DEFAULT_BOARD) -> str:
    """Legal moves from the last square of ``t`` to squares not in ``t``."""
    w, h = board.width, board.height
    p = f"{t}[len({t})]"
    cands = ", ".join(
        f"CASE WHEN {p} // {w} + ({dr}) BETWEEN 0 AND {h - 1} AND {p} % {w} + ({dc}) BETWEEN 0 AND {w - 1} "
        f"THEN ({p} // {w} + ({dr})) * {w} + {p} % {w} + ({dc}) END" for dr, dc in board.offsets)
    return (f"list_filter([{cands}], lambda q: q IS NOT NULL AND NOT list_contains("
            f"{t}, CAST(q AS TINYINT)))")
