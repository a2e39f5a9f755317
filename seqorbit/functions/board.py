"""Board geometry, symmetry images and rule checks as Spark column expressions.

Everything here returns ``pyspark.sql.Column`` objects, so the work stays in
the JVM (projection / filter / higher-order array functions); nothing is a
Python UDF.  Squares are numbered row-major: ``idx = row * width + col``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOUR_TYPE = T.ArrayType(T.ByteType())

# The move offsets (d_row, d_col) of a knight, the default piece.
KNIGHT_OFFSETS: tuple[tuple[int, int], ...] = (
    (-2, -1), (-2, 1), (-1, -2), (-1, 2), (1, -2), (1, 2), (2, -1), (2, 1),
)

# The order of the eight board images (sym_id -> new (row, col)),
# with n = board size - 1.  Results must keep this order.
#   0 identity      (r, c)
#   1 rotate 90     (c, n - r)
#   2 rotate 180    (n - r, n - c)
#   3 rotate 270    (n - c, r)
#   4 horizontal    (r, n - c)
#   5 vertical      (n - r, c)
#   6 diagonal      (c, r)
#   7 anti-diagonal (n - c, n - r)
SQUARE_SYMMETRIES = (0, 1, 2, 3, 4, 5, 6, 7)
# On a non-square board only the symmetries that keep the shape apply.
RECT_SYMMETRIES = (0, 2, 4, 5)


def _image_rc(k: int, r, c, h1: int, w1: int):
    """New (row, col) of image ``k``; works on Python ints and on Columns.

    ``h1``/``w1`` are height-1 and width-1 (equal on a square board).
    """
    if k == 0:
        return r, c
    if k == 1:
        return c, h1 - r
    if k == 2:
        return h1 - r, w1 - c
    if k == 3:
        return w1 - c, r
    if k == 4:
        return r, w1 - c
    if k == 5:
        return h1 - r, c
    if k == 6:
        return c, r
    if k == 7:
        return w1 - c, h1 - r
    raise ValueError(f"unknown symmetry {k}")


@dataclass(frozen=True)
class Board:
    """A rectangular board and the piece that moves on it."""

    width: int = 8
    height: int = 8
    offsets: tuple[tuple[int, int], ...] = KNIGHT_OFFSETS

    @property
    def n_squares(self) -> int:
        return self.width * self.height

    @property
    def symmetries(self) -> tuple[int, ...]:
        return SQUARE_SYMMETRIES if self.width == self.height else RECT_SYMMETRIES

    @property
    def key_width(self) -> int:
        """Digits per square in a tour key (``'00-17-…'``)."""
        return max(2, len(str(self.n_squares - 1)))

    # ---- pure-Python helpers (used to derive small tables from rules) ----

    def image_of(self, k: int, p: int) -> int:
        r, c = divmod(p, self.width)
        r2, c2 = _image_rc(k, r, c, self.height - 1, self.width - 1)
        return r2 * self.width + c2

    def neighbours_of(self, p: int) -> list[int]:
        r, c = divmod(p, self.width)
        out = []
        for dr, dc in self.offsets:
            r2, c2 = r + dr, c + dc
            if 0 <= r2 < self.height and 0 <= c2 < self.width:
                out.append(r2 * self.width + c2)
        return sorted(out)

    @cached_property
    def step_classes(self) -> tuple[tuple[int, int], ...]:
        """Distinct (|d_row|, |d_col|) pairs of the piece's moves."""
        return tuple(sorted({(abs(a), abs(b)) for a, b in self.offsets}))

    @cached_property
    def canonical_pair_table(self) -> list[int]:
        """For every ordered pair (first, second) of squares: the symmetry
        whose image of the pair is the unique lexicographic minimum, or -1
        if two images tie (then the whole sequence decides).  Derived from
        the symmetry rule; n_squares**2 entries."""
        n = self.n_squares
        table = []
        for a in range(n):
            imgs_a = [self.image_of(k, a) for k in self.symmetries]
            for b in range(n):
                pairs = [(imgs_a[i], self.image_of(k, b)) for i, k in enumerate(self.symmetries)]
                best = min(pairs)
                hits = [k for k, pr in zip(self.symmetries, pairs) if pr == best]
                table.append(hits[0] if len(hits) == 1 and a != b else -1)
        return table

    @cached_property
    def image_table(self) -> list[int]:
        """Image of every square under every symmetry, symmetry-major:
        entry ``slot * n_squares + p``.  Derived from the symmetry rule."""
        return [self.image_of(k, p) for k in self.symmetries for p in range(self.n_squares)]

    @cached_property
    def step_table(self) -> list[bool]:
        """``a * n_squares + b`` -> is a -> b one move.  Derived from the offsets."""
        n = self.n_squares
        table = [False] * (n * n)
        for a in range(n):
            for b in self.neighbours_of(a):
                table[a * n + b] = True
        return table

    @cached_property
    def neighbour_masks(self) -> list[int]:
        """Bitmask of neighbours for each square (boards of at most 64 squares)."""
        if self.n_squares > 64:
            raise ValueError("bitmask state needs at most 64 squares")
        masks = []
        for p in range(self.n_squares):
            m = 0
            for q in self.neighbours_of(p):
                m |= 1 << q
            masks.append(m - (1 << 64) if m >= 1 << 63 else m)  # signed BIGINT
        return masks


DEFAULT_BOARD = Board()


# --------------------------------------------------------------------------
# Column expressions
# --------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda).  Rule checks
    use it so that, when the optimizer pushes a filter below the projection
    that produced a sequence, the producer is inlined once per row and not
    once per reference inside a per-element lambda."""
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def row_of(p, board: Board = DEFAULT_BOARD) -> Column:
    return (_c(p).cast("int") / board.width).cast("int")


def col_of(p, board: Board = DEFAULT_BOARD) -> Column:
    return _c(p).cast("int") % board.width


def square_image_arith(p, k: int, board: Board = DEFAULT_BOARD) -> Column:
    """Image of square ``p`` under symmetry ``k`` by row/column arithmetic."""
    r, c = row_of(p, board), col_of(p, board)
    r2, c2 = _image_rc(k, r, c, board.height - 1, board.width - 1)
    return r2 * board.width + c2


@lru_cache(maxsize=None)
def array_literal(values: tuple, sql_type: str) -> Column:
    """One array literal built from a single SQL expression (one call into the
    JVM, instead of one per element); cached per table."""
    if sql_type == "boolean":
        body = ",".join("true" if v else "false" for v in values)
    else:
        body = ",".join(str(int(v)) for v in values)
    return F.expr(f"CAST(array({body}) AS ARRAY<{sql_type}>)")


@lru_cache(maxsize=None)
def nested_array_literal(rows: tuple, sql_type: str) -> Column:
    """An array of arrays as one SQL expression (cached per table)."""
    body = ",".join("array(" + ",".join(str(int(v)) for v in r) + ")" if r else
                    f"CAST(array() AS ARRAY<{sql_type}>)" for r in rows)
    return F.expr(f"CAST(array({body}) AS ARRAY<ARRAY<{sql_type}>>)")


def neighbour_lists(board: Board) -> Column:
    """Per square, the squares one move away (derived from the offsets)."""
    return nested_array_literal(tuple(tuple(board.neighbours_of(p)) for p in range(board.n_squares)), "int")


def _image_table(board: Board) -> Column:
    return array_literal(tuple(board.image_table), "tinyint" if board.n_squares <= 128 else "int")


def square_image(p, k, board: Board = DEFAULT_BOARD) -> Column:
    """Image of square ``p`` under symmetry ``k`` (an int or an int column),
    read from the look-up table; null for squares off the board."""
    p = _c(p).cast("int")
    slot = board.symmetries.index(k) if isinstance(k, int) else _c(k)
    if not isinstance(k, int) and board.symmetries != SQUARE_SYMMETRIES:
        slot = F.array_position(F.lit(list(board.symmetries)), k).cast("int") - 1
    idx = slot * board.n_squares + p + 1 if not isinstance(slot, int) else p + (slot * board.n_squares + 1)
    return F.when(in_board(p, board), F.try_element_at(_image_table(board), idx))


def square_image_by(p, k, board: Board = DEFAULT_BOARD) -> Column:
    """Image of square ``p`` under a per-row symmetry column ``k``."""
    return square_image(p, _c(k), board)


def tour_image(tour, k: int, board: Board = DEFAULT_BOARD) -> Column:
    """The whole sequence mapped by symmetry ``k`` (ARRAY<TINYINT>)."""
    if k == 0:
        return _c(tour)
    return F.transform(_c(tour), lambda p: square_image(p, k, board))


def tour_image_by(tour, k, board: Board = DEFAULT_BOARD) -> Column:
    """Sequence mapped by a per-row symmetry.  ``k`` should be a plain
    column reference: lambdas re-evaluate outer expressions per element."""
    return F.transform(_c(tour), lambda p: square_image(p, _c(k), board))


def tour_images(tour, board: Board = DEFAULT_BOARD) -> Column:
    """ARRAY of the images in symmetry order (8 on a square board)."""
    return F.array(*[tour_image(tour, k, board) for k in board.symmetries])


def canonical_symmetry(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Symmetry that canonicalises ``tour``, read from its first two squares.

    -1 when the first two squares do not decide (short, repeated or
    out-of-range input); callers then fall back to the minimum of all images.
    """
    n = board.n_squares
    if n > 256:  # table would be too large for a literal: always fall back
        return F.lit(-1)
    table = array_literal(tuple(board.canonical_pair_table), "tinyint")

    def body(t):
        a = F.element_at(t, 1).cast("int")
        b = F.element_at(t, 2).cast("int")
        ok = (F.size(t) >= 2) & a.between(0, n - 1) & b.between(0, n - 1)
        return F.when(ok, F.try_element_at(table, a * n + b + 1)).otherwise(F.lit(-1)).cast("int")
    return let(tour, body)


def canonical(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Lexicographically least image of the sequence (Spark orders arrays
    element by element, a proper prefix first), as one column expression.
    Prefer ``with_canonical`` on large data: it evaluates the deciding
    symmetry once per row instead of once per element."""
    t = _c(tour)
    return F.when(t.isNotNull(), F.array_min(tour_images(t, board)))


def with_canonical(df: DataFrame, tour: str = "tour", out: str = "canon",
                   board: Board = DEFAULT_BOARD, sym_out: str | None = None) -> DataFrame:
    """Add the canonical form of ``tour`` as column ``out``.

    For sequences whose first two squares decide the minimum (every legal
    sequence of length >= 2), a single image is computed from the
    (first, second) -> symmetry table; otherwise the minimum over all images."""
    k = "__canon_sym"
    t = F.col(tour)
    df = df.withColumn(k, canonical_symmetry(t, board))
    canon = (F.when(t.isNull(), F.lit(None).cast(TOUR_TYPE))
             .when(F.col(k) >= 0, tour_image_by(t, k, board))
             .otherwise(F.array_min(tour_images(t, board))))
    df = df.withColumn(out, canon)
    if sym_out:
        return df.withColumnRenamed(k, sym_out)
    return df.drop(k)


def canonical_full(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Reference form of ``canonical``: minimum over all images."""
    return F.array_min(tour_images(tour, board))


def tour_key(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Zero-padded squares joined by '-'; string order equals array order."""
    w = board.key_width
    known = F.expr("array(" + ",".join(f"'{p:0{w}d}'" for p in range(board.n_squares)) + ")")
    return F.concat_ws("-", F.transform(_c(tour), lambda p: F.coalesce(
        F.get(known, p.cast("int")), F.lpad(p.cast("string"), w, "0"))))


def key_prefix(key, k: int, board: Board = DEFAULT_BOARD) -> Column:
    """Key of the first ``k`` squares, cut from a full key."""
    return F.substring(_c(key), 1, k * (board.key_width + 1) - 1)


# ---- rule checks ---------------------------------------------------------

def in_board(p, board: Board = DEFAULT_BOARD) -> Column:
    return _c(p).between(0, board.n_squares - 1)


def is_step_arith(a, b, board: Board = DEFAULT_BOARD) -> Column:
    """a -> b is one move, by row/column arithmetic (any board size)."""
    a = _c(a).cast("int")
    b = _c(b).cast("int")
    dr = F.abs(row_of(a, board) - row_of(b, board))
    dc = F.abs(col_of(a, board) - col_of(b, board))
    cls = None
    for x, y in board.step_classes:
        term = (dr == x) & (dc == y)
        cls = term if cls is None else (cls | term)
    return in_board(a, board) & in_board(b, board) & cls


def is_step(a, b, board: Board = DEFAULT_BOARD) -> Column:
    """True iff a -> b is one move of the piece between squares on the board
    (one look-up in the rule-derived step table for boards up to 256 squares)."""
    n = board.n_squares
    if n > 256:
        return is_step_arith(a, b, board)
    a = _c(a).cast("int")
    b = _c(b).cast("int")
    # a row for each square; null for a square off the board
    table = nested_array_literal(tuple(tuple(board.step_table[p * n:p * n + n]) for p in range(n)), "boolean")
    return F.coalesce(F.get(F.get(table, a), b), F.lit(False))


def _steps(t: Column, board: Board) -> Column:
    """For every consecutive pair of ``t`` whether it is a move; empty if size < 2.  Both squares
    are lambda variables, so none is fetched from the sequence more than once."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: is_step(a, b, board))


def is_legal(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Every consecutive pair is a move (V-1); empty and single pass, null stays null."""
    return let(tour, lambda t: F.when(t.isNotNull(), ~F.array_contains(_steps(t, board), F.lit(False))))


def n_illegal_steps(tour, board: Board = DEFAULT_BOARD) -> Column:
    return let(tour, lambda t: F.when(t.isNotNull(), F.size(F.filter(_steps(t, board), lambda ok: ~ok))))


def first_illegal_step(tour, board: Board = DEFAULT_BOARD) -> Column:
    """1-based index of the first square reached by an illegal move, or null."""
    def body(t):
        at = F.array_position(_steps(t, board), F.lit(False))
        return F.when(at > 0, (at + 1).cast("int"))
    return let(tour, body)


def is_unique(tour) -> Column:
    """Non-empty and no square repeated (V-3); length is not checked."""
    return let(tour, lambda t: (F.size(t) > 0) & (F.size(F.array_distinct(t)) == F.size(t)))


def is_closed(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Last square is one move from the first (V-4); empty -> null."""
    return let(tour, lambda t: F.when(
        F.size(t) > 0,
        (F.size(t) >= 2) & is_step(F.element_at(t, 1), F.element_at(t, -1), board)))


def is_complete(tour, board: Board = DEFAULT_BOARD) -> Column:
    return F.size(_c(tour)) == board.n_squares


def all_in_board(tour, board: Board = DEFAULT_BOARD) -> Column:
    return F.forall(_c(tour), lambda p: in_board(p, board))


def is_valid_tour(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Legal and without repeats (the corpus acceptance rule)."""
    return is_legal(tour, board) & is_unique(tour)


def square_bit(square) -> Column:
    """BIGINT with only the bit of ``square`` set (squares 0..63)."""
    bits = tuple((1 << i) - (1 << 64) if i == 63 else (1 << i) for i in range(64))
    return F.element_at(array_literal(bits, "bigint"), _c(square).cast("int") + 1)


# ---- sets of squares for boards of any size: arrays of BIGINT words ----------

WORD = 64


def _bits() -> Column:
    return array_literal(tuple((1 << i) - (1 << 64) if i == 63 else 1 << i for i in range(WORD)), "bigint")


def no_squares(board: Board = DEFAULT_BOARD) -> Column:
    """The empty set of squares."""
    return F.array_repeat(F.lit(0).cast("long"), -(-board.n_squares // WORD))


def with_square(squares, square) -> Column:
    """``squares`` and ``square`` (a square of the board)."""
    q = _c(square).cast("int")
    return F.transform(_c(squares), lambda w, i: F.when(
        i == F.floor(q / WORD), w.bitwiseOR(F.element_at(_bits(), q % WORD + 1))).otherwise(w))


def has_square(squares, square) -> Column:
    q = _c(square).cast("int")
    word = F.element_at(_c(squares), F.floor(q / WORD).cast("int") + 1)
    return word.bitwiseAND(F.element_at(_bits(), q % WORD + 1)) != 0


def squares_of(path, board: Board = DEFAULT_BOARD) -> Column:
    """The set of the squares on a path."""
    return F.aggregate(_c(path), no_squares(board), with_square)


def free_degree(square, visited, board: Board = DEFAULT_BOARD) -> Column:
    """Number of moves from ``square`` to squares not in the ``visited`` bitmask."""
    masks = array_literal(tuple(board.neighbour_masks), "bigint")
    m = F.element_at(masks, _c(square).cast("int") + 1)
    return F.bit_count(m.bitwiseAND(F.bitwise_not(_c(visited))))


def onward_moves(tour, board: Board = DEFAULT_BOARD) -> Column:
    """Legal moves from the last square to squares not yet in ``tour`` (V-7)."""
    t = _c(tour)
    last = F.try_element_at(t, F.lit(-1)).cast("int")
    r = (last / board.width).cast("int")
    c = last % board.width
    cands = F.array(*[
        F.when((r + dr).between(0, board.height - 1) & (c + dc).between(0, board.width - 1),
               (r + dr) * board.width + (c + dc))
        for dr, dc in board.offsets])
    return F.filter(cands, lambda q: q.isNotNull() & ~F.array_contains(t, q.cast("tinyint")))
