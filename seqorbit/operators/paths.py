"""Distributed path expansion over the board (G-1..G-8, P-4).

Three forms, by how much state a seed needs:

* ``expand_levels`` (G-2/G-6): exhaustive simple-path expansion for a fixed
  number of levels; each level is one narrow ``explode`` of the legal,
  unvisited next squares (no join: the board is arithmetic).
* ``warnsdorff_complete`` (G-3): one path per seed, extended square by square
  with the fewest-onward-moves rule and a seeded hash tie-break.  Seeds are dealt
  out once, then a task walks a batch of them together with NumPy: linear in
  the number of seeds; any board.
* ``bounded_paths`` (G-4/G-5): the first ``per_seed`` full tours of every seed
  in degree order, by backtracking in rounds.  A round gives each open seed a
  budget of moves; what is not finished goes on in the next round from the
  node it stands at, and hard seeds are cut into branches for all tasks.  The
  first round, which ends most seeds, takes a batch of them together with NumPy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.board import (
    DEFAULT_BOARD, TOUR_TYPE, Board, array_literal, has_square, neighbour_lists, onward_moves, squares_of, with_square,
)
from ..session import materialize
from ..sources.tables import task_count


def _level_columns(df: DataFrame, path: str, levels: int, board: Board) -> DataFrame:
    """Add ``l1 … lL``: per row, the arrays of all simple continuations by
    exactly d moves, built level by level inside the row (at most 8**d
    paths per seed, the expansion bound)."""
    out = df.withColumn("l0", F.array(F.col(path)))
    for d in range(1, levels + 1):
        out = out.withColumn(f"l{d}", F.flatten(F.transform(
            f"l{d - 1}", lambda p: F.transform(onward_moves(p, board),
                                               lambda q: F.concat(p, F.array(q.cast("tinyint")))))))
    return out


def expand_levels(seeds: DataFrame, levels: int, path: str = "tour",
                  board: Board = DEFAULT_BOARD, keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """All simple continuations of each seed path by 1..``levels`` moves:
    ``(keep…, depth, path)``.  Every level is computed once per seed inside
    its row (narrow; no join, no shuffle, no recomputation of earlier
    levels); the output grows by up to 8x per level, so ``levels`` is the
    bound."""
    d = _level_columns(seeds.select(*keep, path), path, levels, board)
    def tag(k):
        return lambda p: F.struct(F.lit(k).alias("depth"), p.alias("path"))
    tagged = F.concat(*[F.transform(f"l{k}", tag(k)) for k in range(1, levels + 1)])
    return d.select(*keep, F.inline(tagged))


def count_levels(seeds: DataFrame, levels: int, path: str = "tour",
                 board: Board = DEFAULT_BOARD, keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """``(keep…, depth, n_paths)``: the number of simple continuations per
    depth, without materialising one row per path: a task expands a slice of its seeds
    together, level by level; the last level is counted only.  A seed that is empty or has a null or
    off-board square has none."""
    rows = seeds.select(*keep, F.col(path).alias("__path"))
    dealt = rows.repartition(task_count(seeds.sparkSession), *rows.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = _Squares(board)
        for b in batches:
            n = squares.count_levels(b.column(len(keep)), levels)
            row, depth = np.nonzero(n)
            yield pa.record_batch([*[c.take(pa.array(row)) for c in b.columns[:len(keep)]], pa.array(depth + 1, pa.int32()),
                                   pa.array(n[row, depth], pa.int64())], names=[*keep, "depth", "n_paths"])

    kept = T.StructType([rows.schema[i] for i in range(len(keep))])
    return dealt.mapInArrow(count, kept.add("depth", T.IntegerType()).add("n_paths", T.LongType()))


def count_by_states(seeds: DataFrame, levels: int, path: str = "tour", board: Board = DEFAULT_BOARD,
                    seed_id: str = "tour_id") -> DataFrame:
    """G-6: ``(seed_id, depth, n_paths)`` as ``count_levels`` gives it, by merging: partial
    paths that stand on one square and have visited the same squares have the same
    continuations, so a level holds one row for each (last square, visited squares) with
    the number of its paths, and seeds in the same state are expanded once.  All levels of a
    state stay in its partition (one shuffle); a level is a table in the shared folder.

    Seeds are legal paths without repeats on a board of any size."""
    last = F.try_element_at(path, F.lit(-1)).cast("int")
    own = seeds.where(F.size(path) > 0).select(F.col(seed_id), last.alias("last"), squares_of(path, board).alias("seen"))
    start = own.select("last", "seen").distinct().select(F.monotonically_increasing_id().alias("state"), "last", "seen")
    start = materialize(start, "states-0")
    level = start.repartition("state").withColumn("n", F.lit(1).cast("long"))
    counts = None
    near = neighbour_lists(board)
    for depth in range(1, levels + 1):
        free = F.filter(F.element_at(near, F.col("last") + 1), lambda q: ~has_square("seen", q))
        moved = level.select("state", "seen", "n", F.explode(free).alias("last")).select(
            "state", "last", with_square("seen", "last").alias("seen"), "n")
        level = moved.groupBy("state", "last", "seen").agg(F.sum("n").alias("n"))
        if depth < levels:
            level = materialize(level, f"states-{depth}")
        some = level.groupBy("state").agg(F.sum("n").alias("n_paths")).withColumn("depth", F.lit(depth))
        counts = some if counts is None else counts.unionByName(some)
    per = own.join(start, ["last", "seen"]).select(seed_id, "state")
    return per.join(counts, "state").select(seed_id, "depth", "n_paths")


class _Squares:
    """Paths of a batch as NumPy arrays: neighbours by square, ``n`` where there is none."""

    def __init__(self, board: Board):
        self.n = n = board.n_squares
        lists = [board.neighbours_of(p) for p in range(n)]
        self.near = np.full((n + 1, max([1, *map(len, lists)])), n, np.int32)
        for p, to in enumerate(lists):
            self.near[p, :len(to)] = to
        self.reach = np.zeros((n, n), np.float32)  # [q, p]: p is a neighbour of q
        for p, to in enumerate(lists):
            self.reach[to, p] = 1

    def read(self, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(squares, sizes, known)``: a row for each path, filled up with ``n``; ``n`` also for squares that
        are null or off the board; whether a path is there and has none of these."""
        flat = paths.flatten()
        size = pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.fill_null(flat, self.n).to_numpy(zero_copy_only=False).astype(np.int32)
        values = np.where((values < 0) | (values >= self.n), self.n, values)
        squares = np.full((len(size), max(self.n, int(size.max(initial=0)))), self.n, np.int32)
        squares[np.arange(squares.shape[1]) < size[:, None]] = values
        known = paths.is_valid().to_numpy(zero_copy_only=False) & ((squares != self.n).sum(axis=1) == size)
        return squares, size, known

    def visited(self, squares: np.ndarray) -> np.ndarray:
        """``[row, square]``; the square ``n`` counts as visited."""
        seen = np.zeros((len(squares), self.n + 1), bool)
        seen[:, self.n] = True
        seen[np.arange(len(squares))[:, None], squares] = True
        return seen

    def count_levels(self, paths: pa.Array, levels: int) -> np.ndarray:
        """``[path, depth - 1]``: simple continuations of each path by exactly ``depth`` moves."""
        out = np.zeros((len(paths), levels), np.int64)
        at_once = max(1, 2**21 // 8**min(levels, 7))
        for first in range(0, len(paths), at_once):
            squares, size, known = self.read(paths.slice(first, at_once))
            seen = self.visited(squares)
            row = np.flatnonzero(known & (size > 0))
            added = squares[row, size[row] - 1][:, None]  # the last square and the moves since
            for d in range(levels):
                to = self.near[added[:, -1]]
                free = ~seen[row[:, None], to]
                for k in range(1, d + 1):
                    free &= to != added[:, k, None]
                out[first:first + at_once, d] = np.bincount(row, free.sum(axis=1), len(size))
                if d + 1 < levels:
                    path, way = np.nonzero(free)
                    row, added = row[path], np.concatenate([added[path], to[path, way][:, None]], axis=1)
        return out

    def warnsdorff(self, keys: list, paths: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All paths walked on together, a move each at a time: ``(squares, sizes, known)`` as ``read`` gives them."""
        n = self.n
        squares, size, known = self.read(paths)
        seen = self.visited(squares)
        free_near = ((~seen[:, :n]).astype(np.float32) @ self.reach).astype(np.int32)
        free_near = np.concatenate([free_near, np.zeros((len(size), 1), np.int32)], axis=1)
        head = [(f"{seed}:" if k is None else f"{seed}:{k}:").encode() for k in keys]
        tail = [[f"{i}:{q}".encode() for q in range(n)] for i in range(n)]
        row = np.flatnonzero(known & (size > 0) & (size < n))
        while len(row):
            to = self.near[squares[row, size[row] - 1]]
            open_ = ~seen[row[:, None], to]
            some = open_.any(axis=1)
            row, to, open_ = row[some], to[some], open_[some]
            degree = np.where(open_, free_near[row[:, None], to], n + 1)
            least = degree == degree.min(axis=1, initial=n + 1, keepdims=True)
            way = least.argmax(axis=1)
            tied = np.flatnonzero(least.sum(axis=1) > 1)
            at, ways = np.nonzero(least[tied])
            best = [b"\xff" * 17] * len(tied)
            choice = way[tied]
            many = row[tied]
            for i, w, r, s, q in zip(at.tolist(), ways.tolist(), many[at].tolist(), size[many[at]].tolist(),
                                     to[tied[at], ways].tolist()):
                h = hashlib.md5(head[r] + tail[s][q]).digest()
                if h < best[i]:
                    best[i], choice[i] = h, w
            way[tied] = choice
            q = to[np.arange(len(row)), way]
            squares[row, size[row]] = q
            seen[row, q] = True
            free_near[row[:, None], self.near[q]] -= 1  # the filling ``n`` is never a candidate
            size[row] += 1
            row = row[size[row] < n]
        return squares, size, known


def warnsdorff_complete(seeds: DataFrame, path: str = "tour", seed: int = 42,
                        board: Board = DEFAULT_BOARD,
                        keep: tuple[str, ...] = ("tour_id",)) -> DataFrame:
    """G-3: extend every seed path to a full tour by the fewest-onward-moves
    rule; ties go to the smallest md5 of ``seed:id:squares so far:square``.  A walk
    that reaches a square with no free neighbour stops (``complete`` false),
    as the reference drops such dead ends.

    Seeds are dealt out to all tasks first (a small table of keys is one task's, the work is in
    the moves), then a task walks a batch of them together.  A seed with a null or off-board
    square is not walked; a null one has a null ``complete``.

    Output: ``(keep…, path, complete)``."""
    n = board.n_squares
    square = "tinyint" if n <= 128 else "int"
    key = (F.col(keep[0]) if keep else F.lit(0)).cast("string")
    rows = seeds.select(*keep, key.alias("__key"), F.col(path).cast(f"array<{square}>").alias("__path"))
    dealt = rows.repartition(task_count(seeds.sparkSession), "__key", "__path")
    kind = pa.int8() if n <= 128 else pa.int32()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        board_squares = _Squares(board)
        for b in batches:
            paths = b.column(len(keep) + 1)
            squares, size, known = board_squares.warnsdorff(b.column(len(keep)).to_pylist(), paths, seed)
            there = paths.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.where(known, size, 0))]).astype(np.int32)
            walked = squares[(np.arange(squares.shape[1]) < size[:, None]) & known[:, None]]
            full = pa.ListArray.from_arrays(pa.array(ends), pa.array(walked, kind))
            if not known.all():  # these stay as they are
                full = pc.if_else(pa.array(known), full, paths.cast(full.type))
            yield pa.record_batch([*b.columns[:len(keep)], full, pa.array(size == n, mask=~there)], names=[*keep, "path", "complete"])

    kept = T.StructType([rows.schema[i] for i in range(len(keep))])
    squares_type = T.ArrayType(T.ByteType() if n <= 128 else T.IntegerType())
    return dealt.mapInArrow(walk, kept.add("path", squares_type).add("complete", T.BooleanType()))


def quadrant(board: Board = DEFAULT_BOARD) -> list[int]:
    """The squares of the upper left quarter: every start up to symmetry."""
    return [r * board.width + c for r in range((board.height + 1) // 2) for c in range((board.width + 1) // 2)]


def start_seeds(keys: DataFrame, squares: list[int] | None = None, board: Board = DEFAULT_BOARD) -> DataFrame:
    """G-1: for each row of ``keys`` one seed path for each of ``squares`` (all by default):
    its columns, ``start`` and ``tour``, the path of that square alone."""
    squares = list(range(board.n_squares)) if squares is None else squares
    rows = keys.withColumn("start", F.explode(array_literal(tuple(squares), "int")))
    return rows.withColumn("tour", F.array("start").cast(TOUR_TYPE if board.n_squares <= 128 else "array<int>"))


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class _Search:
    """Backtracking over one board, squares as bits of a Python integer (any size).
    ``thorough`` tests a node harder before it branches; it finds the same tours."""

    def __init__(self, board: Board, seed: int, order: str, thorough: bool):
        n, w = board.n_squares, board.width
        self.n, self.seed, self.order, self.thorough = n, seed, order, thorough
        self.moves, self.near, self.shifts = [], [0] * n, []
        for p in range(n):
            to = [(k, p + dr * w + dc) for k, (dr, dc) in enumerate(board.offsets)
                  if 0 <= p // w + dr < board.height and 0 <= p % w + dc < w]
            self.moves.append(to)
            self.near[p] = sum(1 << q for _, q in to)
        for k, (dr, dc) in enumerate(board.offsets):
            keep = sum(1 << p for p in range(n) if any(k == j for j, _ in self.moves[p]))
            self.shifts.append((keep, dr * w + dc))
        self.both_ways = {(-a, -b) for a, b in board.offsets} == set(board.offsets)
        self.flips = all((a + b) % 2 for a, b in board.offsets)  # every move changes the colour
        self.odd = sum(1 << p for p in range(n) if (p // w + p % w) % 2)

    def _hopeless(self, free: int, head: int) -> bool:
        """A free square that no move enters, or two that must both be the last."""
        source, once, twice = free | 1 << head, 0, 0
        for keep, by in self.shifts:
            to = (source & keep) << by if by >= 0 else (source & keep) >> -by
            twice |= once & to
            once |= to
        ends = free & once & ~twice
        return bool(free & ~once) or (self.both_ways and bool(ends & (ends - 1)))

    def _no_circuit(self, free: int, head: int) -> bool:
        """No tour by forced steps: with a square x between head and last square the tour
        is a circuit; a square with two neighbours left takes both, one with two taken
        loses the others, and no step closes a smaller circuit."""
        x, total = self.n, free.bit_count() + 2
        last = free
        if self.flips:
            last &= self.odd if ((self.odd >> head & 1) + total) % 2 else ~self.odd
        live = free | 1 << head
        adj = {v: self.near[v] & live | (last >> v & 1) << x for v in _bits(free)}
        adj[head], adj[x] = self.near[head] & free | 1 << x, last | 1 << head
        taken, tail = dict.fromkeys(adj, 0), {v: v for v in adj}
        queue, steps = list(adj), 0

        def drop(a, b):
            adj[a] &= ~(1 << b)
            adj[b] &= ~(1 << a)
            queue.extend((a, b))

        def take(a, b):
            nonlocal steps
            if taken[a] >> b & 1:
                return True
            if not adj[a] >> b & 1 or (tail[a] == b and steps < total - 1):
                return False
            taken[a] |= 1 << b
            taken[b] |= 1 << a
            steps += 1
            s, t = tail[a], tail[b]
            tail[s], tail[t] = t, s
            for v in (a, b):
                if taken[v].bit_count() == 2:
                    for u in _bits(adj[v] & ~taken[v]):
                        drop(v, u)
            if steps < total - 1 and adj[s] >> t & 1 and not taken[s] >> t & 1:
                drop(s, t)
            return True

        if not take(head, x):
            return True
        while queue:
            v = queue.pop()
            degree = adj[v].bit_count()
            if degree < 2 or (degree == 2 and not all(take(v, u) for u in _bits(adj[v] & ~taken[v]))):
                return True
        return False

    def _ranked(self, sid, path: list, free: int) -> list:
        """``(ordinal, degree, square)`` of all free next squares, best last.  The ordinal
        does not depend on what is pruned, so ordinals along a path are its depth-first rank."""
        near = [(k, q, (self.near[q] & free).bit_count()) for k, q in self.moves[path[-1]] if free >> q & 1]
        degrees = [d for _, _, d in near]
        ranked = []
        for k, q, d in near:
            tie = k
            if self.order != "offset":  # a tie needs a hash only where a degree is shared
                tie = "" if degrees.count(d) == 1 else hashlib.md5(f"{self.seed}:{sid}:{len(path)}:{q}".encode()).hexdigest()
            ranked.append((d, tie, q))
        return [(i, d, q) for i, (d, _, q) in enumerate(sorted(ranked))][::-1]

    def _options(self, sid, path: list, free: int) -> list:
        """``(ordinal, square)`` of the next squares worth trying, best last."""
        if len(path) == self.n or self._hopeless(free, path[-1]):
            return []
        if self.thorough and self.both_ways and self._no_circuit(free, path[-1]):
            return []
        return [(i, q) for i, d, q in self._ranked(sid, path, free) if d or len(path) + 1 == self.n]

    def advance(self, sid, start: list, base: int, at: list, want: int, budget: int, split: bool):
        """Goes on below ``at[:base]`` from node ``at`` for ``budget`` moves, or until
        ``want`` paths: (paths as (rank, path), open branches as (base, at, rank of at[:base])).
        What is left is one branch, or with ``split`` one for each untried sibling."""
        path, rank, out = list(start), [], []
        free = (1 << self.n) - 1
        for p in path:
            free &= ~(1 << p)

        def go(i, q):
            nonlocal free
            path.append(q)
            rank.append(i)
            free &= ~(1 << q)

        for q in at[len(start):base]:
            go(next(i for i, _, x in self._ranked(sid, path, free) if x == q), q)
        todo = [self._options(sid, path, free)]
        for q in at[base:]:
            if not any(x == q for _, x in todo[-1]):
                todo[-1] = []
                break  # a harder test than in the round before: nothing below this node
            while todo[-1][-1][1] != q:
                todo[-1].pop()
            go(*todo[-1].pop())
            todo.append(self._options(sid, path, free))
        fresh = True  # no move from the last square was tried yet
        while True:
            if len(path) == self.n:
                out.append((list(rank), list(path)))
                if len(out) >= want:
                    return out, []
            if todo[-1]:
                if budget <= 0 and fresh:
                    break
                go(*todo[-1].pop())
                todo.append(self._options(sid, path, free))
                budget, fresh = budget - 1, True
            elif len(path) == base:
                return out, []
            else:
                todo.pop()
                rank.pop()
                free |= 1 << path.pop()
                fresh = False
        if not split:
            return out, [(base, list(path), rank[:base - len(start)])]
        parts = []
        for depth, waiting in enumerate(todo, base):
            parts += [(depth + 1, [*path[:depth], q], [*rank[:depth - len(start)], i]) for i, q in waiting]
        return out, parts


class _BatchSearch:
    """The first round for a batch of seeds: each goes on depth first by ``_Search``'s order and
    test, all of them a move at a time.  For pieces that can take every move back."""

    def __init__(self, board: Board, seed: int, order: str):
        self.squares, self.n, self.seed, self.order = _Squares(board), board.n_squares, seed, order
        # by the number of the move, ``n`` where it leaves the board
        self.near = np.full((self.n + 1, len(board.offsets)), self.n, np.int32)
        for p, to in enumerate(_Search(board, seed, order, False).moves):
            for k, q in to:
                self.near[p, k] = q
        self.tail = [[f"{i}:{q}".encode() for q in range(self.n)] for i in range(self.n)]

    def _ties(self, rows: np.ndarray, size: np.ndarray, to: np.ndarray, degree: np.ndarray, head: list) -> list:
        """Sort keys below the degree: both halves of the md5 where a degree is shared."""
        shared = ((degree[:, :, None] == degree[:, None, :]).sum(axis=2) > 1) & (degree <= self.n)
        at, way = np.nonzero(shared)
        sums = [hashlib.md5(head[r] + self.tail[s][q]).digest()
                for r, s, q in zip(rows[at].tolist(), size[at].tolist(), to[at, way].tolist())]
        halves = np.zeros((2, *to.shape), np.uint64)
        halves[:, at, way] = np.frombuffer(b"".join(sums), ">u8").reshape(-1, 2).T
        return [halves[1], halves[0]]

    def advance(self, keys: list, paths: pa.Array, want: np.ndarray, budget: int):
        """Up to ``want`` tours of each seed in ``budget`` moves: (rows of the tours found, in the order of
        each row, their squares, whether a row is still open, the squares and sizes of the nodes that rows stand at)."""
        n, near = self.n, self.near
        squares, size, _ = self.squares.read(paths)
        seen = self.squares.visited(squares)
        free_near = np.zeros(seen.shape, np.int16)
        free_near[:, :n] = (~seen[:, :n]).astype(np.float32) @ self.squares.reach
        head = [f"{self.seed}:{k}:".encode() for k in keys]
        base, left, moves = size.copy(), want.copy(), np.zeros(len(size), np.int64)
        options = np.full((len(size), n + 1, near.shape[1]), n, np.int16)  # next squares by size of the path, best first
        count, tried = np.zeros((2, len(size), n + 1), np.int16)
        open_ = np.zeros(len(size), bool)
        found = [np.flatnonzero((size == n) & (want > 0))]
        tours = [squares[found[0], :n]]

        def enter(rows: np.ndarray) -> None:
            """The options of the nodes that ``rows`` stand at."""
            last = squares[rows, size[rows] - 1]
            count[rows, size[rows]] = tried[rows, size[rows]] = 0
            enters = free_near[rows]
            enters[np.arange(len(rows))[:, None], near[last]] += 1
            enters = np.where(seen[rows], n + 1, enters)  # squares from which a free square can be entered
            some = (enters.min(axis=1, initial=n + 1) > 0) & ((enters == 1).sum(axis=1) < 2)  # as ``_Search._hopeless``
            rows, to, enters = rows[some], near[last[some]], enters[some]
            s = size[rows]
            degree = enters[np.arange(len(rows))[:, None], to] - 1  # ``n`` for squares that are not free
            degree = np.where((degree < n) & ((degree > 0) | (s == n - 1)[:, None]), degree, n + 1)
            count[rows, s] = (degree <= n).sum(axis=1)
            way = np.argsort(degree, axis=1, kind="stable")
            if self.order != "offset":
                by = np.take_along_axis(degree, way, axis=1)
                tied = np.flatnonzero(((by[:, 1:] == by[:, :-1]) & (by[:, 1:] <= n)).any(axis=1))
                if len(tied):
                    way[tied] = np.lexsort([*self._ties(rows[tied], s[tied], to[tied], degree[tied], head), degree[tied]], axis=1)
            options[rows, s] = np.take_along_axis(to, way, axis=1)

        live = np.flatnonzero((size < n) & (want > 0))
        enter(live)
        while len(live):
            more = tried[live, size[live]] < count[live, size[live]]
            go, back = live[more], live[~more]
            back = back[size[back] > base[back]]  # the others are searched to the end
            size[back] -= 1
            q = squares[back, size[back]]
            squares[back, size[back]] = n
            seen[back, q] = False
            free_near[back[:, None], near[q]] += 1
            s = size[go]
            q = options[go, s, tried[go, s]]
            tried[go, s] += 1
            squares[go, s] = q
            seen[go, q] = True
            free_near[go[:, None], near[q]] -= 1
            size[go] += 1
            moves[go] += 1
            ends = size[go] == n
            done, go = go[ends], go[~ends]
            found.append(done)
            tours.append(squares[done, :n])
            left[done] -= 1
            over = moves[go] >= budget
            open_[go[over]] = True
            go = go[~over]
            enter(go)
            live = np.concatenate([back, done[left[done] > 0], go])
        return np.concatenate(found), np.concatenate(tours), open_, squares, size


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list of the first ``sizes`` values of each row."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = values[np.arange(values.shape[1]) < sizes[:, None]]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


#: Moves of a branch in one round once a round has fewer branches than task slots.
SPLIT_BUDGET = 20_000


def bounded_paths(seeds: DataFrame, per_seed: int | Column, path: str = "tour", seed: int = 42, board: Board = DEFAULT_BOARD,
                  seed_id: str = "tour_id", order: str = "md5", budget: int = 300, split_budget: int = SPLIT_BUDGET) -> DataFrame:
    """G-4/G-5/O-6: ``(seed_id, path)``, the first ``per_seed`` (a number, or a column) full
    tours that extend each seed, or all if there are fewer, in depth-first order: at every
    square by the fewest onward moves, ties by the md5 of ``seed:id:squares so far:square`` (``order``
    "md5", O-4) or by the number of the move (``"offset"``, O-5).

    While there are more open seeds than task slots, a seed is one row: a round advances it
    by ``budget`` moves (four times as many in each later round, which also tests nodes
    harder; the first takes the seeds of a batch together), and what is open is dealt out again with the node it stands at.  When fewer are left,
    they are cut into branches, one row for a node's untried sibling, so that one hard seed
    is searched by all tasks.  A branch carries its depth-first rank (an array of ordinals):
    the branches of least rank go first, and those beyond the rank of a seed's last wanted tour are
    dropped, so the result depends neither on the budgets nor on the splitting.

    Branches are cut only where no full tour exists.  Null, empty, repeating and off-board
    seeds have no tour; a full seed is its own.  Ids should be unique."""
    n = board.n_squares
    kind = seeds.schema[seed_id].dataType.simpleString()
    usable = (F.size(path) > 0) & (F.size(F.array_distinct(path)) == F.size(path)) & F.forall(
        F.col(path), lambda p: p.isNotNull() & p.between(0, n - 1))
    start = F.col(path).cast("array<int>")
    wanted = F.lit(per_seed) if isinstance(per_seed, int) else per_seed
    todo = seeds.where(usable & (wanted > 0)).select(
        F.monotonically_increasing_id().alias("key"), F.col(seed_id).alias("sid"), start.alias("start"), F.size(path).alias("base"), start.alias("at"),
        F.array().cast("array<int>").alias("rank"), wanted.cast("int").alias("want"))
    parts = task_count(seeds.sparkSession)
    ints = pa.list_(pa.int32())
    found_type = pa.list_(pa.struct([("rank", ints), ("path", ints)]))
    open_type = pa.list_(pa.struct([("base", pa.int32()), ("at", ints), ("rank", ints)]))

    def round_of(budget: int, thorough: bool, split: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _Search(board, seed, order, thorough)
            for b in batches:
                want = b.column(5).to_pylist()
                got = [search.advance(i, s, x, a, w, budget, split)
                       for i, s, x, a, w in zip(*[b.column(c).to_pylist() for c in (1, 2, 3, 4)], want)]
                yield pa.record_batch([
                    b.column(0), b.column(1), b.column(2), pa.array([w - len(f) for w, (f, _) in zip(want, got)], pa.int32()),
                    pa.array([[{"rank": r, "path": p} for r, p in f] for f, _ in got], found_type),
                    pa.array([[{"base": x, "at": y, "rank": z} for x, y, z in left] for _, left in got], open_type)],
                    names=["key", "sid", "start", "want", "found", "open"])
        return run

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _BatchSearch(board, seed, order)
        for b in batches:
            want = b.column(3).to_numpy().astype(np.int64)
            rows, tours, open_, squares, size = search.advance(b.column(1).to_pylist(), b.column(2), want, budget)
            by = np.argsort(rows, kind="stable")
            ends, tours = np.bincount(rows, minlength=len(want)), tours[by]
            none, at = np.zeros(len(by), np.int64), np.flatnonzero(open_)
            found = pa.StructArray.from_arrays([_lists(tours, none), _lists(tours, none + n)], names=["rank", "path"])
            nodes = pa.StructArray.from_arrays([
                pc.list_value_length(b.column(2)).take(pa.array(at)), _lists(squares[at], size[at]),
                _lists(squares[at], np.zeros(len(at), np.int64))], names=["base", "at", "rank"])
            yield pa.record_batch([
                b.column(0), b.column(1), pc.if_else(pa.array(open_), b.column(2), pa.scalar(None, b.column(2).type)),
                pa.array(want - ends, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]), pa.int32()), found),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(open_)]), pa.int32()), nodes)],
                names=["key", "sid", "start", "want", "found", "open"])

    schema = (f"key long, sid {kind}, start array<int>, want int, found array<struct<rank array<int>, path array<int>>>, "
              "open array<struct<base int, at array<int>, rank array<int>>>")

    def advance(rows: DataFrame, *how) -> DataFrame:
        # dealt into a fixed number of tasks: the work is in the moves, not in the bytes
        dealt = rows.select("key", "sid", "start", "base", "at", "want", "rank").repartition(parts, "key", "rank")
        return materialize(dealt.mapInArrow(round_of(*how), schema), "paths-round")

    def tours_of(step: DataFrame) -> DataFrame:
        return step.select("key", "sid", F.inline("found"))

    def still_open(step: DataFrame) -> DataFrame:
        return step.select("key", "sid", "start", F.inline("open"), "want")

    both_ways = {(-a, -b) for a, b in board.offsets} == set(board.offsets)
    out, first = None, True
    while True:
        if first and both_ways:
            dealt = todo.select("key", "sid", "start", "want").repartition(parts, "key")
            step = materialize(dealt.mapInArrow(first_round, schema), "paths-round")
        else:
            step = advance(todo, budget, not first, False)
        out = tours_of(step) if out is None else out.unionByName(tours_of(step))
        todo, first = still_open(step), False
        left = todo.count()
        if left < parts:
            break
        budget *= 4
    if left:
        out = _split_search(out, todo, advance, tours_of, still_open, split_budget, parts)
    full = out.select(F.col("sid").alias(seed_id), "path")
    return full.withColumn("path", F.col("path").cast(TOUR_TYPE if n <= 128 else "array<int>"))


def _split_search(out: DataFrame, todo: DataFrame, advance, tours_of, still_open, budget: int, parts: int) -> DataFrame:
    """Finishes fewer open seeds than task slots, branch by branch: all found ``(key, sid, rank, path)``."""
    hard = materialize(todo.select("key", F.col("want").alias("wanted")), "paths-hard")  # fewer rows than slots
    found = None
    by_rank = Window.partitionBy("key").orderBy("rank")
    while True:
        seeds, rows = todo.agg(F.count_distinct("key"), F.count("*")).first()
        if not rows:
            break
        # branches of least rank first; the others wait as rows
        share = max(1, 2 * parts // seeds)
        ranked = todo.withColumn("nth", F.row_number().over(by_rank))
        step = advance(ranked.where(F.col("nth") <= share), budget, True, rows < 4 * parts)
        todo = still_open(step).unionByName(ranked.where(F.col("nth") > share).drop("nth"))
        new = tours_of(step)
        found = new if found is None else found.unionByName(new)
        kept = found.join(F.broadcast(hard), "key").withColumn("nth", F.row_number().over(by_rank))
        kept = materialize(kept.where("nth <= wanted"), "paths-found")
        cut = kept.where("nth = wanted").select("key", F.col("rank").alias("cut"))  # at most one for each open seed
        found = kept.select("key", "sid", "rank", "path")
        todo = todo.join(F.broadcast(cut), "key", "left").where("cut IS NULL OR rank < cut").drop("cut")
        todo = materialize(todo, "paths-open")
    return out.unionByName(found) if found is not None else out
