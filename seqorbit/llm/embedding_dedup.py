"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are rotated to principal dimensions (a covariance summed by Spark, one
d x d matrix).  A cosine of at least t means a distance of at most
eps = sqrt(2 - 2t), also in any projection.  Vectors are sorted by their grid cells
of width eps on the leading dimensions, the sorted sequence is cut into blocks with
bounding boxes, and only pairs of blocks whose boxes are within eps meet.  Runs of
blocks form stripes, and a pair of stripes (a tile) is one task's work: it gets each
block that a pair needs once.  Tiles go in waves, so that what is under way at once
stays in proportion to the vectors.  Inside a tile the two sequence intervals are
halved recursively, skipping provably distant halves, down to intervals that one
matrix product compares.

Equal vectors are one node with a multiplicity.  A task reports link counts and a
spanning forest, never its pairs.  Vectors are stored and sent as they were given,
in their own precision; a task makes them unit vectors of doubles again.

Defined results: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing; vectors of different length never link; rows that
repeat an id count as vectors of their own; a null id is never the name of a
component that has an id; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, stage
from .minhash_dedup import Forest, _runs

BLOCK = 1024
LEAF = 512
DTYPE = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}
#: Leading dimensions of the grid, and of the bounding boxes.
GRID_DIMS = 4
BOX_DIMS = 16
#: Components of the vectors of a stripe, at most (but for one block).
STRIPE_VALUES = 1 << 22
#: Vectors of a stripe, at least, if stripes are made smaller to keep all cores busy.
STRIPE_ROWS = 4096
#: Tiles for each core, if stripes are made smaller.
CORE_TILES = 4
#: Components that a wave may send if all vectors twice are less.
WAVE_VALUES = 1 << 26
SLACK = 1e-9
#: Of the bound on a cosine, which is computed in single precision.
BOUND_SLACK = 1e-5
#: Intervals with more than one in so many pairs to confirm are compared in full.
DENSE = 32


def _kind(vectors: DataFrame, vec_col: str) -> str:
    """The element type in which vectors are stored."""
    return "float" if vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "double"


def _normal(a: np.ndarray) -> np.ndarray:
    """The rows (finite, not zero) as unit vectors."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _rows(a: np.ndarray) -> list[bytes]:
    data, size = a.tobytes(), a.shape[1] * a.itemsize
    return [data[i:i + size] for i in range(0, len(data), size)]


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, node, vec)`` per row; node is null for a vector that cannot link.  ``vec``
    has the components as they were given, node is a hash of the unit vector."""
    kind = _kind(vectors, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(DTYPE[kind], copy=False)  # null as NaN
            begin = np.cumsum(size) - size
            nodes, vecs = [None] * b.num_rows, [None] * b.num_rows
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                given = flat[begin[at][:, None] + np.arange(n)]
                sound = np.isfinite(given).all(axis=1) & given.any(axis=1)
                at, given = at[sound], given[sound]
                if len(at):
                    for i, unit, own in zip(at.tolist(), _rows(_normal(given.astype(np.float64))), _rows(given)):
                        nodes[i] = int.from_bytes(hashlib.md5(unit).digest()[:8], "little", signed=True)
                        vecs[i] = own
            yield pa.record_batch([b.column(0), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())],
                                  names=["vec_id", "node", "vec"])

    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    return src.mapInArrow(run, "vec_id long, node long, vec binary")


def _unit(column, width: int, kind: str) -> np.ndarray:
    """Rows of the column as unit vectors of doubles, padded with zeros to ``width``."""
    raw, size = column.to_pylist(), width * DTYPE[kind].itemsize
    if not all(len(x) == size for x in raw):
        raw = [x.ljust(size, b"\0") for x in raw]
    return _normal(np.frombuffer(b"".join(raw), DTYPE[kind]).reshape(len(raw), width).astype(np.float64))


def principal_axes(nodes: DataFrame, width: int, n: int, kind: str) -> np.ndarray:
    """The leading axes (columns) of all vectors' covariance."""
    def sums(batches):
        total, some = np.zeros((width + 1, width)), False
        for b in batches:
            if b.num_rows:
                u = _unit(b.column(0), width, kind)
                total[:width] += u.T @ u
                total[width] += u.sum(axis=0)
                some = True
        if some:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    few = nodes.select("vec").coalesce(nodes.sparkSession.sparkContext.defaultParallelism)  # a matrix from each task
    parts = few.mapInArrow(sums, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((width + 1, width))
    for i, j, x in parts.collect():  # width * (width + 1) numbers
        total[i, j] = x
    mean = total[width] / n
    _, axes = np.linalg.eigh(total[:width] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :min(BOX_DIMS, width)].copy()


def grid_blocks(own: Scratch, nodes: DataFrame, axes: np.ndarray, eps: float, width: int, kind: str) -> DataFrame:
    """``(block, node, m, vec_id, vec)``: vectors in epsilon grid order, cut into blocks.
    Frees ``nodes``."""
    dims = min(GRID_DIMS, axes.shape[1])

    def project(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cells = np.floor(_unit(b.column(3), width, kind) @ axes[:, :dims] / eps).astype(np.int32)
            yield pa.record_batch([*b.columns, *[pa.array(cells[:, i]) for i in range(dims)]],
                                  names=["node", "m", "vec_id", "vec", *[f"c{i}" for i in range(dims)]])

    cells = [f"c{i}" for i in range(dims)]
    placed = stage(nodes.select("node", "m", "vec_id", "vec").mapInArrow(
        project, "node long, m long, vec_id long, vec binary, " + ", ".join(f"{c} int" for c in cells)), "ego-cells")
    own.drop(nodes)

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = (np.int64(part) << 32) + (seen + np.arange(b.num_rows)) // BLOCK
            seen += b.num_rows
            yield pa.record_batch([pa.array(ids), *b.columns[:4]], names=["block", "node", "m", "vec_id", "vec"])

    ordered = placed.repartitionByRange(*cells, "node").sortWithinPartitions(*cells, "node")
    blocks = stage(ordered.mapInArrow(cut, "block long, node long, m long, vec_id long, vec binary"), "ego-blocks")
    own.drop(placed)
    return blocks


def block_boxes(blocks: DataFrame, axes: np.ndarray, width: int, kind: str) -> DataFrame:
    """``(block, lo0.., hi0..)``: the bounding box of each block on the box axes."""
    dims = axes.shape[1]
    ends = [*[f"lo{i}" for i in range(dims)], *[f"hi{i}" for i in range(dims)]]

    def bound(batches):
        for b in batches:
            if b.num_rows:
                p, ids = _unit(b.column(1), width, kind) @ axes, b.column(0).to_numpy()
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                box = np.hstack([np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)])
                yield pa.record_batch([pa.array(ids[first]), *[pa.array(x) for x in box.T]], names=["block", *ends])

    found = blocks.select("block", "vec").mapInArrow(bound, "block long, " + ", ".join(f"{c} double" for c in ends))
    return stage(found.groupBy("block").agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends]), "ego-boxes")


def striped(box: DataFrame, n: int, width: int) -> tuple[DataFrame, int, int]:
    """``box`` with the ``stripe`` of each block, a run of the sequence; the number of
    stripes and of blocks."""
    spark = box.sparkSession
    per = box.groupBy(F.shiftright("block", 32).alias("part")).count().orderBy("part").collect()  # a row for each partition
    first, total = [], 0
    for part, count in per:
        first.append((part, total))
        total += count
    cores = spark.sparkContext.defaultParallelism
    busy = math.ceil(math.sqrt(2 * CORE_TILES * cores)) - 1  # so many stripes have about that many pairs
    stripes = max(math.ceil(total / max(1, STRIPE_VALUES // width // BLOCK)), min(total, math.ceil(n / STRIPE_ROWS), busy))
    rank = F.col("first") + F.col("block").bitwiseAND((1 << 32) - 1)
    starts = spark.createDataFrame(first, "part long, first long")
    with_rank = box.join(F.broadcast(starts), F.shiftright("block", 32) == F.col("part"))
    return with_rank.withColumn("stripe", F.floor(rank * stripes / total).cast("long")).drop("part", "first"), stripes, total


def block_pairs(box: DataFrame, eps: float, dims: int) -> DataFrame:
    """``(a, b, x, y)`` with a <= b: blocks whose boxes are at most eps apart, and their stripes.
    A block meets the boxes of stripes first, then the blocks of those that are near."""
    def prefixed(d, prefix, **names):
        return d.withColumnsRenamed({f"{x}{i}": f"{prefix}{x}{i}" for x in ("lo", "hi") for i in range(dims)} | names)

    def near(prefix):
        gap = None
        for i in range(dims):
            d = F.greatest(F.col(f"lo{i}") - F.col(f"{prefix}hi{i}"), F.col(f"{prefix}lo{i}") - F.col(f"hi{i}"), F.lit(0.0))
            gap = d * d if gap is None else gap + d * d
        return gap <= (eps + SLACK) ** 2

    # in order of the sequence, so that a task has few stripes x
    left = box.repartitionByRange(CORE_TILES * box.sparkSession.sparkContext.defaultParallelism, "block")
    left = left.withColumnsRenamed({"block": "a", "stripe": "x"})
    around = box.groupBy("stripe").agg(*[f(f"{x}{i}").alias(f"{x}{i}") for x, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)])
    met = left.join(F.broadcast(prefixed(around, "s", stripe="y")), F.expr("x <= y") & near("s"))
    met = met.select("a", "x", "y", *[f"{x}{i}" for x in ("lo", "hi") for i in range(dims)])
    # a row for each block: a thousandth of the vectors
    met = met.join(F.broadcast(prefixed(box, "r", block="b", stripe="y")), "y")
    return met.where("a <= b").where(near("r")).select("a", "b", "x", "y")


def tile_blocks(pairs: DataFrame) -> DataFrame:
    """``(x, y, side, block)``: the blocks that each tile needs, once each; side is 1 in
    stripe y of a tile of two stripes."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")),
                   F.struct((F.col("x") < F.col("y")).cast("int").alias("side"), F.col("b").alias("block")))
    return stage(pairs.select("x", "y", F.explode(ends).alias("e")).select("x", "y", "e.side", "e.block").distinct(), "ego-tiles")


def waves(needed: DataFrame, total: int, values: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of x, and how many tiles they have: as many as send all blocks (with so many
    ``values``) twice, or ``WAVE_VALUES``.  One x alone never sends more than all blocks twice."""
    most = total * max(2.0, WAVE_VALUES / values)
    # a row for each stripe
    per = needed.groupBy("x", "y").count().groupBy("x").agg(F.sum("count").alias("blocks"), F.count("*").alias("tiles"))
    start, blocks, tiles, last = None, 0, 0, None
    for x, more, n in per.orderBy("x").collect():
        if start is not None and blocks + more > most:
            yield start, last, tiles
            start, blocks, tiles = None, 0, 0
        start, last, blocks, tiles = x if start is None else start, x, blocks + more, tiles + n
    if start is not None:
        yield start, last, tiles


class Interval:
    """A run of the sorted sequence with its vectors, projections, bounds and multiplicities."""

    def __init__(self, u, p, bound, m, dim, at=0):
        self.u, self.p, self.bound, self.m, self.dim, self.at = u, p, bound, m, dim, at
        self.lo, self.hi = p.min(axis=0), p.max(axis=0)
        self._halves = None

    def halves(self):
        if self._halves is None:
            h = len(self.u) // 2
            self._halves = tuple(Interval(self.u[s], self.p[s], self.bound[s], self.m[s], self.dim[s], self.at + (s.start or 0))
                                 for s in (slice(0, h), slice(h, None)))
        return self._halves


def _linked(x: Interval, y: Interval, t: float) -> np.ndarray | None:
    """The links as a mask, None if there are none.  A cosine is at most the product of the
    projections and that of what they leave; only pairs that this lets through are confirmed."""
    near = np.flatnonzero(x.bound @ y.bound.T >= np.float32(t - BOUND_SLACK))
    if not len(near):
        return None
    if len(near) * DENSE > len(x.u) * len(y.u):
        mask = (x.u @ y.u.T >= t) & (x.dim[:, None] == y.dim)
        return mask if mask.any() else None
    i, j = np.divmod(near, len(y.u))
    ok = (np.einsum("ij,ij->i", x.u[i], y.u[j]) >= t) & (x.dim[i] == y.dim[j])
    if not ok.any():
        return None
    mask = np.zeros((len(x.u), len(y.u)), bool)
    mask[i[ok], j[ok]] = True
    return mask


def _join(x: Interval, y: Interval, t: float, eps: float, same: bool, found) -> None:
    """Calls ``found(x, y, mask)`` for the compared intervals; ``same`` if x is y."""
    gap = np.maximum(np.maximum(x.lo - y.hi, y.lo - x.hi), 0.0)
    if float(gap @ gap) > (eps + SLACK) ** 2:
        return
    if len(x.u) <= LEAF and len(y.u) <= LEAF:
        mask = _linked(x, y, t)
        if mask is not None and same:
            np.fill_diagonal(mask, False)
        if mask is not None and mask.any():
            found(x, y, mask)
    elif same:
        a, b = x.halves()
        _join(a, a, t, eps, True, found)
        _join(a, b, t, eps, False, found)
        _join(b, b, t, eps, True, found)
    elif len(x.u) >= len(y.u):
        for h in x.halves():
            _join(h, y, t, eps, False, found)
    else:
        for h in y.halves():
            _join(x, h, t, eps, False, found)


def _bipartite_forest(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest (row, column) of the links in ``mask``."""
    left = np.flatnonzero(mask.any(axis=1))
    free_rows, free_cols = set(left.tolist()), mask.any(axis=0)
    while free_rows:
        todo = [free_rows.pop()]
        while todo:
            i = todo.pop()
            cols = np.flatnonzero(mask[i] & free_cols)
            free_cols[cols] = False
            for j in cols:
                yield i, int(j)
                for r in np.flatnonzero(mask[:, j]):
                    if int(r) in free_rows:
                        free_rows.discard(int(r))
                        todo.append(int(r))
                        yield int(r), int(j)


def _compare(t: float, eps: float, axes: np.ndarray, width: int, kind: str):
    """Rows (tile, side, node, m, vec) sorted by tile and side; a tile of one stripe has side 0 only."""
    def interval(tab):
        """The rows' vectors in grid order, and their nodes."""
        vec = tab.column(4).combine_chunks()
        u = _unit(vec, width, kind)
        p = u @ axes
        order = np.lexsort(np.floor(p / eps).T[::-1])
        u, p = u[order], p[order]
        left = np.sqrt(np.maximum(np.einsum("ij,ij->i", u, u) - np.einsum("ij,ij->i", p, p), 0.0))
        dim = np.array([len(x) for x in vec.to_pylist()])
        return (Interval(u, p, np.hstack([p, left[:, None]]).astype(np.float32), tab.column(3).to_numpy()[order], dim[order]),
                tab.column(2).to_numpy()[order])

    def run(batches):
        for t0, cuts in _runs(batches, 0):
            for x, y in zip(cuts[:-1], cuts[1:]):
                rows = t0.slice(x, y - x)
                h = int(np.searchsorted(rows.column(1).to_numpy(), 1))
                one = h == len(rows)
                mine, first = interval(rows.slice(0, h))
                theirs, second = (mine, first) if one else interval(rows.slice(h))
                every = first if one else np.concatenate([first, second])
                counts, shift = np.zeros(len(every), np.int64), 0 if one else len(first)
                forest = Forest(len(every))

                def found(p, q, mask, counts=counts, forest=forest, one=one, shift=shift):
                    a, b = p.at, shift + q.at
                    counts[a:a + len(p.u)] += mask @ q.m
                    if not (one and p.at == q.at):
                        counts[b:b + len(q.u)] += mask.T @ p.m
                    ends = [*(a + np.flatnonzero(mask.any(axis=1))).tolist(), *(b + np.flatnonzero(mask.any(axis=0))).tolist()]
                    if len({forest.root(i) for i in ends}) > 1:  # else all are connected already
                        for i, j in _bipartite_forest(mask):
                            forest.join(a + i, b + j)

                _join(mine, theirs, t, eps, one, found)
                hit = np.flatnonzero(counts)
                if len(hit):
                    roots = np.array([every[forest.root(int(i))] for i in hit])
                    yield pa.record_batch([pa.array(every[hit]), pa.array(counts[hit]), pa.array(roots)], names=["node", "n", "root"])
    return run


def _component(found: DataFrame) -> DataFrame:
    return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _summed(found: DataFrame) -> DataFrame:
    """``found`` with one row for each node."""
    with Scratch() as own:
        label = _component(found)
        counts = stage(found.groupBy("node").agg(F.sum("n").alias("n")), "ego-counts")
        named = counts.join(label, "node", "left").select("node", "n", F.coalesce("component", "node").alias("root"))
        return own.keep(stage(named, "ego-found"))


def linked_nodes(own: Scratch, blocks: DataFrame, needed: DataFrame, stripes: int, total: int, n: int, width: int, compare) -> DataFrame:
    """``(node, n, root)``: links counted and forests, of all tiles, wave after wave.  Rows
    are summed up by node whenever there are more than twice the nodes."""
    parts, rows = [], 0
    for start, end, tiles in waves(needed, total, n * width):
        here = needed.where(F.col("x").between(start, end)).select((F.col("x") * stripes + F.col("y")).alias("tile"), "side", "block")
        sent = blocks.join(F.broadcast(here), "block").select("tile", "side", "node", "m", "vec")
        dealt = sent.repartition(4 * tiles, "tile").sortWithinPartitions("tile", "side")
        parts.append(stage(dealt.mapInArrow(compare, "node long, n long, root long"), "ego-found"))
        rows += parts[-1].count()
        if len(parts) > 1 and rows > 2 * n:
            made = _summed(reduce(DataFrame.unionByName, parts))
            own.drop(*parts)
            parts, rows = [made], made.count()
    return reduce(DataFrame.unionByName, parts)


def near_duplicate_vectors(vectors: DataFrame, id_col="vec_id", vec_col="embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = math.sqrt(2.0 - 2.0 * threshold)
    kind = _kind(vectors, vec_col)
    given = distinct_vectors(vectors, id_col, vec_col)
    with Scratch() as own:
        nodes = stage(given.where("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("m"), F.first("vec").alias("vec"), F.min("vec_id").alias("vec_id")), "ego-nodes")
        n, width = nodes.agg(F.count("*"), F.max(F.length("vec"))).first()
        rows = own.keep(stage(given.select("vec_id", "node"), "ego-rows"))
        alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                  F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        if not n:
            return alone
        width //= DTYPE[kind].itemsize
        axes = principal_axes(nodes, width, n, kind)
        blocks = grid_blocks(own, nodes, axes, eps, width, kind)
        box, stripes, total = striped(block_boxes(blocks, axes, width, kind), n, width)
        needed = tile_blocks(block_pairs(box, eps, axes.shape[1]))
        found = linked_nodes(own, blocks, needed, stripes, total, n, width, _compare(threshold, eps, axes, width, kind))
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        label = stage(_component(found), "ego-label")
        named = blocks.select("node", "m", "vec_id").join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
        named = stage(named.join(counts, "node", "left").select("node", "c", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")),
                      "ego-named")
        names = stage(named.groupBy("c").agg(F.min("vec_id").alias("component_id")), "ego-names")
        full = own.keep(stage(named.join(names, "c").select("node", "n_links", "component_id"), "ego-full"))
    linked = rows.where("node IS NOT NULL").select("vec_id", "node").join(full, "node")
    return linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                         F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
