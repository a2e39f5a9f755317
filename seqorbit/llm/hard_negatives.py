"""Hard-negative mining with packed R-trees over integer vectors.

Rows are packed by Sort-Tile-Recursive: Spark sorts by label and the coordinate of
largest variance and cuts the order into slabs, a task sorts a slab by the second
coordinate and cuts it into segments, and inside a segment the third and fourth
coordinates give slices and leaves.  Leaves and the boxes over them are a packed
R-tree.  A box holds per coordinate the least and greatest value and so an interval of the
inner product with any anchor, and an interval of labels.

Two searches run best first, from a queue of boxes by upper bound.  Positives: the
best rows of the anchor's label; boxes strictly below the k-th score so far, or without
the label, are pruned.  Negatives: per positive, the best rows of other labels in the
score window; boxes outside the window, strictly below the k-th, or of the anchor's label
alone, are pruned.

Blocks of anchors meet segments, one pair in one task; equal vectors with one label are
one node with its smallest ids.  Work grows with anchors times rows (the contract's
anchors are a fixed share of the rows); a task's memory does not.

Defined results: null ids, labels and vectors, null or non-finite components and squared
lengths of 2**62 or more take no part; of rows that repeat an id the least vector (then
label) counts; vectors of different length do not meet; ties go to the smaller id; an
anchor without positives, or a window without rows, gives no rows; so does an empty
table; other columns are ignored."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vector_blocks import blocked, integer_vectors, matrix, meet, nodes_of, slack, spread_order

SEGMENT = 4096
ANCHORS = 1024
#: Rows of a leaf, and boxes under one box.
LEAF = 128
FAN = 8


class PackedTree:
    """A packed R-tree over rows that lie in leaf order."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label, self.real = x, label, x.astype(np.float64)
        cuts = np.arange(0, len(x), LEAF)
        lo, hi = np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)
        first, last = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
        self.levels = [(lo, hi, first, last)]
        while len(lo) > 1:
            cuts = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.levels.append((lo, hi, first, last))
        self.most = np.maximum(np.abs(lo[0]), np.abs(hi[0]))

    def intervals(self, q: np.ndarray):
        """Per level ``(lower, upper)`` bounds of the inner products, anchors x boxes, and
        per anchor what they may be off (0: sums in doubles are exact)."""
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        off = np.array([slack(x, self.most) for x in q])
        pairs = [(up @ lo.T + down @ hi.T - off[:, None], up @ hi.T + down @ lo.T + off[:, None]) for lo, hi, _, _ in self.levels]
        return pairs, off

    def best_first(self, q, exact: bool, bounds, own: int, same: bool, windows, k: int, first) -> list[list[tuple]]:
        """Per window (low, high) the best k ``(-score, first, row)`` among rows with
        (``same``) or without label ``own``; ``bounds`` are this anchor's rows of ``intervals``."""
        kept = [[] for _ in windows]
        floors, least, most = [w[0] for w in windows], min(w[0] for w in windows), max(w[1] for w in windows)
        top = len(self.levels) - 1
        queue = [(-bounds[top][1][0], -top, 0)]
        rows, q = (self.real, q.astype(np.float64)) if exact else (self.x, q)
        while queue:
            bound, level, i = heapq.heappop(queue)
            upper, level = -bound, -level
            if upper < least:
                break  # strictly below the k-th of every window, as is all that waits
            lower = bounds[level][0]
            _, _, a, b = self.levels[level]
            if (not a[i] <= own <= b[i]) if same else (a[i] == own == b[i]):
                continue
            if not any(upper >= f and lower[i] <= w[1] for f, w in zip(floors, windows)):
                continue
            if level:
                below = bounds[level - 1][1]
                for j in range(i * FAN, min((i + 1) * FAN, len(below))):
                    if below[j] >= least:
                        heapq.heappush(queue, (-below[j], 1 - level, j))
                continue
            at = i * LEAF
            score = rows[at:at + LEAF] @ q
            fits = (score >= least) & (score <= most)
            if a[i] != own or b[i] != own:
                fits &= (self.label[at:at + LEAF] == own) == same
            some = fits.nonzero()[0].tolist()
            for r in some:
                s = int(score[r])
                entry = (-s, int(first[at + r]), at + r)
                for n, (w, best) in enumerate(zip(windows, kept)):
                    if floors[n] <= s <= w[1] and (len(best) < k or entry < best[-1]):
                        bisect.insort(best, entry)
                        if len(best) > k:
                            best.pop()
                        if len(best) == k:
                            floors[n] = max(w[0], -best[-1][0])
            if some:
                least = min(floors)
        return kept


def _tiled(dims: list[int], label: str):
    """Order of a slab's rows by label and the second coordinate."""
    def order(t: pa.Table) -> np.ndarray:
        keys = [t.column("node").to_numpy()]
        keys += [t.column(f"k{i}").to_numpy() for i in range(1, min(len(dims), 2))]
        return np.lexsort([*keys, t.column(label).to_numpy(), t.column("width").to_numpy()])
    return order


def packed(t: pa.Table, width: int):
    """The rows of a segment in leaf order and their tree: slices by the third, leaves by
    the fourth sorting coordinate, within labels."""
    x, label = matrix(t.column("vec"), width), t.column("label").to_numpy().astype(np.int64)
    keys = [t.column(f"k{i}").to_numpy() for i in (2, 3) if f"k{i}" in t.column_names]
    node = t.column("node").to_numpy()
    order = np.lexsort([node, *keys[:1], label])
    if len(keys) == 2:
        slices = max(1, int(np.sqrt(len(order) / LEAF)))
        slab = np.empty(len(order), np.int64)
        slab[order] = np.arange(len(order)) // -(-len(order) // slices)
        order = np.lexsort([node, keys[1], label, slab])
    return order, PackedTree(x[order], label[order])


FOUND = pa.schema([("anchor", pa.int64()), ("at", pa.int64()), ("node", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _search(k: int, same: bool):
    """The best k nodes of a segment per anchor (``same``), or per anchor and window."""
    def run(key, anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return FOUND.empty_table()
        width = anchors.column("width")[0].as_py()
        q, own = matrix(anchors.column("vec"), width), anchors.column("label").to_numpy()
        order, tree = packed(rows, width)
        node, first = rows.column("node").to_numpy()[order], rows.column("id").to_numpy()[order]
        ids = anchors.column("anchor").to_numpy()
        everything = [{"at": 0, "low": -np.inf, "high": np.inf}]
        windows = [everything] * len(q) if same else anchors.column("windows").to_pylist()
        levels, off = tree.intervals(q)
        out = []
        for i, (a, lab, mine) in enumerate(zip(ids.tolist(), own.tolist(), windows)):
            bounds = [(lo[i], hi[i]) for lo, hi in levels]
            best = tree.best_first(q[i], off[i] == 0, bounds, lab, same, [(w["low"], w["high"]) for w in mine], k, first)
            out += [(a, w["at"], int(node[r]), f, -s) for w, few in zip(mine, best) for s, f, r in few]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], schema=FOUND) if out else FOUND.empty_table()
    return run


def _meet(anchors: DataFrame, segments: DataFrame, tiles: DataFrame, search, name: str) -> DataFrame:
    return meet(anchors.join(tiles, "group"), segments.join(tiles, "segment"), tiles, ["group", "segment"], search,
                "anchor long, at long, node long, id long, score long", name)


def _blocks(rows: DataFrame, number: str) -> DataFrame:
    return rows.groupBy(number, "width").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))


def _firsts(found: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(anchor, at, nth, vec_id, score)``: the first k rows of the best k nodes."""
    best = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "id")
    few = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    rows = few.join(nodes.select("node", "ids"), "node").select("anchor", "at", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = 5,
                        n_negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id",
                        vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``label`` is a column of ``vectors`` (by default "label"), ``is_anchor`` a condition on
    ``vec_id``; a negative's score lies between ``low`` and ``high`` percent of the positive's."""
    label = F.col("label") if label is None else label
    rows = integer_vectors(vectors, id_col, vec_col, scale, label=label.cast("long"))
    rows = stage(rows.where("label IS NOT NULL"), "mine-rows")
    nodes = stage(nodes_of(rows, n_positives + 1, "label"), "mine-nodes")
    n = nodes.count()
    dims = spread_order(nodes, 4)
    keys = [F.coalesce(F.get("vec", F.lit(d)), F.lit(0)).alias(f"k{i}") for i, d in enumerate(dims)]
    packing = nodes.select("node", "width", "vec", "label", F.col("ids")[0].alias("id"), *keys)
    segments = blocked(packing, [F.col(c) for c in ("label", "k0")[:1 + len(dims)]], SEGMENT, n, "mine-segments", "segment", _tiled(dims, "label"))
    asked = stage(rows.where(is_anchor).join(nodes.select("node", "label", "vec"), ["label", "vec"]).select(
        F.col("vec_id").alias("anchor_id"), F.col("node").alias("anchor")), "mine-asked")
    wanted = stage(nodes.select("node", "width", "vec", "label").join(asked, F.col("anchor") == F.col("node"), "left_semi"), "mine-wanted")
    anchors = blocked(wanted, [F.col("label")], ANCHORS, wanted.count(), "mine-anchors", "group").withColumnRenamed("node", "anchor")
    groups = _blocks(anchors, "group").withColumnsRenamed({"lo": "glo", "hi": "ghi"})
    met = stage(groups.join(_blocks(segments, "segment"), "width"), "mine-tiles")

    near = met.where("lo <= ghi AND glo <= hi").select("group", "segment")
    found = _meet(anchors, segments.drop("width"), near, _search(n_positives + 1, True), "mine-near")
    top = stage(_firsts(found, nodes, n_positives + 1).select("anchor", "nth", "vec_id", "score"), "mine-positives")

    # one window for each positive score of an anchor
    ps = F.col("score")
    bound = F.struct(ps.alias("at"), F.ceil(ps.cast("decimal(20,0)") * low / 100).cast("long").alias("low"),
                     F.floor(ps.cast("decimal(20,0)") * high / 100).cast("long").alias("high"))
    windows = top.groupBy("anchor").agg(F.collect_set(bound).alias("windows"))  # at most n_positives + 1
    windows = windows.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"]))
    far = met.where("NOT (glo = ghi AND lo = hi AND lo = glo)").select("group", "segment")
    looking = anchors.join(windows.where(F.size("windows") > 0), "anchor")
    found = _meet(looking, segments.drop("width"), far, _search(n_negatives, False), "mine-far")
    hard = _firsts(found, nodes, n_negatives).groupBy("anchor", "at").agg(  # n_negatives rows
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hard"))

    per_anchor = top.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("top"))
    other = F.filter("top", lambda t: t["vec_id"] != F.col("anchor_id"))
    pairs = asked.join(per_anchor, "anchor").select("anchor_id", "anchor", F.inline(F.slice(other, 1, n_positives)))
    pairs = pairs.select("anchor_id", "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    full = pairs.join(hard, (pairs["anchor"] == hard["anchor"]) & (F.col("positive_score") == F.col("at")))
    return full.select("anchor_id", "positive_id", "positive_score", F.inline("hard")).select(
        "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
