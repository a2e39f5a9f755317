"""Near-duplicate documents by a chosen-path set similarity join.

Each distinct shingle set gets ``COORDS`` minwise values.  In each of ``trees``
independent trees, a node picks one of the coordinates (two with probability
``1/threshold - 1``) by a hash of its own id and sends every set to the child of its
minwise value there, so a pair at the threshold keeps meeting with expectation one.
Nodes of at most ``NODE`` sets are compared exhaustively on their sketches, nodes of up to
``TASK_SETS`` are walked to their end in one task, and from larger ones Spark deals out the
next level.  In a node of over ``NODE`` sets one head speaks for the sets that agree with it on ``COVER`` coordinates:
any set that agrees with such a covered set also agrees with the head on all but the
coordinates where the covered set differs, so it is grouped with the head and covered
sets need not go on.  The others branch again; what is still larger than ``NODE`` at
``DEPTH`` is taken together as a whole.  The number of trees follows from the target
recall of a pair that meets by depth ``SHALLOW``; sets that branch on below it get as many
trees more as the recall takes at ``DEPTH``.

Sketches only form *groups*, supersets of the linked sets.  Links are confirmed on
full shingle sets inside groups: a group that fits one task in one go; a larger one
in blocks that all meet the group's pivots (the sets nearest to its consensus
sketch), after which only sets outside the group's largest class meet the other
blocks.  Pairs already connected are skipped and links leave a task as a spanning
forest, so output is linear in a group's size; no pair between classes is dropped.

Defined results: text without words (or null) has an empty set, no links and is its
own component; identical sets are linked; rows that repeat an id and a text are one
document; a null id is never the name of a component that has an id, and is kept if
its component has none; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Scratch, batches_of, binaries, connected_components, mix64, signed, stage

COORDS = 64
NODE = 256
DEPTH = 8
SHALLOW = 3
RECALL = 0.9999
GROUP_SETS = 512
GROUP_SHINGLES = 2_000_000
PIVOTS = 8
#: Agreement of two sketches below which a pair is not compared: five standard
#: deviations under a similarity of 0.8.
AGREE = 0.55
#: Coordinates on which a set agrees with the head of its node to be covered by it.
COVER = 52
#: A set that agrees with a covered one on AGREE of all coordinates agrees with the head on as many.
NEAR = math.ceil(AGREE * COORDS) + COVER - COORDS
#: Nodes of up to this many sets branch on inside one task; the others, whatever their size, by jobs.
TASK_SETS = 16384
_A = mix64(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = mix64(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def tree_recall(trees: int, threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold meets at ``depth`` in one of ``trees``, averaged over
    the spread of its agreement on ``COORDS`` coordinates."""
    extra, out = 1.0 / threshold - 1.0, 0.0
    for same in range(COORDS + 1):
        s, p = same / COORDS, 1.0
        for _ in range(depth):
            p = 1.0 - (1.0 - s * p) * (1.0 - extra * s * p)
        out += math.comb(COORDS, same) * threshold ** same * (1.0 - threshold) ** (COORDS - same) * (1.0 - (1.0 - p) ** trees)
    return out


def trees_for(recall: float, threshold: float, depth: int = SHALLOW) -> int:
    """Trees that make a pair at the threshold meet at ``depth`` with ``recall``."""
    trees = 1
    while tree_recall(trees, threshold, depth) < recall:
        trees += 1
    return trees


def shingle_sets(hasher: Hasher, texts: list, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased words)."""
    for i, j in batches_of(texts):
        h, at, _, _ = hasher.words(texts[i:j], lower=True)
        s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for x in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[x:x + len(s)]
        s = mix64(s)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                yield np.unique(s[a:b - k + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in range(a, b):
                    whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + h[x:x + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(out, (s[i:i + 8192, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(16)).astype(np.uint32)


def sketches(src: DataFrame, k: int) -> DataFrame:
    """``(doc_id, rk, n, skey, sig, low)``: set size, 128-bit key of the set, minwise
    values and their low bytes.  ``rk`` names the row (id and text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            n, key, sig, low = [], [], [], []
            for s in shingle_sets(hasher, binaries(b.column(2)), k):
                m = minwise(s) if len(s) else np.zeros(0, np.uint32)
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest())
                sig.append(m.tobytes())
                low.append(m.astype(np.uint8).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                   pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
                                  names=["doc_id", "rk", "n", "skey", "sig", "low"])

    return src.mapInArrow(run, "doc_id long, rk long, n long, skey binary, sig binary, low binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _children(node: np.ndarray, values, extra: float):
    """Child ids of each row's node: ``values(c)`` gives the rows' value at coordinate
    ``c`` (an index per row).  Yields (rows, child ids)."""
    for pick in (0, 1):
        x = mix64(node + np.uint64(0x632BE59BD9B4E019 * (pick + 1) & ((1 << 64) - 1)))
        rows = np.arange(len(node)) if pick == 0 else np.flatnonzero((x >> np.uint64(40)) < np.uint64(int(extra * (1 << 24))))
        c = (x[rows] % np.uint64(COORDS)).astype(np.int64)
        child = mix64(node[rows] * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
                      + values(rows, c).astype(np.uint64) + np.uint64(1))
        yield rows, child


_MEMBER = "node long, doc long, n long, low binary"


def _members(b, rows, child, doc, n, low):
    rows = pa.array(rows)
    return pa.record_batch([pa.array(signed(child)), b.column(doc).take(rows), b.column(n).take(rows),
                            b.column(low).take(rows)], names=["node", "doc", "n", "low"])


def _roots(trees: range, extra: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column(2), COORDS * 4).copy().view(np.uint32)
            for t in trees:
                root = np.full(b.num_rows, int(mix64(np.array([t + 1], np.uint64))[0]), np.uint64)
                for rows, child in _children(root, lambda r, c: sig[r, c], extra):
                    yield _members(b, rows, child, 0, 1, 3)
    return run


def _branch(extra: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            low = _matrix(b.column(3), COORDS)
            node = b.column(0).to_numpy().view(np.uint64)
            for rows, child in _children(node, lambda r, c: low[r, c], extra):
                yield _members(b, rows, child, 1, 2, 3)
    return run


def _labels(adj: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for each row of a symmetric adjacency matrix."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches, key: int):
    """Rows of equal key (sorted input) as one table per key, across batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(cuts):
            yield t.slice(0, cuts[-1]).combine_chunks(), np.concatenate([[0], cuts])
            rest = t.slice(cuts[-1])
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _compare(cuts, n, low, threshold: float, most: int) -> Iterator[tuple]:
    """Links ``(rows, rows)`` of the sketch graph of each node of up to ``most`` rows cuts[i]:cuts[i + 1]."""
    size = np.diff(cuts)
    first = cuts[:-1][size == 2]  # most nodes: one pair, all at once
    ok = ((low[first] == low[first + 1]).mean(axis=1) >= AGREE) & (
        np.minimum(n[first], n[first + 1]) >= threshold * np.maximum(n[first], n[first + 1]))
    yield first[ok], first[ok] + 1
    for i in np.flatnonzero((size > 2) & (size <= most)):
        x, y = cuts[i], cuts[i + 1]
        own, m = low[x:y], n[x:y]
        adj = np.zeros((y - x, y - x), bool)
        for r in range(y - x):
            adj[r] = (own[r] == own).mean(axis=1) >= AGREE
        adj &= np.minimum(m[:, None], m) >= threshold * np.maximum(m[:, None], m)
        label = _labels(adj)
        child = np.flatnonzero(label != np.arange(y - x))
        yield x + label[child], x + child


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest ``(smallest, other)`` that spans the links between a and b."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[label[child]], names[child]


_LINK = "a long, b long, deep boolean"


def _links(doc, n, low, node, depth: int, threshold: float, most: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, deep)``: links of nodes at ``depth`` (rows sorted by node) and, level by level, of
    those below them, down to ``last``, in nodes of over ``most`` sets; ``deep`` are the sets that
    branch on below ``SHALLOW``."""
    a, b, deep = [], [], []
    rows = np.arange(len(doc))
    while len(rows):
        cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        for x, y in _compare(cuts, n[rows], low[rows], threshold, most):
            a.append(doc[rows[x]])
            b.append(doc[rows[y]])
        size, on = np.diff(cuts), []
        for x, y in zip(cuts[:-1][size > most], cuts[1:][size > most]):
            mine = rows[x:y]
            head = mine[np.argmin(doc[mine])]
            same = (low[mine] == low[head]).sum(axis=1)
            near = mine if depth == last else mine[same >= NEAR]
            a.append(np.full(len(near), doc[head]))
            b.append(doc[near])
            on.append(x + np.flatnonzero(same < COVER))
        if depth == last or not on:
            break
        on = np.concatenate(on)
        rows, node = rows[on], node[on]
        if depth == SHALLOW:
            deep.append(doc[rows])
        new = list(_children(node, lambda r, c, at=rows: low[at[r], c], 1.0 / threshold - 1.0))
        rows, node = np.concatenate([rows[r] for r, _ in new]), np.concatenate([c for _, c in new])
        order = np.argsort(node, kind="stable")
        rows, node, depth = rows[order], node[order], depth + 1
    none = [np.zeros(0, np.int64)]
    return *_forest(np.concatenate(a), np.concatenate(b)), np.unique(np.concatenate(deep or none))


def _node_links(threshold: float, depth: int):
    """Forests that span the links of the nodes of a level (rows sorted by node) and below, and
    the sets that branch on below ``SHALLOW`` (as links to themselves)."""
    most, last = NODE, DEPTH

    def run(batches):
        for t, _ in _runs(batches, 0):
            a, b, deep = _links(t.column(1).to_numpy(), t.column(2).to_numpy(), _matrix(t.column(3).combine_chunks(), COORDS),
                                t.column(0).to_numpy().view(np.uint64), depth, threshold, most, last)
            yield pa.record_batch([pa.array(np.concatenate([a, deep])), pa.array(np.concatenate([b, deep])),
                                   pa.array(np.arange(len(a) + len(deep)) >= len(a))], names=["a", "b", "deep"])
    return run


def _agreement(batches):
    """Rows (node, doc, n, low, head, head's low) with the coordinates on which the two agree (-1 without a head)."""
    for b in batches:
        same, has = np.full(b.num_rows, -1, np.int32), np.flatnonzero(b.column(4).is_valid())
        both = b.take(pa.array(has))
        same[has] = (_matrix(both.column(3), COORDS) == _matrix(both.column(5), COORDS)).sum(axis=1)
        yield pa.record_batch([*b.columns[:5], pa.array(same, pa.int32())], names=["node", "doc", "n", "low", "head", "same"])


def _with_head(own: Scratch, level: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of the large nodes with their agreement with the node's head.  Every row of the level
    meets at most one head, whatever its node's size."""
    heads = stage(level.join(large.withColumnRenamed("head", "doc"), ["node", "doc"]).dropDuplicates(["node"])
                  .select("node", F.col("doc").alias("head"), F.col("low").alias("hlow")), "cps-heads")
    rows = level.join(heads, "node", "left").select("node", "doc", "n", "low", "head", "hlow")
    inner = stage(rows.mapInArrow(_agreement, _MEMBER + ", head long, same int").where("same >= 0"), "cps-agreement")
    own.drop(heads)
    return inner


def candidate_groups(reps: DataFrame, threshold: float, trees: int, deep_trees: int) -> DataFrame:
    """``(doc, grp)`` for sets that share a group with another set.  Of ``deep_trees``, those
    beyond ``trees`` hold only the sets that branch on below ``SHALLOW``: a pair that met there in
    a large node has both of its sets among them."""
    with Scratch() as own:
        links = _grow(own, reps, threshold, range(trees))
        deep = stage(links.where("deep").select(F.col("a").alias("rk")).distinct(), "cps-deep")
        if deep_trees > trees and not deep.isEmpty():
            more = stage(reps.join(deep, "rk", "left_semi"), "cps-deep-sets")
            links = links.union(_grow(own, more, threshold, range(trees, deep_trees)))
        groups = connected_components(links.where("NOT deep").select("a", "b"))
        return own.keep(stage(groups.withColumnsRenamed({"node": "doc", "component": "grp"}), "cps-groups"))


def _grow(own: Scratch, reps: DataFrame, threshold: float, trees: range) -> DataFrame:
    """``(a, b, deep)``: linked sketches and, as links to themselves, the sets that branch on below
    ``SHALLOW``.  A level is freed once its links and the rows that go on are written."""
    extra = 1.0 / threshold - 1.0
    level = reps.select("rk", "n", "sig", "low").mapInArrow(_roots(trees, extra), _MEMBER)
    links = inner = None
    for depth in range(1, DEPTH + 1):
        level = stage(level, f"cps-level{depth}")
        if inner is not None:
            own.drop(inner)
        large = stage(level.groupBy("node").agg(F.count("*").alias("m"), F.min("doc").alias("head"))
                      .where(F.col("m") > max(NODE, TASK_SETS)).select("node", "head"), "cps-large")
        last, here = large.isEmpty(), level
        small = level if last else level.join(large, "node", "left_anti").select("node", "doc", "n", "low")
        found = small.repartition("node").sortWithinPartitions("node").mapInArrow(_node_links(threshold, depth), _LINK)
        if not last:
            inner = _with_head(own, level, large)
            near, on = F.col("same") >= NEAR if depth < DEPTH else F.lit(True), inner.where(F.col("same") < COVER)
            found = found.union(inner.where(near & (F.col("doc") != F.col("head"))).select("head", "doc", F.lit(False)))
            if depth == SHALLOW:
                found = found.union(on.select("doc", "doc", F.lit(True)))
            level = on.select("node", "doc", "n", "low").mapInArrow(_branch(extra), _MEMBER)
        found = stage(found, "cps-edges")
        links = found if links is None else links.union(found)
        own.drop(here, large)
        if last:
            break
    return links


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= round(100 * threshold) * (len(x) + len(y) - both)


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def confirm(sets: list, low: np.ndarray, threshold: float, forest: Forest, one: np.ndarray, other: np.ndarray) -> None:
    """Joins linked pairs of ``one`` x ``other`` that are not connected yet, the most
    alike sketches first."""
    n = np.array([len(s) for s in sets])
    for i in one:
        agree = (low[i] == low[other]).mean(axis=1)
        fit = (agree >= AGREE) & (np.minimum(n[i], n[other]) >= threshold * np.maximum(n[i], n[other])) & (other != i)
        for j in other[fit][np.argsort(-agree[fit], kind="stable")]:
            if forest.root(i) != forest.root(j) and _linked(sets[i], sets[j], threshold):
                forest.join(i, j)


def _confirm_task(k: int, threshold: float):
    """Rows (key, role, rk, low, text) sorted by key and role.  Roles: 0 pivot, 1 straggler
    (compared with all), 2 member.  Without stragglers members are compared with one another."""
    def run(batches):
        hasher = Hasher()
        for t, cuts in _runs(batches, 0):
            a, b = [], []
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x < 2:
                    continue
                rows = t.slice(x, y - x)
                role, rk = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                low = _matrix(rows.column(3).combine_chunks(), COORDS)
                sets = list(shingle_sets(hasher, rows.column(4).cast(pa.binary()).to_pylist(), k))
                forest, every = Forest(y - x), np.arange(y - x)
                same: dict = {}
                for i, r in enumerate(rk):  # a set may stand in two roles
                    forest.join(same.setdefault(int(r), i), i)
                confirm(sets, low, threshold, forest, every[role == 0], every)
                confirm(sets, low, threshold, forest, every[role == 1], every[role == 2])
                if not (role == 1).any():
                    confirm(sets, low, threshold, forest, every[role == 2], every[role == 2])
                root = np.array([forest.root(i) for i in range(y - x)])
                child = np.flatnonzero(rk[root] != rk)
                a.append(rk[root[child]])
                b.append(rk[child])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def _confirmed(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    return (rows.select("key", "role", "rk", "low", "text").repartition("key").sortWithinPartitions("key", "role")
            .mapInArrow(_confirm_task(k, threshold), "a long, b long"))


def _pivots(rows: DataFrame) -> DataFrame:
    """``(grp, rk)``: the sets of each large group nearest to its consensus sketch."""
    def tally(batches):
        for b in batches:
            if not b.num_rows:
                continue
            grp, low = b.column(0).to_numpy(), _matrix(b.column(1), COORDS)
            code = (np.arange(COORDS) * 256 + low).astype(np.int64)
            for g in np.unique(grp):
                count = np.bincount(code[grp == g].ravel(), minlength=COORDS * 256)
                at = np.flatnonzero(count)
                yield pa.record_batch([pa.array(np.full(len(at), g)), pa.array(at // 256), pa.array(at % 256), pa.array(count[at])],
                                      names=["grp", "coord", "value", "n"])

    votes = rows.select("grp", "low").mapInArrow(tally, "grp long, coord long, value long, n long")
    votes = votes.groupBy("grp", "coord", "value").agg(F.sum("n").alias("n"))
    top = votes.groupBy("grp", "coord").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    consensus = stage(top.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("c")), "cps-consensus")

    def nearest(batches):
        best: dict = {}
        for b in batches:
            for g, rk, low, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(low, np.uint8)
                score = sum(int(own[x["coord"]]) == x["value"] for x in c)
                best[g] = sorted([*best.get(g, ()), (-score, rk)])[:PIVOTS]
        out = [(g, s, rk) for g, xs in best.items() for s, rk in xs]
        if out:
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                  names=["grp", "s", "rk"])

    few = rows.select("grp", "rk", "low").join(consensus, "grp").select("grp", "rk", "low", "c").mapInArrow(
        nearest, "grp long, s long, rk long")
    # at most PIVOTS rows a task and group reach this aggregate
    few = few.groupBy("grp").agg(F.slice(F.array_sort(F.collect_set(F.struct("s", "rk"))), 1, PIVOTS).alias("p"))
    return few.select("grp", F.explode("p.rk").alias("rk"))


def _large_groups(rows: DataFrame, sizes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links in groups too large for one task.  rows: grp, rk, low, text."""
    rows = stage(rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rk", F.lit(3)), "blocks")), "cps-rows")
    key = lambda *c: F.xxhash64(*c)
    pivots = stage(_pivots(rows), "cps-pivots")
    heads = rows.join(pivots, ["grp", "rk"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = rows.withColumn("role", F.lit(2)).unionByName(heads.withColumn("role", F.lit(0)))
    links = stage(_confirmed(first.withColumn("key", key("grp", "block")), k, threshold), "cps-links")
    label = connected_components(links)
    named = stage(rows.select("grp", "rk", "block").join(label.withColumnRenamed("node", "rk"), "rk", "left")
                  .withColumn("label", F.coalesce("component", "rk")), "cps-labels")
    largest = (named.groupBy("grp", "label").agg(F.count("*").alias("m"))
               .groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main")))
    strays = stage(named.join(stage(largest, "cps-main"), "grp").where("label <> main").select("grp", "rk"), "cps-strays")
    if strays.isEmpty():
        return links
    per = strays.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(GROUP_SETS)).cast("long").alias("sblocks"))
    wide = rows.join(stage(per, "cps-per"), "grp")
    out = (wide.join(strays, ["grp", "rk"], "left_semi").withColumn("sb", F.pmod(F.xxhash64("rk", F.lit(5)), "sblocks"))
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1)))
    each = wide.withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("sblocks") - 1))).withColumn("role", F.lit(2))
    more = out.unionByName(each).withColumn("key", key("grp", "sb", "block"))
    return links.unionByName(_confirmed(more, k, threshold))


def _classes(own: Scratch, rows: DataFrame, src: DataFrame, shingle: int, threshold: float, recall: float) -> DataFrame:
    """``(skey, c)``: the class of every distinct set.  src: rk, text."""
    reps = stage(rows.where("n > 0").groupBy("skey").agg(
        F.min("rk").alias("rk"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("low").alias("low")), "cps-reps")
    groups = candidate_groups(reps, threshold, trees_for(recall, threshold), trees_for(recall, threshold, DEPTH))
    member = reps.select("rk", "n", "low").join(groups.withColumnRenamed("doc", "rk"), "rk")
    sizes = member.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select(
        "grp", F.greatest(F.ceil(F.col("m") / GROUP_SETS), F.ceil(F.col("s") / GROUP_SHINGLES)).cast("long").alias("blocks"))
    sizes = stage(sizes, "cps-sizes")
    texts = src.join(member.select("rk", "low", "grp"), "rk").dropDuplicates(["rk"])
    texts = stage(texts, "cps-texts")
    large = sizes.where("blocks > 1")
    small = texts.join(large, "grp", "left_anti").withColumn("role", F.lit(2)).withColumn("key", F.col("grp"))
    links = _confirmed(small, shingle, threshold)
    if not large.isEmpty():
        links = links.unionByName(_large_groups(texts.join(large, "grp", "left_semi").select("grp", "rk", "low", "text"),
                                                large, shingle, threshold))
    label = stage(connected_components(links), "cps-components").withColumnsRenamed({"node": "rk", "component": "c"})
    classes = reps.select("skey", "rk").join(label, "rk", "left").select("skey", F.coalesce("c", "rk").alias("c"))
    return stage(classes, "cps-classes")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 5, threshold: float = 0.8,
                    recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, rk (a hash of id and text), n_shingles,
    component_id and kept."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rk = F.xxhash64("doc_id", "text").alias("rk")
    with Scratch() as own:
        rows = stage(sketches(src.select("doc_id", rk, "text"), shingle), "cps-sketch")
        classes = _classes(own, rows, src.select(rk, "text"), shingle, threshold, recall)
        full = rows.where("n > 0").select("doc_id", "rk", "n", "skey").join(classes, "skey")
        names = stage(full.groupBy("c").agg(F.min("doc_id").alias("component_id")), "cps-names")
        for t in (rows, classes, names):
            own.keep(t)
    out = full.join(names, "c").select("doc_id", "rk", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "rk", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
