"""Exact top-k by integer inner product, by no-random-access aggregation.

Rows are cut into segments; a segment stores one list per coordinate, sorted by
value.  A query reads the lists of a segment block by block, each from the end that
suits the sign of its own coordinate.  What was read gives every row a lower and an
upper score bound (unread coordinates lie between the list's cursor and its far
end); reading stops when no row outside a few can reach the k-th best score, and the
final scores of these few are put together from the lists.  The k-th best score of the
segments before is the first bound for the next, so a whole segment may fall at once.

Blocks of queries meet stripes of segments, one pair in one task.  Equal vectors are
one node with its smallest ids, so a vector that most rows share is searched once.
Work and exchange grow with queries times rows (the contract's queries are a fixed
share of the rows); a task's memory does not.

Defined results: null ids, null vectors, null or non-finite components and squared
lengths of 2**62 or more take no part; of rows that repeat an id the least vector
counts; vectors of different length do not meet; empty vectors score 0 with each
other; ties go to the smaller id; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vector_blocks import blocked, integer_vectors, matrix, meet, nodes_of, slack, spread_order

SEGMENT = 2048
#: Segments that one task reads, one after the other, and queries that it holds.
STRIPE = 4
QUERIES = 1024
#: Queries that read lists together.
BATCH = 256
#: Entries read from every list at a time; share of a list read before the first look at the
#: bounds (after that, every second time).
STEP = 128
FIRST_LOOK = 0.5
#: As few rows as this are resolved instead of being bounded further.
FEW = 64


def sorted_lists(nodes: DataFrame, n: int) -> DataFrame:
    """``(segment, width, dim, at array<smallint>, value array<int>, node, id)``: per
    coordinate the rows of a segment (numbers in it) by falling value; dim -1 holds the
    nodes and smallest ids of these numbers."""
    order = [F.get("vec", F.lit(i)) for i in spread_order(nodes, 2)]
    rows = blocked(nodes.select("node", "width", "vec", F.col("ids")[0].alias("id")), order, SEGMENT, n, "topk-segments", "segment")
    schema = "segment long, width int, dim int, at array<smallint>, value array<int>, node array<bigint>, id array<bigint>"
    names = ["segment", "width", "dim", "at", "value", "node", "id"]

    def build(key, t):
        # at most SEGMENT rows
        seg, width = t.column("segment")[0].as_py(), t.column("width")[0].as_py()
        x = matrix(t.column("vec"), width)
        at = np.argsort(-x, axis=0, kind="stable")
        some = [[seg] * (width + 1), [width] * (width + 1), [-1, *range(width)],
                [None, *at.T.astype(np.int16)], [None, *np.take_along_axis(x, at, 0).T.astype(np.int32)],
                [t.column("node").to_pylist(), *[None] * width], [t.column("id").to_pylist(), *[None] * width]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(some, kinds)], names=names)

    return stage(rows.groupBy("segment").applyInArrow(build, schema), "topk-lists")


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``score`` the k-th largest, or -inf."""
    n = score.shape[1]
    return np.partition(score, n - k, axis=1)[:, n - k] if n >= k else np.full(len(score), -np.inf)


def read_lists(at: np.ndarray, value: np.ndarray, q: np.ndarray, k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (row of ``q``) ``(numbers, scores)``: a superset of the rows whose scores
    are among the best k and at least ``known``; the scores are exact.  ``at`` and ``value``
    are the lists (coordinates x rows, values falling).

    All queries read on together, positive coordinates from the front of a list and negative ones
    from its back, until each has few rows left that can qualify."""
    width, n = at.shape
    if width == 0:
        return [(np.arange(n), np.zeros(n, np.int64))] * len(q)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    off = np.array([slack(x, np.maximum(np.abs(value[:, 0]), np.abs(value[:, -1]))) for x in q])
    dim = np.arange(width)[:, None]
    front, back = np.zeros((width, n)), np.zeros((width, n))
    unread, unread_back = np.ones((width, n), bool), np.ones((width, n), bool)
    first, last = value[:, :1].astype(np.float64), value[:, -1:].astype(np.float64)
    reach = (up @ first + down @ last)[:, 0] + off
    todo = np.flatnonzero(reach >= known)
    left = [np.zeros(0, np.int64)] * len(q)
    for begin in range(0, n, STEP):
        if not len(todo):
            break
        end = min(begin + STEP, n)
        front[dim, at[:, begin:end]] = value[:, begin:end]
        unread[dim, at[:, begin:end]] = False
        back[dim, at[:, n - end:n - begin]] = value[:, n - end:n - begin]
        unread_back[dim, at[:, n - end:n - begin]] = False
        if end < n and (end < FIRST_LOOK * n or (end // STEP) % 2):
            continue
        u, d = up[todo], down[todo]
        # an unread coordinate lies between the cursor and the far end of its list
        upper = u @ np.where(unread, value[:, end - 1:end], front) + d @ np.where(unread_back, value[:, n - end:n - end + 1], back)
        lower = u @ np.where(unread, last, front) + d @ np.where(unread_back, first, back)
        floor = np.maximum(_kth(lower, k) - off[todo], known[todo])
        live = upper + off[todo][:, None] >= floor[:, None]
        ready = (live.sum(axis=1) <= max(FEW, k)) | (end == n)
        for i in np.flatnonzero(ready):
            left[todo[i]] = np.flatnonzero(live[i])
        todo = todo[~ready]
    # the rest of the lists, once for all queries, completes the rows that are left
    some = np.unique(np.concatenate(left)) if left else np.zeros(0, np.int64)
    whole = np.zeros((width, n), np.int64)
    whole[dim, at] = value
    rows, number = whole[:, some].T.copy(), np.zeros(n, np.int64)
    number[some] = np.arange(len(some))
    return [(m, rows[number[m]] @ x) for m, x in zip(left, q)]


def best_of(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k by falling score, then smaller id."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((first[some], -score[some]))[:k]]


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(key, queries, lists):
        if not queries.num_rows or not lists.num_rows:
            return schema.empty_table()
        width = queries.column("width")[0].as_py()
        q = matrix(queries.column("vec"), width)
        found = [(np.zeros(0, np.int64),) * 3 for _ in range(len(q))]
        lists = lists.sort_by([("segment", "ascending"), ("dim", "ascending")])
        for s in range(0, lists.num_rows, width + 1):
            seg = lists.slice(s, width + 1)
            node, first = (np.array(seg.column(c)[0].as_py(), np.int64) for c in ("node", "id"))
            n = len(node)
            at = matrix(seg.column("at").slice(1), n) if width else np.zeros((0, n), np.int64)
            value = matrix(seg.column("value").slice(1), n) if width else np.zeros((0, n), np.int64)
            known = np.array([float(f[0][-1]) if len(f[0]) == k else -np.inf for f in found])
            for b in range(0, len(q), BATCH):
                got = read_lists(at, value, q[b:b + BATCH], k, known[b:b + BATCH])
                for i, (some, scores) in enumerate(got, b):
                    if len(some):
                        score, of, least = (np.concatenate(c) for c in zip(found[i], (scores, node[some], first[some])))
                        best = best_of(score, least, k)
                        found[i] = score[best], of[best], least[best]
        ids = queries.column("query").to_numpy()
        return pa.table([np.repeat(ids, [len(f[0]) for f in found]),
                         *[np.concatenate([f[c] for f in found]) for c in (1, 2, 0)]], schema=schema)
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: per query (rows where ``is_query``, a condition on
    ``vec_id``) the k other rows of highest score, ties to the smaller id."""
    rows = stage(integer_vectors(vectors, id_col, vec_col, scale), "topk-rows")
    nodes = stage(nodes_of(rows, k + 1), "topk-nodes")
    n = nodes.count()
    asked = stage(rows.where(is_query).join(nodes.select("node", "vec"), "vec").select(
        F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "topk-asked")
    lists = sorted_lists(nodes, n)
    stripes = lists.select("segment", "width").distinct()
    # segments of a task are neighbours; equal widths only
    stripe = F.floor(F.col("segment").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) / STRIPE) + F.shiftright("segment", 32) * (1 << 32)
    lists = lists.withColumn("stripe", stripe)
    stripes = stripes.withColumn("stripe", stripe).select("width", "stripe").distinct()
    wanted = stage(nodes.join(asked, F.col("query") == F.col("node"), "left_semi").select("node", "width", "vec"), "topk-wanted")
    n_groups = max(1, round(wanted.count() / QUERIES))
    queries = wanted.withColumn("group", F.pmod(F.xxhash64("node"), F.lit(n_groups)))
    groups = queries.select("group", "width").distinct()
    tiles = stage(groups.join(stripes, "width").select("group", "width", "stripe"), "topk-tiles")
    left = queries.withColumnRenamed("node", "query").join(tiles, ["group", "width"]).select("group", "stripe", "query", "width", "vec")
    right = lists.join(tiles, ["stripe", "width"]).select("group", "stripe", "width", "segment", "dim", "at", "value", "node", "id")
    found = meet(left, right, tiles, ["group", "stripe", "width"], _search(k + 1), "query long, node long, id long, score long", "topk-found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    ids = top.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    per_query = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("top"))  # k + 1 rows
    others = asked.join(per_query, "query").select("query_id", F.filter("top", lambda t: t["vec_id"] != F.col("query_id")).alias("top"))
    return others.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("rank", "t")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
