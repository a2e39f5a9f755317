"""Integer vectors in blocks: scaling, equal vectors as one node, and the meeting of
blocks of queries with blocks of rows, each pair of blocks in a task of bounded memory."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Vectors whose squared length reaches this take no part: their scores need not fit a long.
MAX_SQUARE = float(1 << 62)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256, **extra: Column) -> DataFrame:
    """``(vec_id, vec array<int>, extra...)``: floor(scale * x) of each component.  Left
    out: null ids and vectors, null or non-finite components, squared lengths of 2**62 or
    more.  Of rows that repeat an id the one with the least vector (then extra) counts."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *[c.alias(n) for n, c in extra.items()])
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 31)))
    scaled = rows.where(sound).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    least = Window.partitionBy("vec_id").orderBy("vec", *extra)
    return (scaled.where(square < MAX_SQUARE).select("vec_id", F.col("v").cast("array<int>").alias("vec"), *extra)
            .withColumn("nth", F.row_number().over(least)).where("nth = 1").drop("nth"))


def nodes_of(rows: DataFrame, keep: int, *by: str) -> DataFrame:
    """``(node, width, vec, by..., ids)``: the distinct vectors (within ``by``), with their
    ``keep`` smallest ids in order; a partial limit drops the others before the shuffle."""
    first = Window.partitionBy(*by, "vec").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= keep)
    made = few.groupBy(*by, "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most ``keep`` ids
    return made.select(F.monotonically_increasing_id().alias("node"), F.size("vec").alias("width"), "vec", *by, "ids")


def spread_order(nodes: DataFrame, dims: int) -> list[int]:
    """The ``dims`` coordinates of largest variance, the largest first (read from one row
    for each coordinate)."""
    at = nodes.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s"))
    return [r["i"] for r in at.orderBy(F.desc("s"), "i").limit(dims).collect()]


def blocked(rows: DataFrame, order: list[Column], size: int, n: int, name: str, column: str, inner=None) -> DataFrame:
    """``rows`` with ``column``, the number of a block of at most ``size`` rows with equal
    width, near in ``order``.  ``inner`` (a sort of positions, given the Arrow batch) orders
    rows in a task before they are cut; a task holds about 16 blocks."""
    import pyarrow as pa
    from pyspark import TaskContext

    width = rows.columns.index("width")

    def cut(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part = TaskContext.get().partitionId()
        t = pa.Table.from_batches(got).combine_chunks()
        at = inner(t) if inner else np.arange(t.num_rows)
        t = t.take(pa.array(at))
        w = t.column(width).to_numpy()
        block, begin = np.zeros(len(w), np.int64), 0
        number = 0
        for stop in [*(np.flatnonzero(np.diff(w)) + 1), len(w)]:
            block[begin:stop] = number + np.arange(stop - begin) // size
            number = block[stop - 1] + 1
            begin = stop
        t = t.append_column(column, pa.array((np.int64(part) << 32) + block))
        yield from t.to_batches(max_chunksize=4096)

    parts = max(1, math.ceil(n / (16 * size)))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], f"{column} long"])
    near = rows.repartitionByRange(parts, "width", *order, "node").sortWithinPartitions("width", *order, "node")
    return stage(near.mapInArrow(cut, schema), name)


def meet(left: DataFrame, right: DataFrame, tiles: DataFrame, by: list[str], search, schema: str, name: str) -> DataFrame:
    """``search`` on every tile (a pair of blocks, the ``by`` columns of ``tiles``): the
    rows of its left and of its right block, both in memory."""
    conf = left.sparkSession.conf
    want = max(int(conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism)
    # a stated number, for tiles are few rows but much work
    parts = max(1, min(tiles.count(), 4 * want))
    one, other = (d.repartition(parts, *by).groupBy(*by) for d in (left, right))
    return stage(one.cogroup(other).applyInArrow(search, schema), name)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column of equal widths as an int64 matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), width)


def slack(q: np.ndarray, most: np.ndarray) -> float:
    """What bounds in doubles may be off: nothing as long as all sums are exact."""
    size = float(np.abs(q) @ most)
    return 0.0 if size < 2.0 ** 52 else size * 1e-12
