"""A-8 / A-17: number of distinct k-prefixes for every k (P-1).

Naive form: one ``count(DISTINCT slice(tour, 1, k))`` per k, i.e. k times the
data through a shuffle.  Here: one range repartition on (group, sequence) and
a sort inside each partition; then, per partition, the length of the common
prefix with the previous row (vectorised with NumPy inside the task).  A row
starts a new k-prefix exactly when its common prefix with the previous row
is shorter than k, so the curve is a cumulative histogram of those lengths.
The first row of each partition is corrected against the last row of the
previous non-empty partition: a table of two rows per partition.

Range partitioning uses the whole sequence, so a group (a start square, a
source) that holds most rows is still spread over many partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SAME = 1 << 30  # "identical to the previous row": never starts a new prefix

_OUT = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),      # 0 first row, 1 last row, 2 histogram
    T.StructField("grp", T.StringType()),
    T.StructField("d", T.IntegerType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("seq", T.ArrayType(T.ShortType())),
])


def _padded(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List array -> (matrix padded with -1, lengths)."""
    arr = arr.cast(pa.list_(pa.int16()))
    offsets = np.asarray(arr.offsets)
    lengths = np.diff(offsets)
    width = int(lengths.max()) if len(lengths) else 0
    values = np.asarray(arr.flatten()) if width else np.zeros(0, np.int16)
    m = np.full((len(lengths), max(width, 1)), -1, dtype=np.int16)
    if width:
        rows = np.repeat(np.arange(len(lengths)), lengths)
        cols = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        m[rows, cols] = values
    return m, lengths


def _lcp_rows(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """d[i] for rows 1..n-1 against the row before (SAME if identical)."""
    if len(m) < 2:
        return np.zeros(0, dtype=np.int64)
    neq = m[1:] != m[:-1]
    any_neq = neq.any(axis=1)
    first = np.where(any_neq, neq.argmax(axis=1), m.shape[1])
    lo = np.minimum(lengths[1:], lengths[:-1])
    lcp = np.minimum(first, lo)
    same = (lengths[1:] == lengths[:-1]) & (lcp >= lengths[1:])
    return np.where(same, SAME, lcp).astype(np.int64)


def _partition_lcp(batches):
    pid = TaskContext.get().partitionId()
    hist: dict[tuple[str, int], int] = {}
    first_row = None
    last_grp, last_seq = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        grp = batch.column(0).cast(pa.string()).to_pylist()
        seqs = batch.column(1)
        if last_seq is not None:  # carry the previous batch's last row
            grp = [last_grp] + grp
            seqs = pa.concat_arrays([pa.array([last_seq], type=seqs.type), seqs])
        else:
            first_row = (grp[0], seqs[0].as_py())
        m, lengths = _padded(seqs)
        d = _lcp_rows(m, lengths)
        g = np.array(grp, dtype=object)
        d = np.where(g[1:] != g[:-1], 0, d)  # new group: every prefix is new
        if len(d):
            counts = pd.DataFrame({"g": g[1:], "d": d}).value_counts()
            for (gk, dk), cnt in counts.items():
                hist[(gk, int(dk))] = hist.get((gk, int(dk)), 0) + int(cnt)
        last_grp, last_seq = grp[-1], seqs[len(seqs) - 1].as_py()
    rows = {"pid": [], "kind": [], "grp": [], "d": [], "cnt": [], "seq": []}

    def put(kind, grp, d, cnt, seq):
        rows["pid"].append(pid); rows["kind"].append(kind); rows["grp"].append(grp)
        rows["d"].append(d); rows["cnt"].append(cnt); rows["seq"].append(seq)

    if first_row is not None:
        put(0, first_row[0], None, None, first_row[1])
        put(1, last_grp, None, None, last_seq)
    for (grp, d), cnt in hist.items():
        put(2, grp, min(d, SAME), cnt, None)
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
        ("pid", pa.int32()), ("kind", pa.int32()), ("grp", pa.string()), ("d", pa.int32()),
        ("cnt", pa.int64()), ("seq", pa.list_(pa.int16()))]))


def _lcp_expr(a: Column, b: Column) -> Column:
    """Common prefix length of two arrays, or SAME when equal."""
    n = F.least(F.size(a), F.size(b))
    eq = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                     lambda i: F.when(i <= n, F.element_at(a, i) == F.element_at(b, i)))
    pos = F.array_position(eq, False)
    lcp = F.when(n == 0, F.lit(0)).when(pos == 0, n).otherwise(pos - 1)
    return F.when((F.size(a) == F.size(b)) & (lcp >= F.size(a)), F.lit(SAME)).otherwise(lcp)


def prefix_diversity(df: DataFrame, seq: str, max_k: int, group: str | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """``(group?, k, n_prefixes)`` for k = 1..max_k over the rows of ``df``.

    Duplicated sequences count once.  ``group`` (optional) restarts the
    curve per value (A-17: per source)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = F.col(group).cast("string") if group else F.lit("")
    base = df.select(g.alias("grp"), F.col(seq).cast("array<smallint>").alias("seq"))
    ordered = base.repartitionByRange(n, "grp", "seq").sortWithinPartitions("grp", "seq")
    # small (two rows per partition plus a histogram of at most max_k + 2
    # lengths per group and partition); a reliable checkpoint keeps the
    # shuffle and the Arrow pass from running twice below
    stats = cut_lineage(ordered.mapInArrow(_partition_lcp, _OUT))
    bounds = stats.where("kind < 2")
    # at most two rows per partition: a global window here is bounded by the
    # partition count, not by the data
    w = Window.orderBy("pid", "kind")
    firsts = (bounds.withColumn("pg", F.lag("grp").over(w)).withColumn("ps", F.lag("seq").over(w))
              .where("kind = 0")
              .select("grp", F.when(F.col("ps").isNull() | (F.col("pg") != F.col("grp")), F.lit(0))
                      .otherwise(_lcp_expr(F.col("ps"), F.col("seq"))).alias("d"),
                      F.lit(1).cast("long").alias("cnt")))
    hist = (stats.where("kind = 2").select("grp", "d", "cnt").unionByName(firsts)
            .groupBy("grp", "d").agg(F.sum("cnt").alias("cnt")))
    per_grp = hist.groupBy("grp").agg(F.collect_list(F.struct("d", "cnt")).alias("h"))
    ks = F.sequence(F.lit(1), F.lit(max_k))
    curve = per_grp.select("grp", F.explode(ks).alias("k"), "h").select(
        "grp", F.col("k").cast("int").alias("k"),
        F.aggregate(F.filter("h", lambda x: x["d"] < F.col("k")), F.lit(0).cast("long"),
                    lambda acc, x: acc + x["cnt"]).alias("n_prefixes"))
    if group:
        return curve.withColumnRenamed("grp", group)
    return curve.drop("grp")
