"""Running products along ordered segments, such as the turns of a conversation, when a
segment may hold most of all rows.

Rows are range-partitioned by segment and order, each task folds its own rows, and
the fold of a segment that began in an earlier partition is put before it: the
operation is associative, so only one value per partition is carried."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Monoid:
    """An associative operation on tuples of longs: ``ints`` in Python, ``columns`` on Columns."""

    identity: tuple[int, ...]
    ints: Callable[[tuple, tuple], tuple]
    columns: Callable[[list[Column], list[Column]], list[Column]]


def sums(width: int) -> Monoid:
    return Monoid((0,) * width, lambda x, y: tuple(a + b for a, b in zip(x, y)),
                  lambda x, y: [a + b for a, b in zip(x, y)])


def _fold(monoid: Monoid, segment: int, values: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first, now, state = TaskContext.get().partitionId(), 0, None, None, monoid.identity
        for b in batches:
            if not b.num_rows:
                continue
            seg = b.column(segment).to_pylist()
            if at == 0:
                first = now = seg[0]
            before = []
            for s, *x in zip(seg, *[b.column(i).to_pylist() for i in values]):
                if s != now:
                    now, state = s, monoid.identity
                before.append(state)
                state = monoid.ints(state, tuple(x))
            yield pa.record_batch(
                [*b.columns, pa.array([part] * len(seg), pa.int32()), pa.array(range(at, at + len(seg)), pa.int64()),
                 pa.array([s == first for s in seg]), *[pa.array(c, pa.int64()) for c in zip(*before)]], names=names)
            at += len(seg)
    return run


def running(df: DataFrame, segment: str, order: list[str], values: list[str], monoid: Monoid, name: str) -> DataFrame:
    """``df`` with ``before_<value>``: the product of the rows that precede a row in its
    segment.  ``segment`` is a long without nulls; rows with equal ``order`` in a segment
    must be interchangeable."""
    before = [f"before_{v}" for v in values]
    cols = df.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields],
                        "part int, at long, open boolean", *[f"{c} long" for c in before]])
    spread = df.withColumn("__at", F.monotonically_increasing_id())
    rows = spread.repartitionByRange(segment, *order, "__at").sortWithinPartitions(segment, *order, "__at").drop("__at")
    names = [*cols, "part", "at", "open", *before]
    placed = stage(rows.mapInArrow(_fold(monoid, cols.index(segment), [cols.index(v) for v in values], names), schema), name)
    # one row for each partition
    last = placed.groupBy("part").agg(F.min(segment).alias("first"), F.max_by(F.struct(segment, "open", *values, *before), "at").alias("row"))
    carries, ended, state = [], None, monoid.identity
    for r in sorted(last.collect(), key=lambda r: r["part"]):
        end = r["row"]
        own = monoid.ints(tuple(end[c] for c in before), tuple(end[c] for c in values))
        if ended is not None and r["first"] == ended:
            carries.append((r["part"], *state))
            state = monoid.ints(state, own) if end["open"] else own
        else:
            state = own
        ended = end[segment]
    if not carries:
        return placed.select(*cols, *before)
    known = placed.sparkSession.createDataFrame(carries, "part int, " + ", ".join(f"carry_{v} long" for v in values))
    joined = placed.join(F.broadcast(known), "part", "left")  # at most one row for each partition
    whole = monoid.columns([F.col(f"carry_{v}") for v in values], [F.col(c) for c in before])
    late = F.col("open") & F.col(f"carry_{values[0]}").isNotNull()
    return joined.select(*cols, *[F.when(late, w).otherwise(F.col(c)).alias(c) for w, c in zip(whole, before)])
