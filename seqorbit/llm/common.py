"""Helpers shared by the operators: table access, staging, byte tokenisers,
vectorised word hashing and connected components."""

from __future__ import annotations

from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

MASK64 = (1 << 64) - 1
#: Sorts before every real id; stands for a null id inside an operator.
NULL_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, and Spark
    drops the shuffle files behind the table as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        table = materialize(df, f"llm-{name}")
    finally:
        if before is None:
            conf.unset(_FREE_SHUFFLES)
        else:
            conf.set(_FREE_SHUFFLES, before)
    if (block := _SCRATCH.get()) is not None:
        block.tables.append(table)
    return table


def _free(table: DataFrame) -> None:
    """Deletes the files of a table that ``stage`` has written."""
    for f in table.inputFiles()[:1]:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if path.getName().startswith("stage-llm-"):
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """The stage tables written in a ``with`` block.  They are freed at its end, or before by
    ``drop``; tables that a lazy result still reads are passed on to the block around by ``keep``."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def __enter__(self):
        self._token = _SCRATCH.set(self)
        return self

    def __exit__(self, *error):
        _SCRATCH.reset(self._token)
        if (outer := _SCRATCH.get()) is not None:
            outer.tables.extend(self.kept)
        self.drop(*self.tables)

    def _without(self, gone) -> None:
        self.tables = [t for t in self.tables if not any(t is x for x in gone)]

    def drop(self, *tables: DataFrame) -> None:
        self._without(tables)
        for t in tables:
            _free(t)

    def keep(self, table: DataFrame) -> DataFrame:
        self._without([table])
        self.kept.append(table)
        return table


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def binaries(column) -> list:
    """Python bytes (or None) of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


# --------------------------------------------------------------------------
# tokenising a whole Arrow column at once
# --------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_BYTES = _byte_table()


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have:have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


class Hasher:
    """Word hashes of many texts in one pass over their bytes: a polynomial
    prefix sum gives every word's hash by one subtraction, then a mix."""

    def __init__(self):
        self.r = self.rinv = np.ones(1, np.uint64)

    def words(self, texts: list, lower: bool):
        """``(hashes, offsets)`` of the ASCII-white-space words of ``texts``
        (None counts as empty); words of text i are offsets[i]:offsets[i+1]."""
        data = b"\n".join(b"" if t is None else t for t in texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        if lower:
            buf = _LOWER[buf]
        if len(self.r) < len(buf) + 1:
            n = 1 << int(len(buf) + 1).bit_length()
            self.r, self.rinv = _powers(_BASE, n), _powers(_BASE_INV, n)
        word = ~_SPACE[buf]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        ends = np.flatnonzero(edge == -1)
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[buf] * self.r[:len(buf)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.rinv[starts]
        h = mix64(h + (ends - starts).astype(np.uint64))
        sizes = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=begin[1:])
        return h, np.searchsorted(starts, begin), starts, ends


def batches_of(texts: list, max_bytes: int = 4 << 20):
    """Index ranges of ``texts`` of about ``max_bytes`` each (at least one text)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < max_bytes):
            size += len(texts[j] or b"")
            j += 1
        yield i, j
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest reachable node, for every node of
    ``edges(a, b)`` that has a link.

    Alternating large-star and small-star contraction: each round links every
    node to the smallest node near it, so rounds grow with the logarithm of a
    component's diameter; a round in which every node has either one smaller or
    only greater neighbours ends them, as it would change nothing.  All state is in staged tables; minima are combined
    before the shuffle, and the joins have a plain exchange on either side, so a
    node with very many links is split by the adaptive join."""
    with Scratch() as own:
        e = own.keep(_contracted(own, edges, max_rounds))
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def _contracted(own: Scratch, edges: DataFrame, max_rounds: int) -> DataFrame:
    """The stars ``(u, v)`` of all components: u is the smallest node."""
    e = stage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
              .where("u < v").distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        near = both.groupBy("x").agg(F.min("y").alias("m"), F.max("y").alias("top"), F.count_if(F.col("y") < F.col("x")).alias("below"))
        goes_on = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("top") > F.col("x")))
        low = stage(near.select("x", F.least("x", "m").alias("m"), goes_on.alias("goes_on")), "cc-large")
        if low.where("goes_on").isEmpty():
            break
        low = low.select("x", "m")
        large = stage(both.join(low, "x").where("y > x")
                      .select(F.col("m").alias("u"), F.col("y").alias("v")).distinct(), "cc-star")
        low = stage(large.groupBy("v").agg(F.min("u").alias("m")), "cc-small")
        small = large.join(low, "v")
        e = stage(small.select(F.col("m").alias("u"), "v")
                  .union(small.where("u <> m").select("m", F.col("u").alias("v"))).distinct(), "cc-edges")
        own.drop(*[t for t in own.tables if t is not e])
    else:
        raise RuntimeError("components did not settle")
    return e
