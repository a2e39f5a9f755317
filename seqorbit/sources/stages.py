"""Stage tables kept for later queries, by the input files they were derived from (S-12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path


def input_mark(spark: SparkSession, folder: str) -> tuple:
    """``(files, mark)`` of all Parquet files below ``folder``: their number and an order-free
    hash of path, length and time of change.  Only the listing is read, no content."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(folder).select("path", "length", "modificationTime"))
    return tuple(files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns))).first())


class Stages:
    """Tables by (application, input folder, name); one is reused while the input files are
    the same and built anew, under a fresh path, once they differ.  Replaced tables stay
    until ``release``, as open DataFrames may still read them."""

    def __init__(self):
        self._held: dict[tuple, tuple] = {}
        self._written: list[tuple] = []

    def get(self, spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        app = spark.sparkContext.applicationId
        key, mark = (app, folder.rstrip("/"), name), input_mark(spark, folder)
        if self._held.get(key, (None,))[0] != mark:
            df, path = build(), stage_path(spark, name)
            df.write.option("compression", "zstd").parquet(path)
            self._held[key] = (mark, path, df.schema)
            self._written.append((app, path, df.schema))
        _, path, schema = self._held[key]
        # the schema is known: no file is opened for it, and an empty table is one like any other
        return spark.read.schema(schema).parquet(path)

    def release(self, spark: SparkSession) -> int:
        """Empties every table of this application and forgets it; returns their number."""
        app = spark.sparkContext.applicationId
        mine = [x for x in self._written if x[0] == app]
        self._written = [x for x in self._written if x[0] != app]
        self._held = {k: v for k, v in self._held.items() if k[0] != app}
        for _, path, schema in mine:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return len(mine)


STAGES = Stages()
