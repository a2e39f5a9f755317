"""Parquet sources and sinks, wide/array adapters, packing and manifests
(S-1, S-2, S-5..S-14, F-8..F-10, A-19)."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.board import DEFAULT_BOARD, TOUR_TYPE, Board
from ..session import stage_path


def wide_schema(n_moves: int = 64) -> T.StructType:
    """S-1: the interchange schema ``move_0 … move_{n-1}`` of TINYINT."""
    return T.StructType([T.StructField(f"move_{i}", T.ByteType()) for i in range(n_moves)])


def read_wide(spark: SparkSession, *paths: str, n_moves: int = 64, number: str | None = None) -> DataFrame:
    """S-1/S-2: read wide tour files with an explicit schema; ``number`` is a pattern
    whose first group is the number in a file's path, added as ``file_no``."""
    df = spark.read.schema(wide_schema(n_moves)).parquet(*paths)
    if number:
        df = df.withColumn("file_no", F.regexp_extract(F.col("_metadata.file_path"), number, 1).cast("int"))
    return df


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The ``paths`` that hold files (a numbered file without rows is not written)."""
    def there(path: str) -> bool:
        try:
            spark.read.format("binaryFile").load(path).schema
            return True
        except AnalysisException:
            return False
    return [p for p in paths if there(p)]


def from_wide(df: DataFrame, n_moves: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """F-8: ``move_*`` columns -> one ``tour`` array (and the ``start``)."""
    tour = F.array(*[F.col(f"move_{i}") for i in range(n_moves)]).cast(TOUR_TYPE)
    return df.select(*keep, tour.alias("tour")).withColumn("start", F.try_element_at("tour", F.lit(1)))


def to_wide(df: DataFrame, tour: str = "tour", n_moves: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """F-9: array -> ``move_0 … move_{n-1}`` (null past the end, never an error)."""
    return df.select(*keep, *[F.try_element_at(tour, F.lit(i + 1)).cast("tinyint").alias(f"move_{i}")
                              for i in range(n_moves)])


def strict_tinyint(df: DataFrame, cols: list[str]) -> DataFrame:
    """F-1: strict downcast (raises on overflow under ANSI, like the reference)."""
    return df.select(*[F.col(c).cast("tinyint").alias(c) if c in cols else F.col(c) for c in df.columns])


def fits_tinyint(cols: list[str]):
    """Whether all of a row's ``cols`` are null or fit TINYINT."""
    ok = None
    for c in cols:
        term = F.col(c).try_cast("tinyint").isNotNull() | F.col(c).isNull()
        ok = term if ok is None else ok & term
    return ok


def quarantine_tinyint(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """F-1 variant: rows whose values fit TINYINT, and the rows that do not."""
    return df.where(fits_tinyint(cols)), df.where(~fits_tinyint(cols))


def write_clustered(df: DataFrame, path: str, n_files: int | None = None, tour: str = "tour",
                    start: str = "start", partition_by: tuple[str, ...] = (),
                    max_records_per_file: int | None = None, mode: str = "errorifexists") -> None:
    """S-7/S-8/S-10: zstd Parquet, range-partitioned on (start, tour) and
    sorted inside each file, so neighbouring rows share long prefixes (better
    dictionary/RLE) and files cover disjoint key ranges.  Ranges come from
    the whole sequence, so a dominant start square is still split."""
    n = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, start, tour).sortWithinPartitions(start, tour)
    w = out.write.mode(mode).option("compression", "zstd")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """S-9: append without reading the existing data back."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def pack(df: DataFrame, tour: str = "tour") -> DataFrame:
    """F-10: causal-LM samples: ``input_ids`` and ``labels`` (a copy)."""
    return df.select(F.col(tour).alias("input_ids"), F.col(tour).alias("labels"))


def packed_schema(keys: str) -> T.StructType:
    """The schema of packed samples behind the ``keys`` columns (a DDL string)."""
    return T.StructType([T.StructField("input_ids", TOUR_TYPE), T.StructField("labels", TOUR_TYPE),
                         *T.StructType.fromDDL(keys).fields])


def write_packed(df: DataFrame, path: str, by: tuple[str, ...], tour: str = "tour") -> None:
    """H-6/S-13: packed samples as zstd Parquet, one folder per ``by`` value, rows in
    the order of ``df``."""
    ids = F.col(tour)
    (df.select(*by, ids.alias("input_ids"), ids.alias("labels"))
       .write.partitionBy(*by).option("compression", "zstd").parquet(path))


def stream_copy(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S-10/S-13: read a folder as a file stream until its present end, land it in the
    shared folder and return what was landed."""
    out = stage_path(spark, "streamed")
    query = (spark.readStream.schema(schema).parquet(path).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", stage_path(spark, "streamed-ckpt"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


# The trainer's step budget constants (GPUs, per-device batch,
# epochs, gradient accumulation).
TRAIN_GPUS, TRAIN_BATCH, TRAIN_EPOCHS, TRAIN_ACCUM = 2, 128, 1, 1


def step_budget(rows, gpus=TRAIN_GPUS, batch=TRAIN_BATCH, epochs=TRAIN_EPOCHS, accum=TRAIN_ACCUM):
    """A-19: ``rows // (gpus * batch) * epochs // accumulation`` (Column or int)."""
    if isinstance(rows, int):
        return (rows // (gpus * batch)) * epochs // accum
    return F.floor(F.floor(rows / F.lit(gpus * batch)) * epochs / F.lit(accum)).cast("long")


def manifest(df: DataFrame, name_col: str, board: Board = DEFAULT_BOARD, seed: int = 42,
             parent: str | None = None) -> DataFrame:
    """S-11/A-19: one provenance row per dataset (rows counted by Spark; the
    name/board/seed/date move from file names into columns)."""
    return df.groupBy(name_col).agg(F.count("*").alias("rows")).select(
        F.col(name_col).alias("dataset"), "rows",
        F.lit(f"{board.width}x{board.height}").alias("board"),
        F.lit(seed).alias("seed"), F.lit(parent).cast("string").alias("parent"),
        F.lit(date.today().strftime("%Y%m%d")).alias("created"),
        step_budget(F.col("rows")).alias("train_steps"))

