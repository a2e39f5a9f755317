"""Published data sets with a manifest that proves their content (S-11, A-19).

``publish`` writes the rows first and the one-row manifest last, so a data set without a
manifest does not exist.  The manifest holds what the file names used to say (board,
count, date, method, held-out start, percent, parent) and a fingerprint of the rows that
does not depend on their order, their files or their number of tasks; ``read_checked``
computes it again and refuses rows that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import DEFAULT_BOARD, Board
from .parquet import step_budget

#: Hexadecimal digits of a row's md5 that are summed: the sum fits a decimal of 38 digits.
DIGITS = 15


class ContentError(ValueError):
    """The rows are not those that were published."""


def fingerprint(*key: str) -> tuple[Column, Column]:
    """Aggregates ``(rows, fingerprint)``: the sum of a hash of each row's ``key`` columns
    (joined by ":", null as the empty string); repeated rows count as often as they occur."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    part = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("decimal(20,0)")
    return F.count("*").alias("rows"), F.coalesce(F.sum(part).cast("string"), F.lit("0")).alias("fingerprint")


def publish(df: DataFrame, path: str, key: tuple[str, ...], method: str, start: int | None = None, fraction: str = "1",
            parent: str | None = None, board: Board = DEFAULT_BOARD, seed: int = 42) -> DataFrame:
    """Writes ``df`` under ``path`` and returns its manifest: dataset (a readable name), board,
    rows, rows_text, start, fraction, method, parent, seed, created, train_steps, key, fingerprint.

    ``fraction`` is a decimal number as text, ``key`` the columns that the fingerprint covers."""
    spark = df.sparkSession
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/rows")
    facts = spark.read.parquet(f"{path}/rows").agg(*fingerprint(*key))
    size, percent = f"{board.width}x{board.height}", F.round(F.lit(fraction).cast("decimal(12,10)") * 100, 2).cast("double")
    day = F.date_format(F.current_date(), "yyyyMMdd")
    held = F.lit(start).cast("int")
    name = F.concat_ws("_", F.lit(size), F.col("rows").cast("string"), F.lit(method),
                       F.concat(F.lit("start"), held.cast("string")), F.concat(percent.cast("string"), F.lit("pct")), day)
    manifest = facts.select(
        name.alias("dataset"), F.lit(size).alias("board"), "rows", F.format_number("rows", 0).alias("rows_text"),
        held.alias("start"), F.lit(fraction).cast("decimal(12,10)").cast("double").alias("fraction"), F.lit(method).alias("method"),
        F.lit(parent).cast("string").alias("parent"), F.lit(seed).alias("seed"), day.alias("created"),
        step_budget(F.col("rows")).alias("train_steps"), F.lit(",".join(key)).alias("key"), "fingerprint")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, manifest)`` of a published data set; ``ContentError`` if its rows are not
    those that the manifest describes."""
    manifest = spark.read.parquet(f"{path}/manifest")
    rows = spark.read.parquet(f"{path}/rows")
    said = manifest.first()
    found = rows.agg(*fingerprint(*said["key"].split(","))).first()
    if (found["rows"], found["fingerprint"]) != (said["rows"], said["fingerprint"]):
        raise ContentError(f"{path}: {found['rows']} rows with fingerprint {found['fingerprint']}, "
                           f"published were {said['rows']} with {said['fingerprint']}")
    return rows, manifest
