"""A training-data pipeline over ``documents``: language ID, line dedup, near-dedup,
benchmark decontamination, source mixing.

Each stage is ``f(spark, docs, sf_dir)`` and works on all rows the stage before kept;
its result is written as Parquet and read again for the next.  All but the last
return the columns of documents; the last adds size, source_size, target, taken and
first_slot.  Columns a stage does not need pass through unchanged.

Defined results: text that is null or has no letter is rejected by the first stage; a
document whose lines all go leaves with the second; rows that repeat an id and a text
are one document from the third on; an empty table passes as an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqorbit.llm import decontaminate, language, line_dedup, minhash_dedup, mixing
from seqorbit.llm.common import Scratch, read, stage

#: Language predictions that are less sure than this are rejected.
MIN_LANGUAGE_SCORE = 0.4


def _others(docs: DataFrame, *used: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in used)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    # other columns go by private names, whatever they are called
    private = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    plain = docs.withColumnsRenamed(private)
    found = language.identify(plain, extra=_others(plain, "doc_id"))
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return sure.select(*[F.col(private.get(c, c)).alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles are cut from their text."""
    rest = _others(docs, "doc_id", "text")
    found = line_dedup.dedup_lines(docs, extra=rest)
    kept = found.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    cols = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"x_{c}") for c in rest}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("x_n_chars")).cast(
            docs.schema["n_chars"].dataType)
    return kept.select(*[cols[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8)."""
    key = "__rk"
    while key in docs.columns:
        key += "_"
    with Scratch() as own:
        found = minhash_dedup.near_duplicates(docs, shingle=5, threshold=0.8)
        keep = own.keep(stage(found.where("kept").select(F.col("rk").alias(key)).distinct(), "pipeline-keep"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    rest = _others(docs, "doc_id")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), extra=rest)
    cols = {"doc_id": F.col("doc_id")} | {c: F.col(f"x_{c}") for c in rest}
    return found.where("NOT contaminated").select(*[cols[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words from, with how many it takes."""
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    added = ["size", "source_size", "target", "taken", "first_slot"]
    mixed = mixing.mixed_documents(rows, id_col="__row").where("taken > 0").select(F.col("doc_id").alias("__row"), *added)
    own = [c for c in docs.columns if c not in added]
    return rows.select("__row", *own).join(mixed, "__row").drop("__row")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_stage),
]

#: Language ID and the shuffles by Spark's own hashes have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        with Scratch() as own:  # its tables and the result before
            docs = own.keep(stage(f(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower()))
    return docs
