"""Registered queries: packed training sets, the cross-source split, given wide files,
strict casts, source contributions, quotas per start and the full prompt set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import corpus as C
from ..operators import scoring as SC
from ..operators import split as S
from ..session import stage_path
from ..sources import parquet as PQ
from ..sources.tables import read_table
from . import sqltext as Q
from .catalog import BOARD, N, PRE, register, tours
from .catalog_scoring import PARTIAL_SQL, partials
from .catalog_splits import NESTED, SEED, SOURCE_FRACTION, _h, _nested_sql, parts

# The sampled shares of the training and validation sets, in percent.
PERCENTS = tuple(int(f * 100) for f in NESTED)


def _packed_sets_sql() -> str:
    shares = ", ".join(f"({f}, {p})" for f, p in zip(NESTED, PERCENTS))
    return ("SELECT l.split, s.pct, l.image_key AS input_ids, l.image_key AS labels FROM ("
            + _nested_sql() + f") l JOIN (VALUES {shares}) s(f, pct) ON l.min_fraction <= s.f")


@register("packed_training_sets", "F-10 H-6 S-13 M-1 M-5 T-1", _packed_sets_sql())
def q_packed_training_sets(spark, sf):
    """Samples of every share of train and val: shuffled by hash, written as zstd
    Parquet by (split, pct), and streamed back as arrays."""
    lv = S.nested_levels(parts(spark, sf)["split"], "image_key", NESTED, SEED, by=("split",),
                         tie=("tour_id", "sym_id"), max_groups=2)
    shares = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(p).alias("pct")) for f, p in zip(NESTED, PERCENTS)])
    each = (lv.where("min_fraction IS NOT NULL").withColumn("s", F.explode(shares))
            .where("min_fraction <= s.f").select("split", F.col("s.pct").alias("pct"), "image_key"))
    each = each.select("split", "pct", "image_key", F.split("image_key", "-").cast(B.TOUR_TYPE).alias("tour"))
    path = stage_path(spark, "packed")
    PQ.write_packed(S.hash_order(each, "image_key", SEED, by=("split", "pct")), path, by=("split", "pct"))
    back = PQ.stream_copy(spark, path, PQ.packed_schema("split string, pct int"))
    return back.select("split", "pct", B.tour_key("input_ids", BOARD).alias("input_ids"),
                       B.tour_key("labels", BOARD).alias("labels"))


# The source that trains and the sources that validate.
TRAIN_SOURCE = "1-URGENT"
VAL_SOURCES = ("2-HIGH", "3-MEDIUM", "5-LOW")


@register("cross_source_split", "M-7 M-6 F-10",
          PRE + f", r AS (SELECT tour_id, source, tkey, row_number() OVER (PARTITION BY source ORDER BY {_h('tkey')}, "
          f"tour_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM tv WHERE valid AND source IN {VAL_SOURCES}) "
          f"SELECT 'train' AS split, tour_id, source, tkey AS input_ids FROM tv WHERE valid AND source = '{TRAIN_SOURCE}' "
          f"UNION ALL SELECT 'val', tour_id, source, tkey FROM r WHERE rn <= floor(n * {SOURCE_FRACTION})")
def q_cross_source_split(spark, sf):
    """Train on all of one source, validate on an exact share of each of three others."""
    t = tours(spark, sf).where(B.is_valid_tour("tour", BOARD)).select(
        "tour_id", "source", B.tour_key("tour", BOARD).alias("input_ids"))
    train = t.where(F.col("source") == TRAIN_SOURCE).withColumn("split", F.lit("train"))
    val = S.exact_fraction(t.where(F.col("source").isin(*VAL_SOURCES)), "input_ids", SOURCE_FRACTION, SEED,
                           by=("source",), tie=("tour_id",), max_groups=len(VAL_SOURCES))
    val = val.where("picked").drop("picked").withColumn("split", F.lit("val"))
    return train.unionByName(val).select("split", "tour_id", "source", "input_ids")


# How many numbered files the corpus is dealt to.
N_FILES = 4


@register("wide_sources", "S-1 S-2 F-8",
          PRE + f" SELECT CAST(tour_id % {N_FILES} AS INTEGER) AS file_no, tkey AS tour_key, count(*) AS n_rows "
          "FROM tv GROUP BY ALL")
def q_wide_sources(spark, sf):
    """Numbered folders of wide rows, read with the explicit schema; the number comes from the path."""
    t = tours(spark, sf).withColumn("no", (F.col("tour_id") % N_FILES).cast("int"))
    path = stage_path(spark, "numbered-wide")
    PQ.to_wide(t, "tour", N, keep=("no",)).write.partitionBy("no").option("compression", "zstd").parquet(path)
    given = [f"{path}/no={k}" for k in range(N_FILES)]
    wide = PQ.read_wide(spark, *PQ.existing(spark, given), n_moves=N, number=r"no=(\d+)")
    rows = PQ.from_wide(wide, N, keep=("file_no",))
    return rows.groupBy("file_no", B.tour_key("tour", BOARD).alias("tour_key")).agg(F.count("*").alias("n_rows"))


@register("strict_cast", "F-1",
          "SELECT CAST(l_linenumber AS TINYINT) AS line_no, CAST(l_partkey % 128 AS TINYINT) AS square, "
          "count(*) AS n_rows FROM lineitem GROUP BY ALL")
def q_strict_cast(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_linenumber", "l_partkey").select(
        F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") % 128).alias("square"))
    return PQ.strict_tinyint(li, ["line_no", "square"]).groupBy("line_no", "square").agg(F.count("*").alias("n_rows"))


@register("canonical_sources", "U-4 A-6",
          PRE + " SELECT canon AS canon_key, source, count(*) AS n_copies, min(tour_id) AS first_tour_id "
          "FROM tv WHERE valid GROUP BY canon, source")
def q_canonical_sources(spark, sf):
    found = C.source_contributions(tours(spark, sf), board=BOARD)
    return found.select(B.tour_key("canon", BOARD).alias("canon_key"), "source", "n_copies", "first_tour_id")


# Tours taken for each start square.
START_QUOTA = 5


@register("quota_per_start", "O-6 M-6",
          PRE + f", r AS (SELECT tour_id, start, tkey, row_number() OVER (PARTITION BY start ORDER BY {_h('tkey')}, "
          f"tour_id) AS rn FROM tv WHERE valid) SELECT tour_id, start, tkey AS tour_key FROM r WHERE rn <= {START_QUOTA}")
def q_quota_per_start(spark, sf):
    t = tours(spark, sf).where(B.is_valid_tour("tour", BOARD)).select(
        "tour_id", F.col("start").cast("int").alias("start"), B.tour_key("tour", BOARD).alias("tour_key"))
    picked = S.exact_quota(t, "tour_key", START_QUOTA, SEED, by=("start",), tie=("tour_id",), max_groups=N)
    return picked.where("picked").select("tour_id", "start", "tour_key")


@register("all_prompts", "E-4 G-1 F-7",
          PARTIAL_SQL + "SELECT tour_id, 'partial' AS case_set, CAST(len(tour) AS INTEGER) AS given_len, "
          f"{Q.key('tour')} AS given FROM pt WHERE {Q.legal('tour')} AND {Q.unique('tour')} "
          "UNION ALL SELECT CAST(s AS BIGINT), 'every_start', 1, lpad(CAST(s AS VARCHAR), 2, '0') "
          f"FROM range({N}) r(s)")
def q_all_prompts(spark, sf):
    """Every valid partial tour, and each square of the board, as a prompt."""
    return SC.prompt_set(partials(spark, sf), BOARD).select(
        "tour_id", "case_set", "given_len", B.tour_key("given", BOARD).alias("given"))
