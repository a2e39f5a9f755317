"""Registered queries: holdouts, splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import holdout as H
from ..operators import split as S
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import sqltext as Q
from .catalog import BOARD, CANON_LIST, PRE, canon, register, staged, tours

SPEC = H.HoldoutSpec()
SEED = SPEC.seed


def _h(key):
    return f"md5({key} || ':{SEED}')"


def _img_rows(rel: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT tour_id, canon_key, {k} AS sym_id, {Q.key(Q.image_list('cl', k))} AS image_key{extra} "
        f"FROM {rel}" for k in BOARD.symmetries)


HOLD = (PRE + f", c AS (SELECT tour_id, canon AS canon_key, start, {CANON_LIST} AS cl FROM vcanon), "
        f"p1 AS (SELECT * FROM c WHERE start = {SPEC.point1_start}), "
        f"p2 AS (SELECT *, row_number() OVER (ORDER BY {_h('canon_key')}, tour_id) <= "
        f"floor(count(*) OVER () * {SPEC.point23_fraction}) AS test FROM c WHERE start = {SPEC.point2_start}), "
        f"rest AS (SELECT * FROM c WHERE start NOT IN ({SPEC.point1_start}, {SPEC.point2_start}, "
        f"{SPEC.point3_start})), "
        f"i3 AS ({_img_rows(f'(SELECT * FROM c WHERE start = {SPEC.point3_start})')}), "
        f"p3 AS (SELECT *, row_number() OVER (ORDER BY {_h('image_key')}, tour_id, sym_id) <= "
        f"floor(count(*) OVER () * {SPEC.point23_fraction}) AS test FROM i3), "
        f"pool AS ({_img_rows('rest', ", 'rest' AS part")} UNION ALL "
        f"{_img_rows('(SELECT * FROM p2 WHERE NOT test)', ", 'point2_train' AS part")} UNION ALL "
        f"SELECT tour_id, canon_key, sym_id, image_key, 'point3_train' AS part FROM p3 WHERE NOT test), "
        f"sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_h('image_key')}, tour_id, sym_id) <= "
        f"floor(count(*) OVER () * {SPEC.train_fraction}) THEN 'train' ELSE 'val' END AS split FROM pool) ")


def parts(spark, sf):
    return H.holdouts(canon(spark, sf), SPEC, BOARD,
                      stage=lambda df, name: staged(spark, sf, f"holdout_{name}", lambda: df))


@register("holdout_orbit", "H-1 F-2", HOLD + "SELECT canon_key, tour_id FROM p1")
def q_holdout_orbit(spark, sf):
    return parts(spark, sf)["point1"].select("canon_key", "tour_id")


@register("holdout_canonical_half", "H-2 M-2 M-3 P-2",
          HOLD + "SELECT canon_key, tour_id, CASE WHEN test THEN 'test' ELSE 'train' END AS side FROM p2")
def q_holdout_canonical_half(spark, sf):
    p = parts(spark, sf)
    return (p["point2_test"].withColumn("side", F.lit("test"))
            .unionByName(p["point2_train"].withColumn("side", F.lit("train")))
            .select("canon_key", "tour_id", "side"))


@register("holdout_image_half", "H-3 Y-4 P-2",
          HOLD + "SELECT image_key, tour_id, sym_id, CASE WHEN test THEN 'test' ELSE 'train' END AS side FROM p3")
def q_holdout_image_half(spark, sf):
    p = parts(spark, sf)
    return (p["point3_test"].withColumn("side", F.lit("test"))
            .unionByName(p["point3_train"].withColumn("side", F.lit("train")))
            .select("image_key", "tour_id", "sym_id", "side"))


@register("training_pool", "H-4 U-1 Y-4", HOLD + "SELECT image_key, tour_id, sym_id, part FROM pool")
def q_training_pool(spark, sf):
    return parts(spark, sf)["pool"].select("image_key", "tour_id", "sym_id", "part")


@register("train_val_split", "H-5 M-3 P-2", HOLD + "SELECT image_key, split FROM sp")
def q_train_val_split(spark, sf):
    return parts(spark, sf)["split"].select("image_key", "split")


@register("split_plan", "A-16 A-7",
          PRE + ", a AS (SELECT count(*) AS n, count_if(start <> 9) AS n_not_p1, "
          "count_if(start IN (11, 2)) AS n_p23, count_if(start = 9) AS n_p1, count_if(start = 11) AS n_p2, "
          "count_if(start = 2) AS n_p3 FROM vcanon), "
          "b AS (SELECT n, n_p1, n_p2, n_p3, CAST(floor(8 * (n_not_p1 - 0.5 * n_p23)) AS BIGINT) AS pool_rows FROM a), "
          "c2 AS (SELECT pool_rows, CAST(floor(0.93 * pool_rows) AS BIGINT) AS train_rows, "
          "CAST(floor(0.07 * pool_rows) AS BIGINT) AS val_rows, CAST(8 * n AS BIGINT) AS augmented_rows, "
          "CAST(8 * n_p1 AS BIGINT) AS point1_rows, CAST(floor(8 * 0.5 * n_p2) AS BIGINT) AS point2_rows, "
          "CAST(floor(8 * 0.5 * n_p3) AS BIGINT) AS point3_rows FROM b) "
          "SELECT *, augmented_rows - train_rows - val_rows AS test_rows, "
          "abs((augmented_rows - train_rows - val_rows) - (point1_rows + point2_rows + point3_rows)) <= "
          "1e-8 + 1e-5 * abs(point1_rows + point2_rows + point3_rows) AS sizes_consistent FROM c2")
def q_split_plan(spark, sf):
    return H.split_plan(canon(spark, sf), SPEC, BOARD)


@register("overlap_check", "J-2 U-3 H-5",
          HOLD + "SELECT 'train_val' AS pair, count(*) AS n_overlap FROM sp a WHERE split = 'train' AND "
          "image_key IN (SELECT image_key FROM sp WHERE split = 'val') "
          "UNION ALL SELECT 'point2_test_train', count(*) FROM p2 WHERE test AND canon_key IN "
          "(SELECT canon_key FROM p2 WHERE NOT test) "
          "UNION ALL SELECT 'point3_test_train', count(*) FROM p3 WHERE test AND image_key IN "
          "(SELECT image_key FROM p3 WHERE NOT test) "
          "UNION ALL SELECT 'point1_pool', count(*) FROM p1 WHERE canon_key IN (SELECT canon_key FROM pool)")
def q_overlap_check(spark, sf):
    p = parts(spark, sf)
    sp = p["split"]

    def n(df, pair):
        return df.agg(F.lit(pair).alias("pair"), F.count("*").alias("n_overlap"))
    return (n(H.overlap(sp.where("split = 'train'"), sp.where("split = 'val'"), ["image_key"]), "train_val")
            .unionByName(n(H.overlap(p["point2_test"], p["point2_train"], ["canon_key"]), "point2_test_train"))
            .unionByName(n(H.overlap(p["point3_test"], p["point3_train"], ["image_key"]), "point3_test_train"))
            .unionByName(n(H.overlap(p["point1"], p["pool"], ["canon_key"]), "point1_pool")))


@register("orbit_leakage", "H-7 J-2",
          HOLD + "SELECT 'train_val' AS pair, count(DISTINCT canon_key) AS n_shared_orbits FROM sp "
          "WHERE split = 'train' AND canon_key IN (SELECT canon_key FROM sp WHERE split = 'val') "
          "UNION ALL SELECT 'point1_pool', count(DISTINCT canon_key) FROM p1 WHERE canon_key IN "
          "(SELECT canon_key FROM pool) "
          "UNION ALL SELECT 'point2_test_pool', count(DISTINCT canon_key) FROM p2 WHERE test AND canon_key IN "
          "(SELECT canon_key FROM pool) "
          "UNION ALL SELECT 'point3_test_pool', count(DISTINCT canon_key) FROM p3 WHERE test AND canon_key IN "
          "(SELECT canon_key FROM pool)")
def q_orbit_leakage(spark, sf):
    p = parts(spark, sf)
    # the split holds the pool's rows, so its two sides together are the pool
    return H.orbit_leakage(
        {"train": p["split"].where("split = 'train'"), "val": p["split"].where("split = 'val'"),
         "point1": p["point1"], "point2_test": p["point2_test"], "point3_test": p["point3_test"]},
        {"train_val": ("train", ["val"]), "point1_pool": ("point1", ["train", "val"]),
         "point2_test_pool": ("point2_test", ["train", "val"]),
         "point3_test_pool": ("point3_test", ["train", "val"])})


@register("set_equality", "A-11 U-2",
          HOLD + ", l AS (SELECT canon_key FROM p2 WHERE test), r AS (SELECT canon_key FROM p2 WHERE NOT test), "
          "x AS (SELECT (SELECT count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)) AS n_left_only, "
          "(SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)) AS n_right_only) "
          "SELECT n_left_only, n_right_only, n_left_only = 0 AND n_right_only = 0 AS equal FROM x")
def q_set_equality(spark, sf):
    p = parts(spark, sf)
    return H.frames_equal(p["point2_test"].select("canon_key"), p["point2_train"].select("canon_key"))


# Nested sample fractions of the training and validation sets.
NESTED = (0.01, 0.1, 0.25, 0.5)


def _nested_sql():
    arms = " ".join(f"WHEN r <= floor(n * {f}) THEN CAST({f} AS DOUBLE)" for f in NESTED)
    return (HOLD + f", rk AS (SELECT image_key, split, row_number() OVER (PARTITION BY split ORDER BY "
            f"{_h('image_key')}, tour_id, sym_id) AS r, count(*) OVER (PARTITION BY split) AS n FROM sp) "
            f"SELECT image_key, split, CASE {arms} END AS min_fraction FROM rk")


@register("nested_fractions", "M-5 H-6 P-2", _nested_sql())
def q_nested_fractions(spark, sf):
    sp = parts(spark, sf)["split"]
    # two groups (train, val): a bound known by construction
    out = S.nested_levels(sp, "image_key", NESTED, SEED, by=("split",), tie=("tour_id", "sym_id"),
                          max_groups=2)
    return out.select("image_key", "split", "min_fraction")


# The per-source sample fraction of the balanced sample (3.3333 %).
SOURCE_FRACTION = "0.033333"


@register("balanced_source_sample", "M-6 M-7 O-6",
          PRE + f", r AS (SELECT tour_id, source, tkey, row_number() OVER (PARTITION BY source ORDER BY "
          f"{_h('tkey')}, tour_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM tv WHERE valid) "
          f"SELECT tour_id, source, tkey AS tour_key FROM r WHERE rn <= floor(n * {SOURCE_FRACTION})")
def q_balanced_source_sample(spark, sf):
    t = tours(spark, sf).where(B.is_valid_tour("tour", BOARD)).select(
        "tour_id", "source", B.tour_key("tour", BOARD).alias("tour_key"))
    picked = S.exact_fraction(t, "tour_key", SOURCE_FRACTION, SEED, by=("source",), tie=("tour_id",))
    return picked.where("picked").select("tour_id", "source", "tour_key")


@register("random_pick", "M-9 M-1 F-12",
          HOLD + f"SELECT image_key, tour_id, sym_id FROM sp ORDER BY {_h('image_key')} LIMIT 5")
def q_random_pick(spark, sf):
    return S.hash_sample_rows(parts(spark, sf)["split"], "image_key", 5, SEED).select(
        "image_key", "tour_id", "sym_id")


def event_tours(spark, sf):
    ev = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    return staged(spark, sf, "event_tours", lambda: FX.tours_from_events(ev))


@register("seen_set_exclusion", "J-3 J-1 G-8 U-2",
          "WITH " + Q.fixture_tours_cte("events", "event_id", "user_id", "event_type", "et") + ", "
          + Q.fixture_tours_cte() +
          f", ek AS (SELECT tour_id, {Q.canon_key('tour')} AS canon FROM et), "
          f"ok AS (SELECT DISTINCT {Q.canon_key('tour')} AS canon FROM tours) "
          "SELECT canon AS canon_key, min(tour_id) AS first_event_id, count(*) AS n_events FROM ek "
          "WHERE canon NOT IN (SELECT canon FROM ok) GROUP BY canon")
def q_seen_set_exclusion(spark, sf):
    seen = B.with_canonical(tours(spark, sf).select("tour"), board=BOARD).select(
        B.tour_key("canon", BOARD).alias("canon_key"))
    new = B.with_canonical(event_tours(spark, sf).select("tour_id", "tour"), board=BOARD).select(
        "tour_id", B.tour_key("canon", BOARD).alias("canon_key"))
    # one row per key before the join: hot keys collapse in the partial
    # aggregate instead of landing in one join partition
    per_key = new.groupBy("canon_key").agg(F.min("tour_id").alias("first_event_id"),
                                           F.count("*").alias("n_events"))
    return H.difference(per_key, seen, ["canon_key"])
