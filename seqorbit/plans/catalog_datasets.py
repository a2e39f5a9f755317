"""Registered queries: published data sets with manifests, and orbit counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import augment as A
from ..operators import board_graph as G
from ..session import stage_path
from ..sources import datasets as D
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import sqltext as Q
from .catalog import BOARD, _raw_tours_sql, register
from .catalog_splits import HOLD, SEED, SPEC, parts

# The data sets of the holdout plan: rows in SQL, key column, method, held-out start, fraction, parent.
_REST = str(round(1 - SPEC.train_fraction, 10))
PLAN = {
    "point1": ("p1", "canon_key", "holdout", SPEC.point1_start, "1", "canonical"),
    "point2_test": ("p2 WHERE test", "canon_key", "half", SPEC.point2_start, str(SPEC.point23_fraction), "canonical"),
    "point3_test": ("p3 WHERE test", "image_key", "images", SPEC.point3_start, str(SPEC.point23_fraction), "canonical"),
    "train": ("sp WHERE split = 'train'", "image_key", "split", None, str(SPEC.train_fraction), "pool"),
    "val": ("sp WHERE split = 'val'", "image_key", "split", None, _REST, "pool"),
}


def _published_sql() -> str:
    arms = []
    for rel, key, method, start, fraction, parent in PLAN.values():
        held = "NULL" if start is None else str(start)
        arms.append(
            f"SELECT '{method}' AS method, CAST({held} AS INTEGER) AS start, CAST({fraction} AS DOUBLE) AS fraction, '{parent}' AS parent, "
            f"count(*) AS rows, CAST(coalesce(sum(CAST(('0x' || substr(md5({key} || ':' || tour_id), 1, {D.DIGITS})) AS BIGINT)), 0) AS VARCHAR) "
            f"AS fingerprint FROM {rel}")
    return (
        HOLD + ", made AS (" + " UNION ALL ".join(arms) + ") SELECT concat_ws('_', "
        f"'{BOARD.width}x{BOARD.height}', CAST(rows AS VARCHAR), method, 'start' || start, CAST(round(fraction * 100, 2) AS VARCHAR) || 'pct', "
        "strftime(current_date, '%Y%m%d')) AS dataset, "
        f"'{BOARD.width}x{BOARD.height}' AS board, rows, format('{{:,}}', rows) AS rows_text, start, fraction, method, parent, {SEED} AS seed, "
        "strftime(current_date, '%Y%m%d') AS created, CAST((rows // 256) * 1 // 1 AS BIGINT) AS train_steps, fingerprint FROM made")


@register("published_datasets", "S-11 A-19 H-6 2.11", _published_sql())
def q_published_datasets(spark, sf):
    """Publishes every data set of the holdout plan, reads each back with its content
    checked, and returns the manifests."""
    found = parts(spark, sf)
    frames = {"train": found["split"].where("split = 'train'"), "val": found["split"].where("split = 'val'"),
              **{k: found[k] for k in ("point1", "point2_test", "point3_test")}}
    out = None
    for name, (_, key, method, start, fraction, parent) in PLAN.items():
        path = stage_path(spark, f"dataset-{name}")
        D.publish(frames[name].select(key, "tour_id"), path, (key, "tour_id"), method, start, fraction, parent, BOARD, SEED)
        manifest = D.read_checked(spark, path)[1].drop("key")
        out = manifest if out is None else out.unionByName(manifest)
    return out


@register("walk_orbits", "A-7 Y-2 Y-3 V-8",
          _raw_tours_sql() + ", img AS (" + " UNION ALL ".join(
              f"SELECT tour_id, {Q.key(Q.image_list('tour', k))} AS image_key FROM rt" for k in BOARD.symmetries)
          + f"), ck AS (SELECT tour_id, {Q.canon_key('tour')} AS canon FROM rt), "
          "per AS (SELECT tour_id, count(DISTINCT image_key) AS orbit FROM img GROUP BY tour_id), "
          "one AS (SELECT canon, min(orbit) AS orbit FROM ck JOIN per USING (tour_id) GROUP BY canon) "
          "SELECT CAST(orbit AS INTEGER) AS orbit_size, count(*) AS n_canonical, CAST(sum(orbit) AS BIGINT) AS n_images FROM one GROUP BY orbit")
def q_walk_orbits(spark, sf):
    """Distinct raw walks up to symmetry by the size of their orbit; walks on a diagonal
    are their own image and have smaller orbits."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    walks = G.steps_to_tours(FX.raw_steps_from_lineitem(li)).select("tour")
    one = B.with_canonical(walks, board=BOARD).select("canon").distinct()
    return one.groupBy(A.orbit_size("canon", BOARD).alias("orbit_size")).agg(
        F.count("*").alias("n_canonical"), F.sum(A.orbit_size("canon", BOARD)).cast("long").alias("n_images"))
