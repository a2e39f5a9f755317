"""Registered queries: completion scoring, prompts and partial tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as B
from ..operators import scoring as SC
from ..sources import fixtures as FX
from . import sqltext as Q
from .catalog import BOARD, N, orders, register, staged
from .catalog_splits import HOLD, parts

W = BOARD.width


def completions(spark, sf):
    return staged(spark, sf, "completions", lambda: FX.completions_from_orders(orders(spark, sf)))


def scored(spark, sf):
    return SC.case_set(SC.score(completions(spark, sf), BOARD), BOARD)


SCORED_SQL = (
    "WITH " + Q.completions_cte() + ", "
    f"sc AS (SELECT model, case_id, given_len, given, tour, CAST(given[1] AS INTEGER) AS start, "
    f"{Q.legal('tour')} AS legal, {Q.unique('tour')} AS uniq, len(tour) = {N} AS complete, "
    "tour[1:given_len] = given AS prefix_kept, "
    f"CAST(greatest(len(tour) - 1, 0) AS INTEGER) AS n_moves, CAST({Q.n_illegal('tour')} AS INTEGER) AS n_illegal, "
    f"CASE given[len(given)] // {W} WHEN 4 THEN 'row4' WHEN 3 THEN 'row3' ELSE 'other' END AS case_set "
    "FROM comp), "
    "s AS (SELECT *, legal AS legal_only, legal AND uniq AND complete AND prefix_kept AS solved FROM sc) ")

COUNTS_SQL = "count(*) AS n_cases, count_if(legal) AS n_legal, count_if(solved) AS n_solved"


@register("score_by_start", "E-1 J-8 A-13", SCORED_SQL + f"SELECT model, start, {COUNTS_SQL} FROM s GROUP BY model, start")
def q_score_by_start(spark, sf):
    return SC.by_start(scored(spark, sf))


@register("score_by_given_len", "E-2 J-8",
          SCORED_SQL + f"SELECT model, given_len, {COUNTS_SQL} FROM s GROUP BY model, given_len")
def q_score_by_given_len(spark, sf):
    return SC.by_given_len(scored(spark, sf))


@register("score_rollup", "A-13 E-3 F-6",
          SCORED_SQL + f"SELECT model, case_set, {COUNTS_SQL} FROM s GROUP BY ROLLUP (model, case_set)")
def q_score_rollup(spark, sf):
    return SC.rollup_report(scored(spark, sf))


@register("score_outcomes", "A-15 D-12",
          SCORED_SQL + "SELECT model, legal_only, solved, count(*) AS n_cases FROM s "
          "GROUP BY model, legal_only, solved")
def q_score_outcomes(spark, sf):
    return SC.outcomes(scored(spark, sf))


@register("move_error_rate", "A-18",
          SCORED_SQL + "SELECT model, CAST(sum(n_moves) AS BIGINT) AS n_moves, "
          "CAST(sum(n_illegal) AS BIGINT) AS n_illegal_moves, "
          "round(sum(n_illegal) / sum(n_moves), 8) AS error_rate, "
          "count_if(n_illegal > 0) AS n_tours_with_error FROM s GROUP BY model")
def q_move_error_rate(spark, sf):
    return SC.move_error_rate(scored(spark, sf))


@register("dead_end_steps", "E-5 V-7",
          SCORED_SQL + f", b AS (SELECT model, case_id, tour, CAST({Q.first_bad('tour')} AS INTEGER) AS fb "
          "FROM s WHERE n_illegal > 0) "
          f"SELECT model, case_id, fb AS first_bad, CAST({Q.onward_count('tour', 'fb - 1')} AS INTEGER) AS free_moves, "
          f"{Q.onward_count('tour', 'fb - 1')} = 0 AS dead_end FROM b")
def q_dead_end_steps(spark, sf):
    return SC.dead_ends(scored(spark, sf), BOARD)


# The training-data fraction (percent) of each model; the
# fixture names models by order status.
MODEL_TRAIN_PCT = {"F": 1, "O": 10, "P": 25}


@register("success_curve", "A-14",
          SCORED_SQL + ", m AS (SELECT * FROM (VALUES " +
          ", ".join(f"('{k}', {v})" for k, v in MODEL_TRAIN_PCT.items()) +
          ") t(model, train_pct)) SELECT s.model, m.train_pct, count(*) AS n_cases, "
          "count_if(solved) AS n_solved, count_if(solved AND case_set <> 'other') AS n_solved_lower_rows, "
          "round(100.0 * count_if(solved) / count(*), 4) AS pct_solved "
          "FROM s LEFT JOIN m USING (model) GROUP BY s.model, m.train_pct")
def q_success_curve(spark, sf):
    sc = scored(spark, sf)
    models = spark.createDataFrame(list(MODEL_TRAIN_PCT.items()), "model string, train_pct int")
    agg = sc.groupBy("model").agg(
        F.count("*").alias("n_cases"), F.count_if("solved").alias("n_solved"),
        F.count_if(F.col("solved") & (F.col("case_set") != "other")).alias("n_solved_lower_rows"),
        F.round(F.lit(100.0) * F.count_if("solved") / F.count("*"), 4).alias("pct_solved"))
    # the model table has one row per model: a bounded broadcast; completions of
    # a model it does not name keep their row, with an unknown share
    return agg.join(F.broadcast(models), "model", "left").select(
        "model", "train_pct", "n_cases", "n_solved", "n_solved_lower_rows", "pct_solved")


@register("prompt_cases", "E-4 F-7",
          HOLD + f", byl AS (SELECT tour_id, 'by_given_len' AS case_set, CAST(g.n AS INTEGER) AS given_len, "
          f"{Q.key('cl[1:g.n]')} AS given FROM p2 CROSS JOIN range(1, {N - 1}) g(n) WHERE test), "
          "st AS (SELECT DISTINCT CAST(substr(image_key, 1, 2) AS INTEGER) AS s FROM p3 WHERE test), "
          "evs AS (SELECT CAST(s AS BIGINT) AS tour_id, 'every_start' AS case_set, 1 AS given_len, "
          "lpad(CAST(s AS VARCHAR), 2, '0') AS given FROM st) "
          "SELECT * FROM byl UNION ALL SELECT * FROM evs")
def q_prompt_cases(spark, sf):
    p = parts(spark, sf)
    t2 = p["point2_test"]
    byl = SC.prompts_by_len(t2, "canon", N - 2, "by_given_len")
    starts = (p["point3_test"].select(F.substring("image_key", 1, 2).cast("int").alias("s")).distinct()
              .select(F.col("s").cast("long").alias("tour_id"), F.lit("every_start").alias("case_set"),
                      F.lit(1).alias("given_len"), F.array(F.col("s").cast("tinyint")).alias("given")))
    return byl.unionByName(starts).select("tour_id", "case_set", "given_len",
                                          B.tour_key("given", BOARD).alias("given"))


def partials(spark, sf):
    return staged(spark, sf, "partials", lambda: FX.partial_tours(orders(spark, sf)))


PARTIAL_SQL = (
    "WITH " + Q.fixture_tours_cte() + ", "
    f"pt AS (SELECT tour_id, source, tour[1:{FX.PARTIAL_BASE} + tour_id % {FX.PARTIAL_SPREAD}] AS tour FROM tours) ")


@register("continuable_partials", "F-6 E-3 E-4",
          PARTIAL_SQL + f", v AS (SELECT source, CAST(tour[len(tour)] AS INTEGER) AS last FROM pt "
          f"WHERE {Q.legal('tour')} AND {Q.unique('tour')}) "
          f"SELECT source, count(*) AS n_partials, count_if(last BETWEEN {3 * W} AND {5 * W - 1}) AS n_rows_3_4, "
          f"count_if(last BETWEEN {4 * W} AND {5 * W - 1}) AS n_row_4, "
          f"count_if(last BETWEEN {3 * W} AND {4 * W - 1}) AS n_row_3 FROM v GROUP BY source")
def q_continuable_partials(spark, sf):
    return SC.continuable(partials(spark, sf), BOARD)
