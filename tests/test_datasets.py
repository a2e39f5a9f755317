"""Manifests that prove their rows, and orbit sizes against counted images."""

import pytest
from pyspark.sql import functions as F

from seqorbit.functions import board as B
from seqorbit.operators import augment as A
from seqorbit.session import stage_path
from seqorbit.sources import datasets as D


def test_orbit_sizes_equal_counted_images(spark):
    for board, seqs in ((B.Board(8, 8), [[0], [9, 18], [0, 7], [0, 17, 32], [], None, [0, 63], [3, 60], [99, 1], [27, 36, 27]]),
                        (B.Board(5, 5), [[12], [2, 12, 22], [0, 6, 12], [1], [12, 13]]),
                        (B.Board(5, 4), [[0], [0, 19], [2], [2, 17]])):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "tour_id int, tour array<tinyint>")
        got = {r.tour_id: r.n for r in df.select("tour_id", A.orbit_size("tour", board).alias("n")).collect()}
        for i, s in enumerate(seqs):
            if s is None or any(p >= board.n_squares for p in s):
                assert got[i] is None
            else:
                assert got[i] == len({tuple(board.image_of(k, p) for p in s) for k in board.symmetries})


def test_orbit_counts_plan_builds_no_image(spark):
    one = spark.createDataFrame([([0, 17],), ([12],)], "canon array<tinyint>")
    found = A.orbit_counts(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan
    assert found.first().asDict() == {"n_canonical": 2, "n_augmented": 16, "n_distinct_images": 16}


def test_a_published_set_is_read_only_with_its_own_rows(spark):
    rows = spark.range(1234).select(F.col("id").alias("tour_id"), F.concat(F.lit("k"), F.col("id") % 50).alias("canon_key"))
    path = stage_path(spark, "test-dataset")
    made = D.publish(rows.repartition(3), path, ("canon_key", "tour_id"), "half", 11, "0.5", "canonical").first()
    assert made["rows"] == 1234 and made["rows_text"] == "1,234" and made["dataset"].startswith("8x8_1234_half_start11_50.0pct_")
    back, manifest = D.read_checked(spark, path)
    assert back.count() == 1234 and manifest.first() == made
    # another order and other files: the same content
    again = stage_path(spark, "test-dataset")
    other = D.publish(rows.orderBy(F.desc("tour_id")).repartition(7), again, ("canon_key", "tour_id"), "half", 11, "0.5", "canonical").first()
    assert other["fingerprint"] == made["fingerprint"]
    # a row more, and a row exchanged
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(D.ContentError):
        D.read_checked(spark, path)
    rows.withColumn("canon_key", F.when(F.col("tour_id") == 5, "x").otherwise(F.col("canon_key"))).write.mode("overwrite").parquet(f"{again}/rows")
    with pytest.raises(D.ContentError):
        D.read_checked(spark, again)
    # rows without a manifest were never published
    half = stage_path(spark, "test-dataset")
    rows.write.parquet(f"{half}/rows")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        D.read_checked(spark, half)


def test_an_empty_set_has_a_manifest(spark):
    none = spark.createDataFrame([], "tour_id long, canon_key string")
    path = stage_path(spark, "test-dataset")
    made = D.publish(none, path, ("canon_key", "tour_id"), "split").first()
    assert made["rows"] == 0 and made["fingerprint"] == "0" and made["start"] is None
    assert D.read_checked(spark, path)[0].count() == 0
