"""The registry of stage tables."""

from pyspark.sql import functions as F

from seqorbit.sources.stages import Stages


def test_stages_follow_their_input(spark, tmp_path):
    folder, stages, built = str(tmp_path / "in"), Stages(), []

    def put(n, mode):
        spark.range(n).write.mode(mode).parquet(f"{folder}/numbers.parquet")

    def get(name="sum", least=0):
        def build():
            built.append(name)
            return spark.read.parquet(f"{folder}/numbers.parquet").where(F.col("id") >= least)
        return stages.get(spark, folder, name, build)

    put(10, "overwrite")
    first = get()
    assert first.count() == 10 and get().count() == 10 and built == ["sum"]
    put(5, "append")
    assert get().count() == 15 and get().count() == 15 and built == ["sum"] * 2
    assert first.count() == 10  # what was read before stays readable
    put(4, "overwrite")
    assert get().count() == 4 and built == ["sum"] * 3


def test_an_empty_stage_is_a_table(spark, tmp_path):
    folder, stages = str(tmp_path / "in"), Stages()
    spark.range(3).write.parquet(f"{folder}/numbers.parquet")
    none = lambda: spark.read.parquet(f"{folder}/numbers.parquet").where("id > 100")
    assert stages.get(spark, folder, "none", none).columns == ["id"]
    assert stages.get(spark, folder, "none", none).count() == 0


def test_released_stages_are_built_anew(spark, tmp_path):
    folder, stages, built = str(tmp_path / "in"), Stages(), []
    spark.range(3).write.parquet(f"{folder}/numbers.parquet")

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/numbers.parquet")
    old = stages.get(spark, folder, "all", build)
    path = old.inputFiles()[0].rsplit("/", 1)[0]
    assert stages.release(spark) == 1 and stages.release(spark) == 0
    assert spark.read.schema(old.schema).parquet(path).count() == 0
    assert stages.get(spark, folder, "all", build).count() == 3 and len(built) == 2
