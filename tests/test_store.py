"""The versioned store, generation up to a quota, and the ingest stream on it."""

from pyspark.sql import functions as F

from seqorbit.functions import board as B
from seqorbit.operators.generate import fill_to_quota
from seqorbit.session import stage_path
from seqorbit.sources.store import VersionedStore, key_of
from seqorbit.streaming import store_ingest as I


def numbered(spark, a, b):
    rows = spark.range(a, b).select("id", F.array((F.col("id") % 97).cast("int"), F.col("id").cast("int")).alias("tour"))
    return rows.withColumn("key", key_of("tour"))


def test_a_batch_reads_what_it_touches_whatever_the_store_holds(spark):
    read = {}
    for big in (600, 3000):
        store = VersionedStore(spark, stage_path(spark, "test-store"), bucket_rows=16)
        assert store.add_new(numbered(spark, 0, big), "big") == big
        for n in range(3):
            assert store.add_new(numbered(spark, 10_000 + 20 * n, 10_020 + 20 * n), f"b{n}", batch_id=n) == 20
        assert store.compact() and len(store.live()) == 2  # the small ones become one, the big one stays
        assert store.add_new(numbered(spark, 0, 20), "again", batch_id=9) == 0
        read[big] = store.log()[-1]["n_read"]
        rows = store.read().select("id", "key").collect()
        assert len(rows) == big + 60 == store.n_rows() == len({bytes(r["key"]) for r in rows})
    # 20 keys and buckets of about 16 rows: five times the rows, no more of them read
    assert read[3000] < 1.5 * read[600] and read[3000] < 3000 / 5


def test_a_batch_given_twice_or_cut_short_is_stored_once(spark):
    path = stage_path(spark, "test-store")
    store = VersionedStore(spark, path)
    rows = numbered(spark, 0, 50)
    assert store.read() is None and store.n_rows() == 0 and not store.compact()
    # a try that wrote files and died before its commit
    rows.withColumn("bucket", F.lit("all")).write.partitionBy("bucket").parquet(f"{path}/data/b0")
    assert store.n_rows() == 0
    assert store.add_new(rows.union(rows), "b0", batch_id=0) == 50
    assert store.add_new(rows, "b0", batch_id=0) == 0 and store.add_new(rows, "b1", batch_id=1) == 0
    assert VersionedStore(spark, path).n_rows() == store.read().count() == 50
    assert store.add_new(numbered(spark, 40, 60), "b2", batch_id=2, limit=4) == 4


def test_generation_ends_by_quota_or_by_nothing_new(spark):
    tours = lambda lo, hi: spark.range(lo, hi).select(F.array(F.col("id").cast("int"), F.lit(1)).alias("tour"))
    store = VersionedStore(spark, stage_path(spark, "test-store"))
    store.add_new(tours(0, 10).withColumn("key", key_of("tour")), "existing")
    assert fill_to_quota(store, lambda t: tours(5 * t, 5 * t + 12), 24) == [2, 5, 5, 2]
    assert fill_to_quota(store, lambda t: tours(0, 99), 24) == []
    stored = {r["tour"][0] for r in store.read().collect()}
    missing = set(range(25)) - stored
    want = [len(missing), 0] if missing else [0]
    assert fill_to_quota(store, lambda t: tours(0, 25), 99) == want
    assert {r["tour"][0] for r in store.read().collect()} == stored | set(range(25))


def test_canonical_keys_fold_images(spark):
    from seqorbit.operators.generate import keyed
    from seqorbit.sources.fixtures import BASE_TOURS
    rows = spark.createDataFrame([(list(BASE_TOURS[0]),)], "tour array<tinyint>")
    images = rows.select(F.explode(B.tour_images("tour")).alias("tour"))
    assert keyed(images, up_to_symmetry=True).select("key").distinct().count() == 1
    assert keyed(images).select("key").distinct().count() == 8


def test_late_rows_are_set_aside_and_batches_are_idempotent(spark):
    from seqorbit.sources.fixtures import BASE_TOURS
    t = [list(b) for b in BASE_TOURS]
    schema = "tour_id long, source string, tour array<tinyint>, ts string"

    def batch(*rows):
        d = spark.createDataFrame(list(rows), schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        return I.canonical_rows(d)

    store = VersionedStore(spark, stage_path(spark, "test-store"))
    first = batch((1, "a", t[0], "2024-01-05 00:00:00"), (2, "a", t[0][::-1], "2024-01-05 01:00:00"), (3, "a", [0, 0], "2024-01-05 01:00:00"))
    assert I.ingest_batch(first, 0, store, "1 DAY") == 2
    late = batch((4, "b", t[1], "2024-01-03 00:00:00"), (5, "b", t[2], "2024-01-04 12:00:00"), (6, "b", t[1][::-1], None))
    assert I.ingest_batch(late, 1, store, "1 DAY") == 2 and I.ingest_batch(late, 1, store, "1 DAY") == 0
    assert [r["tour_id"] for r in I.late_rows(store).collect()] == [4]
    assert {r["tour_id"] for r in I.stored_tours(store).collect()} == {1, 2, 5, 6}
    assert I.ingest_batch(batch(), 2, store, "1 DAY") == 0
    # another stream counts its batches anew; 8 is stored, 7 is so far only among the late rows
    assert I.ingest_batch(batch((7, "c", t[1], "2024-01-05 00:00:00"), (8, "c", t[0], "2024-01-05 00:00:00")), 0, store, None, "other") == 1
    assert len(store.log()) >= 4 and "other-0" in store.names()
    empty = VersionedStore(spark, stage_path(spark, "test-store"))
    assert I.stored_tours(empty).count() == 0 and I.late_rows(empty).count() == 0
