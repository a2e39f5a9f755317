"""Splits, prefix diversity, path expansion and streaming ingest."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seqorbit.functions import board as B
from seqorbit.operators import holdout as H
from seqorbit.operators import paths as P
from seqorbit.operators import split as S
from seqorbit.operators.prefix import prefix_diversity
from seqorbit.sources import parquet as PQ


def test_exact_fraction_matches_sorted_hash(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    out = S.exact_fraction(df, "k", 0.37, seed=7, by=("g",), tie=("k",)).where("picked")
    got = sorted(r.k for r in out.collect())
    want = []
    for g in range(3):
        keys = [str(i) for i in range(n) if i % 3 == g]
        keys.sort(key=lambda k: (hashlib.md5(f"{k}:7".encode()).hexdigest(), k))
        want += keys[: math.floor(len(keys) * 0.37)]
    assert got == sorted(want)


def test_nested_levels_are_nested(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    out = S.nested_levels(df, "k", (0.1, 0.5), seed=1, tie=("k",))
    counts = {r.min_fraction: r.n for r in out.groupBy("min_fraction").agg(F.count("*").alias("n")).collect()}
    assert counts == {0.1: 300, 0.5: 1200, None: 1500}


def test_prefix_diversity_matches_naive(spark):
    import random
    rnd = random.Random(3)
    rows = [([rnd.randrange(4) for _ in range(rnd.randrange(1, 7))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "t array<tinyint>")
    got = {r.k: r.n_prefixes for r in prefix_diversity(df, "t", 6, num_partitions=5).collect()}
    for k in range(1, 7):
        naive = len({tuple(r[0][:k]) for r in rows})
        assert got[k] == naive, k


def test_simple_paths_from_corner(spark):
    seeds = spark.createDataFrame([(0, [0])], "tour_id int, tour array<tinyint>")
    out = P.expand_levels(seeds, 6, "tour")
    counts = {r.depth: r.n for r in out.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert [counts[d] for d in range(1, 7)] == [2, 10, 50, 268, 1268, 5852]


def test_warnsdorff_walks_are_legal(spark):
    seeds = spark.createDataFrame([(i, [i]) for i in range(64)], "tour_id int, tour array<tinyint>")
    out = P.warnsdorff_complete(seeds, "tour", seed=5)
    rows = out.select("complete", B.is_valid_tour("path").alias("v"), F.size("path").alias("n")).collect()
    assert all(r.v for r in rows)
    assert sum(r.complete for r in rows) >= 32  # the rule completes most starts


def test_streaming_ingest_is_idempotent(spark):
    from seqorbit.session import stage_path
    from seqorbit.sources.fixtures import tours_from_events
    from seqorbit.streaming.ingest import run_unique_ingest, start_unique_ingest
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    tours = tours_from_events(ev)
    store_df = run_unique_ingest(spark, tours, n_files=3)
    n1 = store_df.count()
    distinct = tours.where(B.is_valid_tour("tour")).transform(lambda d: B.with_canonical(d)).select("canon").distinct().count()
    assert n1 == distinct
    # re-deliver the same files through a fresh checkpoint: nothing new is appended
    store = store_df.inputFiles()[0].split("/bucket=")[0]
    src = stage_path(spark, "replay")
    tours.select("tour_id", "source", "tour", "ts").write.parquet(src)
    q = start_unique_ingest(spark, src, store, stage_path(spark, "replay-ckpt"))
    q.awaitTermination()
    assert spark.read.parquet(store).count() == n1


def test_streaming_within_watermark_runs(spark):
    from seqorbit.session import stage_path
    from seqorbit.sources.fixtures import tours_from_events
    from seqorbit.streaming.ingest import start_unique_ingest
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    tours = tours_from_events(ev)
    src = stage_path(spark, "wm-src")
    tours.select("tour_id", "source", "tour", "ts").repartition(2).write.parquet(src)
    store = stage_path(spark, "wm-store")
    q = start_unique_ingest(spark, src, store, stage_path(spark, "wm-ckpt"), within_watermark="1 hour")
    q.awaitTermination()
    n = spark.read.parquet(store).count()
    distinct = B.with_canonical(tours.where(B.is_valid_tour("tour"))).select("canon").distinct().count()
    assert n == distinct


def _completions(board, start):
    """All full tours that extend ``start``, by plain recursion."""
    if len(start) == board.n_squares:
        return [start]
    return [t for q in board.neighbours_of(start[-1]) if q not in start for t in _completions(board, [*start, q])]


def test_bounded_paths_finds_every_tour(spark):
    board = B.Board(5, 5)
    seeds = spark.createDataFrame([(0, [0]), (1, [1]), (2, [12]), (3, [0, 7]), (4, []), (5, None), (6, [0, 0]), (7, [99])],
                                  "tour_id int, tour array<tinyint>")
    want = {(i, tuple(t)) for i, s in enumerate([[0], [1], [12], [0, 7]]) for t in _completions(board, s)}
    assert len(want) > 300
    for budget, order in ((50, "md5"), (100_000, "offset")):
        got = P.bounded_paths(seeds, 10_000, "tour", 1, board, order=order, budget=budget).collect()
        assert len(got) == len(want) and {(r[0], tuple(r[1])) for r in got} == want
    assert P.bounded_paths(seeds.limit(0), 3, board=board).count() == 0


def test_bounded_paths_does_not_depend_on_the_budget(spark):
    from seqorbit.sources.fixtures import BASE_TOURS
    seeds = spark.createDataFrame([(100 * i + n, list(t[:n])) for i, t in enumerate(BASE_TOURS) for n in (1, 20, 40, 55, 64)],
                                  "tour_id int, tour array<tinyint>")
    a = {(r[0], tuple(r[1])) for r in P.bounded_paths(seeds, 2, "tour", 3, budget=30).collect()}
    b = {(r[0], tuple(r[1])) for r in P.bounded_paths(seeds, 2, "tour", 3).collect()}
    assert a == b and {i for i, _ in a} == {r[0] for r in seeds.collect()}  # every seed has an answer
    assert all(len(set(p)) == 64 for _, p in a)


def test_a_hard_seed_is_split_and_its_answer_stays(spark, monkeypatch):
    """One corner of a 5x6 board, cut into branches every few moves, gives the tours a plain depth-first search gives."""
    board = B.Board(6, 5)
    want = P._Search(board, 42, "offset", False).advance(7, [0], 1, [0], 10 ** 6, 10 ** 9, False)[0]
    seeds = spark.createDataFrame([(7, [0]), (8, [1]), (7, [0]), (None, [0, 8])], "tour_id int, tour array<tinyint>")
    rounds = []
    plain = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: rounds.append((name, out := plain(df, name))) or out)
    for per_seed, split_budget in ((5, 20), (60, 400)):
        got = P.bounded_paths(seeds, per_seed, board=board, order="offset", budget=3, split_budget=split_budget).collect()
        mine = sorted(tuple(r.path) for r in got if r.tour_id == 7)
        assert mine == sorted([tuple(p) for _, p in want[:per_seed]] * 2)  # the repeated seed is a seed of its own
        assert len([r for r in got if r.tour_id is None]) == per_seed
    # no round with many open branches leaves them to one task
    busy = [out.groupBy(F.input_file_name()).count().count() for name, out in rounds if name == "paths-round" and out.count() >= 16]
    assert busy and min(busy) >= 4
    # a number of tours for each seed, and seeds without any tour
    own = spark.createDataFrame([(i, [i], i % 3) for i in range(30)], "tour_id int, tour array<tinyint>, n int")
    got = P.bounded_paths(own, F.col("n"), board=board, order="offset", budget=3, split_budget=50).groupBy("tour_id").count().collect()
    every = {i: len(P._Search(board, 42, "offset", False).advance(i, [i], 1, [i], i % 3, 10 ** 9, False)[0]) for i in range(30) if i % 3}
    assert {r.tour_id: r["count"] for r in got} == {i: n for i, n in every.items() if n}


def test_merged_states_count_every_path(spark):
    for board, seeds, levels in ((B.Board(5, 5), [[0], [12], [0, 7, 10], [0, 7, 10], [24, 17]], 6),
                                 (B.Board(9, 9), [[0], [80], [40, 51], [63, 44, 61]], 4)):
        df = spark.createDataFrame(list(enumerate(seeds)) + [(99, [])], "tour_id int, tour array<int>")
        got = {(r.tour_id, r.depth): r.n_paths for r in P.count_by_states(df, levels, board=board).collect()}
        want = {}
        for i, s in enumerate(seeds):
            level = [s]
            for d in range(1, levels + 1):
                level = [[*p, q] for p in level for q in board.neighbours_of(p[-1]) if q not in p]
                if level:
                    want[i, d] = len(level)
        assert got == want


def test_bounded_paths_beyond_64_squares(spark):
    board = B.Board(10, 9)
    seeds = spark.createDataFrame([(i, [i]) for i in (0, 44)], "tour_id int, tour array<tinyint>")
    got = P.bounded_paths(seeds, 1, board=board).withColumn("ok", B.is_valid_tour("path", board)).collect()
    assert sorted(r.tour_id for r in got) == [0, 44] and all(r.ok and len(r.path) == 90 for r in got)


def test_exact_picks_with_repeated_keys_and_null_groups(spark):
    from pyspark.sql import functions as F
    from seqorbit.operators import split as S
    same = spark.range(1000).select(F.lit("k").alias("key"))
    assert S.exact_fraction(same, "key", 0.5).where("picked").count() == 500
    hot = spark.range(900).select(F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
                                  F.when(F.col("id") % 2 == 0, F.lit("g")).alias("grp"))
    got = S.exact_fraction(hot, "key", 0.5, by=("grp",)).where("picked").groupBy("grp").count().collect()
    assert {r[0]: r[1] for r in got} == {"g": 225, None: 225}
    assert S.exact_quota(spark.range(30).select(F.lit(None).cast("string").alias("key")), "key", 7).where("picked").count() == 7


def test_approximate_fraction_near_zero_and_one(spark):
    from pyspark.sql import functions as F
    from seqorbit.operators import split as S
    d = spark.range(10_000).select(F.col("id").cast("string").alias("key"))
    n = {f: S.approx_fraction(d, "key", f).where("picked").count() for f in (0, 0.000005, 0.5, 0.999995, 1)}
    assert n[0] == 0 and n[1] == 10_000 and n[0.000005] <= 2 and n[0.999995] >= 9_998 and 4_800 < n[0.5] < 5_200


def test_scoring_takes_empty_prompts(spark):
    from seqorbit.operators import scoring as SC
    d = spark.createDataFrame([("m", 1, 0, [], [])], "model string, case_id long, given_len int, given array<tinyint>, tour array<tinyint>")
    got = SC.case_set(SC.score(d)).collect()
    assert len(got) == 1 and got[0]["start"] is None and not got[0]["complete"]


def test_hash_order_shuffles_inside_groups(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("k"))
    got = [(r.g, r.k) for r in S.hash_order(df, "k", 5, by=("g",)).collect()]
    want = sorted(((i % 2, str(i)) for i in range(400)),
                  key=lambda r: (r[0], hashlib.md5(f"{r[1]}:5".encode()).hexdigest()))
    assert got == want


def test_orbit_leakage_counts_shared_keys(spark):
    def part(*keys):
        return spark.createDataFrame([(k,) for k in keys], "canon_key string")
    got = H.orbit_leakage({"a": part("x", "x", "y", None), "b": part("x", "z"), "c": part("y", None)},
                          {"a_b": ("a", ["b"]), "a_bc": ("a", ["b", "c"]), "b_c": ("b", ["c"])})
    assert {r.pair: r.n_shared_orbits for r in got.collect()} == {"a_b": 1, "a_bc": 2, "b_c": 0}


def test_dup_audit_of_nulls_and_copies(spark):
    from seqorbit.operators import corpus as C
    rows = [([0, 17],), ([0, 17],), ([7, 22],), ([0, 1],), (None,)]
    got = C.dup_audit(spark.createDataFrame(rows, "tour array<tinyint>")).first()
    # (7, 22) is an image of (0, 17); (0, 1) is not a legal step
    assert tuple(got) == (5, 3, 2, 3, 1)
    assert tuple(C.dup_audit(spark.createDataFrame([], "tour array<tinyint>")).first()) == (0, 0, 0, 0, 0)


def test_strict_cast_raises_on_overflow(spark):
    df = spark.createDataFrame([(5,), (200,)], "v int")
    assert PQ.strict_tinyint(df.where("v < 100"), ["v"]).dtypes == [("v", "tinyint")]
    with pytest.raises(Exception, match="OVERFLOW"):
        PQ.strict_tinyint(df, ["v"]).collect()


def test_wide_files_keep_short_tours_and_skip_missing_files(spark, tmp_path):
    df = spark.createDataFrame([(0, [0, 17]), (2, [])], "no int, tour array<tinyint>")
    PQ.to_wide(df, "tour", 3, keep=("no",)).write.partitionBy("no").parquet(str(tmp_path / "w"))
    paths = PQ.existing(spark, [f"{tmp_path}/w/no={k}" for k in range(3)])
    assert len(paths) == 2
    got = PQ.from_wide(PQ.read_wide(spark, *paths, n_moves=3, number=r"no=(\d+)"), 3, keep=("file_no",))
    assert sorted((r.file_no, r.tour) for r in got.collect()) == [(0, [0, 17, None]), (2, [None, None, None])]


def test_exact_pick_cuts_inside_a_key_with_a_third_of_the_rows(spark, monkeypatch):
    """The cut falls among equal hashes: ties decide, and they are ranked over many partitions."""
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                               F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("g")).alias("g"))
    seen = []
    stage = S.materialize

    def keep(t, name, *a):
        out = stage(t, name, *a)
        if name == "split-cut":
            seen.append(out.groupBy("__p").count().collect())
        return out
    monkeypatch.setattr(S, "materialize", keep)
    monkeypatch.setattr(S, "MAX_BROADCAST_GROUPS", 0)  # the joins by shuffle
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = {}
        for r in df.collect():
            h = hashlib.md5(f"{r['k']}:7".encode()).digest()
            want.setdefault(r["g"], []).append((h, r["id"], r["k"]))
        for rows in want.values():
            rows.sort()
        places = [i for i, x in enumerate(want["g"]) if x[2] == "hot"]
        middle = (places[0] + places[-1]) // 2
        got = S.exact_quota(df, "k", middle, seed=7, by=("g",), tie=("id",)).where("picked").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, rows in want.items():
        assert {r["id"] for r in got if r["g"] == g} == {x[1] for x in rows[:middle]}
    sizes = [r["count"] for r in seen[0]]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2


def _walk(start, key, seed, board):
    """Warnsdorff's rule by hand."""
    path = list(start)
    while len(path) < board.n_squares:
        free = [q for q in board.neighbours_of(path[-1]) if q not in path]
        if not free:
            break
        path.append(min(free, key=lambda q: (
            sum(x not in path and x != q for x in board.neighbours_of(q)),
            hashlib.md5(f"{seed}:{key}:{len(path)}:{q}".encode()).hexdigest(), q)))
    return path


@pytest.mark.parametrize("board", [B.Board(5, 4), B.DEFAULT_BOARD, B.Board(9, 8), B.Board(12, 12)])
def test_walks_of_a_batch_follow_the_rule(spark, board):
    kind = "tinyint" if board.n_squares <= 128 else "int"
    seeds = [(k, [k % board.n_squares]) for k in range(60)] + [(99, _walk([0], 0, 1, board)[:9]), (100, None), (101, list(range(board.n_squares)))]
    df = spark.createDataFrame(seeds, f"tour_id long, tour array<{kind}>")
    out = P.warnsdorff_complete(df.coalesce(1), "tour", 7, board)
    got = {r.tour_id: (r.path, r.complete) for r in out.collect()}
    for key, start in seeds:
        want = None if start is None else _walk(start, key, 7, board)
        assert got[key] == (want, None if want is None else len(want) == board.n_squares), key
    # the seeds of one partition are walked by all tasks
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_levels_are_counted_as_expanded(spark):
    board = B.Board(5, 5)
    seeds = [(k, _walk([k % 25], k, 3, board)[:1 + k % 20]) for k in range(80)] + [(90, None), (91, []), (92, [3, None])]
    df = spark.createDataFrame(seeds, "tour_id long, tour array<tinyint>").coalesce(1)
    want = P.expand_levels(df, 4, "tour", board).groupBy("tour_id", "depth").agg(F.count("*").alias("n_paths"))
    out = P.count_levels(df, 4, "tour", board)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_one_row_group_is_dealt_out(spark, tmp_path):
    from seqorbit.sources.tables import read_table
    spark.range(40_000).withColumn("v", F.xxhash64("id")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits, and all rows in one of them
    try:
        rows = [r["count"] for r in read_table(spark, str(tmp_path), "t", "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(rows) == 40_000 and max(rows) < 10_000


def test_step_checks_on_odd_sequences(spark):
    rows = [(None, None, None, None), ([], True, 0, None), ([3], True, 0, None), ([None], True, 0, None), ([0, 17], True, 0, None),
            ([0, 17, None], False, 1, 3), ([None, 0], False, 1, 2), ([0, 17, -3], False, 1, 3), ([70, 80], False, 1, 2),
            ([17, 0, 1, 0, 17], False, 2, 3), ([0, 17, 2, 8], True, 0, None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t array<tinyint>")
    got = df.select("i", B.is_legal("t"), B.n_illegal_steps("t"), B.first_illegal_step("t")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_a_micro_batch_is_evaluated_once(spark, tmp_path):
    from pyspark.sql import types as T
    from seqorbit.streaming.ingest import ingest_batch
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, "s", f"{k % 7:02d}", k % 7) for k in range(70)],
                                 "tour_id long, source string, canon_key string, bucket int")
    store = f"{tmp_path}/store"
    ingest_batch(rows.where("tour_id < 3"), 0, store)
    ingest_batch(rows.mapInArrow(count, T.StructType(rows.schema.fields)), 1, store)
    got = spark.read.parquet(store).select("canon_key", "tour_id").collect()
    assert sorted(map(tuple, got)) == [(f"{k:02d}", k) for k in range(7)]
    assert seen.value == 70


@pytest.mark.parametrize("order", ["md5", "offset"])
def test_first_round_finds_what_the_plain_search_finds(order):
    """A batch of seeds together: the same tours in the same order; open seeds go on from their node."""
    import numpy as np
    import pyarrow as pa
    from seqorbit.sources.fixtures import BASE_TOURS
    late = [list(t[:n]) for t in BASE_TOURS for n in (1, 30, 50, 52, 56, 60, 63, 64)]
    for board, seeds, want in ((B.DEFAULT_BOARD, late, 3), (B.Board(5, 4), [[i] for i in range(20)], 2), (B.Board(6, 5), [[0], [1, 9], [8]], 4)):
        keys = [None, *range(1, len(seeds))]
        plain = P._Search(board, 42, order, False)
        for budget in (7, 40, 400):
            rows, tours, left, squares, size = P._BatchSearch(board, 42, order).advance(
                keys, pa.array(seeds, pa.list_(pa.int32())), np.full(len(seeds), want), budget)
            for i, s in enumerate(seeds):
                got = tours[rows == i].tolist()
                if left[i]:
                    node = squares[i, :size[i]].tolist()
                    assert len(node) < board.n_squares and len(got) < want
                    rest = plain.advance(keys[i], s, len(s), node, want - len(got), 3000, False)[0]
                    both = plain.advance(keys[i], s, len(s), s, want, 3000 + budget, False)[0]
                    k = min(len(both), len(got) + len(rest))
                    assert [*got, *[p for _, p in rest]][:k] == [p for _, p in both][:k] and len(got) <= len(both)
                else:
                    assert got == [p for _, p in plain.advance(keys[i], s, len(s), s, want, 10 ** 9, False)[0]]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fixture_tours_are_cut_from_a_table(spark):
    from seqorbit.sources import fixtures as FX
    board = B.DEFAULT_BOARD
    df = spark.createDataFrame([(k, k * 7 % 91) for k in range(200)] + [(None, 3), (4, None)], "k long, c long")
    for r in df.select("k", "c", FX.fixture_tour("k", "c").alias("t"), FX.fixture_tour("k", "c", corrupt=False).alias("clean")).collect():
        if r.k is None or r.c is None:
            assert r.t is None and r.clean is None
            continue
        back = r.k // 3 % 2
        want = [board.image_of(r.k // 6 % 8, FX.BASE_TOURS[r.k % 3][(r.c + (63 - i if back else i)) % 64]) for i in range(64)]
        assert r.clean == want
        assert r.t == [(p + 1) % 64 if i == 10 and r.k % 50 == 0 else p for i, p in enumerate(want)]
    assert "lambdafunction" not in _plan(df.select(FX.fixture_tour("k", "c", corrupt=False)))  # no work for each square


def test_keys_of_odd_sequences(spark):
    df = spark.createDataFrame([(0, [0, 17]), (1, [7, None, 63]), (2, [64, 100, -3]), (3, []), (4, None)], "i int, t array<tinyint>")
    got = [r[0] for r in df.orderBy("i").select(B.tour_key("t"), "i").collect()]
    assert got == ["00-17", "07-63", "64-10--3", "", ""]


def test_global_quota_checks_its_input_once(spark):
    from __spark_entry__ import queries
    plan = _plan(queries()["global_quota"](spark, "/root/testdata/sf0.001"))
    assert "lambdafunction" not in plan
