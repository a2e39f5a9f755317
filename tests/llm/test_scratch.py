"""Stage tables are freed when nothing reads them; filters and joins grow with the input."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqorbit.llm import common, embedding_dedup, hmm, line_dedup, minhash_dedup
from seqorbit.llm.common import Scratch, connected_components, stage
from seqorbit.session import shared_dir


def tables(spark, name=""):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {os.path.basename(x) for x in glob.glob(f"{folder}/stage-llm-{name}*")}


def kinds(new):
    return sorted(x[len("stage-llm-"):-len("-123456789012")] for x in new)


def test_scratch_frees_all_but_what_is_kept(spark):
    before = tables(spark, "scratch")
    with Scratch() as outer:
        with Scratch() as own:
            stage(spark.range(3), "scratch-a")
            early, kept = stage(spark.range(4), "scratch-b"), own.keep(stage(spark.range(5), "scratch-c"))
            own.drop(early)
            assert kinds(tables(spark, "scratch") - before) == ["scratch-a", "scratch-c"]
        assert kinds(tables(spark, "scratch") - before) == ["scratch-c"] and kept.count() == 5
        outside = outer.keep(stage(spark.range(6), "scratch-d"))
    assert kinds(tables(spark, "scratch") - before) == ["scratch-d"] and outside.count() == 6
    with pytest.raises(ValueError), Scratch():
        stage(spark.range(2), "scratch-e")
        raise ValueError
    assert kinds(tables(spark, "scratch") - before) == ["scratch-d"]


def test_operators_leave_only_what_their_result_reads(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "NODE", 4)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(30)]
    df = spark.createDataFrame([(i, t + (" z" if i % 2 else "")) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    before = tables(spark)
    lines = line_dedup.dedup_lines(df)
    assert kinds(tables(spark) - before) == ["line-gone"]
    assert lines.where("n_removed > 0").count() == 30
    before = tables(spark)
    found = minhash_dedup.near_duplicates(df, shingle=1)
    assert kinds(tables(spark) - before) == ["cps-classes", "cps-names", "cps-sketch"]
    assert found.where("kept").count() <= 30
    before = tables(spark)
    ends = connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert kinds(tables(spark) - before) == ["cc-edges"] and ends.where("component = 0").count() == 10


def test_sketches_fold_and_never_exceed_the_difference():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 64, 1200, np.uint64)
    n = np.array([1, 79, 80, 159, 160, 320, 1100, 30])
    lines = [rng.choice(words, k, replace=False) for k in n]
    flat, ends = line_dedup._sketches(np.concatenate(lines), np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    assert np.diff(ends, prepend=0).tolist() == [1, 1, 2, 2, 4, 8, 8, 1]
    column = pa.array([flat[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)], pa.binary())
    f = object.__new__(line_dedup._Filter)
    f.width, f.sketches = line_dedup._folded(pa.chunked_array([column]).slice(0))
    x, y = (a.ravel() for a in np.meshgrid(np.arange(8), np.arange(8)))
    differ = np.array([len(set(lines[a]) ^ set(lines[b])) for a, b in zip(x, y)])
    apart = f.apart(x, y)
    assert (apart <= differ).all() and (apart[x == y] == 0).all()
    one = np.array([np.bitwise_xor.reduce(np.uint64(1) << (w & np.uint64(63))) for w in lines])
    assert (apart >= np.bitwise_count(one[x] ^ one[y])).all()
    f.width, f.sketches = line_dedup._folded(column.slice(3))
    assert (f.apart(x[(x > 2) & (y > 2)] - 3, y[(x > 2) & (y > 2)] - 3) == apart[(x > 2) & (y > 2)]).all()


def test_long_lines_that_differ_are_not_paired(spark, monkeypatch):
    """Lines of 150 words of 400: a sketch of 64 bits let about every second pair pass."""
    met, real = [], stage

    def counted(df, name):
        table = real(df, name)
        if name == "line-pairs":
            met.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "stage", counted)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.choice(400, 150, replace=False)) for _ in range(60)]
    texts += [t + " more" for t in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = line_dedup.dedup_lines(df).where("n_removed > 0").select("doc_id").collect()
    assert sorted(r[0] for r in gone) == list(range(60, 65))
    assert met[0] <= 10


def test_agreement_keeps_one_row_a_member():
    low = [bytes([i]) * minhash_dedup.COORDS for i in (1, 2, 3)]
    one = bytes([1]) * 40 + bytes([9]) * (minhash_dedup.COORDS - 40)
    b = pa.record_batch([pa.array([5, 5, 6]), pa.array([1, 2, 3]), pa.array([4, 4, 4]), pa.array(low, pa.binary()),
                         pa.array([1, 1, None], pa.int64()), pa.array([one, one, None], pa.binary())],
                        names=["node", "doc", "n", "low", "head", "hlow"])
    (out,) = minhash_dedup._agreement([b])
    assert out.column("same").to_pylist() == [40, 0, -1] and out.column("doc").to_pylist() == [1, 2, 3]


def test_a_pass_frees_the_shares_it_has_read(spark, monkeypatch):
    seen, real = [], hmm.stage

    def watched(df, name):
        if name == "hmm-pass-sums":
            seen.append(kinds(tables(spark, "hmm-pass-sums") - before))
        return real(df, name)

    before = tables(spark, "hmm-pass-sums")
    monkeypatch.setattr(hmm, "stage", watched)
    df = spark.createDataFrame([(i, f"a b c{i % 7}") for i in range(40)], "doc_id long, text string")
    assert hmm.score_texts(df, F.col("doc_id") % 5 == 1, passes=3).count() == 40
    assert seen == [[], [], []]


def test_large_nodes_branch_on_in_their_task(spark, monkeypatch):
    """One task or jobs by level: the same groups; only jobs write the rows of a second level."""
    staged, groups, real = [], [], minhash_dedup.stage

    def watched(df, name):
        table = real(df, name)
        staged.append(name)
        if name == "cps-groups":
            groups.append(sorted(tuple(r) for r in table.collect()))
        return table

    monkeypatch.setattr(minhash_dedup, "stage", watched)
    monkeypatch.setattr(minhash_dedup, "NODE", 4)
    texts = [" ".join([f"shared{x}" for x in range(70)] + [f"own{i // 2}x{x}" for x in range(30)]) + " z" * (i % 2) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for most in (16384, 4):
        monkeypatch.setattr(minhash_dedup, "TASK_SETS", most)
        found.append(sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, shingle=1).select("doc_id", "component_id").collect()))
        assert ("cps-level2" in staged) == (most == 4)
    assert found[0] == found[1] == [(i, i - i % 2) for i in range(80)]
    assert groups[0] == groups[1] and len(groups[0]) == 80


def test_components_end_with_stars(spark, monkeypatch):
    staged, real = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: staged.append(name) or real(df, name))
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (22, 20)], "a long, b long")
    assert sorted(tuple(r) for r in connected_components(stars).collect()) == sorted(
        [(i, 0) for i in range(9)] + [(i, 20) for i in range(20, 23)])
    assert staged.count("cc-star") == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(30, 32), (31, 32)], "a long, b long")
    assert sorted(tuple(r) for r in connected_components(path).collect()) == sorted(
        [(i, 0) for i in range(10)] + [(i, 30) for i in range(30, 33)])


def test_rows_of_tokens_take_three_bytes():
    rows = np.random.default_rng(2).integers(0, 1 << 24, 1000).astype(np.uint32)
    for x, size in ((rows, 3), (rows[:0], 3), (np.append(rows, np.uint32(1 << 24)), 4), (np.append(rows, np.uint32((1 << 24) - 1)), 3)):
        raw = hmm._packed(x)
        assert len(raw) == size * len(x)
        assert hmm._unpacked(raw, len(x)).dtype == np.uint32 and (hmm._unpacked(raw, len(x)) == x).all()


def near_vectors(n, groups, width, spread):
    rng = np.random.default_rng(5)
    return rng.normal(size=(groups, width))[np.arange(n) % groups] + rng.normal(size=(n, width)) * spread


def links_and_components(data, threshold=0.95):
    u = data / np.linalg.norm(data, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    name = np.arange(len(u))
    while True:
        near = np.where(link, name, len(u)).min(axis=1)
        if (near >= name).all():
            return link.sum(axis=1), name
        name = np.minimum(name, near)


def test_vectors_sent_at_once_stay_in_proportion(spark, monkeypatch):
    """However many pairs of blocks meet, a wave of tiles gets each vector about twice."""
    for name, value in {"BLOCK": 4, "LEAF": 4, "STRIPE_VALUES": 24 * 40, "STRIPE_ROWS": 40, "WAVE_VALUES": 1}.items():
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    sent, folded, compare = [], [], embedding_dedup._compare

    def counted(*args):
        run, rows = compare(*args), spark.sparkContext.accumulator(0)
        sent.append(rows)

        def each(batches):
            def passed():
                for b in batches:
                    rows.add(b.num_rows)
                    yield b
            return run(passed())
        return each

    monkeypatch.setattr(embedding_dedup, "_compare", counted)
    if hasattr(embedding_dedup, "waves"):  # one accumulator for each wave
        here, real = [], embedding_dedup.waves

        def each_wave(*args):
            for w in real(*args):
                here.append(sent[0].value)
                yield w
            here.append(sent[0].value)

        monkeypatch.setattr(embedding_dedup, "waves", each_wave)
        summed = embedding_dedup._summed
        monkeypatch.setattr(embedding_dedup, "_summed", lambda found: folded.append(1) or summed(found))
    data = near_vectors(400, 40, 24, 0.5).astype(np.float32).astype(float)
    df = spark.createDataFrame(list(enumerate(data.tolist())), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, threshold=0.6).collect()}
    waves = np.diff(here) if hasattr(embedding_dedup, "waves") else [x.value for x in sent]
    assert len(waves) > 3 and max(waves) <= 2.2 * len(data) and folded
    n, name = links_and_components(data, 0.6)
    assert n.max() > 3 and len(got) == len(data)
    for i in range(len(data)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], name[i], name[i] == i)


def test_vector_tables_are_freed_and_hold_what_was_given(spark, monkeypatch):
    sizes, real = {}, embedding_dedup.stage

    def watched(df, name):
        table = real(df, name)
        if "vec" in table.columns:
            sizes[name] = table.agg(F.max(F.length("vec"))).first()[0]
        return table

    monkeypatch.setattr(embedding_dedup, "stage", watched)
    data = near_vectors(60, 6, 8, 0.1)
    given = [*enumerate(data.tolist()), (60, data[3].tolist()), (61, None), (62, [1.0, None]), (63, []), (64, [0.0] * 8),
             (65, [float("inf")] * 8), (66, data[3][:5].tolist()), (None, [0.0] * 7 + [-1.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    before = tables(spark)
    found = embedding_dedup.near_duplicate_vectors(df)
    assert kinds(tables(spark) - before) == ["ego-full", "ego-rows"]
    assert sizes and set(sizes.values()) == {4 * 8}
    got = {r["vec_id"]: r for r in found.collect()}
    n, name = links_and_components(np.vstack([data, data[3:4]]).astype(np.float32).astype(float))
    assert len(got) == len(given) and got[60]["component_id"] == got[3]["component_id"] == name[3]
    assert [got[i]["n_links"] for i in range(61)] == n.tolist()
    for i in (61, 62, 63, 64, 65, 66):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)


@pytest.mark.parametrize("dense", [1, 10 ** 9])
def test_bounds_let_every_link_through(monkeypatch, dense):
    """Links at the threshold, and just above and below it; ``dense`` pairs are compared one way or the other."""
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    rng = np.random.default_rng(9)
    u = embedding_dedup._normal(rng.normal(size=(40, 24)))
    turn = embedding_dedup._normal(rng.normal(size=(40, 24)))
    away = embedding_dedup._normal(turn - np.einsum("ij,ij->i", turn, u)[:, None] * u)
    t = 0.95 + np.tile([-1e-9, 1e-9, -1e-3, 1e-3], 10)
    v = u * t[:, None] + away * np.sqrt(1 - t * t)[:, None]
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0][:, :16]

    def interval(x):
        p = x @ axes
        left = np.sqrt(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0))
        return embedding_dedup.Interval(x, p, np.hstack([p, left[:, None]]).astype(np.float32), np.ones(40, int), np.full(40, 24))

    x, y = interval(u), interval(v)
    assert (embedding_dedup._linked(x, y, 0.95) == (u @ v.T >= 0.95)).all() and embedding_dedup._linked(x, y, 0.95).sum() == 20
    y.dim = np.full(40, 23)
    assert embedding_dedup._linked(x, y, 0.95) is None
