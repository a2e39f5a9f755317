"""Conversation trie, hard negatives and exact top-k against brute force, and their defined
results on nulls, repeated rows, ties, clashing columns and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqorbit.llm import conversation_trie, hard_negatives, scan, topk
from seqorbit.llm.common import id_remainder

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<double>, label int"


def clashing(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("clash"))
    return df


def found(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- trie ---------------------------------------------------------------------

def brute_trie(rows, head, base):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{role}\0{text}".encode()).hexdigest(), role, text))
    plain = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {c: plain.get(base(c), [])[:head(c)] + v[head(c):] for c, v in plain.items()}
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    words = lambda s: len([w for w in s.replace("\t", " ").replace("\n", " ").split(" ") if w])
    out = []
    for k, m in members.items():
        below = [(x, y) for x, y in members.items() if x[:len(k)] == k]
        ends = sorted(c for c in m if len(whole[c]) == len(k))
        out.append({
            "conv_id": min(m), "depth": len(k), "parent_conv_id": min(members[k[:-1]]) if k else None, "n_convs": len(m),
            "n_children": kids[k], "n_leaves": sum(not kids[x] for x, _ in below),
            "saved_tokens": sum((len(y) - 1) * (words(x[-1][1]) if x else 0) for x, y in below),
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()})
    return sorted(out, key=lambda r: (r["conv_id"], r["depth"]))


def _head(c):
    return zlib.crc32(str(c).encode()) % 4


def _base(c):
    return int(math.fmod(c, 20)) * -1 + c


def trie(df, **options):
    got = conversation_trie.prefix_trie(df, head=id_remainder("conv", 4), base=F.col("conv") - F.col("conv") % 20, **options)
    return sorted(found(got.drop("fingerprint")), key=lambda r: (r["conv_id"], r["depth"]))


def some_turns(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 45), 60, -3, -20, 81, 85]:  # no 80: conversations 81 and 85 have no base
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a", "b  c\td", ""])))
    rows += [(3, None, None, None), (3, None, "user", "x"), (5, 0, "user", "a b"), (5, 0, "user", "a b"),
             (None, 0, "user", "a b"), (7, 1, None, "a"), (7, 2, "", "a")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = some_turns()
    df = clashing(spark.createDataFrame(rows, TURNS).repartition(4), "depth", "ref", "conv", "words", "tie", "h", "n", "len")
    assert trie(df) == brute_trie(rows, _head, _base)


def test_trie_without_heads_keeps_the_conversations(spark):
    rows = some_turns(2)
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).drop("fingerprint")
    assert sorted(found(got), key=lambda r: (r["conv_id"], r["depth"])) == brute_trie(rows, lambda c: 0, lambda c: c)


def test_one_conversation_with_most_turns_is_spread(spark):
    rows = [(20, t, "user", f"t{t % 7}") for t in range(300)] + [(c, 0, "user", "t0") for c in range(21, 30)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    assert trie(df) == brute_trie(rows, _head, _base)
    # the running position of a long segment goes through all partitions
    one = df.select("conv_id", "turn", F.lit(1).cast("long").alias("x"))
    got = scan.running(one, "conv_id", ["turn"], ["x"], scan.sums(1), "test")
    assert all(r["before_x"] == (r["turn"] if r["conv_id"] == 20 else 0) for r in found(got))


def test_many_copies_and_a_digest_in_parts(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    rows = [(c, t, "user", "same") for c in range(400, 460) for t in range(2)]
    assert trie(spark.createDataFrame(rows, TURNS).repartition(3)) == brute_trie(rows, _head, _base)


def test_hash_collisions_start_again(spark):
    rows = some_turns(3)
    df = spark.createDataFrame(rows, TURNS)
    turns = conversation_trie.stored_turns(df, "conv_id", "turn", "role", "text")
    assert not conversation_trie.equal_turns(conversation_trie.hashed(turns, 1, 1))
    assert trie(df, hashes=[(1, 1), (2, 64)]) == brute_trie(rows, _head, _base)
    with pytest.raises(RuntimeError):
        trie(df, hashes=[(1, 1)])


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "a")], TURNS)) == []


def test_maps_are_a_group():
    r = random.Random(5)
    some = [r.randrange(1, conversation_trie.PRIME) << 31 | r.randrange(conversation_trie.PRIME) for _ in range(20)] + [conversation_trie.SAME]
    x = np.array(some)
    assert (conversation_trie.compose_arrays(x, conversation_trie.inverse(x)) == conversation_trie.SAME).all()
    for a, b, c in zip(some, some[1:], some[2:]):
        f = conversation_trie.compose_ints
        assert f(f(a, b), c) == f(a, f(b, c))
        assert conversation_trie.compose_arrays(np.array([a]), np.array([b]))[0] == f(a, b)


# -- vectors ------------------------------------------------------------------

def vectors(seed=1, n=160, width=6, hot=40):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(r.normal(size=width), 2)], int(r.integers(3))) for i in range(n)]
    for i in range(hot):  # equal vectors, ties
        rows[i * 3] = (i * 3, rows[0][1], i % 2)
    rows += [(500, None, 1), (501, [1.0, None] + [0.0] * (width - 2), 1), (502, [math.inf] + [0.0] * (width - 1), 1),
             (550, [math.nan] * width, 0), (600, [0.0] * width, 0), (601, [0.0] * width, 1), (None, rows[1][1], 1),
             (650, rows[2][1], None), (651, [0.5, 0.25], 1), (700, [0.5, -0.25], 1), (701, [], 1), (750, [], 1)]
    return rows


def scaled(rows, labelled=False):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = ([math.floor(256 * x) for x in v], label)
        out[i] = min(out.get(i, q), q) if labelled else min(out.get(i, q), q, key=lambda z: z[0])
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every):
    v = scaled(rows)
    out = []
    for i in sorted(v):
        if i % every == 0:
            best = sorted((-dot(v[i][0], w), j) for j, (w, _) in v.items() if j != i and len(w) == len(v[i][0]))[:k]
            out += [{"query_id": i, "rank": n, "vec_id": j, "score": -s} for n, (s, j) in enumerate(best, 1)]
    return out


def brute_negatives(rows, every=10, n_pos=5, n_neg=3):
    v = scaled(rows, labelled=True)
    out = []
    for i in sorted(v):
        if i % every:
            continue
        q, own = v[i]
        scores = [(-dot(q, w), j, lab) for j, (w, lab) in v.items() if j != i and len(w) == len(q)]
        for s, j in sorted((s, j) for s, j, lab in scores if lab == own)[:n_pos]:
            p = -s
            hard = sorted((t, x) for t, x, lab in scores if lab != own and 50 * p <= -100 * t <= 95 * p)[:n_neg]
            out += [{"anchor_id": i, "positive_id": j, "rank": n, "negative_id": x, "positive_score": p, "negative_score": -t}
                    for n, (t, x) in enumerate(hard, 1)]
    return sorted(out, key=lambda r: (r["anchor_id"], r["positive_id"], r["rank"]))


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:  # several segments, stripes and steps
        for name, value in (("SEGMENT", 16), ("STRIPE", 2), ("QUERIES", 4), ("STEP", 3), ("FEW", 2), ("BATCH", 3)):
            monkeypatch.setattr(topk, name, value)
    rows = vectors()
    df = clashing(spark.createDataFrame(rows + rows[:5], VECTORS).repartition(3), "node", "ids", "nth", "score", "query", "vec", "v", "width")
    got = found(topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5))
    assert sorted(got, key=lambda r: (r["query_id"], r["rank"])) == brute_top(rows, 5, 10)


def test_top_k_of_repeated_ids_and_huge_numbers(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [2e6, -3e6], 0), (1, [1e6, 3e6], 0), (2, [3e6, 3e6], 0), (3, [1e300, 1.0], 0), (4, [-3e6, 0.5], 0)]
    got = found(topk.exact_top_k(spark.createDataFrame(rows, VECTORS), F.lit(True), k=2))
    assert sorted(got, key=lambda r: (r["query_id"], r["rank"])) == brute_top([r for r in rows if r[0] != 3], 2, 1)


def test_lists_are_read_until_nobody_else_can_qualify(monkeypatch):
    r = np.random.default_rng(4)
    x = np.floor(256 * r.normal(size=(900, 8))).astype(np.int64)
    x[5:9] = x[4]
    q = np.concatenate([x[:6], np.zeros((1, 8), np.int64)])
    at = np.argsort(-x, axis=0, kind="stable").T
    value = np.take_along_axis(x.T, at, 1)
    scores = q @ x.T
    for step in (1, 37, 128, 2000):
        monkeypatch.setattr(topk, "STEP", step)
        for known in (np.full(7, -np.inf), np.sort(scores, axis=1)[:, -3].astype(float)):
            for i, (some, got) in enumerate(topk.read_lists(at, value, q, 4, known)):
                assert (scores[i, some] == got).all()
                want = set(np.flatnonzero(scores[i] >= max(np.sort(scores[i])[-4], known[i])))
                assert want <= set(some)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # several segments, leaves and levels
        for name, value in (("SEGMENT", 24), ("ANCHORS", 4), ("LEAF", 3), ("FAN", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(2)
    df = clashing(spark.createDataFrame(rows + rows[:5], VECTORS).repartition(3), "node", "ids", "at", "score", "anchor", "vec", "k0", "rank")
    got = found(hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert sorted(got, key=lambda r: (r["anchor_id"], r["positive_id"], r["rank"])) == brute_negatives(rows)


def test_tree_searches_equal_a_full_scan(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 5)
    monkeypatch.setattr(hard_negatives, "FAN", 3)
    r = np.random.default_rng(6)
    x = np.floor(64 * r.normal(size=(400, 5))).astype(np.int64)
    label, first = np.sort(r.integers(4, size=400)), r.permutation(400)
    tree = hard_negatives.PackedTree(x, label)
    q = x[::40]
    levels, off = tree.intervals(q)
    for i, a in enumerate(q):
        score = x @ a
        for lo, hi in levels:
            assert lo[i].min() <= score.min() and hi[i].max() >= score.max()
        for same in (True, False):
            windows = [(-math.inf, math.inf), (int(np.median(score)), int(score.max()) // 2), (10, 9)]
            got = tree.best_first(a, off[i] == 0, [(lo[i], hi[i]) for lo, hi in levels], 2, same, windows, 4, first)
            for (low, high), few in zip(windows, got):
                want = sorted((-int(s), int(f), n) for n, (s, f, lab) in enumerate(zip(score, first, label))
                              if (lab == 2) == same and low <= s <= high)[:4]
                assert few == want


def test_vector_searches_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    void = spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], VECTORS)
    for df in (none, void):
        assert found(topk.exact_top_k(df, F.lit(True))) == []
        assert found(hard_negatives.mine_hard_negatives(df, F.lit(True))) == []
