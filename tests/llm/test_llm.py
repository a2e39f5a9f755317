"""Operators of the training-data package against brute force, and their defined
results on nulls, empty and long texts, repeated rows, clashing columns and empty
tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqorbit.llm import (decontaminate, embedding_dedup, extract, hmm, language, licenses, line_dedup,
                          minhash_dedup, mixing, substring_dedup)
from seqorbit.llm.common import connected_components, id_remainder
from tests.conftest import SF_SMALL

BASE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
MESSY = [
    (1, BASE, "en", "a"), (2, BASE, "en", None), (2, BASE, "en", None),          # copy, repeated row
    (3, BASE.replace("word7 ", "other "), None, "b"), (4, None, "en", "a"), (5, "", "fr", "a"),
    (6, " \t\n", None, None), (7, "one", "fr", "b"), (8, "ONE", "fr", "b"), (None, "alone here", "en", "a"),
    (9, LONG, "en", "a"), (10, "x " * 50, "fr", "a"), (11, "x " * 50 + "y", "fr", "b"), (12, "!!! 123", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def messy(spark):
    """The rows above with columns whose names the operators use themselves."""
    df = spark.createDataFrame(MESSY, SCHEMA).repartition(3)
    for c in ("size", "target", "rk", "did", "tag", "n", "key", "node", "component", "score", "start", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)}
    assert connected_components(edges.limit(0)).count() == 0


# --- op1 ---------------------------------------------------------------------------

def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    data = [(i, (centre[i % 12] + rng.normal(size=16) * 0.22).tolist()) for i in range(240)]
    data += [(300 + i, data[0][1]) for i in range(5)]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16),
           (405, data[0][1][:8]), (None, [5.0] * 16), (400, None)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("node", F.lit(2))
    got = rows(embedding_dedup.near_duplicate_vectors(df, threshold=0.95))
    assert len(got) == len(data + odd)
    ids = np.array([i for i, _ in data])
    u = np.array([v for _, v in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.any()
    want = components(ids.tolist(), [(ids[i], ids[j]) for i, j in zip(*np.nonzero(link))])
    by = {r["vec_id"]: r for r in got}
    for i, n in zip(ids.tolist(), link.sum(axis=1)):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (n, want[i], want[i] == i)
    for i in (400, 401, 402, 403, 404, 405):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# --- op2 ---------------------------------------------------------------------------

@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b &lt;c&gt;", "a b <c>"),
    ("<nav>m</nav><article><h1>T</h1><p>one <b>t</b>wo\n three</p><div class='comments'>c</div></article><footer>f</footer>",
     "T one two three"),
    ("<script>var x='</p>';</script><div><p>some longer text here</p><p>and more text there</p></div><div class=ad>buy</div>",
     "some longer text here and more text there"),
    ("<p>cut off <a href='x", "cut off"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article><form><input>q</form><p>kept</p><aside>s</aside><p hidden>h</p></article>", "kept"),
])
def test_main_text(page, want):
    assert extract.main_text(page) == want


STORY = "<p>" + "plain words of the story " * 20 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "comments-open", "layout share-enabled"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_with_noise_words(name, inner):
    want = " ".join((STORY[3:-4] * 2).split())
    beside = "<div><p>beside the wrapper</p></div>"
    for attr in ("class", "id"):
        page = (f"<body>{beside}<div {attr}='{name}'><{inner}>{STORY * 2}</{inner}>"
                f"<div class='sidebar'>side words</div><div class='comments-area'>{STORY * 3}</div></div></body>")
        got = extract.main_text(page)
        assert want in got and "side words" not in got and got.count("story") == 40


def test_noise_parts_stay_out():
    teasers = "<div class='related-posts'><article><p>teaser words</p></article></div>"
    comments = f"<div class='comments-area'><article class='comment-body'>{STORY}</article></div>"
    page = f"<body><main><article>{STORY}</article>{teasers}{comments}</main><div class='top-widget-x'>small</div></body>"
    assert extract.main_text(page) == " ".join(STORY[3:-4].split())


def test_bare_text_around_a_nested_block():
    bare = [f"bare{i} " + "words of the page itself " * 16 for i in range(6)]
    quote = "".join(f"<p>{'the quoted words of another ' * 11}</p>" for _ in range(2))
    before, after = "<br>".join(bare[:3]), "<br>".join(bare[3:5]) + "<br>" + bare[5].replace("bare5", "<b>bare5</b>")
    page = f"<body><div>{before}<blockquote>{quote}</blockquote>{after}</div><div>x <a href=/>links here</a></div></body>"
    want = " ".join([*bare[:3], *["the quoted words of another"] * 22, *bare[3:]])
    root = extract.parse(page)
    kept = extract.main_nodes(root)
    assert [n.tag for n in kept] == ["#text", "blockquote", "#text"]
    assert extract.main_text(page) == " ".join(want.split())
    # little text does not reach the threshold
    short = f"<body><div>tiny<blockquote>{quote}</blockquote><a href=/>more</a> here</div></body>"
    assert extract.main_text(short) == " ".join(["the quoted words of another"] * 22)


def test_deep_and_link_heavy_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert extract.main_text(deep) == "deep text"
    links = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(40)) + "</ul>"
    body = "".join(f"<p>{'plain words of the story ' * 8}</p>" for _ in range(4))
    page = f"<html><body><div>{links}</div><div>{body}</div></body></html>"
    assert extract.main_text(page) == " ".join(["plain words of the story"] * 32)
    df = spark.createDataFrame([(1, None, page), (1, None, page), (None, "u", None)], "page_id long, url string, html string")
    got = rows(extract.extract_main_text(df))
    assert [r["n_chars"] == len(r["text"]) for r in got] == [True] * 3
    assert extract.extract_main_text(df.limit(0)).count() == 0


# --- op3 ---------------------------------------------------------------------------

def test_language_held_out(docs):
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    got = rows(language.identify(docs, trains=~held, extra=("lang",)))
    test = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in test) >= 0.9 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(messy, empty):
    got = Counter((r["doc_id"], r["lang_pred"]) for r in rows(language.identify(messy)))
    assert sum(got.values()) == len(MESSY)
    assert language.words_of("² ½ ① x² Été 12") == ["x²", "été"]  # numerals alone are no letters
    assert all(got[i, "und"] == 1 for i in (4, 5, 6, 12)) and got[1, "en"] == 1
    assert language.identify(empty).count() == 0
    none = language.identify(messy.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in rows(none)} == {"und"}


# --- op4 ---------------------------------------------------------------------------

@pytest.mark.parametrize("k, large", [(2, False), (5, True)])
def test_near_duplicates(spark, docs, monkeypatch, k, large):
    if large:  # take the paths of large nodes and groups
        for name, value in (("NODE", 6), ("GROUP_SETS", 8), ("DEPTH", 2)):
            monkeypatch.setattr(minhash_dedup, name, value)
    base = [f"t{i}" for i in range(200)]
    extra = [(10_000 + i, " ".join(base[:3 * i] + [f"new{i}"] + base[3 * i + 1:]), "en", "s", 0) for i in range(50)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    text = {r["doc_id"]: r["text"] for r in rows(df)}
    sets = {i: shingles(t, k) for i, t in text.items()}
    common, where = Counter(), {}
    for i, s in sets.items():
        for g in s:
            for j in where.setdefault(g, []):
                common[j, i] += 1
            where[g].append(i)
    links = [p for p, c in common.items() if 100 * c >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    want = components(sets, links)
    got = rows(minhash_dedup.near_duplicates(df, shingle=k))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_trees_reach_the_recall_at_every_depth(spark, monkeypatch):
    """Pairs at the threshold, walked through the trees by the operator's own children."""
    t = minhash_dedup.trees_for(0.9999, 0.8, minhash_dedup.DEPTH)
    assert minhash_dedup.trees_for(0.9999, 0.8) < t
    for depth in (3, 5, 8):
        need = minhash_dedup.trees_for(0.9999, 0.8, depth)
        assert need <= t and minhash_dedup.tree_recall(need, 0.8, depth) >= 0.9999
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        same = rng.random(minhash_dedup.COORDS) < 0.8
        pair = np.where(same[None, :], 0, [[1], [2]])
        nodes = [np.arange(1, t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rng.integers(0, 1 << 60, 1, np.uint64)] * 2
        for _ in range(minhash_dedup.DEPTH):
            nodes = [np.concatenate([c for _, c in minhash_dedup._children(x, lambda r, c, k=k: pair[k, c], 0.25)])
                     for k, x in enumerate(nodes)]
            nodes = [np.intersect1d(*nodes)] * 2
        met += len(nodes[0]) > 0
    assert met >= 298  # about 292 with the trees for depth 3 by the former formula
    # sets in large nodes get the trees of the full depth, the others do not
    used = []
    roots = minhash_dedup._roots
    monkeypatch.setattr(minhash_dedup, "_roots", lambda trees, extra: used.append(trees) or roots(trees, extra))
    monkeypatch.setattr(minhash_dedup, "NODE", 4)
    texts = [" ".join([f"shared{x}" for x in range(70)] + [f"own{i}x{x}" for x in range(30)]) for i in range(80)]
    few = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert minhash_dedup.near_duplicates(few, shingle=1).count() == 80
    first = minhash_dedup.trees_for(0.9999, 0.8)
    assert used == [range(first), range(first, t)]


def test_near_duplicates_edges(messy, empty):
    got = rows(minhash_dedup.near_duplicates(messy, shingle=2))
    assert len(got) == len(MESSY)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[2] == (59, 1, False) and by[3] == (59, 1, False) and by[8] == (1, 7, False)
    assert by[4] == (0, 4, True) and by[6] == (0, 6, True) and by[None] == (1, None, True) and by[10] == (1, 10, True)
    assert minhash_dedup.near_duplicates(empty).count() == 0


# --- op5 ---------------------------------------------------------------------------

def brute_lines(pairs):
    """Kept texts of (id, text) rows in id order."""
    lines = [(i, k, frozenset(x.lower().split())) for i, t in pairs for k, x in enumerate((t or "").encode().split(b"\n"))]
    earlier, out = [], {i: [] for i, _ in pairs}
    for i, k, s in lines:
        same = bool(s) and any(100 * len(s & o) >= 80 * len(s | o) for o in earlier)
        if s:
            earlier.append(s)
        if not same:
            out[i].append(k)
    return {i: None if t is None else "\n".join(t.split("\n")[k] for k in out[i]) for i, t in pairs}


@pytest.mark.parametrize("first", [3, 1])
def test_line_dedup(spark, docs, monkeypatch, first):
    monkeypatch.setattr(line_dedup, "FIRST", first)
    if first == 1:
        monkeypatch.setattr(line_dedup, "SMALL", 3)
        monkeypatch.setattr(line_dedup, "TILE", 4)
    pairs = [(r["doc_id"], r["text"]) for r in rows(docs.orderBy("doc_id"))][:60]
    words = [f"v{i}" for i in range(30)]
    pairs += [(9000 + i, " ".join(words[:i] + [f"q{i}"] + words[i + 1:]) + "\n\nThe  END") for i in range(25)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["kept_text"] for r in rows(line_dedup.dedup_lines(df))}
    assert got == brute_lines(pairs)


def test_line_dedup_edges(messy, empty):
    got = rows(line_dedup.dedup_lines(messy, extra=("size",)))
    assert len(got) == len(MESSY) and {r["x_size"] for r in got} == {"clash"}
    by = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in got}
    assert by[1] == (1, 0, BASE) and by[2] == (1, 1, "") and by[3] == (1, 1, "") and by[8] == (1, 1, "")
    assert by[4] == (0, 0, None) and by[6] == (2, 0, " \t\n") and by[9] == (1, 0, LONG)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- op6 ---------------------------------------------------------------------------

def test_forward_matches_path_sum():
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, size=3), rng.dirichlet([1] * 5, size=3).T)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (6, 4, 1)]
    for s, got in zip(seqs, hmm.forward(model, seqs)[0]):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)
    emit, move, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    hmm.expected_counts(model, seqs, emit, move, start)
    assert np.isclose(emit.sum(), 11) and np.isclose(move.sum(), 8) and np.isclose(start.sum(), 3)


@pytest.mark.parametrize("frequent", [65536, 50])
def test_language_model(docs, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "N_FREQUENT", frequent)
    monkeypatch.setattr(hmm, "N_CLASSES", 30)
    got = {r["doc_id"]: r for r in rows(hmm.score_texts(docs, id_remainder("doc_id", 5) == 1, passes=2))}
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in rows(docs)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    test = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_language_model_edges(messy, empty):
    got = rows(hmm.score_texts(messy, id_remainder("doc_id", 5) == 1, passes=1))
    assert len(got) == len(MESSY) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert hmm.score_texts(empty, F.lit(False), passes=1).count() == 0
    assert hmm.score_texts(messy, F.lit(True), passes=1).where("n_known > 0").count() == 0


def test_expected_counts_of_every_word(spark, monkeypatch):
    """Words beyond the broadcast ones, all with the same last bytes, get counts of their own by
    state, added up over many blocks: the same scores as from one model with a row for each."""
    monkeypatch.setattr(hmm, "N_CLASSES", 10)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 100)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'ab'[i % 2]}{x}same" for x in rng.integers(0, 40, 30)).encode() for i in range(60)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in rows(hmm.score_texts(df, F.col("doc_id") >= 50, states=3, passes=2))}

    c = Counter(w for t in texts[:50] for w in [*t.split(), b""])
    order = sorted(c, key=lambda w: (-c[w], w))
    by: dict = {}
    for w in order[10:]:
        k = zlib.crc32(w[-3:]) % hmm.N_BUCKETS
        by[k] = (by.get(k, (0, 0))[0] + c[w], by.get(k, (0, 0))[1] + 1)
    known = hmm.Classes([(w, c[w]) for w in order[:10]], by, sum(c.values()), len(c))
    rare: dict = {}
    seqs = [known.encode(t, rare) for t in texts]
    own, at = np.array([c[w] for w in rare]), np.array([zlib.crc32(w[-3:]) % hmm.N_BUCKETS for w in rare])
    model, counts = hmm.Model.initial(known, 3), np.zeros((len(rare), 3))
    for _ in range(2):
        m = model.beside(model.emissions(counts, own, at, known))
        emit, move, start = np.zeros_like(m.emit), np.zeros((3, 3)), np.zeros(3)
        hmm.expected_counts(m, seqs[:50], emit, move, start)
        counts, buckets = emit[10:], np.zeros((hmm.N_BUCKETS, 3))
        np.add.at(buckets, at, counts)
        model = hmm.Model.from_counts(start, move, emit[:10], buckets, known)
    last = model.emissions(counts, own, at, known)
    # one bucket, so by its counts alone the states' ratios would be the same for all its words
    assert len(rare) >= 60 and len(set(at)) == 1 and np.ptp(last[:, 0] / last[:, 1]) > 1e-3
    unseen = model.emissions(np.zeros((1, 3)), np.zeros(1), at[:1], known)
    assert np.allclose(model.emit.sum(axis=0) + last[own > 0].sum(axis=0) + unseen[0] + model.buckets.sum(axis=0)
                       - model.buckets[at[0]], 1)
    want = hmm.forward(model.beside(last), seqs)[0]
    assert np.allclose([got[i] for i in range(60)], want, rtol=1e-5)


# --- op7 ---------------------------------------------------------------------------

def brute_repeats(pairs):
    first, words = {}, {i: (t or "").encode().split() for i, t in pairs}
    for i, w in sorted(words.items(), key=lambda x: x[0]):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (i, s))
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (i, s) for p in range(s, s + 20)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    return out


def test_repeats(spark, docs):
    rng = np.random.default_rng(3)
    pairs = [(r["doc_id"], r["text"]) for r in rows(docs)]
    shared = " ".join(f"s{i}" for i in range(55))
    pairs += [(5000 + i, " ".join([f"a{i}"] * (i % 4)) + f" {shared} " + " ".join(rng.choice(list("abc"), 30))) for i in range(12)]
    pairs += [(6000, "r " * 70), (6001, "p q " * 40), (6002, "q p " * 40), (6003, " ".join(["k"] * 19)), (6004, " ".join(["k"] * 19))]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substring_dedup.remove_repeats(df))}
    assert got == brute_repeats(pairs)


def test_repeats_edges(messy, empty):
    got = rows(substring_dedup.remove_repeats(messy))
    assert len(got) == len(MESSY)
    by = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got}
    assert by[2] == (60, 60) and by[4] == (0, 0) and by[6] == (0, 0)
    want = brute_repeats([(i, t) for i, t, *_ in MESSY if i is not None])
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert substring_dedup.remove_repeats(empty).count() == 0


# --- op8 ---------------------------------------------------------------------------

@pytest.mark.parametrize("bound", [500_000, 0])
def test_contamination(spark, messy, empty, bound):
    bench = spark.createDataFrame([("a", BASE), ("b", "One"), ("b", "alone HERE"), ("c", None), ("d", "..."), (None, BASE)],
                                  "item_id string, text string")
    got = rows(decontaminate.contamination(messy, bench, max_broadcast_windows=bound, extra=("n",)))
    assert len(got) == len(MESSY) and {r["x_n"] for r in got} == {"clash"}
    by = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got}
    assert by[1] == (60, 60, 2) and by[3] == (60, 52, 2) and by[7] == (1, 1, 1) and by[8] == (1, 1, 1)
    assert by[None] == (2, 2, 1) and by[4] == (0, 0, 0) and by[12] == (1, 0, 0)
    assert {r["items_sha256"] for r in got if r["doc_id"] == 4} == {hashlib.sha256(b"").hexdigest()}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(messy, bench.limit(0)).where("contaminated").count() == 0


# --- op9 ---------------------------------------------------------------------------

def test_licenses(spark, messy, empty):
    scan = licenses.Scanner().scan
    for body, want in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
                       ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
                       ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        assert licenses.TEMPLATES[scan(body)[0]][0] == want
    assert scan("the licensed driver drove on")[0] is None
    df = spark.createDataFrame([(1, "Text.\nReleased under the MIT License.\nMore."), (2, "no notice"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_blocks"], r["license"]) for r in rows(licenses.scan_licenses(df))}
    assert got == {1: (1, "MIT"), 2: (0, None), 3: (0, None)}
    assert licenses.scan_licenses(messy).count() == len(MESSY) and licenses.scan_licenses(empty).count() == 0


def test_wrapped_licenses(spark):
    wrapped = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
               "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation",
        "BSD": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that "
               "the following\n * conditions are met:\n *\n * 1. Redistributions of source code",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
               "granted, provided that",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL",
        "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU "
                            "General Public License as published by\n    the Free Software Foundation, either version 3 of the "
                            "License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope",
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser "
                             "General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the "
                             "License, or (at your option) any later version.",
        "GPL-2.0-only": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General "
                        "Public License version 2 as\n# published by the Free Software Foundation.",
        "BSD-2-Clause": "/* SPDX-License-Identifier: BSD-2-Clause */\nint main() {}",
        "GPL-2.0-or-later": "# SPDX-License-Identifier: GPL-2.0+",
    }
    plain = "some words of a text that goes on " * 40 + "\n"
    df = spark.createDataFrame([(k, 0, p + v) for k, v in wrapped.items() for p in ("", plain)], "name string, doc_id long, text string")
    found = {k: [licenses.TEMPLATES[w[0]][0] if (w := licenses.Scanner().scan(licenses.candidate_blocks((p + v).encode())[0]))[0]
                 is not None else None for p in ("", plain)] for k, v in wrapped.items()}
    assert found == {k: [k, k] for k in wrapped}
    by_row = rows(licenses.scan_licenses(df.withColumn("doc_id", F.monotonically_increasing_id())))
    assert Counter(r["license"] for r in by_row) == {k: 2 for k in wrapped}
    # another license's notice is no difference of wording
    other = wrapped["GPL-3.0-or-later"].replace("GNU General", "GNU Foo General").replace("version 3", "version 7")
    assert licenses.Scanner().scan(licenses.candidate_blocks(other.encode())[0])[0] is None


def test_templates_against_their_own_text():
    scanner = licenses.Scanner()
    for name, _, body in licenses.TEMPLATES:
        (block,) = licenses.candidate_blocks(body.replace(", ", ",\n").encode())
        got = scanner.scan(block)
        assert got[0] is not None and licenses.TEMPLATES[got[0]][0] == name and got[2] == 0, body


def test_dual_licensed_blocks(spark):
    texts = {
        "Code is released under the MIT License. Licensed under CC BY 4.0.": "CC-BY-4.0,MIT",
        "Licensed under the Apache License, Version 2.0. All rights reserved.": "Apache-2.0,all-rights-reserved",
        "Released under the MIT License.\nLicensed under CC BY-SA 4.0.\nReleased under the MIT License.": "CC-BY-SA-4.0,MIT",
        "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT": "GPL-2.0-only,MIT",
        "Licensed under the MIT License. All rights, as it were, reserved.": "MIT",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(df))}
    assert [got[i]["licenses"] for i in range(len(texts))] == list(texts.values())
    assert all(r["n_blocks"] == 1 and r["license"] in r["licenses"].split(",") for r in got.values())


# --- op10 --------------------------------------------------------------------------

def test_mix(docs):
    got = rows(mixing.mixed_documents(docs))
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, rows(mixing.mixed_documents(docs.repartition(7)))))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    assert math.isclose(sum(s[2] for s in by.values()), sum(s[1] for s in by.values()))
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 4 * mixing.BLOCK_WORDS and target <= 3 * size + 1e-6


def test_mix_edges(messy, empty):
    got = rows(mixing.mixed_documents(messy))
    assert len(got) == len(MESSY) and all(r["taken"] <= 3 * r["size"] for r in got)
    caps = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert all(math.isclose(caps[s][0], 3 * caps[s][1]) for s in ("b", "c", None))
    assert math.isclose(sum(t for t, _ in caps.values()), sum(n for _, n in caps.values()))
    assert mixing.mixed_documents(empty).count() == 0
    assert {r["taken"] for r in rows(mixing.mixed_documents(messy.withColumn("text", F.lit(None).cast("string"))))} == {0}
