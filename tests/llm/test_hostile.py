"""Hostile and unusual input: equal checksums, broken markup, repeated notices."""

import random
import re
import time
import zlib

import pyarrow.parquet as pq
import pytest

from seqorbit.llm import extract, licenses, line_dedup, substring_dedup

PAGES = "/root/testdata/sf0.001/pages.parquet"
PARA = "<p>The river rose by two metres overnight, and the old bridge was closed to all but the post van.</p>"


def colliding_texts():
    """Two texts of different length and line count with one crc32."""
    rng, seen = random.Random(3), {}
    while True:
        n = rng.choice((25, 40))
        t = ("\n" * (n == 40)).join(f"w{rng.randrange(10**6)} " for _ in range(n))
        c = zlib.crc32(t.encode())
        if c in seen and len(seen[c]) != len(t):
            return seen[c], t
        seen[c] = t


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_with_one_id_and_checksum(spark, doc_id):
    a, b = colliding_texts()
    df = spark.createDataFrame([(doc_id, a), (doc_id, b), (8, b)], "doc_id long, text string")
    lines = sorted((r["doc_id"] or 0, r["n_lines"]) for r in line_dedup.dedup_lines(df).collect())
    assert [n for _, n in lines] in ([a.count("\n") + 1, b.count("\n") + 1, b.count("\n") + 1],
                                     [b.count("\n") + 1, a.count("\n") + 1, b.count("\n") + 1])
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(t.split()) for t in (a, b, b))
    assert {r["n_removed"] for r in got if r["doc_id"] == 8} == {len(b.split())}
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] == doc_id)


# --- pages -------------------------------------------------------------------------

#: A plain restatement of what a tag is; quadratic on hostile pages.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)(?![^\s/<>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)


def tags_of(page):
    tags, pos, out = extract._Tags(page), 0, []
    while found := tags.next(pos):
        out.append(found)
        pos = found[1]
    return out


def plain_tags(page):
    return [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or "") for m in TAG.finditer(page)]


def test_tags_match_plain_form():
    rng = random.Random(5)
    parts = ["<a ", "<div>", "</p>", "<!--", "-->", "<!x", ">", '"', "'", " x=", "text", "<", "/", "<b c='>'>", "<i"]
    pages = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]
    pages += pq.read_table(PAGES).column("html").to_pylist()
    for page in pages:
        assert tags_of(page or "") == plain_tags(page or ""), page


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "x", '<a "' * 250_001 + ">", "<a<" * 330_000,
                                  "<ul>" + "<div>" * 50_000 + "<li>x" * 50_000, "<script>" + "</script " * 100_000])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    extract.main_text(page)
    assert time.process_time() - start < 2


def test_sibling_articles_blocks_and_headings():
    long, short = PARA * 12, PARA.replace("river", "lake") * 8
    both = extract.main_text(f"<body><article>{long}</article><article>{short}</article></body>")
    assert both.count("river") == 12 and both.count("lake") == 8
    divs = extract.main_text(f"<body><div>{long}</div><div>{PARA.replace('river', 'lake') * 11}</div></body>")
    assert divs.count("river") == 12 and divs.count("lake") == 11
    head = extract.main_text(f"<body><h1>Flood</h1><div>{long}</div><h2>Elsewhere</h2><ul><li><a href=x>more news</a></ul></body>")
    assert head.startswith("Flood The river") and "Elsewhere" not in head and "more" not in head
    excerpts = "".join(f"<article><a href={i}>Other news {i}</a> <p>The lake</p></article>" for i in range(4))
    assert "lake" not in extract.main_text(f"<body><article>{long}</article>{excerpts}</body>")
    linked = f"<div><a href=x>{short}</a></div>"
    assert "lake" not in extract.main_text(f"<body><div>{long}</div>{linked}</body>")


# --- notices -----------------------------------------------------------------------

def plain_scan(scanner, block):
    """Confirmed templates by the ranking; every place of the block is compared anew after each find."""
    own = licenses.words(block)
    ranked = {i: w for i, *w in scanner.scan_all(block)[2]}
    order = sorted(range(len(scanner.templates)), key=lambda i: (-saving(scanner, own, i), i))
    out = []
    for i in order:
        template = scanner.templates[i][2]
        allowed, first = len(template) // licenses.WORDS_PER_DIFFERENCE, None
        cuts = [len(template) * k // (2 * allowed + 1) for k in range(2 * allowed + 2)]
        while True:
            best = None
            for x, y in zip(cuts[:-1], cuts[1:]):
                for at in range(len(own) - (y - x) + 1):
                    if own[at:at + y - x] == template[x:y]:
                        low = max(at - x - allowed, 0)
                        near = own[low:at + len(template) - x + allowed]
                        missing, foreign, (s, e) = scanner.differences(template, near)
                        if max(len(missing), len(foreign)) <= allowed and not any(map(licenses._tells, missing + foreign)):
                            got = (len(missing) + len(foreign), low + s, low + e)
                            best = got if best is None else min(best, got)
            if best is None:
                break
            first = first or best
            own[best[1]:best[2]] = [licenses.TAKEN] * (best[2] - best[1])
        if first:
            out.append((i, first[0]))
    assert set(ranked) == {i for i, _ in out}
    return out


def saving(scanner, own, i):
    data = " ".join(own if licenses.TAKEN not in own else []).encode()
    alone = len(scanner.plain.compress(data))
    return (alone - len(scanner.given[i].compress(data))) / alone


def test_notices_match_plain_form():
    rng, scanner = random.Random(11), licenses.Scanner()
    bodies = [b for _, _, b in licenses.TEMPLATES if not b.startswith("SPDX")]
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(bodies).split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w))
                w[k:k + rng.randint(0, 1)] = [rng.choice(("foo", "bar"))] * rng.randint(0, 1) or w[k:k + 1]
            text += w * rng.choice((1, 1, 2)) + ["between"] * rng.randint(0, 2)
        block = " ".join(text)
        assert [(i, d) for i, d, _ in scanner.scan_all(block)[2]] == plain_scan(scanner, block)


def test_many_notices_take_linear_time():
    scanner, start = licenses.Scanner(), time.process_time()
    won = scanner.scan_all("All rights reserved. " * 20_000)[2]
    assert won and time.process_time() - start < 5
