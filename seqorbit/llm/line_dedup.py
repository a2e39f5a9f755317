"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words.  A line goes if an earlier line (smaller
id, or same document and earlier line) has a Jaccard similarity of at least
``threshold``; this is judged on the input, so lines that go themselves count too.

Words are ordered by rarity: corpus counts of at most ``FREQUENT`` most frequent words
(broadcast, a fixed bound), all other words before them by hash.  Two similar lines
share a word among the first n - ceil(t n) + 1 of either, so only these prefix words
are posted; words that occur once in the corpus are left out by a Bloom filter of
fixed size.  Lines that share a posted word pass length, positional and parity sketch
filters; a sketch has 64 bits for each ``SKETCH_WORDS`` words of its line, up to
``SKETCH_MOST`` times 64.  Each line first verifies its ``FIRST`` earliest partners; only lines that had
more partners and are not yet decided verify all of them in a last round.
Verification is on the full word sets.

Equal sets are one line with an earliest place.  Posted frequent words are dealt by
bands of line length as well, so no word gathers all lines.

Defined results: null text stays null, lines without words are kept and match
nothing; a text whose lines all go becomes empty; rows that repeat an id and a text
(by a 64-bit hash) are one document; rows that share an id but not the text compare by line number; a
null id comes before all ids; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Hasher, Scratch, batches_of, binaries, mix64, signed, stage
from .minhash_dedup import _runs

FREQUENT = 65536
BLOOM_BITS = 1 << 26
#: 32-bit words of the Bloom filter that travel as one value.
BLOOM_CHUNK = 1 << 15
#: Hash shares of a class of equally frequent words.
SHARES = 64
FIRST = 3
TILE = 512
#: Groups of up to this many lines are filtered together with others of their size.
SMALL = 24
#: Words of a line for each 64 bits of its sketch; 64-bit words of the widest sketch (a power of two).
SKETCH_WORDS = 80
SKETCH_MOST = 8


def word_counts(src: DataFrame) -> DataFrame:
    """``(word, c)``: occurrences of each word hash in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            texts = binaries(b.column(0))
            h = [hasher.words(texts[i:j], lower=True)[0] for i, j in batches_of(texts)]
            word, c = np.unique(np.concatenate(h) if h else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(signed(word)), pa.array(c.astype(np.int64))], names=["word", "c"])

    return src.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of about the ``most`` largest counts, never more: whole count classes (16 to
    a doubling), and of the class at the cut as many of its ``SHARES`` hash shares as fit.
    A histogram of fixed size finds the cut, so no task and not the driver sorts words."""
    words = counts.withColumn("cls", F.floor(F.log2("c") * 16).cast("int")).withColumn(
        "share", F.pmod("word", F.lit(SHARES)).cast("int"))
    sizes = words.groupBy("cls", "share").agg(F.count("*").alias("n")).collect()  # at most 64 * 16 * SHARES rows
    cls, share, total = 1 << 30, 0, 0
    for r in sorted(sizes, key=lambda r: (-r["cls"], r["share"])):
        total += r["n"]
        if total > most:
            break
        cls, share = r["cls"], r["share"]
    return words.where((F.col("cls") > cls) | ((F.col("cls") == cls) & (F.col("share") <= share))).select("word", "c")


def _pack_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bloom words (chunk, i, x) as one binary value a chunk."""
    chunks: dict = {}
    for b in batches:
        chunk, i, x = (b.column(k).to_numpy() for k in range(3))
        for c in np.unique(chunk):
            at = chunk == c
            bits = chunks.setdefault(int(c), np.zeros(BLOOM_CHUNK, np.uint32))
            bits[i[at] % BLOOM_CHUNK] |= x[at].astype(np.uint32)
    if chunks:
        yield pa.record_batch([pa.array(list(chunks), pa.int32()), pa.array([v.tobytes() for v in chunks.values()], pa.binary())],
                              names=["chunk", "bits"])


def bloom_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the column ``word``."""
    at = F.pmod("word", F.lit(BLOOM_BITS))
    bits = keys.groupBy(F.floor(at / 32).cast("int").alias("i")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(word, {BLOOM_BITS}) % 32 as int))")).alias("x"))
    packed = bits.select(F.floor(F.col("i") / BLOOM_CHUNK).cast("int").alias("chunk"), "i", "x").repartition("chunk")
    bloom = np.zeros(BLOOM_BITS // 32, np.uint32)
    for r in packed.mapInArrow(_pack_bits, "chunk int, bits binary").collect():  # BLOOM_BITS in all
        bloom[r["chunk"] * BLOOM_CHUNK:(r["chunk"] + 1) * BLOOM_CHUNK] = np.frombuffer(r["bits"], np.uint32)
    return bloom


def in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
    return (bloom[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1


class Rarity:
    """Counts of the frequent words and a Bloom filter of the words that occur twice or more."""

    def __init__(self, counts: DataFrame):
        top = frequent_words(counts).collect()  # at most FREQUENT rows
        word = np.array([r[0] for r in top], np.int64).view(np.uint64)
        order = np.argsort(word)
        self.word = word[order]
        self.count = np.array([r[1] for r in top], np.int64)[order]
        self.bloom = bloom_of(counts.where("c > 1"))

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.word, h)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == h, self.count[at], 0)

    def repeats(self, h: np.ndarray) -> np.ndarray:
        return in_bloom(self.bloom, h)


def _sketches(h: np.ndarray, head: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sketches, ends)`` of lines of ``n`` word hashes from ``head`` on.  Bit k of a sketch of w
    64-bit words is the parity of the line's words with hash k modulo 64 w, so the sketches of
    two lines differ in no more bits than the lines in words; w is a power of two, and the
    halves of a sketch give by XOR the sketch of half the width."""
    width = np.ones(len(n), np.int64)
    while (more := (n >= SKETCH_WORDS * width) & (width < SKETCH_MOST)).any():
        width[more] *= 2
    ends = np.cumsum(width)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    for w in np.unique(width):
        mine = width == w
        x = h[np.repeat(mine, n)]
        begin = np.concatenate([[0], np.cumsum(n[mine])[:-1]])
        word, bit = (x >> np.uint64(6)) & np.uint64(w - 1), np.uint64(1) << (x & np.uint64(63))
        for j in range(w):
            out[ends[mine] - w + j] = np.bitwise_xor.reduceat(np.where(word == j, bit, np.uint64(0)), begin)
    return out, ends


def _folded(column) -> tuple[np.ndarray, dict]:
    """Of a column of sketches: their widths and, for every width, ``(places, sketches)`` of all
    sketches at least as wide, folded down to it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint64)
    start, width = (at[:-1] - at[0]) // 8, np.diff(at) // 8
    rows, m, out = np.zeros(0, np.int64), np.zeros((0, 2 * SKETCH_MOST), np.uint64), {}
    w = SKETCH_MOST
    while w:
        mine = np.flatnonzero(width == w)
        m = np.concatenate([m[:, :w] ^ m[:, w:], flat[start[mine, None] + np.arange(w)]])
        rows = np.concatenate([rows, mine])
        place = np.zeros(len(width), np.int64)
        place[rows] = np.arange(len(rows))
        out[w] = place, m
        w //= 2
    return width, out


def _line_sets(hasher: Hasher, texts: list, rarity: Rarity, threshold: float):
    """Lines with words of ``texts``: (text, line number, set key, size, sketches and their ends,
    posted words, those of them that are not frequent, the words and their positions)."""
    h, at, starts, _ = hasher.words(texts, lower=True)
    data = b"\n".join(b"" if t is None else t for t in texts) + b"\n"
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    sizes = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    first_line = np.searchsorted(breaks, begin)
    c = rarity.counts(h)
    perm = np.lexsort((h, (line << 32) | np.minimum(c, (1 << 32) - 1)))
    h, c, line = h[perm], c[perm], line[perm]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, c, line = h[new], c[new], line[new]
    if not len(h):
        return None
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(head, len(h)))
    key = mix64(np.add.reduceat(mix64(h + np.uint64(0x5851F42D4C957F2D)), head) + n.astype(np.uint64))
    sketch = _sketches(h, head, n)
    pos = np.arange(len(h)) - np.repeat(head, n)
    prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    post = (pos < np.repeat(prefix, n)) & rarity.repeats(h)
    posted, rare = (np.add.reduceat(x.astype(np.int64), head) for x in (post, post & (c == 0)))
    text = np.searchsorted(first_line, line[head], side="right") - 1
    return text, line[head] - first_line[text], key, n, sketch, posted, rare, h[post], pos[post]


_LINES = "lid long, did long, tag long, line int, n int, later boolean, rare int, sketch binary, word array<long>, pos array<int>"


def line_table(src: DataFrame, rarity, threshold: float) -> DataFrame:
    """One row per line with words.  ``later``: an equal set stands earlier in the same
    batch; only the others carry posted words, by position (the first ``rare`` are not frequent)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, r = Hasher(), rarity.value
        for b in batches:
            texts = binaries(b.column(2))
            for i, j in batches_of(texts):
                got = _line_sets(hasher, texts[i:j], r, threshold)
                if got is None:
                    continue
                text, line, key, n, (sketch, ends), posted, rare, word, pos = got
                ends = pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int32))
                did = b.column(0).to_numpy()[i:j][text]
                perm = np.lexsort((line, did, key))
                k, d, ln = key[perm], did[perm], line[perm]
                new = np.concatenate([[True], k[1:] != k[:-1]])
                head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                later = np.zeros(len(k), bool)
                later[perm] = (d != d[head]) | (ln != ln[head])
                keep = np.repeat(~later, posted)
                off = pa.array(np.concatenate([[0], np.cumsum(np.where(later, 0, posted))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x[keep])) for x in (signed(word), pos.astype(np.int32))]
                yield pa.record_batch([pa.array(signed(key)), pa.array(did), b.column(1).slice(i, j - i).take(pa.array(text)),
                                       pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(later),
                                       pa.array(rare.astype(np.int32)),
                                       pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(sketch)]), *lists],
                                      names=["lid", "did", "tag", "line", "n", "later", "rare", "sketch", "word", "pos"])

    return src.select("did", "tag", "text").mapInArrow(run, _LINES)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each lid (rows sorted by lid)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        lid = b.column(0).to_numpy()
        new = np.concatenate([[lid[0] != last], lid[1:] != lid[:-1]])
        last = lid[-1]
        yield b.take(pa.array(np.flatnonzero(new)))


def first_lines(heads: DataFrame) -> DataFrame:
    """The earliest line of each set."""
    cols = ["lid", "did", "line", "tag", "n", "rare", "sketch", "word", "pos"]
    kinds = dict(heads.dtypes)
    return heads.select(*cols).repartition("lid").sortWithinPartitions("lid", "did", "line", "tag").mapInArrow(
        _first_rows, ", ".join(f"{c} {kinds[c]}" for c in cols))


#: ``size`` holds the line number and, in its low half, the line's words; ``at`` the position and ``home``.
_POSTED = "key long, lid long, did long, size long, at long, sketch binary"


def postings(first: DataFrame, threshold: float, only=None) -> DataFrame:
    """One row for each posted word.  A frequent word's key holds a band of line lengths, and
    lines of the next band visit it (home false).  A column ``open`` of ``first`` passes through;
    ``only``, a broadcast Bloom filter, leaves out other keys."""
    extra = [c for c in first.columns if c == "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posted = np.diff(b.column(6).offsets.to_numpy())
            word, pos = (b.column(i).flatten().to_numpy() for i in (6, 7))
            n, rare = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            size = (b.column(2).to_numpy().astype(np.int64) << 32) | n
            row = np.repeat(np.arange(b.num_rows), posted)
            often = np.arange(len(row)) - np.repeat(np.cumsum(posted) - posted, posted) >= rare[row]
            band = np.floor(np.log(n) / math.log(1.0 / threshold)).astype(np.int64)[row]
            key, h = word.view(np.uint64).copy(), word.view(np.uint64)
            salt = (2 * band + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            visit = mix64(h[often] + (2 * band[often] - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key[often] = mix64(h[often] + salt[often])
            key = np.concatenate([key, visit])
            row = np.concatenate([row, row[often]])
            at = np.concatenate([2 * pos.astype(np.int64) + 1, 2 * pos[often].astype(np.int64)])
            back = np.argsort(row, kind="stable")
            if only is not None:
                back = back[in_bloom(only.value, key[back])]
            key, row, at = key[back], row[back], at[back]
            take = pa.array(row)
            yield pa.record_batch([pa.array(signed(key)), b.column(0).take(take), b.column(1).take(take), pa.array(size[row]),
                                   pa.array(at), b.column(5).take(take), *[c.take(take) for c in b.columns[8:]]],
                                  names=["key", "lid", "did", "size", "at", "sketch", *extra])

    return first.select("lid", "did", "line", "n", "rare", "sketch", "word", "pos", *extra).mapInArrow(
        run, _POSTED + "".join(f", {c} boolean" for c in extra))


class _Filter:
    """The columns of posted lines and the filters a pair (later, earlier) must pass."""

    def __init__(self, t: pa.Table, threshold: float):
        self.t = threshold
        self.lid, self.did, size, at = (t.column(i).to_numpy() for i in range(1, 5))
        self.line, self.n = size >> 32, size & 0xFFFFFFFF
        self.pos, self.home = at >> 1, at & 1 == 1
        self.width, self.sketches = _folded(t.column(5))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows x and y differ at the width of the narrower one."""
        width, out = np.minimum(self.width[x], self.width[y]), np.zeros(len(x), np.int64)
        for w, (place, m) in self.sketches.items():
            mine = np.flatnonzero(width == w)
            out[mine] = np.bitwise_count(m[place[x[mine]]] ^ m[place[y[mine]]]).sum(axis=1)
        return out

    def passed(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For row numbers that broadcast against each other."""
        n, pos, t = self.n, self.pos, self.t
        na, ne = n[a], n[e]
        need = np.ceil(t / (1 + t) * (na + ne) - 1e-9)
        ok = np.minimum(na, ne) >= t * np.maximum(na, ne) - 1e-9
        ok &= np.minimum(na - pos[a], ne - pos[e]) >= need
        ok &= (self.lid[a] != self.lid[e]) & (self.home[a] | self.home[e])
        ok &= (self.did[e] < self.did[a]) | ((self.did[e] == self.did[a]) & (self.line[e] < self.line[a]))
        at = np.nonzero(ok)
        x, y = np.broadcast_to(a, ok.shape)[at], np.broadcast_to(e, ok.shape)[at]
        ok[at] = n[x] + n[y] - self.apart(x, y) >= 2 * need[at]
        return ok


def _partners(threshold: float, keep: int | None):
    """Filtered pairs (later line, earlier line) of each key (rows sorted by key, did and line).

    With ``keep``, each line gets its ``keep`` earliest partners and ``more`` says that it
    had others; without, every partner of the rows whose ``open`` is true."""
    def run(batches):
        for t, cuts in _runs(batches, 0):
            f = _Filter(t, threshold)
            undecided = t.column(6).to_numpy() if keep is None else None
            later, earlier, more = [], [], []

            def found(ok, a, e, have):
                """Takes the passed pairs, given the partners each row of ``a`` already has."""
                if undecided is not None:
                    ok &= undecided[a]
                else:
                    nth = np.cumsum(ok, axis=-1) + have[..., None]
                    have = have + ok.sum(axis=-1)
                    ok = ok & (nth <= keep)
                at = np.nonzero(ok)
                x, y = np.broadcast_to(a, ok.shape)[at], np.broadcast_to(e, ok.shape)[at]
                later.append(f.lid[x])
                earlier.append(f.lid[y])
                more.append(np.zeros(len(x), bool))
                return have

            def others(rows):
                later.append(f.lid[rows])
                earlier.append(f.lid[rows])
                more.append(np.ones(len(rows), bool))

            size = np.diff(cuts)
            for g in np.unique(size[(size > 1) & (size <= SMALL)]):
                first = cuts[:-1][size == g]
                step = max(1, (1 << 20) // int(g * g))
                for i in range(0, len(first), step):
                    rows = first[i:i + step, None] + np.arange(g)
                    a, e = rows[:, :, None], rows[:, None, :]
                    have = found(f.passed(a, e), a, e, np.zeros(rows.shape, np.int64))
                    if keep is not None:
                        others(rows[have > keep])
            for x, y in zip(cuts[:-1][size > SMALL], cuts[1:][size > SMALL]):
                for s in range(x, y, TILE):
                    a = np.arange(s, min(s + TILE, y))
                    if undecided is not None:
                        a = a[undecided[a]]
                        if not len(a):
                            continue
                    have = np.zeros(len(a), np.int64)
                    for u in range(x, a[-1] + 1, TILE):
                        e = np.arange(u, min(u + TILE, a[-1] + 1))
                        have = found(f.passed(a[:, None], e[None, :]), a[:, None], e[None, :], have)
                    if keep is not None:
                        others(a[have > keep])
            if later:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (later, earlier, more)],
                                      names=["later", "earlier", "more"])
    return run


def _alike(threshold: float):
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = set(x.split()), set(y.split())
                common = len(x & y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["lid"])
    return run


def verified(own: Scratch, pairs: DataFrame, first: DataFrame, src: DataFrame, threshold: float, name: str) -> DataFrame:
    """``lid`` of lines with a verified earlier partner.  pairs: later, earlier."""
    lids = pairs.select(F.col("later").alias("lid")).union(pairs.select("earlier")).distinct()
    places = first.join(lids, "lid").groupBy("did", "tag").agg(F.collect_list(F.struct("line", "lid")).alias("want"))

    def fetch(batches):
        for b in batches:
            out_lid, out_set = [], []
            for text, want in zip(binaries(b.column(0)), b.column(1).to_pylist()):
                lines = text.split(b"\n")
                for w in want:
                    out_lid.append(w["lid"])
                    out_set.append(b" ".join(set(lines[w["line"]].lower().split())))
            yield pa.record_batch([pa.array(out_lid, pa.int64()), pa.array(out_set, pa.binary())], names=["lid", "words"])

    sets = src.select("did", "tag", "text").join(places, ["did", "tag"]).select("text", "want").mapInArrow(
        fetch, "lid long, words binary")
    # rows that repeat an id and a text give their lines twice
    sets = stage(sets.groupBy("lid").agg(F.first("words").alias("words")), f"line-sets{name}")
    both = (pairs.join(sets.select(F.col("lid").alias("later"), F.col("words").alias("x")), "later")
            .join(sets.select(F.col("lid").alias("earlier"), F.col("words").alias("y")), "earlier"))
    found = stage(both.select("later", "x", "y").mapInArrow(_alike(threshold), "lid long").distinct(), f"line-verified{name}")
    own.drop(sets)
    return found


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, total, removed = [], [], []
        for text, gone in zip(binaries(b.column(1)), b.column(2).to_pylist()):
            if text is None:
                texts.append(None)
                total.append(0)
                removed.append(0)
                continue
            lines = text.split(b"\n")
            gone = set(gone or ())
            total.append(len(lines))
            removed.append(len(gone))
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                               pa.array(texts, pa.binary()).cast(pa.string()),
                               pa.array([hashlib.sha256(x or b"").hexdigest() for x in texts], pa.string()), *b.columns[3:]],
                              names=["doc_id", "n_lines", "n_removed", "kept_text", "kept_sha256", *b.schema.names[3:]])


def _gone(own: Scratch, src: DataFrame, threshold: float) -> DataFrame:
    """``(did, tag, gone)``: the numbers of the lines that go, by document."""
    spark = src.sparkSession
    counts = stage(word_counts(src), "line-counts")
    rarity = spark.sparkContext.broadcast(Rarity(counts))
    own.drop(counts)
    lines = stage(line_table(src, rarity, threshold), "line-table")
    first = stage(first_lines(lines.where("NOT later")), "line-first")
    # the posted words are read from ``first`` from now on
    places = stage(lines.select("lid", "did", "tag", "line", "later"), "line-places")
    own.drop(lines)
    holders = first.where(F.size("word") > 0)
    pair_type = "later long, earlier long, more boolean"

    def partners(posted: DataFrame, keep: int | None) -> DataFrame:
        return posted.repartition("key").sortWithinPartitions("key", "did", "size").mapInArrow(_partners(threshold, keep), pair_type)

    met = partners(postings(holders, threshold), FIRST).groupBy("later", "earlier", "more")
    found = stage(met.agg(F.count("*").alias("words")), "line-pairs")
    pairs = found.where("NOT more")
    # one partner settles a line: first the one that shares the most posted words
    best = stage(pairs.groupBy("later").agg(F.max(F.struct("words", "earlier")).alias("b")).select("later", "b.earlier"), "line-best")
    matched = verified(own, best, first, src, threshold, "0")
    others = pairs.select("later", "earlier").join(matched.withColumnRenamed("lid", "later"), "later", "left_anti").join(
        best, ["later", "earlier"], "left_anti")
    matched = matched.union(verified(own, stage(others, "line-others"), first, src, threshold, "1"))
    rest = stage(found.where("more").select(F.col("later").alias("lid")).distinct()
                 .join(matched, "lid", "left_anti"), "line-open")
    if not rest.isEmpty():
        # only keys of open lines are posted again
        keys = postings(holders.join(rest, "lid", "left_semi"), threshold).select(F.col("key").alias("word"))
        wanted = spark.sparkContext.broadcast(bloom_of(keys))
        marked = holders.join(rest.withColumn("open", F.lit(True)), "lid", "left").withColumn("open", F.col("open").isNotNull())
        again = postings(marked, threshold, wanted)
        all_pairs = stage(partners(again, None).select("later", "earlier").distinct()
                          .join(found.where("NOT more"), ["later", "earlier"], "left_anti"), "line-pairs2")
        matched = matched.union(verified(own, all_pairs, first, src, threshold, "2"))
    decided = stage(first.select("lid", F.col("did").alias("fd"), F.col("line").alias("fl"))
                    .join(matched.withColumn("hit", F.lit(True)), "lid", "left"), "line-decided")
    late = (F.col("did") > F.col("fd")) | ((F.col("did") == F.col("fd")) & (F.col("line") > F.col("fl")))
    gone = places.where("NOT later").join(decided, "lid").where(F.col("hit").isNotNull() | late)
    gone = gone.select("did", "tag", "line").union(places.where("later").select("did", "tag", "line"))
    return stage(gone.groupBy("did", "tag").agg(F.collect_set("line").alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = 0.8,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text, kept_sha256 and ``extra``."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
                      F.xxhash64(text).alias("tag"), text.alias("text"),
                      *[F.col(c).alias(f"x_{c}") for c in extra])
    with Scratch() as own:
        gone = own.keep(_gone(own, src, threshold))
    kinds = dict(src.dtypes)
    out = src.join(gone, ["did", "tag"], "left").select("doc_id", "text", "gone", *[f"x_{c}" for c in extra])
    return out.mapInArrow(_rebuild, "doc_id long, n_lines long, n_removed long, kept_text string, kept_sha256 string"
                          + "".join(f", `x_{c}` {kinds[f'x_{c}']}" for c in extra))
