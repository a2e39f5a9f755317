"""Hidden Markov language model over words.

Tokens are lower-cased words and one end token per text.  A state emits words: every
training word has expected counts of its own in every state.  Each of the ``N_OWN`` most
frequent words is a class; the others, and unseen ones, share ``N_BUCKETS`` classes by a hash
of their last three bytes, and a word's chance in its class is the mean of that by its own
counts in the state and that by its corpus count.
States, transitions and emissions are trained with Baum-Welch: every pass reads all
training texts, tasks return expected counts by word and state, Spark adds them up.  A
text's probability is the scaled forward product.

The ``N_CLASSES`` most frequent words are broadcast with their counts and emissions, a
fixed size.  All rarer words grow with the corpus: texts stand in blocks of about
``BLOCK_TOKENS`` tokens, each with its own rare words by a 128-bit hash.  Once, these are
dealt out by hash (in ``parts``, enough for ``PART_WORDS`` postings each), numbered and
counted; then every pass deals out a posting for each rare word of a block (its number, its
training tokens there and the shares of the states in them as 16-bit fractions), adds
them up and joins the shares over the whole corpus back to the blocks.  A rare word has at most
1/N_CLASSES of all tokens and one posting a block, so none is hot, and a task holds one
part at a time.

Defined results: null or wordless text is the end token alone; a null id counts as
not held out and trains; repeated rows count and score one by one; without any
training text every token has the probability of an unseen one; other columns are
ignored."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, stage

STATES = 8
PASSES = 4
N_CLASSES = 65536
N_OWN = 8192
N_BUCKETS = 1024
SUFFIX = 3
N_FREQUENT = 65536  # at most so many words reach the driver
BLOCK_TOKENS = 1 << 20
PART_WORDS = 1 << 20
LEAST_PARTS = 64
END = b""  # no word is empty
PRIOR = 100.0
TINY = 1e-6
CELLS = 1 << 20
FLUSH_WORDS = 1_000_000
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])  # a word's 128-bit hash
SLICE = 1024  # rows of the fixed part that travel as one value
FULL = 65535  # a share of one as a 16-bit fraction


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in binaries(b.column(0)):
            seen.update(t.lower().split() if t else ())
            seen[END] += 1
            if len(seen) > FLUSH_WORDS:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _bucket(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % N_BUCKETS


class Classes:
    """The frequent words with their counts and base probabilities, and the classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], bucket_sums: dict[int, tuple[int, int]], n: int, v: int):
        self.size = len(frequent)
        self.n_own = min(N_OWN, self.size)
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.c = np.array([x for _, x in frequent], float)
        self.norm = n + 0.5 * (v + 1)
        self.base = np.log10(self.c + 0.5) - np.log10(self.norm)
        self.buckets = np.array([_bucket(w) for w, _ in frequent[self.n_own:]], np.int64)
        self.bucket_count, kinds = np.zeros(N_BUCKETS), np.zeros(N_BUCKETS)
        for k, (total, words) in bucket_sums.items():
            self.bucket_count[k], kinds[k] = total, words
        self.bucket_norm = self.bucket_count + 0.5 * (kinds + 1)
        unigram = np.concatenate([self.c[:self.n_own], self.bucket_count]) + 0.5
        self.unigram = unigram / unigram.sum()

    def encode(self, text: bytes | None, rare: dict[bytes, int]):
        """The row of each token: a frequent word's, or behind them its place in ``rare``,
        which takes in new words."""
        words = text.lower().split() if text else []
        words.append(END)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        at[new] = [self.size + rare.setdefault(words[i], len(rare)) for i in new.tolist()]
        return at.astype(np.uint32)


class Model:
    """``emit`` of the frequent words and, for the words of the buckets, the chances and the
    expected counts of the buckets."""

    def __init__(self, start, move, emit, buckets=None, counts=None):
        self.start, self.move, self.emit, self.buckets, self.counts = start, move, emit, buckets, counts

    @classmethod
    def of(cls, start, move, classes, words, counts, known: Classes):
        own = classes[:known.n_own]
        m = cls(start, move, own, classes[known.n_own:], counts)
        m.emit = np.concatenate([own, m.emissions(words, known.c[known.n_own:], known.buckets, known)])
        return m

    @classmethod
    def initial(cls, known: Classes, states: int):
        """Sticky states whose emissions are the unigram tilted by a fixed random factor."""
        tilt = 0.5 + np.random.default_rng(5).random((len(known.unigram), states))
        emit = known.unigram[:, None] * tilt
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls.of(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0),
                      np.zeros((known.size - known.n_own, states)), np.zeros((N_BUCKETS, states)), known)

    @classmethod
    def from_counts(cls, start, move, words, rare_buckets, known: Classes):
        """From the counts of the frequent words and, by bucket, of all rarer ones."""
        counts = rare_buckets.copy()
        np.add.at(counts, known.buckets, words[known.n_own:])
        emit = np.concatenate([words[:known.n_own], counts]) + PRIOR * known.unigram[:, None]
        move, start = move + 1.0, start + 1.0
        return cls.of(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0),
                      words[known.n_own:], counts, known)

    def emissions(self, words, c, buckets, known: Classes) -> np.ndarray:
        """Emissions of words of the buckets.  By its own counts, a word gets half a token more,
        dealt to the states like its bucket, so an unseen word's two chances are equal; over a
        bucket's training words and one unseen word both sum to one."""
        norm = known.bucket_norm[buckets, None]
        plain = (c[:, None] + 0.5) / norm
        each = self.counts[buckets] / np.maximum(known.bucket_count[buckets, None], 1.0)
        own = (words + 0.5 * each + TINY * plain) / (each * norm + TINY)
        return self.buckets[buckets] * (0.5 * own + 0.5 * plain)

    def beside(self, rare: np.ndarray):
        """The model of a block: with the emissions of its rare words behind the others."""
        return Model(self.start, self.move, np.concatenate([self.emit, rare]))

    def relative(self):
        """In single precision, every word's emissions relative to its greatest: the same expected
        counts (a word's factor cancels), likelihoods of no meaning."""
        emit = self.emit / self.emit.max(axis=1, keepdims=True)
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, emit)))


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of similar length together, longest first, about CELLS tokens a group."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = int(max(1, min(1024, CELLS // max(int(lengths[order[i]]), 1))))
        yield order[i:i + n]
        i += n


def forward(model: Model, seqs: list[np.ndarray], keep: bool = False):
    """Scaled forward recursion of sequences sorted by falling length:
    ``(log10 likelihoods, tokens, running widths, alphas, scales, emissions)``; alphas and
    emissions of all tokens only if ``keep``."""
    lengths = np.array([len(s) for s in seqs])
    width = len(seqs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    tokens = np.zeros((lengths[0], len(seqs)), np.uint32)
    for i, s in enumerate(seqs):
        tokens[:len(s), i] = s
    logs = np.zeros(len(seqs))
    shape = (lengths[0], len(seqs), len(model.start))
    alphas, emitted = (np.zeros(shape, model.emit.dtype) if keep else None for _ in range(2))
    scales = np.ones((lengths[0], len(seqs)), model.emit.dtype)
    alpha = None
    for t in range(lengths[0]):
        n = width[t]
        alpha = model.start if alpha is None else alpha[:n] @ model.move
        if keep:  # every token's class is a row of emit: nothing is clipped
            now = model.emit.take(tokens[t, :n], axis=0, out=emitted[t, :n], mode="clip")
            alpha = np.multiply(alpha, now, out=alphas[t, :n])
        else:
            alpha = alpha * model.emit[tokens[t, :n]]
        c = alpha.sum(axis=1)
        alpha /= c[:, None]
        scales[t, :n] = c
    logs = np.log10(scales).sum(axis=0)
    return logs, tokens, width, alphas, scales, emitted


def expected_counts(model: Model, seqs: list[np.ndarray], emit, move, start) -> None:
    """Adds the expected counts of the sequences (sorted by falling length)."""
    # emissions become emission * beta / scale of each later token
    _, tokens, width, gamma, scales, weight = forward(model, seqs, keep=True)
    steps, states = len(width), len(model.start)
    weight /= scales[:, :, None]
    beta = np.ones((len(seqs), states), weight.dtype)
    back = model.move.T
    for t in range(steps - 1, 0, -1):
        n = width[t]
        w = weight[t, :n]
        w *= beta[:n]
        np.matmul(w, back, out=beta[:n])
    # gamma of token t is alpha_t * beta_t, and beta_t = weight_{t+1} @ move'
    later = weight[1:].reshape(-1, states)
    move += model.move * (gamma[:-1].reshape(-1, states).T @ later)
    beta_all = (later @ back).reshape(steps - 1, len(seqs), states)
    beta_all[np.arange(len(seqs))[None, :] >= width[1:, None]] = 1.0
    gamma[:-1] *= beta_all
    start += gamma[0].sum(axis=0)
    real = np.arange(len(seqs))[None, :] < width[:, None]
    flat, by_state = tokens[real], gamma[real].T.astype(float, order="C")
    for k in range(states):
        emit[:, k] += np.bincount(flat, weights=by_state[k], minlength=len(emit))


def _split(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(part, places)`` of the words of each part; -1 stands for none."""
    order = np.argsort(part, kind="stable")
    kinds, first = np.unique(part[order], return_index=True)
    return [(int(p), at) for p, at in zip(kinds, np.split(order, first[1:])) if p >= 0]


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys["a"] % np.uint64(parts)).astype(np.int32)


def _packed(rows: np.ndarray) -> bytes:
    """Numbers of rows in three bytes each, all low halves before the third bytes; in four if they need it."""
    if len(rows) and int(rows.max()) >= 1 << 24:
        return rows.astype(np.uint32).tobytes()
    return rows.astype(np.uint16).tobytes() + (rows >> 16).astype(np.uint8).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 4 * n:
        return np.frombuffer(raw, np.uint32)
    return np.frombuffer(raw, np.uint16, n) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32) << np.uint32(16)


class Block:
    """Row i of the blocks: the texts as sequences and, of its rare words, bucket, corpus count
    ``c``, training tokens in the block ``n``, part and number in the part."""

    def __init__(self, b, i: int):
        col = lambda name, kind: np.frombuffer(b.column(name)[i].as_py() or b"", kind)
        self.id, self.held = b.column("block")[i].as_py(), col("held", bool)
        ends = np.cumsum(col("lengths", np.int64))
        self.seqs = np.split(_unpacked(b.column("cls")[i].as_py(), int(ends[-1])), ends[:-1])
        self.buckets, self.c, self.n = col("buckets", np.int16), col("c", np.int64), col("n", np.int32)
        self.number, self.split = col("number", np.int32), _split(col("part", np.int32))
        self.sums = (b.column("sums")[i].as_py() or ()) if "sums" in b.schema.names else ()

    def model(self, known: Classes, model: Model) -> Model:
        counts = np.zeros((len(self.c), len(model.start)))
        places = dict(self.split)
        for x in self.sums:
            at = places[x["part"]]
            share = np.frombuffer(x["e"], np.uint16).reshape(len(at), -1).astype(float)
            counts[at] = share * (self.c[at] / np.maximum(share.sum(axis=1), 1.0))[:, None]
        return model.beside(model.emissions(counts, self.c, self.buckets, known))

    def postings(self, emit: np.ndarray):
        """``(part, block, number, n, e)`` columns of the block's expected counts by rare word."""
        e = np.rint(emit / np.maximum(self.n, 1)[:, None] * FULL).clip(0, FULL).astype(np.uint16)
        return [pa.array([p for p, _ in self.split], pa.int32()), pa.array([self.id] * len(self.split), pa.int64()),
                *[pa.array([x[at].tobytes() for _, at in self.split], pa.binary()) for x in (self.number, self.n, e)]]


def _with_sums(blocks: DataFrame, sums: DataFrame | None) -> DataFrame:
    """Every block with the state shares of its rare words; none before the first pass."""
    if sums is None:
        return blocks
    return blocks.join(sums.groupBy("block").agg(F.collect_list(F.struct("part", "e")).alias("sums")), "block", "left")


def _by_part(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(columns)`` of every part's rows (part, block, ...), one part in memory at a time:
    its binary columns come as lists, it returns the binary columns of the answer."""
    names = [x.split()[0] for x in schema.split(", ")]

    def answer(rows):
        part, block, *cols = zip(*rows)
        out = each(*cols)
        for i in range(0, len(out[0]), 512):
            j = slice(i, i + 512)
            n = len(out[0][j])
            yield pa.record_batch([pa.array(part[j][:n], pa.int32()), pa.array(block[j][:n], pa.int64()),
                                   *[pa.array(x[j], pa.binary()) for x in out]], names=names)

    def run(batches):
        rows = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if rows and rows[-1][0] != row[0]:
                    yield from answer(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from answer(rows)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _cut(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])]


def _number(keys: list[bytes], n: list[bytes]):
    """Numbers a part's words and counts their training tokens over all blocks."""
    all_keys = np.frombuffer(b"".join(keys), KEY)
    order = np.lexsort((all_keys["b"], all_keys["a"]))
    new, at = np.diff(all_keys["a"][order]) != 0, np.zeros(len(order), np.int64)
    at[order[1:]] = np.cumsum(new | (np.diff(all_keys["b"][order]) != 0))
    c = np.bincount(at, weights=np.frombuffer(b"".join(n), np.int32)).astype(np.int64)
    sizes = [len(x) // KEY.itemsize for x in keys]
    return _cut(at.astype(np.int32), sizes), _cut(c[at], sizes)


def _add_slices(e: list[bytes]):
    """One row for all of a slice's: their sum."""
    total = np.zeros(len(e[0]) // 4)
    for x in e:
        total += np.frombuffer(x, np.float32)
    return [[total.tobytes()]]


def _add_up(number: list[bytes], n: list[bytes], e: list[bytes]):
    """Every block's words get the shares of the states in their tokens of all blocks."""
    at, tokens = np.frombuffer(b"".join(number), np.int32), np.frombuffer(b"".join(n), np.int32)
    e = np.frombuffer(b"".join(e), np.uint16).reshape(len(at), -1)
    sums = np.stack([np.bincount(at, weights=tokens * e[:, k].astype(float)) for k in range(e.shape[1])], axis=1)
    share = np.rint(sums / np.maximum(sums.sum(axis=1), 1.0)[:, None] * FULL).astype(np.uint16)
    return [_cut(share[at], [len(x) // 4 for x in number])]


def _drop(table: DataFrame | None) -> None:
    """Frees a stage table of a pass that the next one has replaced."""
    for f in (table.inputFiles()[:1] if table is not None else ()):
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if path.getName().startswith("stage-llm-hmm-pass"):
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _pass(blocks: DataFrame, sums: DataFrame | None, known, model: Model, states: int) -> tuple:
    """One E-step over all training rows: ``(start, move, frequent words, buckets)`` counts by
    state and the table of the rare words' shares of states, added up by Spark."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    size = len(model.emit)

    names = ["part", "block", "number", "n", "e"]

    def run(batches):
        m = shared.value
        all_rows, some = np.zeros((size + states + 1 + N_BUCKETS, states)), False
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i)
                seqs = [s for s, h in zip(x.seqs, x.held) if not h]
                emit = np.zeros((size + len(x.c), states))
                if seqs:
                    some, own = True, x.model(known.value, m).relative()
                    for g in groups(np.array([len(s) for s in seqs], np.int64)):
                        expected_counts(own, [seqs[j] for j in g], emit, all_rows[size:size + states], all_rows[size + states])
                all_rows[:size] += emit[:size]
                np.add.at(all_rows[size + states + 1:], x.buckets, emit[size:])
                yield pa.record_batch(x.postings(emit[size:]), names=names)
        if some:  # the fixed rows: slice j as part -1 - j
            slices = [x.astype(np.float32).tobytes() for x in np.split(all_rows, range(SLICE, len(all_rows), SLICE))]
            n = len(slices)
            yield pa.record_batch([pa.array(range(-1, -1 - n, -1), pa.int32()), pa.array([0] * n, pa.int64()),
                                   pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(slices, pa.binary())], names=names)

    counted = stage(_with_sums(blocks, sums).mapInArrow(run, "part int, block long, number binary, n binary, e binary"),
                    "hmm-pass-counts")
    _drop(sums)
    fixed = _by_part(counted.where("part < 0").select("part", "block", "e"), _add_slices, "part int, block long, e binary")
    all_rows = np.zeros((size + states + 1 + N_BUCKETS, states))
    for part, _, e in fixed.collect():  # one value per frequent word, bucket and state: a fixed bound
        at = (-1 - part) * SLICE
        all_rows[at:at + SLICE] = np.frombuffer(e).reshape(-1, states)
    added = stage(_by_part(counted.where("part >= 0"), _add_up, "part int, block long, e binary"), "hmm-pass-sums")
    _drop(counted)
    return all_rows[size + states], all_rows[size:size + states], all_rows[:size], all_rows[size + states + 1:], added


def _blocks(src: DataFrame, known) -> DataFrame:
    """Texts in blocks: block, doc_ids, held, lengths and cls of the texts and, of the block's rare
    words, buckets, n, c, part and number (part -1 for one that no training text has)."""
    kind = dict(src.dtypes)["doc_id"]

    def encode(batches):
        names = ["block", "doc_ids", "held", "lengths", "cls", "buckets", "n", "keys"]
        rare, seqs, held, doc_ids, first = {}, [], [], [], None

        def out():
            ids = pa.chunked_array(doc_ids).combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            cls, lengths = np.concatenate(seqs), np.array([len(x) for x in seqs], np.int64)
            trains = cls[~np.repeat(np.array(held, bool), lengths)]
            size = known.value.size
            n = np.bincount(trains[trains >= size] - size, minlength=len(rare)).astype(np.int32)
            one = [x.tobytes() for x in (np.array(held, bool), lengths, np.array([_bucket(w) for w in rare], np.int16), n)]
            one.insert(2, _packed(cls))
            keys = b"".join(map(xxhash.xxh3_128_digest, rare))
            return pa.record_batch([pa.array([first], pa.int64()), ids, *[pa.array([x], pa.binary()) for x in one],
                                    pa.array([keys], pa.binary())], names=names)

        size = 0
        for b in batches:
            start = 0
            for i, (rid, h, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), binaries(b.column(3)))):
                first = rid if first is None else first
                seqs.append(known.value.encode(t, rare))
                held.append(h)
                size += len(seqs[-1])
                if size >= BLOCK_TOKENS:
                    doc_ids.append(b.column(1).slice(start, i + 1 - start))
                    yield out()
                    rare, seqs, held, doc_ids, first, size, start = {}, [], [], [], None, 0, i + 1
            if start < b.num_rows:
                doc_ids.append(b.column(1).slice(start))
        if seqs:
            yield out()

    rid = src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    texts = f"block long, doc_ids array<{kind}>, held binary, lengths binary, cls binary, buckets binary, n binary, "
    encoded = stage(rid.mapInArrow(encode, texts + "keys binary"), "hmm-pass-encoded")
    postings = encoded.agg(F.sum(F.length("keys") / KEY.itemsize)).first()[0] or 0
    parts = max(LEAST_PARTS, int(-(-postings // PART_WORDS)))

    def deal(batches):
        for b in batches:
            for block, n, keys in zip(*(c.to_pylist() for c in b.columns)):
                keys, n = np.frombuffer(keys, KEY), np.frombuffer(n, np.int32)
                split = _split(_parts_of(keys, parts))
                yield pa.record_batch([pa.array([p for p, _ in split], pa.int32()), pa.array([block] * len(split), pa.int64()),
                                       *[pa.array([x[at].tobytes() for _, at in split], pa.binary()) for x in (keys, n)]],
                                      names=["part", "block", "keys", "n"])

    def gather(batches):
        for b in batches:
            found = {"c": [], "part": [], "number": []}
            for keys, numbers in zip(b.column("keys").to_pylist(), b.column("numbers").to_pylist()):
                part = _parts_of(np.frombuffer(keys, KEY), parts)
                c, number = np.zeros(len(part), np.int64), np.zeros(len(part), np.int32)
                places = dict(_split(part))
                for x in numbers or ():
                    at = places[x["part"]]
                    c[at], number[at] = np.frombuffer(x["c"], np.int64), np.frombuffer(x["number"], np.int32)
                for k, x in (("c", c), ("part", np.where(c > 0, part, -1).astype(np.int32)), ("number", number)):
                    found[k].append(x.tobytes())
            kept = [x for x in b.schema.names if x not in ("keys", "numbers")]
            yield pa.record_batch([*[b.column(x) for x in kept], *[pa.array(x, pa.binary()) for x in found.values()]],
                                  names=[*kept, *found])

    dealt = encoded.select("block", "n", "keys").mapInArrow(deal, "part int, block long, keys binary, n binary")
    numbers = _by_part(dealt, _number, "part int, block long, number binary, c binary")
    numbers = numbers.groupBy("block").agg(F.collect_list(F.struct("part", "number", "c")).alias("numbers"))
    blocks = stage(encoded.join(numbers, "block", "left").mapInArrow(gather, texts + "c binary, part binary, number binary"),
                   "hmm-blocks")
    _drop(encoded)
    return blocks


def score_texts(docs: DataFrame, held_out, id_col="doc_id", text_col="text", states: int = STATES,
                passes: int = PASSES) -> DataFrame:
    """Trains on the rows that are not ``held_out`` and scores every row: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    counts = stage(src.where("NOT held_out").select("text").mapInArrow(_count_words, "word binary, c long")
                   .groupBy("word").agg(F.sum("c").alias("c")), "hmm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(min(N_FREQUENT, N_CLASSES)).select("word", "c")
    frequent = [(bytes(r[0]), r[1]) for r in top.collect()]
    shared = counts.where(F.lit(False))
    if len(frequent) > min(N_OWN, N_CLASSES) or v > len(frequent):
        w, c = frequent[min(N_OWN, len(frequent)) - 1]
        shared = counts.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(bytearray(w)))))
    bucket = F.pmod(F.crc32(F.substring("word", -SUFFIX, SUFFIX)), F.lit(N_BUCKETS))
    classes = Classes(frequent, {r[0]: (r[1], r[2]) for r in shared.groupBy(bucket.alias("k"))
                                 .agg(F.sum("c"), F.count("*")).collect()}, n, v)
    known = spark.sparkContext.broadcast(classes)
    blocks = _blocks(src, known)
    model, sums = Model.initial(classes, states), None
    for _ in range(passes):
        start, move, emit, buckets, sums = _pass(blocks, sums, known, model, states)
        model = Model.from_counts(start, move, emit, buckets, classes)
    trained = spark.sparkContext.broadcast(model)
    kind = dict(src.dtypes)["doc_id"]

    def likelihood(batches):
        k = known.value
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i)
                seqs, c, m = x.seqs, x.c, x.model(k, trained.value)
                logs = np.zeros(len(seqs))
                for g in groups(np.array([len(s) for s in seqs], np.int64)):
                    logs[g] = forward(m, [seqs[j] for j in g])[0]
                base = np.concatenate([k.base, np.log10(c + 0.5) - np.log10(k.norm)])
                seen = np.concatenate([np.ones(k.size, bool), c > 0])
                yield pa.record_batch([
                    b.column("doc_ids")[i].values, pa.array(x.held),
                    pa.array([len(s) for s in seqs], pa.int64()), pa.array([int(seen[s].sum()) for s in seqs], pa.int64()),
                    pa.array([float(base[s].sum()) for s in seqs], pa.float64()), pa.array(logs)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = _with_sums(blocks, sums).mapInArrow(
        likelihood, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
                         "base_score", "score")
