"""Removal of repeated word windows by locally consistent recompression.

Rounds of pair compression rename a document's words: a hash bit puts every symbol in
the left or the right half, and a left symbol followed by a right one becomes one
symbol named by a hash of both.  Names depend on content alone, so they are global
without a dictionary, and whether two neighbours merge depends on these two alone, so
equal substrings get equal symbols but for a few words at either end.  (Runs of an
equal symbol never merge: a run's name would depend on its whole length, which a
window inside the run does not see, and repeats would be lost.)

Every window of ``WINDOW`` words picks one symbol of its consistent interior, the
longest, then by hash.  Only windows whose symbol occurs twice can repeat; these are
named as a whole and compared, and all but the earliest of a name are repeats.

A task's own duplicates are settled before the shuffle, so a symbol or window sends
at most one row from each batch.  Names are 64-bit hashes.

Defined results: null or wordless text has nothing to remove; rows that repeat an id
and a text (by a 64-bit hash) are one document; rows that share an id but not the text compare by their
start; a null id comes before all ids; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, NULL_ID, Hasher, _powers, batches_of, binaries, mix64, signed, stage

WINDOW = 20
ROUNDS = 2
#: Words at either end of a window that two rounds may rename differently.
MARGIN = 3
_W = 0xD6E8FEB86659FD93
_W_INV = pow(_W, -1, 1 << 64)


def compress(sym: np.ndarray, pos: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """``(names, first words)`` of the symbols after pair rounds; no symbol spans two documents."""
    for r in range(rounds):
        right = (mix64(sym + np.uint64((r + 1) * 0x632BE59BD9B4E019 & MASK64)) >> np.uint64(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        first = np.flatnonzero(pair)
        sym = sym.copy()
        sym[first] = mix64(sym[first] * np.uint64(0x9E3779B97F4A7C15) + sym[first + 1] + np.uint64(r + 1))
        stay = np.ones(len(sym), bool)
        stay[first + 1] = False
        sym, pos, doc = sym[stay], pos[stay], doc[stay]
    return sym, pos


def anchors(h: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """``(symbol, document, first window, windows)``: runs of windows of a document that pick
    the same symbol.  ``at`` are the documents' offsets in the word hashes ``h``."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(h)
    if not n or sizes.max(initial=0) < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    sym, pos = compress(h, np.arange(n), doc)
    end = np.append(pos[1:], n)
    rank = (np.minimum(end - pos, 15).astype(np.uint64) << np.uint64(60)) | (mix64(sym) >> np.uint64(4))
    starts = np.zeros(n + 1, np.int64)
    starts[pos] = 1
    before = np.concatenate([[0], np.cumsum(starts)])  # symbols that begin before word i
    starts = np.flatnonzero(np.arange(n) + window <= at[1:][doc])  # windows that fit their document
    lo = before[starts + MARGIN]
    hi = before[starts + window - MARGIN] - (end[before[starts + window - MARGIN] - 1] > starts + window - MARGIN)
    best, width = [np.arange(len(sym))], 1
    while 2 * width <= min(window, len(sym)):
        b = best[-1]
        x, y = b[:len(b) - width], b[width:]
        best.append(np.where(rank[x] >= rank[y], x, y))
        width *= 2
    level = np.maximum(hi - lo, 1)
    level = np.frexp(level)[1] - 1
    pick = np.empty(len(starts), np.int64)
    for k in range(len(best)):
        at_k = np.flatnonzero(level == k)
        x = best[k][lo[at_k]]
        y = best[k][hi[at_k] - (1 << k)]
        pick[at_k] = np.where(rank[x] >= rank[y], x, y)
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
    length = np.diff(np.append(new, len(starts)))
    owner = doc[starts[new]]
    return sym[pick[new]], owner, starts[new] - at[owner], length


def window_names(h: np.ndarray, starts: np.ndarray, powers, window: int = WINDOW) -> np.ndarray:
    p, inv = powers
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:len(h)], out=total[1:])
    return mix64((total[starts + window] - total[starts]) * inv[starts])


def _settle(key: np.ndarray, order: np.ndarray):
    """Sorts rows by key and ``order`` and marks the first row of each key:
    ``(permutation, is first, key occurs again)``."""
    perm = np.lexsort((order, key))
    k = key[perm]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    again = np.concatenate([~new[1:], [False]])
    return perm, new, again


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, did, tag, start, n, state).  State 0: a symbol's only occurrence in the
    batch; 1: known to be shared (dealt by a key of its own); 2: stands for the latter."""
    hasher = Hasher()
    for b in batches:
        parts = []
        texts = binaries(b.column(2))
        for i, j in batches_of(texts):
            h, at, _, _ = hasher.words(texts[i:j], lower=False)
            s, d, first, n = anchors(h, at)
            parts.append((s, d + i, first, n))
        if not parts:
            continue
        s, d, first, n = (np.concatenate(x) for x in zip(*parts))
        if not len(s):
            continue
        perm, new, again = _settle(s, np.arange(len(s)))
        shared = ~new | again
        state = shared.astype(np.int8)
        rows = np.concatenate([perm, perm[new & again]])
        state = np.concatenate([state, np.full(int((new & again).sum()), 2, np.int8)])
        back = np.argsort(rows, kind="stable")  # text order: neighbours share their ids' bytes
        rows, state = rows[back], state[back]
        key = s[rows]
        spread = state == 1
        key[spread] = mix64(d[rows][spread].astype(np.uint64) * np.uint64(_W) + first[rows][spread].astype(np.uint64) + key[spread])
        take = pa.array(d[rows])
        yield pa.record_batch([pa.array(signed(key)), b.column(0).take(take), b.column(1).take(take),
                               pa.array(first[rows].astype(np.int32)), pa.array(n[rows].astype(np.int32)), pa.array(state)],
                              names=["key", "did", "tag", "start", "n", "state"])


def _cut_runs(batches, key: int = 0):
    from .minhash_dedup import _runs
    return _runs(batches, key)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of symbols that occur elsewhere too (rows sorted by key)."""
    for t, cuts in _cut_runs(batches):
        state = t.column(5).to_numpy()
        many = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        keep = pa.array(np.flatnonzero((state == 1) | (many & (state == 0))))
        yield pa.record_batch([t.column(i).combine_chunks().take(keep) for i in (1, 2, 3, 4)], names=["did", "tag", "start", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, did, start, tag, known) of candidate windows; ``known`` ones have an
    earlier equal window in the batch and are dealt by a key of their own."""
    hasher, powers, have = Hasher(), None, 0
    for b in batches:
        texts = binaries(b.column(2))
        ranges = b.column(3)
        keys, rows, at_all = [], [], []
        for i, j in batches_of(texts):
            h, at, _, _ = hasher.words(texts[i:j], lower=False)
            if len(h) + 1 > have:
                have = 1 << int(len(h) + 1).bit_length()
                powers = _powers(_W, have), _powers(_W_INV, have)
            starts, owner = [], []
            for d in range(i, j):
                for r in ranges[d].as_py():
                    starts.append(np.arange(r["start"], r["start"] + r["n"]) + at[d - i])
                    owner.append(np.full(r["n"], d))
            if not starts:
                continue
            starts, owner = np.concatenate(starts), np.concatenate(owner)
            keys.append(window_names(h, starts, powers))
            rows.append(owner)
            at_all.append(starts - at[owner - i])
        if not keys:
            continue
        key, row, start = np.concatenate(keys), np.concatenate(rows), np.concatenate(at_all)
        did = b.column(0).to_numpy()[row]
        perm = np.lexsort((start, did, key))
        key, row, start, did = key[perm], row[perm], start[perm], did[perm]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        known = (did != did[head]) | (start != start[head])
        out = key.copy()
        out[known] = mix64(key[known] + did[known].astype(np.uint64) * np.uint64(_W) + start[known].astype(np.uint64))
        back = np.argsort(perm, kind="stable")  # text order again
        out, row, start, did, known = out[back], row[back], start[back], did[back], known[back]
        yield pa.record_batch([pa.array(signed(out)), pa.array(did), pa.array(start.astype(np.int32)),
                               b.column(1).take(pa.array(row)), pa.array(known)],
                              names=["key", "did", "start", "tag", "known"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with an earlier equal one (rows sorted by key, did and start)."""
    for t, cuts in _cut_runs(batches):
        did, start, known = (t.column(i).to_numpy() for i in (1, 2, 4))
        fresh = np.flatnonzero(~known)
        key = t.column(0).to_numpy()[fresh]
        repeat = known.copy()
        if len(fresh):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            head = fresh[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            repeat[fresh] = (did[fresh] != did[head]) | (start[fresh] != start[head])
        keep = pa.array(np.flatnonzero(repeat))
        yield pa.record_batch([t.column(i).combine_chunks().take(keep) for i in (1, 3, 2)], names=["did", "tag", "start"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, texts = [], [], []
        for text, starts, copy in zip(binaries(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
            words = text.split() if text else []
            n_words.append(len(words))
            if copy and len(words) >= WINDOW:
                words = []
            elif starts:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(starts), 1)
                np.add.at(edge, np.array(starts) + WINDOW, -1)
                covered = np.cumsum(edge)[:-1] > 0
                words = [words[i] for i in np.flatnonzero(~covered)]
            n_removed.append(n_words[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                               pa.array(texts, pa.binary()).cast(pa.string()),
                               pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                              names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text and its sha256."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
                      F.xxhash64(text).alias("tag"), text.alias("text"))
    # whole copies: every window of a later copy repeats, so it takes no part below
    ids = stage(src.select("did", "tag", F.md5(F.col("text").cast("binary")).alias("m")).where("m IS NOT NULL"), "rep-ids")
    earliest = stage(ids.groupBy("m").agg(F.min("did").alias("first")), "rep-first")
    copies = stage(ids.join(earliest, "m").where("did > first").select("did", "tag").distinct(), "rep-copies")
    symbols = src.select("did", "tag", "text").mapInArrow(
        _symbols, "key long, did long, tag long, start int, n int, state byte")
    shared = symbols.repartition("key").sortWithinPartitions("key").mapInArrow(
        _shared, "did long, tag long, start int, n int")
    ranges = stage(shared.groupBy("did", "tag").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
                   .join(copies, ["did", "tag"], "left_anti"), "rep-ranges")
    once = src.select("did", "tag", "text").join(ranges, ["did", "tag"])
    windows = once.select("did", "tag", "text", "ranges").mapInArrow(
        _windows, "key long, did long, start int, tag long, known boolean")
    repeats = windows.repartition("key").sortWithinPartitions("key", "did", "start").mapInArrow(
        _repeats, "did long, tag long, start int")
    starts = repeats.groupBy("did", "tag").agg(F.collect_set("start").alias("starts"))
    marks = stage(starts.withColumn("copy", F.lit(False)).unionByName(
        copies.select("did", "tag", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))), "rep-marks")
    return src.join(marks, ["did", "tag"], "left").select("doc_id", "text", "starts", "copy").mapInArrow(
        _strip, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
