"""Benchmark decontamination by hashed n-gram look-up.

Item texts become windows of ``n`` normalised words (a shorter item is one
window).  If their measured number is within ``max_broadcast_windows``, they are
broadcast as a hash set: every document's word windows are hashed and probed, and
hits are confirmed word by word.  Beyond that bound the window texts of documents
and items meet in a shuffle join instead; nothing is broadcast.

Defined results: null or wordless text has no words, no hits; null or wordless
items have no window; a null item id counts as the empty string; items that share
an id are one item; documents that share an id and a text get the same result;
an empty benchmark hits nothing; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, mix64, stage

N = 10
MAX_BROADCAST_WINDOWS = 500_000
#: Word bytes are 0-9, a-z and everything from 0x80; A-Z are lower-cased.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def normal_words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_TABLE).split()


def item_windows(benchmark: DataFrame, item_col="item_id", text_col="text", n: int = N) -> DataFrame:
    """``(item, window, len)``: distinct windows of each item, words joined by a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, windows, sizes = [], [], []
            for item, text in zip(b.column(0).to_pylist(), binaries(b.column(1))):
                words = normal_words(text)
                k = min(n, len(words))
                for w in {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} if k else ():
                    items.append(item)
                    windows.append(w.decode("utf-8", "replace"))
                    sizes.append(k)
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(windows, pa.string()),
                                   pa.array(sizes, pa.int32())], names=["item", "window", "len"])

    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                           F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "item string, window string, len int").distinct()


class WindowSet:
    """The broadcast form: word ids, hashed windows by length, items of each window."""

    def __init__(self, rows):
        self.vocab: dict[bytes, int] = {}
        self.items: dict[tuple, list[str]] = {}
        for item, window, _ in rows:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in window.encode().split(b" "))
            self.items.setdefault(ids, []).append(item)
        by_len: dict[int, list] = {}
        for ids in self.items:
            by_len.setdefault(len(ids), []).append(ids)
        self.hashes = {k: np.unique(self._hash(np.array(v, np.int64), k)[:, 0]) for k, v in by_len.items()}

    @staticmethod
    def _hash(ids: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` ids along the last axis."""
        x = mix64(ids.astype(np.uint64) + np.uint64(1))
        m = x.shape[-1] - k + 1
        h = np.zeros((*x.shape[:-1], m), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[..., j:j + m]
        return mix64(h)

    def hits(self, words: list[bytes]):
        """``(hit mask or None, items)`` of one document's words."""
        ids = np.fromiter((self.vocab.get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        mask, found = None, set()
        for k, hashes in self.hashes.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            h = self._hash(ids, k)[at]
            pos = np.searchsorted(hashes, h)
            pos[pos == len(hashes)] = 0
            for i in at[hashes[pos] == h]:
                items = self.items.get(tuple(ids[i:i + k].tolist()))
                if items:
                    if mask is None:
                        mask = np.zeros(len(ids), bool)
                    mask[i:i + k] = True
                    found.update(items)
        return mask, found


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _spans(mask) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _result(ids, words, hits, rest=(), names=()):
    n_hit = [0 if m is None else int(m.sum()) for m, _ in hits]
    return pa.record_batch([
        pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array([len(f) for _, f in hits], pa.int64()), pa.array([_digest(f) for _, f in hits], pa.string()),
        pa.array([n > 0 for n in n_hit], pa.bool_()),
        pa.array([[] if m is None else [list(s) for s in _spans(m)] for m, _ in hits], pa.list_(pa.list_(pa.int32()))),
        *rest], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *names])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text",
                  item_col="item_id", item_text_col="text", n: int = N,
                  max_broadcast_windows: int = MAX_BROADCAST_WINDOWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: word and hit counts, items found, ``spans`` (word ranges
    [from, to) covered by benchmark windows) and the columns ``extra`` as x_name."""
    windows = stage(item_windows(benchmark, item_col, item_text_col, n), "bench-windows")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *[F.col(c).alias(f"x_{c}") for c in extra])
    if windows.limit(max_broadcast_windows + 1).count() <= max_broadcast_windows:
        return _by_broadcast(src, windows)
    return _by_join(src, windows)


def _schema(src: DataFrame) -> str:
    return SCHEMA + ", spans array<array<int>>" + "".join(f", `{n}` {t}" for n, t in src.dtypes[2:])


def _by_broadcast(src: DataFrame, windows: DataFrame) -> DataFrame:
    rows = [tuple(r) for r in windows.collect()]  # at most max_broadcast_windows, counted above
    known = src.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WindowSet(known.value)
        for b in batches:
            sizes, hits = [], []
            for text in binaries(b.column(1)):
                words = normal_words(text)
                sizes.append(len(words))
                hits.append(index.hits(words))
            yield _result(b.column(0).to_pylist(), sizes, hits, b.columns[2:], b.schema.names[2:])

    return src.mapInArrow(run, _schema(src))


def _by_join(src: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents and items joined on their text; items and spans of a
    document are combined afterwards, so no group is larger than its document."""
    lens = [r[0] for r in windows.select("len").distinct().collect()]  # at most n values

    def cut(batches):
        for b in batches:
            key, at, window, size = [], [], [], []
            for k0, text in zip(b.column(0).to_pylist(), binaries(b.column(1))):
                words = normal_words(text)
                for k in lens:
                    for i in range(len(words) - k + 1):
                        key.append(k0)
                        at.append(i)
                        size.append(k)
                        window.append(b" ".join(words[i:i + k]).decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(key, pa.string()), pa.array(at, pa.int32()), pa.array(size, pa.int32()),
                                   pa.array(window, pa.string())], names=["key", "at", "len", "window"])

    keyed = src.withColumn("key", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                                     F.coalesce("text", F.lit(""))), 256))
    found = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(
        cut, "key string, at int, len int, window string").join(windows.withColumnRenamed("len", "wl"), "window")
    items = found.select("key", "item").distinct().groupBy("key").agg(F.collect_list("item").alias("items"))
    spans = found.select("key", F.struct("at", (F.col("at") + F.col("len")).alias("to")).alias("s")).distinct() \
        .groupBy("key").agg(F.collect_list("s").alias("s"))

    def finish(batches):
        for b in batches:
            sizes, hits = [], []
            for text, it, sp in zip(binaries(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                n_words = len(normal_words(text))
                mask = np.zeros(n_words, bool) if sp else None
                for s in sp or ():
                    mask[s["at"]:s["to"]] = True
                sizes.append(n_words)
                hits.append((mask, it or []))
            yield _result(b.column(0).to_pylist(), sizes, hits, b.columns[4:], b.schema.names[4:])

    return (keyed.join(items, "key", "left").join(spans, "key", "left").select("doc_id", "text", "items", "s", *src.columns[2:])
            .mapInArrow(finish, _schema(src)))
