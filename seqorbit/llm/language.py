"""Language identification by word-first backoff.

A known word votes with its log frequency in each language; a word never seen in
training falls back to its character n-grams, the longest length first, until one
length has a known n-gram.  A document's score per language is the mean over its
words; the best language wins and ties go to the smallest name.

The model is fitted on at most about ``max_train_docs`` labelled rows, picked by a
hash of the id (a documented bound; everything is scored).  Its size is bounded by
that sample, so it may be broadcast.

Defined results: null text or text without a letter gives ``und`` with score 0;
rows with null lang or null text do not train; without any training row all is
``und``; a null id is scored and may train; other columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_TRAIN_DOCS = 4000
NGRAM = 5
MIN_COUNT = 2
EVIDENCE_WORDS = 10
CACHE = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; a run of other numerals alone (such as ² or ½) is no word."""
    found = _LETTERS.findall(text.lower()) if text else []
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Rows of log10 frequencies per language, for words and for n-grams."""

    def __init__(self, langs: list[str], entries: list[tuple[str, int, str, int]]):
        self.langs = langs
        number = {x: i for i, x in enumerate(langs)}
        self.tables = []
        for n in range(NGRAM + 1):  # table 0 holds words, table n the n-grams of length n
            keys: dict[str, int] = {}
            own = [(keys.setdefault(k, len(keys)), number[lang], c) for lang, m, k, c in entries if m == n]
            counts = np.zeros((len(keys), len(langs)))
            for row, col, c in own:
                counts[row, col] += c
            logs = np.log10((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (len(keys) + 1)))
            self.tables.append((keys, logs))

    def backoff(self, word: str) -> np.ndarray | None:
        for n in range(min(NGRAM, len(word) + 2), 0, -1):
            keys, logs = self.tables[n]
            rows = [keys[g] for g in grams_of(word, n) if g in keys]
            if rows:
                return logs[rows].mean(axis=0)
        return None

    def predict(self, text: str | None, cache: dict) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return "und", 0.0
        keys, logs = self.tables[0]
        rows, weights, total = [], [], np.zeros(len(self.langs))
        for word, c in counts.items():
            row = keys.get(word)
            if row is not None:
                rows.append(row)
                weights.append(c)
                continue
            if word not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = self.backoff(word)
            if cache[word] is not None:
                total += c * cache[word]
        if rows:
            total += np.asarray(weights, float) @ logs[rows]
        mean = total / sum(counts.values())
        best = int(np.argmax(mean))  # languages are sorted: ties go to the smallest
        share = 10.0 ** ((mean - mean[best]) * min(EVIDENCE_WORDS, sum(counts.values())))
        return self.langs[best], float(1.0 / share.sum())


def _counted(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter = Counter()
        rows(b, seen)
        yield pa.record_batch([
            pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()),
            pa.array([k[2] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())],
            names=["lang", "n", "k", "c"])


def train(labelled: DataFrame, text_col: str, lang_col: str) -> Model:
    """Counts per language of the labelled rows, made and summed by Spark: words
    first, then the n-grams of the distinct words weighted by their counts."""
    def words(b, seen):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w, c in Counter(words_of(text)).items():
                seen[lang, 0, w] += c

    def grams(b, seen):
        for lang, word, c in zip(*(b.column(i).to_pylist() for i in range(3))):
            for n in range(1, NGRAM + 1):
                for g in grams_of(word, n):
                    seen[lang, n, g] += c

    schema = "lang string, n int, k string, c long"
    total = F.sum("c").alias("c")
    known = stage(labelled.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
                  .mapInArrow(lambda it: _counted(it, words), schema).groupBy("lang", "n", "k").agg(total), "lang-words")
    parts = (known.select("lang", "k", "c").mapInArrow(lambda it: _counted(it, grams), schema)
             .groupBy("lang", "n", "k").agg(total))
    entries = [tuple(r) for r in known.union(parts).where(F.col("c") >= MIN_COUNT).collect()]  # bounded by the sample
    return Model(sorted({e[0] for e in entries}), sorted(entries))


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang",
             trains: Column | None = None, max_train_docs: int = MAX_TRAIN_DOCS,
             extra: tuple[str, ...] = ()) -> DataFrame:
    """``lang_pred`` and ``score`` for every row, beside ``id_col`` and ``extra``.

    ``trains`` marks the rows that may train (all by default)."""
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    labelled = docs.where(ok & trains if trains is not None else ok)
    n = labelled.count()
    if n > max_train_docs:
        part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1_000_000))
        labelled = labelled.where(part < F.lit(int(1_000_000 * max_train_docs / n)))
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled, text_col, lang_col))
    keep = docs.select(id_col, *extra, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for b in batches:
            got = [model.predict(t, cache) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[1] for g in got], pa.float64())],
                                  names=[*b.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    return keep.mapInArrow(run, f"{fields}, lang_pred string, score double")
