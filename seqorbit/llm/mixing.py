"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots of ``block_words`` words.  Slot i is the point
``frac(i * g)`` of a golden-ratio lattice; the cumulative target shares map the
point to a source, and the slot's rank among that source's slots names the block
it takes.  A source's blocks cut its shuffled documents, repeated up to
``max_passes`` times, into runs of ``block_words`` words.

Nothing depends on one task seeing a whole source: documents are shuffled into
16 ** BUCKET_DIGITS
buckets per source, positions are a prefix sum over bucket totals
plus a running sum inside one bucket, and slot ranks are a prefix sum over runs
of ``RUN`` slots plus a rank inside one run.

Defined results: null text has size 0 and takes nothing; the null source is a
source of its own, last in order; an empty table gives an empty result; rows
that repeat a doc_id are mixed one by one; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stage

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 64
#: Hex digits of a document's hash that name its bucket.
BUCKET_DIGITS = 3
RUN = 16384
GRID = 4096
#: Golden-ratio lattice: points (i * G mod M) / M, with M prime.
M = 2147483647
G = 1327217884
WORD = r"[^\x20\x09-\x0D]+"


def document_sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source",
                   seed: int = 7) -> DataFrame:
    """``(doc_id, source, sk, size, h, bucket)``: words of each text, the source's key
    (null-safe) and the document's place in the shuffle."""
    src = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), src.alias("source"),
        F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), src)).alias("sk"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).cast("binary")).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: size, target words and the target's place in the whole.

    Water filling in closed form: with r = cap / weight in rising order, the
    level is the first (all - caps before) / (weights from here on) that is not
    above its own r.  The windows see one row per source, never documents."""
    src = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    src = src.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_passes))
    rising = W.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = W.partitionBy()
    src = (src.withColumn("total", F.sum("source_size").over(everything).cast("double"))
           .withColumn("before", F.sum("cap").over(rising) - F.col("cap"))
           .withColumn("left", F.sum("w").over(everything) - F.sum("w").over(rising) + F.col("w"))
           .withColumn("level", (F.col("total") - F.col("before")) / F.col("left")))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    src = src.withColumn("level", F.first(fits, ignorenulls=True).over(
        rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    src = src.withColumn("target", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")))
    hi = F.sum("target").over(order)
    return src.select("sk", "source", "source_size", "target", "total", (hi - F.col("target")).alias("lo"), hi.alias("hi"))


def schedule(spark, targets: DataFrame, total: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, sk, block)``: which block of which source each slot takes."""
    n = -(-int(total) // block_words)
    share = F.greatest(F.lit(total), F.lit(1.0))
    cells = targets.where("hi > lo").select(
        "sk", (F.col("lo") / share).alias("lo"),
        F.when(F.col("hi") >= total * (1 - 1e-12), F.lit(2.0)).otherwise(F.col("hi") / share).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(
        F.least(F.floor(F.col("lo") * GRID), F.lit(GRID - 1)).cast("int"),
        F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("int"))))
    point = (((F.col("id") % M) * G) % M).cast("double") / float(M)
    slots = (spark.range(n).select(F.col("id").alias("slot"), point.alias("p"))
             .withColumn("cell", F.floor(F.col("p") * GRID).cast("int"))
             .join(cells, "cell").where("p >= lo AND p < hi")
             .select("slot", "sk", F.floor(F.col("slot") / RUN).alias("run")))
    before = (slots.groupBy("sk", "run").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("sk").orderBy("run")) - F.col("n")))
    rank = F.row_number().over(W.partitionBy("sk", "run").orderBy("slot")) - 1
    return (slots.withColumn("rank", rank).join(before.drop("n"), ["sk", "run"])
            .select("slot", "sk", (F.col("before") + F.col("rank")).alias("block")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
        max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS, seed: int = 7):
    """``(documents, pieces)``.

    documents: doc_id, source, size, source_size, target and its ``start`` word in
    the source's shuffled stream.  pieces: slot, doc_id, source key, start, pass and
    the words [from_word, from_word + n_words) of the document that the slot takes."""
    spark = docs.sparkSession
    sizes = stage(document_sizes(docs, id_col, text_col, source_col, seed), "mix-sizes")
    targets = stage(source_targets(sizes, weights, max_passes), "mix-targets")
    total = targets.agg(F.max("total")).first()[0] or 0.0
    slots = stage(schedule(spark, targets, total, block_words), "mix-slots")
    used = slots.groupBy("sk").agg(F.count("*").alias("blocks"))
    per_source = targets.join(used, "sk", "left").select(
        "sk", "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    offsets = (sizes.groupBy("sk", "bucket").agg(F.sum("size").alias("n"))
               .withColumn("offset", F.sum("n").over(W.partitionBy("sk").orderBy("bucket")) - F.col("n"))
               .drop("n").join(per_source, "sk"))
    offsets = stage(offsets, "mix-offsets")
    running = F.sum("size").over(W.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size")
                                 .rowsBetween(W.unboundedPreceding, 0))
    placed = stage(sizes.withColumn("run", running).join(offsets, ["sk", "bucket"])
                   .withColumn("start", F.col("offset") + F.col("run") - F.col("size"))
                   .drop("run", "offset", "h", "bucket"), "mix-placed")
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    at = F.col("pass") * F.col("source_size") + F.col("start")
    first, last = F.floor(at / block_words), F.floor((at + F.col("size") - 1) / block_words)
    cut = (passes.withColumn("at", at).withColumn("first", first)
           .withColumn("last", F.least(last, F.col("blocks") - 1)).where("first <= last")
           .withColumn("block", F.explode(F.sequence("first", "last"))))
    lo = F.greatest(F.col("at"), F.col("block") * block_words)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = (cut.select("sk", "block", "doc_id", "start", "pass", (lo - F.col("at")).alias("from_word"),
                         (hi - lo).alias("n_words")).join(slots, ["sk", "block"]))
    return placed, pieces


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words
    the mix takes from it, repeats counted) and first_slot (null if none)."""
    placed, pieces = mix(docs, **kw)
    taken = stage(pieces.groupBy("sk", "start").agg(F.sum("n_words").alias("taken"),
                                                    F.min("slot").alias("first_slot")), "mix-taken")
    full = placed.where("size > 0").join(taken, ["sk", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0)).withColumn("first_slot", F.lit(None).cast("long"))
    return full.unionByName(none).select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
