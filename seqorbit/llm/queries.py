"""The registered queries of this package, each over its whole table, and their SQL
restatements where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_trie, decontaminate, embedding_dedup, extract, hard_negatives, hmm, language, licenses, line_dedup,
    minhash_dedup, mixing, substring_dedup, topk,
)
from .common import id_remainder, read


def op1_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(read(spark, sf_dir, "pages"))


def op3_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return language.identify(docs, trains=~F.col("held_out"), extra=("held_out",))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 1)


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_ngram_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_golden_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_monoid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(
        read(spark, sf_dir, "conversations"), head=id_remainder("conv", 4), base=F.col("conv") - F.col("conv") % 20).drop("fingerprint")


def op12_packed_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (
    op1_epsilon_grid, op2_text_density, op3_word_backoff, op4_chosen_path, op5_line_join, op6_hidden_markov,
    op7_recompression, op8_ngram_set, op9_conditional_compression, op10_golden_schedule, op11_monoid_trie, op12_packed_rtree, op13_bounded_lists)}

#: The bits of crc32, one at a time: a byte is mixed in, then eight shifts.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii({0}[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
_INTEGER_ROWS = """
  SELECT vec_id, LABEL list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_epsilon_grid": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
names AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN names ON names.x = e.vec_id LEFT JOIN links ON links.x = e.vec_id""",
    "op4_chosen_path": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SPACE_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (nx + ny - c)),
pairs AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
names AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN names ON names.x = s.doc_id""",
    "op7_recompression": f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
named AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM win),
rep AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM named) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) FILTER (cov.p IS NULL) AS t,
    count(cov.p) AS gone FROM words LEFT JOIN cov USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_ngram_set": r"""
WITH norm AS (
  SELECT 0 AS k, CAST(doc_id AS VARCHAR) AS id, LOWERED AS t FROM documents
  UNION ALL SELECT 1, coalesce(CAST(item_id AS VARCHAR), ''), LOWERED FROM benchmark),
tok AS (SELECT k, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM norm),
item AS (
  SELECT DISTINCT id AS item, least(10, len(w)) AS n,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS t
  FROM tok WHERE k = 1 AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item),
win AS (
  SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM tok, sizes WHERE k = 0 AND len(w) >= n),
hit AS (
  SELECT win.id, i, win.n, item FROM (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM win) win
  JOIN item ON item.t = win.t AND item.n = win.n),
cov AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY id),
items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT CAST(tok.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM tok LEFT JOIN cov USING (id) LEFT JOIN items USING (id) WHERE k = 0
""".replace("LOWERED", _LOWERED.format("coalesce(text, '')")),
    "op10_golden_schedule": f"""
WITH sz AS (
  SELECT doc_id, source, CAST(len({_SPACE_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
    md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
src0 AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM sz GROUP BY source),
src1 AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, ss * 3.0::DOUBLE AS cap FROM src0),
src2 AS (
  SELECT *, sum(ss) OVER () AS total, ((sum(ss) OVER ())::DOUBLE - (sum(cap) OVER (ORDER BY cap / w, r) - cap))
    / (sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, r) + w) AS level FROM src1),
lev AS (SELECT arg_min(level, struct_pack(q := cap / w, r := r)) AS level FROM src2 WHERE level <= cap / w),
tgt AS (SELECT source, r, ss, total, least(cap, (SELECT level FROM lev) * w) AS target FROM src2),
cut AS (
  SELECT *, (sum(target) OVER (ORDER BY r) - target) / greatest(total, 1) AS lo,
    CASE WHEN sum(target) OVER (ORDER BY r) >= total * (1 - 1e-12) THEN 2.0 ELSE sum(target) OVER (ORDER BY r) / greatest(total, 1) END AS hi
  FROM tgt),
slot AS (
  SELECT i, ((((i % {mixing.M}) * {mixing.G}) % {mixing.M})::DOUBLE / {mixing.M}.0::DOUBLE) AS p
  FROM range(CAST(ceil((SELECT max(total) FROM tgt)::DOUBLE / {mixing.BLOCK_WORDS}) AS BIGINT)) t(i)),
sched AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS block FROM slot JOIN cut ON p >= lo AND p < hi),
used AS (SELECT r, count(*) * {mixing.BLOCK_WORDS} AS words FROM sched GROUP BY r),
pos AS (
  SELECT sz.*, tgt.ss, tgt.target, coalesce(words, 0) AS words,
    sum(size) OVER (PARTITION BY tgt.r ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sz JOIN tgt ON tgt.source IS NOT DISTINCT FROM sz.source LEFT JOIN used USING (r))
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, words - (e * ss + start))))) AS BIGINT) AS taken
FROM pos""",
    "op11_monoid_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, count(*) AS n, c - c % 20 AS base, {_CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM t GROUP BY c),
rebuilt AS (
  SELECT conv.c, t.i AS i, role, text FROM conv JOIN t ON t.c = conv.base AND t.i < conv.h
  UNION ALL SELECT conv.c, 1000000 + t.i, role, text FROM conv JOIN t ON t.c = conv.c AND t.i >= conv.h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(role || chr(0) || text) AS k,
    len({_SPACE_WORDS.format("text")}) AS w FROM rebuilt),
pre AS (
  SELECT c, d, string_agg(k, '/') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p, w FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM conv),
last AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS (
  SELECT p, d, min(pre.c) AS c, count(*) AS n, max(w) AS w,
    sha256(coalesce(string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) FILTER (last.n = d), '')) AS ends
  FROM pre JOIN last USING (c) GROUP BY p, d),
link AS (
  SELECT child.c, child.d, up.p AS up, parent.c AS parent FROM node child JOIN pre up ON up.c = child.c AND up.d = child.d - 1
  JOIN node parent ON parent.p = up.p AND parent.d = up.d),
kids AS (SELECT up AS p, count(*) AS n FROM link GROUP BY up),
own AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.p = node.p),
sub AS (
  SELECT pre.p, sum(CASE WHEN own.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((own.n - 1) * own.w) AS saved
  FROM own JOIN pre ON pre.c = own.c AND pre.d <= own.d GROUP BY pre.p)
SELECT own.c AS conv_id, CAST(own.d AS BIGINT) AS depth, link.parent AS parent_conv_id, CAST(own.n AS BIGINT) AS n_convs,
  CAST(own.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  own.ends AS ends_sha256
FROM own JOIN sub ON sub.p = own.p LEFT JOIN link ON link.c = own.c AND link.d = own.d""",
    "op12_packed_rtree": f"""
WITH v AS ({_INTEGER_ROWS.replace("LABEL", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")} AND label IS NOT NULL),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
pos AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY neg.s DESC, neg.b) AS INTEGER) AS rank,
  neg.b AS negative_id, pos.s AS positive_score, neg.s AS negative_score
FROM pos JOIN s neg ON neg.a = pos.a AND NOT neg.same AND 50 * pos.s <= 100 * neg.s AND 100 * neg.s <= 95 * pos.s
QUALIFY row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY neg.s DESC, neg.b) <= 3""",
    "op13_bounded_lists": f"""
WITH v AS ({_INTEGER_ROWS.replace("LABEL", "")})
SELECT a.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, b.vec_id AS vec_id,
  CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
WINDOW best AS (PARTITION BY a.vec_id ORDER BY CAST(list_inner_product(a.e, b.e) AS BIGINT) DESC, b.vec_id)
QUALIFY row_number() OVER best <= 5""",
}
