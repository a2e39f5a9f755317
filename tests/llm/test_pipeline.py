"""The corpus pipeline stage by stage on sf0.001 and on messy rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from seqorbit.llm import decontaminate
from seqorbit.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.test_llm import MESSY, SCHEMA, brute_lines, rows, shingles


def test_stages_against_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    kept = P.language_id(spark, docs, SF_SMALL).cache()
    assert kept.columns == docs.columns and kept.count() == docs.count()
    lines = P.line_dedup_stage(spark, kept, SF_SMALL).cache()
    want = brute_lines(sorted((r["doc_id"], r["text"]) for r in rows(kept)))
    want = {i: t for i, t in want.items() if t and t.strip()}
    assert lines.columns == docs.columns and {r["doc_id"]: r["text"] for r in rows(lines)} == want
    near = P.near_dedup(spark, lines, SF_SMALL).cache()
    left = [shingles(r["text"], 5) for r in rows(near)]
    assert near.columns == docs.columns
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    clean = P.decontamination(spark, near, SF_SMALL).cache()
    bad = {r["doc_id"] for r in rows(decontaminate.contamination(near, read(spark, SF_SMALL, "benchmark"))) if r["contaminated"]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in rows(clean)} == {r["doc_id"] for r in rows(near)} - bad
    mixed = rows(P.mixing_stage(spark, clean, SF_SMALL))
    assert mixed and all(0 < r["taken"] <= 3 * r["size"] for r in mixed)


@pytest.mark.parametrize("n", [len(MESSY), 0])
def test_messy_and_empty_tables(spark, n):
    docs = spark.createDataFrame(MESSY[:n], SCHEMA)
    for c in ("score", "rk", "__rk", "lang_pred", "did", "tag", "n", "key", "h", "x_source"):  # names the stages use themselves
        docs = docs.withColumn(c, F.lit("clash"))
    for name, f in P.STAGES:
        before = docs.columns
        docs = P.stage(f(spark, docs, SF_SMALL), "test")
        assert name.startswith("mixing") or docs.columns == before
    got = rows(docs)
    assert all(r["score"] == r["rk"] == r["__rk"] == r["lang_pred"] == "clash" for r in got)
    assert not {r["doc_id"] for r in got} & {4, 5, 6, 12} and len(got) == len({(r["doc_id"], r["text"]) for r in got})
