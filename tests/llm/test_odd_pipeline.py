"""Every stage of the pipeline on odd rows and on an empty table."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline

_SPEC = importlib.util.spec_from_file_location("odd_tables", Path(__file__).with_name("test_ops.py"))
_OPS = importlib.util.module_from_spec(_SPEC)
_SPEC.loader.exec_module(_OPS)
tables = _OPS.tables  # the fixture: null, empty, very long and repeated rows, columns with clashing names

FILTERS = [s for s in corpus_pipeline.STAGES if s[0] in ("language_id", "quality_rules", "minhash_near_dedup")]


def rows(df, columns):
    return Counter(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name, stage", FILTERS, ids=[n for n, _ in FILTERS])
def test_filters_keep_whole_rows(name, stage, spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs = docs.union(docs.where("doc_id = 9"))  # a row twice
    out = stage(spark, docs, tables[0])
    assert out.columns == docs.columns
    before, after = rows(docs, docs.columns), rows(out, docs.columns)
    assert after <= before and sum(after.values()) == out.count()
    assert again(stage, spark, docs, tables[0]) == after
    if name != "minhash_near_dedup":  # what is no text, or has too few words, goes; rows that repeat share their fate
        kept = out.select("text").collect()
        assert all(r.text and any(c.isalpha() for c in r.text) for r in kept)
        assert all(n == before[r] for r, n in after.items())
    none = stage(spark, docs.limit(0), tables[1])
    assert none.columns == docs.columns and none.count() == 0


def again(stage, spark, docs, folder):
    return rows(stage(spark, docs.repartition(3), folder), docs.columns)


def test_mixing_takes_whole_rows(spark, tables):
    stage = dict(corpus_pipeline.STAGES)["mix_sources"]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = stage(spark, docs, tables[0])
    assert out.columns == docs.columns and rows(out, docs.columns).keys() <= rows(docs, docs.columns).keys()
    assert stage(spark, docs.limit(0), tables[1]).count() == 0


def test_encoding_has_a_row_for_each(spark, tables):
    stage = dict(corpus_pipeline.STAGES)["sentencepiece_ids"]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs = docs.union(docs.where("doc_id = 9"))
    out = stage(spark, docs, tables[0])
    assert out.columns == ["doc_id", "source", "n_tokens", "token_ids"]
    assert Counter((r.doc_id, r.source) for r in out.collect()) == Counter((r.doc_id, r.source) for r in docs.collect())
    assert all(r.n_tokens == len(r.token_ids) for r in out.collect())
    empty = {(r.doc_id, r.source) for r in docs.where("text is null or text = ''").collect()}
    assert all(r.n_tokens == 0 for r in out.collect() if (r.doc_id, r.source) in empty)
    assert stage(spark, docs.limit(0), tables[1]).count() == 0


def test_whole_pipeline_on_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
