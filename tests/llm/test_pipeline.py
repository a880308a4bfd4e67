"""Each stage against a plain version of its rule, on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from churnlens.llm import decontaminate, mixing, quality, simhash, tokens
from churnlens.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "test-pipeline"))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(steps[0], quality.fit(steps[0], labels))
    assert ids(steps[1]) == ids(scored.where("score >= 0.3"))
    assert 0 < steps[1].count() < steps[0].count()


def test_near_copies_stage(steps):
    groups = simhash.simhash_groups(steps[1]).collect()
    assert ids(steps[2]) == Counter({r.component_id for r in groups})


def test_benchmark_stage(spark, steps):
    hit = decontaminate.decontaminate(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(steps[3]) == ids(hit.where("not contaminated"))
    assert steps[3].count() < steps[2].count()


def test_mixing_stage(spark, steps):
    m = mixing.mix(steps[3], spark.read.parquet(f"{SF}/labels.parquet"), corpus_pipeline.MIX_TARGETS).collect()
    assert ids(steps[4]) == Counter({r.doc_id: r.n_copies for r in m if r.n_copies})


def test_token_stage(steps):
    enc = tokens.Encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(enc.whole(r.text)) + 1) for r in steps[4].collect())
    rows = steps[5].orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_run_is_the_stages(spark, steps):
    key = lambda df: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])


def test_stages_on_edges(spark, edge_docs, empty_docs):
    """Nulls, repeated rows and clashing names (also those that the operators use inside)."""
    docs = edge_docs.selectExpr("*", "1 as _k1", "2 as k2", "3 as _n", "4 as _copy", "5 as _id", "6 as text_hash")
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            assert (out.count() > 0) == (table is docs)
    kept = simhash.keep_first(docs)
    assert ids(kept) == Counter({r.component_id for r in simhash.simhash_groups(docs).collect()})
    assert corpus_pipeline.STAGES[-1][1](spark, edge_docs, SF).count() == edge_docs.count()
