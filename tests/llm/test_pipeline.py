"""The pipeline's rows against its stages in plain Python, and the queries' SQL."""

import os
import sys

import corpus_pipeline
import pytest

from duepath.llm import bpe, langid, leaks, queries
from test_duplicates import exact, near
from test_text_operators import BPE, best_edits, tokens

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(queries.ORACLE[name]).df()).startswith("ok")


def test_pipeline_against_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = langid.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if (lambda found: found[0] != "und" and found[1] >= langid.MIN_SCORE)(model.classify(r[1]))]
    keep = {w[1] for w in exact(rows)}
    rows = [r for r in rows if r[0] in keep]
    first = {w[2] for w in near(rows)}
    rows = [r for r in rows if r[0] in first]
    items = [tokens(r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    rare = [set(i) for i in items]

    def leaking(words):
        there = set(words)
        # an item within a fifth of its words shares most of them
        return any(len(s & there) >= 0.6 * len(s) and best_edits(i, words) <= int(leaks.MAX_EDITS * len(i)) for i, s in zip(items, rare) if i)

    rows = [r for r in rows if not leaking(tokens(r[1]))]
    enc = bpe.encoding(*BPE)
    got = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {(d, len(enc.encode_ordinary(t))) for d, t in rows}


def test_stages_keep_columns_and_empty_tables(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if k < 4:
            assert out.columns == docs.columns
