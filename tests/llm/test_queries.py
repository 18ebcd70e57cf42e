"""Registered queries against SQL, and the stages of the pipeline."""

import brute
import corpus_pipeline
import pytest
from oracle import compare, duck

from lectern.llm.entry import ORACLE, QUERIES

NAMES = [n for n in QUERIES if n.startswith("op")]


def test_one_query_for_each():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in QUERIES and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    text, ok = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, text


def test_stages(spark, sf_dir):
    """Each stage on what the one before kept; copies and repeated passages are gone at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) > 0.5 * len(before), name
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute.groups(before, 5, 80).items() if c == i}
            assert after == {i: before[i] for i in want}
        if name == "passages":
            want = brute.passages(before)
            left = {i: w for i, w in want.items() if w[2] or not w[1]}
            assert {i: brute.words(t) for i, t in after.items()} == {i: w[2] for i, w in left.items()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert len(set(after.values())) == len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == after.keys()


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = brute.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
