"""Operators beyond the sizes that they broadcast or hold at once."""

import brute
import pyarrow as pa
import pytest

from lectern.llm import common, lines, ngrams, passages, warc


@pytest.fixture
def nothing_broadcast(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ENTRIES", 0)


def kept(df, *columns):
    return {(r[0], *r[1:]) for r in df.where("doc_id is not null").select("doc_id", *columns).collect()}


def test_text_operators_without_broadcast(spark, nothing_broadcast):
    docs, texts = brute.documents(spark), brute.texts()
    want = {(i, removed) for i, (_, removed, _) in brute.passages(texts).items()}
    assert kept(passages.deduplicated(docs), "words_removed") == want
    want = {(i, len(g)) for i, g in brute.line_deletions(texts, lines.patience, lines.blocks, lines.MIN_CHARS).items()} | {(43, 0)}
    assert kept(lines.deduplicated(docs), "lines_removed") == want
    assert kept(ngrams.joined(docs), "n_shingles", "component_id") == {(i, *v) for i, v in brute.groups(texts).items()}


def test_archives_without_broadcast(spark, nothing_broadcast):
    rows = [(i, "u", f"<p>page {i % 7}</p>" * 20) for i in range(40)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(i, None if i < 7 else i % 7) for i in range(40)}


def test_runs_of_texts():
    texts = ["ab", None, "", "éé", "x" * 50, "y", "z" * 9, "zz"]
    for limit in (1, 4, 10, 60, 1000):
        parts = list(common.text_parts(pa.array(texts), limit))
        assert [t for _, some in parts for t in some] == texts
        assert [p.start for p, _ in parts[1:]] == [p.stop for p, _ in parts[:-1]]
        assert all(len(some) == 1 or sum(len((t or "").encode()) for t in some) <= limit for _, some in parts)
    assert list(common.text_parts(pa.array([], pa.string()))) == []


def test_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "1000")
        common.small_batches(spark)
        assert spark.conf.get(setting) == "1000"
        spark.conf.unset(setting)
        common.small_batches(spark)
        assert spark.conf.get(setting) == str(common.BATCH_BYTES)
    finally:
        spark.conf.set(setting, before)
