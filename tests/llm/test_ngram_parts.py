"""Blocks whose leading component is far larger than ``BLOCK``."""

from collections import defaultdict

import brute
import numpy as np

from lectern.llm import ngrams


def dealt(spark, wide):
    rows = [(7, i, i, 1, 1) for i in range(1, 301)] + [(7, i, i, i, 1) for i in range(301, 307)]
    found = defaultdict(set)
    for r in ngrams.parts(spark.createDataFrame(rows, "block long, cls long, node long, comp long, least long"), wide).collect():
        found[r.part].add(r.cls)
    return found


def test_large_lead_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    linear = dealt(spark, False)
    assert set().union(*linear.values()) == set(range(1, 307))
    assert max(map(len, linear.values())) < 30
    assert sum(map(len, linear.values())) < 2 * 306 + 306
    met = {(a, b) for part in dealt(spark, True).values() for a in part for b in part}
    assert all((a, b) in met for a in range(301, 307) for b in range(1, 307))


def test_groups_with_a_large_lead(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    words = brute.vocabulary(11)[:120]
    texts = {i: " ".join([*words[:60], f"only{i}", *words[60:]]) for i in range(100)}
    texts |= {100 + k: " ".join([*words[: 90 - 6 * k], *(f"s{k}x{x}" for x in range(9))]) for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.joined(docs).collect()} == brute.groups(texts)


def test_traversal_is_linear_in_one_component():
    base = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.append(base, np.uint64(i))) for i in range(1025)]
    bits = np.stack([ngrams.bitmap(s) for s in sets])
    tree = ngrams.Tree(np.full(1025, 301), bits, np.arange(1025))
    leaves = len(tree.levels[0][1])
    roots = ngrams.Roots([0] * 1024 + [1])
    assert len(list(tree.leaf_pairs(85, roots))) <= 2 * leaves
    assert {tuple(sorted(p)) for p in tree.pairs(85, roots)} == {(i, 1024) for i in range(1024)}
