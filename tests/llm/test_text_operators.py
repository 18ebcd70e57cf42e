"""Operators over texts against plain versions, on awkward documents and on empty tables."""

import brute
from pyspark.sql import functions as F

from lectern.llm import lines, merkle, ngrams, passages, rules


def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def by_id(df, *columns):
    out = {}
    for r in df.where("doc_id is not null").select("doc_id", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def test_passages(spark):
    docs = brute.documents(spark)
    got = passages.deduplicated(docs)
    assert got.columns == [c for c in docs.columns if c != "words_removed"] + ["words_total", "words_removed"]
    kept = by_id(got, "words_total", "words_removed", "text")
    want = brute.passages(brute.texts())
    for i, (n, removed, left) in want.items():
        for total, gone, text in kept[i]:
            assert (total, gone, brute.words(text)) == (n, removed, left), i
            if gone:
                assert text == " ".join(left)
            else:
                assert text == brute.texts()[i]
    assert sum(w[1] > 0 for w in want.values()) > 8
    assert {r[0] for r in got.where("doc_id is null").select("words_removed").collect()} == {0}
    assert passages.deduplicated(empty(spark)).count() == 0


def test_passages_over_more_levels(spark):
    docs = brute.documents(spark)
    kept = by_id(passages.deduplicated(docs, 48), "words_removed")
    for i, (_, removed, _) in brute.passages(brute.texts(), 48).items():
        assert kept[i][0] == (removed,), i


def test_sliding_minimum():
    import numpy as np

    v = np.random.default_rng(1).integers(0, 9, 200)
    for width in (1, 2, 3, 7, 26, 200):
        assert passages.sliding_argmin(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(201 - width)]


def test_ngram_groups(spark):
    docs = brute.documents(spark)
    got = ngrams.joined(docs)
    kept = by_id(got, "n_shingles", "component_id")
    want = brute.groups(brute.texts())
    assert {i: set(v) for i, v in kept.items()} == {i: {w} for i, w in want.items()}
    assert sum(i != w[1] for i, w in want.items()) > 6
    assert got.where("doc_id is null and component_id is not null").count() == 0
    assert got.count() == docs.count()
    assert ngrams.joined(empty(spark)).count() == 0
    assert ngrams.one_of_each(empty(spark)).count() == 0


def test_ngram_groups_in_parts(spark, monkeypatch):
    """Blocks that are dealt out give the same groups."""
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    kept = by_id(ngrams.joined(brute.documents(spark)), "n_shingles", "component_id")
    assert {i: set(v) for i, v in kept.items()} == {i: {w} for i, w in brute.groups(brute.texts()).items()}


def test_one_of_each_group(spark):
    docs = brute.documents(spark)
    left = ngrams.one_of_each(docs, size=5, percent=80)
    assert left.columns == docs.columns
    want = {i for i, (_, c) in brute.groups(brute.texts(), 5, 80).items() if c == i}
    assert {r[0] for r in left.select("doc_id").distinct().collect()} == want | {None}


def test_tree_leaves_out_no_link():
    import numpy as np

    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = []
    for i in range(90):
        keep = r.random(len(base)) < (0.95 if i % 2 else 0.6)
        sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 1 << 60, 10).astype(np.uint64)])))
    sets.sort(key=len)
    sets += [np.concatenate([s, r.integers(0, 1 << 60, 280).astype(np.uint64)]) for s in sets[:20]]
    sets += [np.unique(np.concatenate([sets[0], s])) for s in sets[-9:]]
    total, n = len(sets), np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for p in ngrams.possible_pairs(n, [ngrams.bitmap(s) for s in sets], 85, ngrams.Roots(list(range(total))))}
    want = {(a, b) for a in range(total) for b in range(a + 1, total) if ngrams.linked(sets[a], sets[b], 85)}
    assert want and want <= found
    assert len(found) < total * (total - 1) / 3


def test_line_dedup(spark):
    docs = brute.documents(spark)
    got = lines.deduplicated(docs)
    assert got.columns == [c for c in docs.columns if c != "lines_total"] + ["lines_total", "lines_removed"]
    kept = by_id(got, "lines_total", "lines_removed", "text")
    texts = brute.texts()
    want = brute.line_deletions(texts, lines.patience, lines.blocks, lines.MIN_CHARS)
    for i, gone in want.items():
        before = texts[i].split("\n")
        left = "\n".join(x for k, x in enumerate(before) if k not in gone)
        assert set(kept[i]) == {(len(before), len(gone), left)}, i
    assert sum(bool(g) for g in want.values()) > 8
    assert kept[43] == [(0, 0, None)]
    assert lines.deduplicated(empty(spark)).count() == 0


def test_line_dedup_of_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "RARE", 2)
    kept = by_id(lines.deduplicated(brute.documents(spark)), "lines_removed")
    want = brute.line_deletions(brute.texts(), lines.patience, lines.blocks, lines.MIN_CHARS, 2)
    assert {i: kept[i][0][0] for i in want} == {i: len(g) for i, g in want.items()}


def test_patience():
    a, b = list("abcXdefgY"), list("abcdeZfgYY")
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert [a[i] for i, _ in pairs] == list("abcdefgY")
    assert list(lines.blocks([(0, 0), (1, 1), (3, 2), (4, 3), (5, 5)])) == [(0, 2), (3, 5), (5, 6)]


def test_merkle(spark):
    docs = brute.documents(spark)
    got = merkle.compared(docs)
    texts = {i: t or "" for i, t in brute.texts().items()}
    ids = sorted(texts, reverse=True)
    after = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    prints = {}
    for r in got.where("doc_id > 0").collect():
        t = texts[r.doc_id]
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[after[r.doc_id]][:third]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited)), r.doc_id
        assert (r.near_edited == 1.0) == (edited == t) and 0 <= r.near_edited <= 1
        assert (r.near_next == 1.0) == (t == texts[after[r.doc_id]])
        prints[r.doc_id] = r.fingerprint
    assert len(set(prints.values())) == len({texts[i] for i in prints})
    assert all((prints[i] == prints[j]) == (texts[i] == texts[j]) for i in prints for j in prints)
    assert got.count() == docs.count()
    assert merkle.compared(empty(spark)).count() == 0


def test_merkle_last_document_and_single(spark):
    got = {r.doc_id: r for r in merkle.compared(spark.createDataFrame([(5, "abcdef"), (9, "ghi")], "doc_id long, text string")).collect()}
    assert got[9].edited_sha256 == brute.sha("gha") and got[5].edited_sha256 == brute.sha("abcdgh")
    one = merkle.compared(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == brute.sha("abcdab") and one.near_next == 1.0


def test_merkle_locates_edits(spark):
    old = "\n".join(f"paragraph {i} with words of its own" for i in range(60))
    new = old.replace("paragraph 33 with", "paragraph 33 without")
    df = spark.createDataFrame([(old, new)], "old string, new string")
    df = merkle.with_tree(merkle.with_tree(df, F.col("old"), "a"), F.col("new"), "b")
    r = df.select(merkle.changed(F.col("a"), F.col("b")).alias("x"), merkle.changed(F.col("a"), F.col("a")).alias("y")).first()
    assert (r.x, r.y) == ([34], [])


def test_rule_counts(spark):
    docs = brute.documents(spark)
    got = rules.judged(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, label int"))
    want = {i: brute.rule_counts(t) for i, t in brute.texts().items()}
    for r in got.where("doc_id is not null").collect():
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert n == want[r.doc_id], r.doc_id
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert r.kept == (not r.base_failed)  # so few labels certify nothing
    assert got.count() == docs.count()
    none = spark.createDataFrame([], "doc_id long, label int")
    assert rules.judged(empty(spark), none).count() == 0
    assert rules.judged(docs, none).where("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (1, 5, 16, 17, 40, 300, 2000) for k in (0, 1, 3, n // 200, n // 40) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p"))
    for k, n, p in df.collect():
        exact = sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))
        assert (p == 1.0) if k >= n * 0.03 else abs(p - exact) <= 1e-9 * exact, (k, n)


def test_certified_cutoffs(spark):
    """With many good documents a rule is certified where they seldom fall, in the stratum that has them."""
    good = [(i, "plain words in a row that say little of note today " + ("# " * (i % 400 == 0)) + f"w{i} v{i}", "en") for i in range(4000)]
    bad = [(10_000 + i, "all *** of *** this *** is *** only *** signs *** here *** and *** there *** q{i}", "en") for i in range(50)]
    few = [(20_000 + i, "alle *** sagen *** wenig *** hier *** und *** dort *** so *** ist *** das *** z", "de") for i in range(9)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good + few] + [(i, 0) for i, _, _ in bad], "doc_id long, label int")
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert not any(got[i].kept for i, _, _ in bad)
    assert all(got[i].kept for i, _, _ in few)  # nine labels certify no cutoff
    assert sum(not got[i].kept for i, _, _ in good) <= 0.05 * len(good)
