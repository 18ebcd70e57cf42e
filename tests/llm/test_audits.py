"""Source divergence, benchmark decontamination and centroid clustering against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids, common, divergence, winnow

LOWER = brute.LOWER


# ------------------------------------------------------------------ divergence
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergences(rows, least, top=50):
    """{(lang, source, part, item, value, rank)} of (text, lang, source) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    df, n = Counter(), Counter()
    for text, lang, source in rows:
        found = Counter(TERM.findall(text.translate(LOWER)))
        df.update((lang, t) for t in found)
        n.update({(lang, source, t): c for t, c in found.items()})
    groups, out = sorted({r[1:] for r in rows}), set()
    for lang in {g[0] for g in groups}:
        terms = [t for x, t in df if x == lang and df[x, t] >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(count, v=len(terms), terms=terms):
            total = sum(map(count, terms))
            return {t: 1 + (10**9 * (count(t) + 5)) // (total + 5 * v) for t in terms}

        p = {s: shares(lambda t, s=s: n[lang, s, t]) for s in sources}  # noqa: B023
        q = shares(lambda t: sum(n[lang, s, t] for s in sources))  # noqa: B023
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s]
            lead = [(q[t] - p[s][t], t.encode(), t) for t in terms if n[lang, s, t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -f, k) for k, (f, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -f, k) for k, (f, _, t) in enumerate(sorted(lead)[:top], 1)}
    return out


def spoken(n=300, seed=4):
    r = random.Random(seed)
    words = [*brute.vocabulary(seed, 60), "Été", "中文", "x1y", "İ", "naïve"]
    lean = {s: r.sample(words, 20) for s in "abcdefg"}
    rows = []
    for _ in range(n):
        source, lang = r.choice("abcdefg"), r.choice(["en", "en", "en", "fr", None, ""])
        rows.append((" ".join(r.choice(lean[source] if r.random() < 0.3 else words).upper() for _ in range(r.randint(0, 40))), lang, source))
    return rows + [(None, "en", "a"), ("", "de", None), ("!! 12", "de", "s"), ("tie tie", "xx", "b"), ("tie tie", "xx", "a"), (None, None, None)]


@pytest.mark.parametrize("block", [256, 2])
def test_divergence(spark, block, monkeypatch):
    if block == 2:
        monkeypatch.setattr(divergence, "GROUP", 200)  # languages in many parts
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = spoken()
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "text string, lang string, source string, value int, item string").repartition(6)
    got = {tuple(r[:6]) for r in divergence.audited(df, least=3, terms=7, block=block).collect()}
    assert got == divergences(rows, 3, 7)
    assert divergence.audited(df.limit(0)).count() == 0


def test_stripes_spill_and_merge(monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "SLICE", 16)
    rows = [(t or "", x or "", s or "") for t, x, s in spoken(80)]
    columns = list(zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in columns[0]]), pa.array(columns[1]), pa.array(columns[2])], ["text", "lang", "source"])
    spilled = pa.Table.from_batches(divergence.folded(iter([batch.slice(0, 30), batch.slice(30)])))
    dealt = spilled.sort_by([("lang", "ascending"), ("term", "ascending")]).to_batches(max_chunksize=7)
    got = pa.Table.from_batches(divergence.merged(2)(iter(dealt))).to_pylist()
    df, counts = Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        for t, c in Counter(TERM.findall(text.translate(LOWER))).items():
            df[lang, t.encode()] += 1
            counts[lang, t.encode()][source] += c
    assert len(spilled) > len(got)
    assert {(r["lang"], r["term"]): (r["df"], dict(zip(r["sources"], r["counts"], strict=True))) for r in got} == {
        k: (n, dict(counts[k])) for k, n in df.items() if n >= 2
    }


def test_shares_of_large_counts():
    for count, total in [(0, 5), (7, 12), (10**13, 10**13 + 5 * 10**8), (3 * 10**14 + 1, 8 * 10**15), (8 * 10**15 - 5, 8 * 10**15)]:
        got = divergence.share(np.array([count], np.int64), np.int64(total))
        assert got.tolist() == [1 + 10**9 * (count + 5) // total]


# ------------------------------------------------------------- decontamination
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items, length=10):
    """[(n_words, hit positions, items)] of texts, by every window of every item."""
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(length, len(w))
        for s in range(len(w) - n + 1):
            if i is not None and n:
                windows[tuple(w[s : s + n])].add(i)
    out, sizes = [], {len(k) for k in windows}
    for t in docs:
        w, hit, held = split(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    held |= found
        out.append((len(w), hit, sorted(held)))
    return out


def leaky():
    r, words = random.Random(9), brute.vocabulary(9, 200)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([40, 25, 10, 11, 9, 5, 2, 1, 12, 30])]
    items += [(20, items[1][1]), (21, items[1][1][:90] + " " + prose(20)), (1, items[1][1]), (30, None), (31, " .,"), (None, prose(12)), (32, "same " * 14), (33, "Ünd 中文 é")]
    docs = [prose(r.randint(0, 80)) for _ in range(30)]
    for i, t in items:
        if t and i is not None:
            w = t.split()
            docs += [prose(20) + " " + t.upper() + ", " + prose(5), t, prose(4) + "--" + " ".join(w[:10]) + ". " + prose(9), " ".join(w[-11:]), " ".join(w[1:9])]
    docs += [None, "", " \n\t", "same-same-same " * 9, items[0][1] + "! " + items[1][1] + " " + items[0][1], "x" * 500 + " " + items[2][1]]
    return docs, items


@pytest.mark.parametrize("tight", [False, True])
def test_decontamination(spark, tight, monkeypatch):
    if tight:  # everything is joined by a shuffle, and a full bitmap decides nothing
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common, "BROADCAST_ENTRIES", 0)
        monkeypatch.setattr(winnow, "LEAST_BITS", winnow.BUCKET)
        monkeypatch.setattr(winnow, "MOST_BITS", winnow.BUCKET)
    docs, items = leaky()
    rows = [(None if k == 3 else k, t, 1, "a", [1]) for k, t in enumerate(docs)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, g int, length string, starts array<int>").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: x for k, x in zip([None if k == 3 else k for k in range(len(docs))], contamination(docs, items), strict=True)}
    got = winnow.contaminated(df, bench, keep=["doc_id", "g", "length", "starts"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, held = want[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), held), r
        assert {p for s in r.spans for p in range(s["first"], s["last"] + 1)} == hit
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))
    assert winnow.contaminated(df.limit(0), bench).count() == 0
    assert winnow.contaminated(df, bench.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


def test_decontamination_of_a_text_beyond_a_chunk(spark):
    words = brute.vocabulary(1, 300)
    r = random.Random(2)
    item = " ".join(r.choice(words) for _ in range(30))
    parts = [" ".join(r.choice(words) for _ in range(150_000)) for _ in range(3)]
    text = f"{parts[0]} {item} {parts[1]} {item[:70]} {parts[2]} {item}"
    assert len(text) > common.CHUNK
    got = winnow.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    (n, hit, held), = contamination([text], [(7, item)])
    assert (got.n_words, got.n_hit, got["items"]) == (n, len(hit), held)


# -------------------------------------------------------------------- clusters
def clusters(rows, k=8, rounds=10):
    """[(id, cluster, distance)] and centroids of (id, integer vector) rows."""
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centers = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in rows:
            mine[near(v)[1]].append(v)
        for n, vs in mine.items():
            centers[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, *reversed(near(v))) for i, v in rows), key=str), centers


def test_clusters(spark):
    r = random.Random(3)
    sound = [(i, [r.gauss(3, 0.4) if k % 5 == i % 5 else r.uniform(-1, 1) for k in range(64)]) for i in range(150)]
    sound += [(200 + i, [0.5] * 64) for i in range(12)] + [(7, [-3.25] * 64), (None, [2.0] * 64), (300, [100000.0] + [0.0] * 63), (301, [-0.0001] * 64)]
    inf = float("inf")
    bad = [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [None] + [0.1] * 63), (405, [float("nan")] * 64), (406, [inf] * 64), (407, [0.0] * 63 + [-inf]), (408, [1e30] * 64)]
    df = spark.createDataFrame([(*x, 9, "d") for x in sound + bad], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    rows = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in sound]
    found, model = centroids.clustered(df)
    want, centers = clusters(rows)
    assert sorted((tuple(x) for x in found.collect()), key=str) == want
    assert model.centroids == centers and model.vectors == len(rows)
    assert len(rows) * 10 <= sum(model.exact) < 0.9 * len(rows) * 8 * 10  # bounds leave work out
    whole = centroids.with_inertia(found, model).collect()
    assert {x.inertia for x in whole} == {sum(d for _, _, d in want)}
    for x in whole:
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[x.cluster])).encode()).hexdigest()
    few, model = centroids.clustered(df.where("vec_id in (1, 2, 404) or vec_id is null"), keep=["vec_id"])
    assert len(model.centroids) == 2 and few.count() == 3
    none, model = centroids.clustered(df.where("vec_id >= 400"))
    assert centroids.with_inertia(none, model).count() == 0 and model.centroids == []
    same, _ = centroids.clustered(df.where("vec_id between 200 and 220"))
    assert {x.cluster for x in same.collect()} == {0}  # of equal distances the smaller number


def test_bounds_never_decide():
    r = np.random.default_rng(5)
    v, c, p = (r.integers(-900, 900, (n, 64)) for n in (400, 8, 6))
    c[3] = c[1]
    v[:50] = c[r.integers(0, 8, 50)]
    roots = lambda x: np.stack([np.sqrt(centroids.squared(x, y)) for y in p], 1)
    all_pairs = np.stack([centroids.squared(v, x) for x in c], 1)
    for pivots in (roots(v).astype(np.float32), np.empty((400, 0), np.float32)):
        cluster, d, work = centroids.nearest(v, pivots, c, roots(c)[:, : pivots.shape[1]])
        assert (d == all_pairs.min(1)).all() and (cluster == all_pairs.argmin(1)).all() and work <= 400 * 8
