"""Archives, language labels, packing, quality scores and SentencePiece codes."""

import hashlib
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow.fs
from pyspark.sql import functions as F

from lectern.llm import language, packing, pieces, quality, warc

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_archives(spark, tmp_path):
    long = "<html>" + "longer than the least " * 10
    rows = [(i, f"http://a/{i}\r\nX: y", f"<p>page {i}</p>" * (i % 9), 1) for i in range(60)]
    rows += [(100, None, long, 1), (98, "u", long, 2), (99, "u", long, 3), (None, "u", long, 4), (98, "u", long, 2)]
    rows += [(200, "u", "é" * 50, 1), (201, "u", "é" * 50, 1), (202, "u", None, 1), (203, "u", "", 1), (204, "u", "é" * 49, 1), (205, "u", "é" * 49, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    listed = warc.write_archives(warc.decide(pages), f"file://{tmp_path}/w", archive_bytes=4000)
    got = warc.read_archives(listed).collect()
    assert len(got) == len(rows) == sum(r.records for r in listed.collect())
    payload = defaultdict(set)
    for i, _, html, _ in rows:
        payload[i].add((html or "").encode())
    for r in got:
        text = next(p for p in payload[r.page_id] if hashlib.sha256(p).hexdigest() == r.payload_digest)
        same = [i for i, _, h, _ in rows if i is not None and (h or "").encode() == text]
        first = min(same) if len(text) >= 100 else r.page_id
        assert r.payload_bytes == len(text)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first)), r
        assert r.payload == (text.decode() if r.record_type == "response" else None)
    assert warc.archived(pages.limit(0)).count() == 0


def test_archive_opens_with_its_dictionary(tmp_path):
    records = [warc.record(i, "u", f"<p>{i} and the usual words</p>".encode() * 20, "00", None, "1970-01-01T00:00:00Z") for i in range(300)]
    data = warc.archive(records, 4096, 1 << 20, 3)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.frames(data)) == records
    plain = sum(len(warc.zstd.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < plain
    assert list(warc.frames(warc.archive(records[:1], 4096, 1 << 20, 3))) == records[:1]
    pyarrow.fs.LocalFileSystem()


def lettered(seed, letters, n):
    r = np.random.default_rng(seed)
    return [" ".join("".join(r.choice(list(letters), r.integers(2, 8))) for _ in range(40)) for _ in range(n)]


def test_language_spans(spark):
    a, b, c = lettered(1, "abcdefgh", 40), lettered(2, "ghijklmn", 40), lettered(3, "абвгде", 40)
    rows = [(i, t, x) for x, ts in (("aa", a), ("bb", b), ("cc", c)) for i, t in enumerate(ts)]
    train = spark.createDataFrame(rows + [(99, None, "aa"), (98, "text", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.languages == ["aa", "bb", "cc"]
    new_a, new_b, new_c = lettered(4, "abcdefgh", 1)[0], lettered(5, "ghijklmn", 1)[0], lettered(6, "абвгде", 1)[0]
    mixed = f"{new_a} -- {new_b} | {new_c}"
    tests = [(1, new_a), (2, new_b), (3, new_c), (4, mixed), (5, None), (6, ""), (7, "12 !? "), (None, new_b), (8, "İ" + new_a), (9, (new_b + " ") * 3000)]
    df = spark.createDataFrame(tests, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in language.label_spans(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5, 6, 7, None, 8, 9)] == ["aa", "bb", "cc", "und", "und", "und", "bb", "aa", "bb"]
    assert (got[5].score, got[5].spans, got[1].score) == (0.0, [], 1.0)
    spans = got[4].spans
    assert [s.lang for s in spans] == ["aa", "bb", "cc"]
    assert [mixed[s.start : s.end] for s in spans] == [new_a, new_b, new_c]
    assert language.identified(empty(spark), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identified(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(2)
    for n in (1, 2, 5):
        scores, bounds = r.normal(size=(n + 3, 3)).astype(np.float32), np.array([0, n, n, n + 3])
        got = language.viterbi(scores, bounds, 0.7)
        for a, b in ((0, n), (n, n + 3)):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
            best = max(product(range(3), repeat=b - a), key=value)
            assert abs(value(best) - value(got[a:b].tolist())) < 1e-5


def test_language_held_out(spark, sf_dir):
    from lectern.llm.queries import op3_language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = op3_language(spark, sf_dir).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0


def test_quality_held_out(spark):
    from lectern.llm.queries import op6_quality

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = op6_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (got.predicted == got.quality).mean() > 0.95


def test_quality_of_awkward_rows(spark):
    docs = brute.documents(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)] + [(1, 0), (None, 1), (4, None)], "doc_id long, label int")
    got = quality.classified(docs, labels, F.lit(True))
    assert got.columns == [c for c in docs.columns if c != "quality_score"] + ["quality_score"]
    assert got.count() == docs.count() == got.where("quality_score between 0 and 1").count()
    empty_scores = {r[0] for r in got.where("trim(text) = '' or text is null").select("quality_score").collect()}
    assert len(empty_scores - {None}) >= 1
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r[0] for r in quality.classified(docs, none, F.lit(True)).select("quality_score").collect()} == {0.5}
    assert quality.classified(empty(spark), none, F.lit(True)).count() == 0


def test_quality_votes_are_the_nearest(spark):
    """Votes against all cosines, the projection against the leading singular vectors of the whole matrix."""
    r = np.random.default_rng(4)
    counts, labels = r.poisson(0.05, (300, quality.WIDTH)).astype(np.float32), (r.random(300) < 0.6).astype(float)
    counts[:150, :200] += r.poisson(0.5, (150, 200)).astype(np.float32)
    cells = [np.flatnonzero(c) for c in counts]
    rows = [(i, bytearray(at.astype(np.uint16).tobytes()), bytearray(c[at].tobytes()), y) for i, (at, c, y) in enumerate(zip(cells, counts, labels.tolist()))]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, at binary, n binary, label double").repartition(5), 4)
    assert (model.labels == labels).all() and model.prior == labels.mean()
    x = model.weighted(counts).astype(np.float64)
    _, size, axes = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.linalg.norm(x @ model.axes, axis=0)[0] - size[0]) < 1e-2 * size[0]
    assert abs(axes[0] @ model.axes[:, 0]) > 0.999
    new = r.poisson(0.05, (700, quality.WIDTH)).astype(np.float32)
    cosines = model.project(new) @ model.vectors.T
    near = np.argsort(-cosines, axis=1)[:, : quality.NEIGHBOURS]
    w = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** 4
    want = ((w * labels[near]).sum(1) + 0.1 * model.prior) / (w.sum(1) + 0.1)
    assert np.abs(model.score(new) - want).max() < 1e-6


def test_packing(spark):
    from tokenizers import Tokenizer

    extra = [(60, "x\u001cy z\u0085w v Σας ΟΔΟΣ é .́ n.,m"), (61, "a " * 5000)]
    docs = brute.documents(spark, extra)
    got = packing.packed(docs, BPE, group_texts=8).collect()
    made = Tokenizer.from_file(BPE)
    want = defaultdict(int)
    for _, t, *_ in brute.rows(extra):
        want[np.array([*made.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    own = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    for i, t in brute.texts().items():
        rows = sorted(own[i], key=lambda r: r.start)
        ids = np.array([*made.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        repeats = sum(r.length for r in rows) * 4 // len(ids)
        assert sum(r.length for r in rows) == repeats * rows[0].doc_tokens and rows[0].doc_tokens == len(ids) // 4
        assert all(r.ids == ids[4 * r.start : 4 * (r.start + r.length)] for r in rows), i
        assert [r.start for r in rows[::repeats]] == list(np.cumsum([0, *[r.length for r in rows[::repeats]]])[:-1])
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1])
        assert sum(r.length for r in rows) <= 2048
    digest = packing.digest(packing.packed(docs, BPE)).where("start = 0").first()
    assert 0 <= digest.ids_crc32 < 1 << 32 and zlib.crc32(b"") == 0
    assert packing.packed(empty(spark), BPE).count() == 0


def test_differencing_is_even():
    r = np.random.default_rng(6)
    sizes = r.integers(1, 385, 900)
    window = packing.pack(sizes)
    load = np.bincount(window, sizes)
    assert load.max() <= 2048 and len(load) == -(-sizes.sum() // 2048)
    assert load.max() - load.min() <= 8
    assert packing.pack(np.array([2000, 2000, 2000, 100])).tolist().count(0) >= 1
    assert np.bincount(packing.pack(np.array([1500, 1500, 1500])), [1500] * 3).max() <= 2048


def test_pieces_round_trip(spark):
    docs = brute.documents(spark)
    got = pieces.decoded(pieces.encoded(docs, PIECES), PIECES)
    assert got.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    assert got.where("not (decoded <=> text)").count() == 0
    assert got.where("(text is null) <> (ids is null)").count() == 0
    assert pieces.encoded(empty(spark), PIECES).count() == 0


def plain_viterbi(v, text):
    marked = (pieces.MARK + text.replace(" ", pieces.MARK)) if text else ""
    best = [(0.0, [])] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for begin in range(max(0, end - v.longest), end):
            found = v.scores.get(marked[begin:end])
            if found and (best[end] is None or best[begin][0] + found[0] > best[end][0]):
                best[end] = (best[begin][0] + found[0], [*best[begin][1], found[1]])
        one = marked[end - 1]
        if one not in v.scores and (best[end] is None or best[end - 1][0] + v.unknown > best[end][0]):
            best[end] = (best[end - 1][0] + v.unknown, [*best[end - 1][1], *v.fallback(one)])
    return best[-1][1]


def test_pieces_are_the_best_path(spark):
    v, _ = pieces.loaded(PIECES)
    texts = ["", " ", "the words  of two\nlines", " lead", "trail ", "ünï中文 x\t\ty", *[t for t in brute.texts().values() if t and len(t) < 400]]
    got = {r.doc_id: r.ids for r in pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_viterbi(v, t), t


def test_pieces_equal_the_library():
    """The library's own unigram search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # scores that single precision adds up exactly
        p.score = max(p.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    v = pieces.Vocabulary(PIECES)
    v.scores = {p: (max(s, -40000.0), i) for p, (s, i) in v.scores.items()}
    words = sorted({w for t in brute.texts().values() for w in brute.words(t or "") if w.isascii() and len(w) < 40 and w[0] != "<"})
    assert len(words) > 300
    assert list(v.encode_sorted([pieces.MARK + w for w in words])) == [library.encode(w) for w in words]
