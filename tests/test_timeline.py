import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.ordered import neighbour, running_sums
from lectern.plans import publish as P
from lectern.plans import timeline as T
from lectern.sources.sinks import write_documents

MARK = "job_id long, idx long, start_s double, end_s double, title string"


def _split(spark, rows, limit, **kw):
    df = spark.createDataFrame(rows, MARK)
    out = T.split_into_parts(df, limit, **kw).orderBy("job_id", "idx").collect()
    return [(r.job_id, r.idx, r.part_index) for r in out]


def _brute(rows, limit):
    out, job, start, part = [], None, None, 0
    for j, i, s, e, _ in sorted(rows):
        if j != job:
            job, start, part = j, s, 1
        elif e - start > limit:
            start, part = s, part + 1
        out.append((j, i, part))
    return out


def test_parts_golden(spark):
    rows = [(1, k, 40.0 * k, 40.0 * k + 40, str(k)) for k in range(4)] + [(2, 0, 0.0, 500.0, "huge")]
    want = [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 0, 1)]
    assert _split(spark, rows, 100.0) == want
    assert _split(spark, rows, 100.0, fold_limit=0) == want
    for limit in (0.0, -1.0):
        assert [p for _, _, p in _split(spark, rows, limit)] == [1, 2, 3, 4, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_match_brute_force_on_both_paths(spark, seed):
    rng, rows = random.Random(seed), []
    for job in range(4):
        at = 0.0
        for i in range(rng.randint(1, 60)):
            end = at + rng.choice([5.0, 20.0, 90.0, 300.0])
            rows.append((job, i, at, end, "t"))
            at = end
    want = _brute(rows, 250.0)
    assert _split(spark, rows, 250.0) == want
    assert _split(spark, rows, 250.0, fold_limit=0) == want
    assert _split(spark, rows, 250.0, fold_limit=20) == want


@pytest.mark.parametrize("limit", [0.3, 0.7, 1.1, 0.0, -0.5, 2.5])
def test_parts_of_fractional_times_do_not_depend_on_size(spark, limit):
    rng, rows = random.Random(7), [(0, i, i * 0.1, (i + 1) * 0.1, "t") for i in range(60)]
    for job in range(1, 6):
        at = rng.random() * 1000
        for i in range(50):
            end = at + rng.choice([0.1, 0.2, 0.3, 1 / 3, 0.7, 0.0])
            rows.append((job, i, at, end, "t"))
            at = end
    want = _brute(rows, limit)
    assert _split(spark, rows, limit) == want
    assert _split(spark, rows, limit, fold_limit=0) == want


def test_ordered_helpers_match_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), i // 7, i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, slab long, i long, v long")
    got = running_sums(df, ["k"], [["slab"], ["i"]], {"run": F.col("v")})
    got = neighbour(got, ["k"], [["slab"], ["i"]], F.col("v"), "prev")
    got = neighbour(got, ["k"], [["slab"], ["i"]], F.col("v"), "nxt", ahead=True)
    for k in (1, 2):
        mine = [r for r in got.orderBy("i").collect() if r.k == k]
        total = 0
        for n, r in enumerate(mine):
            assert r.run == total
            assert r.prev == (mine[n - 1].v if n else None)
            assert r.nxt == (mine[n + 1].v if n + 1 < len(mine) else None)
            total += r.v


def test_assemble(spark):
    rows = [(1, 0, 24000, 24000, 0.35), (1, 1, 12000, 24000, 0.6), (1, 2, 48000, 24000, 0.0)]
    df = spark.createDataFrame(rows, "job_id long, i int, samples long, sample_rate int, pause_after_s double")
    out = T.assemble(df, ["job_id"], [["i"]]).orderBy("i").collect()
    assert [(r.start_s, r.duration_s) for r in out] == [(0.0, 1.0), (1.35, 0.5), (2.45, 2.0)]
    assert T.total_durations(df, ["job_id"]).first().total_s == pytest.approx(4.45)
    assert T.mixed_rates(df, ["job_id"]).count() == 0
    assert T.mixed_rates(df.union(spark.createDataFrame([(1, 3, 1, 22050, 0.0)], df.schema)), ["job_id"]).count() == 1


def _text(lines):
    return "\n".join(r.line for r in lines.orderBy("line_no").collect()) + "\n"


def test_subtitles(spark):
    cues = spark.createDataFrame(
        [(1, 0, 0.0, 2.345, "Cast off now."), (1, 1, 1.5, 3725.125, "Mind the rope.")],
        "job_id long, i int, start_s double, end_s double, text string",
    )
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    srt, vtt = P.srt_lines(cues, jobs, [["i"]]), P.vtt_lines(cues.filter("i = 0"), jobs, [["i"]])
    assert _text(srt.filter("job_id = 1")) == (
        "1\n00:00:00,000 --> 00:00:02,345\nCast off now.\n\n2\n00:00:01,500 --> 01:02:05,125\nMind the rope.\n"
    )
    assert _text(vtt.filter("job_id = 1")) == "WEBVTT\n\n00:00:00.000 --> 00:00:02.345\nCast off now.\n"
    assert _text(srt.filter("job_id = 2")) == "\n" and _text(vtt.filter("job_id = 2")) == "WEBVTT\n\n\n"
    assert spark.range(1).select(P.srt_timestamp(F.lit(-0.5)).alias("t")).first().t == "00:00:00,000"


def test_descriptions(spark, tmp_path):
    marks = spark.createDataFrame([(1, 0, 0.0, 65.0, "One"), (1, 1, 65.0, 3661.0, "Two"), (1, 2, 3661.0, 3700.0, "Three")], MARK)
    jobs = spark.createDataFrame([(1, "My Book", "Me"), (2, "Bare", None)], "job_id long, title string, author string")
    assert _text(P.chapter_list_lines(marks)) == "0:00 One\n1:05 Two\n1:01:01 Three\n"
    text = P.description_lines(marks, jobs)
    assert _text(text.filter("job_id = 1")) == "My Book\nMe\n\n0:00 One\n1:05 Two\n1:01:01 Three\n"
    assert _text(text.filter("job_id = 2")) == "Bare\n\n\n"
    write_documents(text, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out" / "job_id=1")).collect()
    assert "\n".join(r.value for r in back) == "My Book\nMe\n\n0:00 One\n1:05 Two\n1:01:01 Three"


def test_metadata_and_names(spark):
    marks = spark.createDataFrame([(1, 0, 0.0, 1.5, "a=b;c#d\\e")], MARK)
    jobs = spark.createDataFrame([(1, "T", None)], "job_id long, title string, author string")
    assert _text(P.metadata_lines(marks, jobs)) == (
        ";FFMETADATA1\ntitle=T\nalbum=T\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1500\ntitle=a\\=b\\;c\\#d\\\\e\n"
    )
    row = spark.range(1).select(
        P.part_filename(F.lit("B"), F.lit("mp4"), F.lit(2), F.lit(3)).alias("a"),
        P.part_filename(F.lit("B"), F.lit("mp4"), F.lit(1), F.lit(1)).alias("b"),
        P.part_title(F.lit("B"), F.lit(2), F.lit(3)).alias("c"),
    ).first()
    assert row == ("B - Part 2 of 3.mp4", "B.mp4", "B — Part 2 of 3")
