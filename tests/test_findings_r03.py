"""Cases of the third round's findings."""

import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from oracle import duck, rows_of
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions.lexicon import with_lexicon
from lectern.functions.normalize import RULESETS, default_registry, normalize
from lectern.operators import layout as L
from lectern.plans import narration as R
from lectern.queries import all_oracles, all_queries
from lectern.sources import files as S
from lectern.sources.sinks import read_bundles, write_bundles, write_text_files


def _same(spark, folder, name):
    got = all_queries()[name](spark, str(folder))
    cur = duck(str(folder)).execute(all_oracles()[name])
    return rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def _with(spark, folder, sf_dir, **tables):
    """A folder with some tables of its own, the others as given."""
    folder.mkdir()
    for path in Path(sf_dir).iterdir():
        if path.stem not in tables:
            (folder / path.name).symlink_to(path)
    for name, rows in tables.items():
        pq.write_table(rows.toArrow(), folder / f"{name}.parquet")
    return folder


def _orders(spark):
    at = datetime.datetime(1996, 5, 4)
    rows = [(8_999_999, 899_999, at, 1234.5), (900_000, 90_000, at, 1.0), (10, 3, at, 0.5)]
    return spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double")


@pytest.mark.parametrize("language, first", [("en", "seventy-two quintillion, "), ("de", "zweiundsiebzig Trillionen "), ("pl", "siedemdziesiąt dwa tryliony ")])
def test_number_words_of_products_beyond_a_bigint(spark, tmp_path, sf_dir, language, first):
    folder = _with(spark, tmp_path / "sf", sf_dir, orders=_orders(spark))
    got = {r.o_orderkey: r.cardinal for r in all_queries()[f"number_words_{language}"](spark, str(folder)).collect()}
    assert len(got) == 3 and got[8_999_999].startswith(first)


def test_chinese_numbers_of_many_digits(spark, tmp_path, sf_dir):
    assert _same(spark, _with(spark, tmp_path / "sf", sf_dir, orders=_orders(spark)), "number_words_zh")
    cases = {"700000010712749": "七百万亿零一千零七十一万二千七百四十九", "70000010712749": "七十万亿零一千零七十一万二千七百四十九", "100000000": "一亿", "12345678901234567": "一二三四五六七八九零一二三四五六七"}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", N.zh_cardinal(F.col("k")).alias("w"))
    assert {r.k: r.w for r in df.collect()} == cases


def _documents(spark, texts):
    rows = [(i, t, "en", source, len(t)) for i, (source, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", ["line_drop_caps", "block_text"])
def test_big_letters_before_white_space(spark, tmp_path, sf_dir, name):
    long = "and here begins a line that is longer than twenty characters"
    texts = [("src1", f"I am\n{long}\nA\u2003dog\n{long}"), ("src1", f"a\tb\n{long}"), ("src1", f"Oh\n{long}"), ("src1", f"{long}\nb c")]
    assert _same(spark, _with(spark, tmp_path / "sf", sf_dir, documents=_documents(spark, texts)), name)


def test_chinese_whose_second_bytes_are_ascii(spark):
    cases = [("不上一在我一在是在是 " * 20, "big5"), ("一不在上 " * 30, "big5"), ("un café à côté de l'été " * 9, "cp1252"), ("où çà", "cp1252")]
    df = spark.createDataFrame([(t, t.encode(e)) for t, e in cases], "t string, b binary")
    assert all(r.t == r.d for r in df.select("t", S.decode_text(F.col("b")).alias("d")).collect())


def test_documents_of_many_jobs_share_files(spark, tmp_path):
    lines = spark.range(3000).select((F.col("id") % 1000).alias("job_id"), F.floor(F.col("id") / 1000).alias("line_no"), F.concat(F.lit("a\n"), "id").alias("line"))
    write_bundles(lines, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.json"))) <= 64
    back = read_bundles(spark, str(tmp_path / "out")).filter("job_id = 7").orderBy("run", "line_no", "at").collect()
    assert [r.value for r in back] == ["a", "7", "a", "1007", "a", "2007"]


@pytest.mark.parametrize("name, shuffles", [("subtitle_cues", 11), ("srt_documents", 15), ("vtt_documents", 15)])
def test_cues_walk_the_segments_once(spark, sf_dir, name, shuffles):
    plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    print(plan)
    assert plan.count("Window [") <= 3 and plan.count("Exchange hashpartitioning") <= shuffles


def test_sentences_are_dealt_into_short_tasks(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    assert all_queries()["text_zh_number"](spark, sf_dir).rdd.getNumPartitions() >= 8 * cores


@pytest.mark.parametrize("language", list(RULESETS))
def test_word_boundaries_are_tried_only_where_a_match_can_begin(spark, language):
    plan = spark.range(1).select(RULESETS[language].apply(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "(?U)\\b" not in plan and "(?iuU)\\b" not in plan


def test_rules_read_texts_that_have_the_separator(spark):
    cases = [("en", "a\x1e1 and \x1e22.", "a\x1eone and \x1etwenty-two."), ("zh", "1\x1e10010", "一\x1e一万零一十")]
    df = spark.createDataFrame(cases, "l string, t string, want string").withColumn("got", normalize(F.col("t"), F.col("l")))
    assert all(r.got == r.want for r in df.collect())


def test_drop_caps_share_one_sort(spark):
    rows = spark.createDataFrame([(1, 0, "A", 30.0), (1, 1, "B", 15.0), (1, 2, "c d", 6.0)], "b int, line_no int, text string, max_size double")
    merged = L.merge_drop_cap_lines(rows, ["b"], ["line_no"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert [r.text for r in merged.orderBy("line_no").collect()] == ["AB", "c d"]


def test_lexicon_diff_is_the_diff_of_both_plans_in_one_pass(spark):
    kinds = "book_id long, language string, chapters array<struct<title:string,blocks:array<struct<kind:string,text:string>>>>"
    long = " ".join(f"Sentence number {c * 60} in the end." for c in "abcdefghij")
    chapters = [
        [("One", [("para", "The tower."), ("skip", "the note."), ("para", "Nobody there.")]), ("Two", [("para", long), ("para", " ")])],
        [("One", [("para", "Go. the other.")])], [("One", [("para", "  ")])], [("One", [("para", "No rule here.")])], [("One", [("para", "Lost.")])],
    ]
    books = spark.createDataFrame([(i, "fr" if i == 4 else "en", c) for i, c in enumerate(chapters)], kinds)
    rules = [(0, 1, "the ", "thee ", False, True), (1, 2, "Go. ", "", False, True), (2, 1, " ", "x", False, True)]
    entries = spark.createDataFrame(rules, "book_id long, entry int, pattern string, replacement string, is_regex boolean, enabled boolean")
    plain = books.withColumn("lexicon", F.lit(None))
    lexed = with_lexicon(books, entries)
    registry = default_registry(["en"])
    voice, speed, position = F.lit("af_heart"), F.lit(1.0), ["book_id", "segment_index"]
    old, new = (R.with_keys(R.chunk_plan(b.select(*books.columns, *rest), ["book_id"], registry=registry), voice, speed, registry) for b, rest in ((plain, []), (lexed, ["lexicon"])))
    want = sorted(R.run_diff(old, new, position).select(*position, "change").collect())
    assert {r.change for r in want} == {"same", "changed"} and {r.book_id for r in want} == {0, 1, 3}
    diff = R.lexicon_diff(lexed, ["book_id"], voice, speed, registry)
    assert sorted(diff.collect()) == want
    assert "FullOuter" not in diff._jdf.queryExecution().executedPlan().toString()
    large = lexed.withColumn("large", F.col("book_id") == 0)
    assert sorted(R.lexicon_diff(large, ["book_id"], voice, speed, registry).collect()) == want


def test_documents_of_headings_alone_are_prepared_without_those_that_their_texts_settle(spark):
    kinds = "doc long, page int, pos long, x0 double, y0 double, x1 double, y1 double, text string, max_size double"
    block = lambda doc, page, pos, y0, text, size: (doc, page, pos, 40.0, y0, 190.0, y0 + 12, text, size)
    rows = [
        block(1, 1, 1, 100.0, "Chapter 1", 11.0), block(2, 1, 1, 100.0, "Chapter 1", 11.0), block(2, 1, 2, 200.0, "two\nlines", 20.0),
        block(3, 1, 1, 100.0, "Chapter 3", 11.0), block(3, 1, 2, 200.0, "x" * 121, 20.0), block(4, 1, 1, 100.0, "plain", 11.0),
        block(5, 1, 1, 100.0, "Chapter 5", 11.0), block(5, 1, 2, 200.0, "T", 33.0), block(5, 1, 3, 300.0, "\nhe", 11.0), block(7, 1, 1, 100.0, "Chapter 7", 11.0),
        *[block(6, p, 1, 10.0, "run\nning", 11.0) for p in (1, 2, 3)], block(6, 2, 2, 300.0, "Chapter 6", 11.0),
    ]
    blocks = spark.createDataFrame(rows, kinds)
    pages = spark.createDataFrame([(d, 3 if d == 6 else 1, 500.0, 700.0) for d in range(1, 9)], "doc long, n_pages int, width double, height double")
    outline = spark.createDataFrame([(7,)], "doc long")
    assert {r.doc for r in L.settled_by_text(blocks, pages).collect()} == {2, 3}
    want = L.without_chapters(L.prepare(blocks, pages), outline).collect()
    assert {r.doc for r in want} == {1, 6}
    assert sorted(L.headings_alone(blocks, pages, outline).collect()) == sorted(want)


def test_shelves_of_any_area_are_files_of_one_directory(spark, tmp_path, sf_dir):
    rows = [(0, "a", "x/y"), (1, "bé\nc", "x/y"), (300, None, "x/y"), (2, "d", None), (3, "e" * 40_000, "p q+%"), (4, "f", "")]
    docs = spark.createDataFrame([(i, t, "en", a, 1) for i, t, a in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = _with(spark, tmp_path / "sf", sf_dir, documents=docs)
    assert _same(spark, folder, "storage_usage") and _same(spark, folder, "intake_limit")
    out = tmp_path / "out"
    assert write_text_files(docs, str(out), "source", "doc_id", "text") == 6
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == [
        "area=/4.txt", "area=p%20q%2B%25/3.txt", "area=x%2Fy/0.txt", "area=x%2Fy/1.txt", "area=x%2Fy/300.txt", "no-area/2.txt",
    ]
    assert (out / "area=x%2Fy" / "1.txt").read_bytes() == "bé\nc\n".encode() and (out / "area=x%2Fy" / "300.txt").read_bytes() == b"\n"
