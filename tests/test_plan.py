import hashlib

from pyspark.sql import functions as F

from lectern.functions.lexicon import apply_lexicon, with_lexicon
from lectern.functions.normalize import NormalizerRegistry
from lectern.operators import catalog as C
from lectern.plans import narration as R

BOOKS = "book_id long, language string, chapters array<struct<title:string,blocks:array<struct<kind:string,text:string>>>>"
LEXICON = "book_id long, entry int, pattern string, replacement string, is_regex boolean, enabled boolean"


def _plan(spark, chapters, entries=(), language="en"):
    books = spark.createDataFrame([(1, language, chapters)], BOOKS)
    books = with_lexicon(books, spark.createDataFrame(list(entries), LEXICON))
    return R.chunk_plan(books, ["book_id"]).orderBy("segment_index").collect()


def test_pauses_and_skip_blocks(spark):
    long = " ".join(f"Sentence number with some length in it {c * 40}." for c in "abcdefghijkl")
    got = _plan(spark, [
        ("One", [("para", long), ("para", "Two here."), ("skip", "a footnote.")]),
        ("Two", [("para", "Three here."), ("skip", "another.")]),
    ])
    assert [r.segment_index for r in got] == list(range(len(got)))
    assert [r.pause_after_s for r in got] == [0.35] * (len(got) - 3) + [0.6, 1.2, 0.0]
    assert all(len(r.text) <= 350 for r in got)


def test_empty_last_block_takes_no_pause(spark):
    got = _plan(spark, [("One", [("para", "Text."), ("para", " ")]), ("Two", [("para", "End.")])])
    assert [(r.text, r.pause_after_s) for r in got] == [("Text.", 0.6), ("End.", 0.0)]


def test_lexicon_runs_before_normalization(spark):
    entries = [
        (1, 1, "Zaltharion", "Zal-thar-ee-on", False, True), (1, 2, r"(\d+)km", r"\1 kilometers for $5", True, True),
        (1, 3, "off", "on", False, False), (1, 4, r"(?P<a>x)y", r"\g<a>-\g<1>", True, True),
    ]
    got = _plan(spark, [("One", [("para", "Zaltharion ran 5km off xy.")])], entries)
    assert got[0].text == "Zal-thar-ee-on ran five kilometers for five dollars off x-x."


def test_changed_lexicon_changes_only_its_chunks(spark):
    chapters = [("One", [("para", "Zaltharion spoke."), ("para", "Nobody answered.")])]
    keys = []
    for entries in ([], [(1, 1, "Zaltharion", "Zal", False, True)]):
        books = with_lexicon(spark.createDataFrame([(1, "en", chapters)], BOOKS), spark.createDataFrame(entries, LEXICON))
        keys.append(R.with_keys(R.chunk_plan(books, ["book_id"]), F.lit("af_heart"), F.lit(1.0)))
    assert {r.segment_index: r.change for r in R.run_diff(*keys, ["book_id", "segment_index"]).collect()} == {0: "changed", 1: "same"}
    report = R.reuse_report(*keys).first()
    assert (report.reused, report.fresh) == (1, 1)


def test_key_fields(spark):
    base = ("text", "voice", "engine", "v1", 1.0, "en-1")
    rows = [base] + [tuple("x" if i == k and i != 4 else (2.0 if i == k else v) for i, v in enumerate(base)) for k in range(6)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e double, f string")
    got = [r.k for r in df.select(R.content_key(*[F.col(x) for x in "abcdef"]).alias("k")).collect()]
    assert len(set(got)) == 7
    assert got[0] == hashlib.sha256("\x1f".join(["text", "voice", "engine", "v1", "1.000", "en-1"]).encode()).hexdigest()
    assert df.select(R.content_key(F.lit(None).cast("string"), *[F.col(x) for x in "bcdef"]).alias("k")).first().k is None


def test_provider_sees_each_missing_key_once(spark):
    seg = spark.createDataFrame([("k1", "one two three"), ("k1", "one two three"), ("k2", "four"), ("k3", "five")], "cache_key string, text string")
    cache = spark.createDataFrame([("k3", 9.0)], "cache_key string, duration_s double")
    seen = []

    def provider(requests):
        seen.extend(r.cache_key for r in requests.collect())
        return R.estimated_durations(requests)

    got = {r.cache_key: r.duration_s for r in R.resolve_durations(seg, cache, provider).collect()}
    assert sorted(seen) == ["k1", "k2"] and got == {"k1": 1.2, "k2": 0.4, "k3": 9.0}


def test_failures(spark):
    seg = spark.createDataFrame([(1, 0, "fine", "a"), (1, 1, "x" * 90, "b"), (1, 2, "no answer", "c")], "job_id long, i int, text string, cache_key string")
    res = spark.createDataFrame([("a", 1.0, None), ("b", None, "boom")], "cache_key string, duration_s double, error string")
    merged = R.merge_results(seg, res)
    assert {r.i: (r.status, r.duration_s) for r in merged.collect()} == {0: ("done", 1.0), 1: ("failed", None), 2: ("queued", None)}
    assert R.failure_summary(merged, ["i"]).first().message == f'synthesis failed on 1 of 3 chunks; first: "{"x" * 80}…": boom'


def test_user_normalizer(spark):
    registry = NormalizerRegistry()
    registry.register("xx", lambda t: F.upper(t), "xx-7")
    df = spark.createDataFrame([("a", "xx"), ("b", "yy")], "t string, language string")
    got = df.select(registry.normalize(F.col("t"), F.col("language")).alias("n"), registry.version(F.col("language")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("A", "xx-7"), (None, None)]
    assert "yy" in registry.unsupported(df).first().error


def test_lexicon_validity(spark):
    rows = [(1, 1, "a(b", "", True, True), (1, 2, "a(b", "", False, True), (1, 3, "a+", "", True, True)]
    got = C.check_lexicon(spark.createDataFrame(rows, LEXICON)).collect()
    assert {r.entry: r.error for r in got} == {1: "invalid regex: a(b", 2: None, 3: None}


def test_lexicon_rules_that_cannot_run_are_set_aside(spark):
    """Each rule alone on one text: the result, or the reason why the text stays as it is."""
    cases = [
        ("(?P<a>b)(?P=a)", "<\\g<a>>", "abba", "a<b>a", None), ("(a)?(?(1)b|c)", "x", "abc", "abc", "invalid regex"),
        ("(b)", "\\9", "abc", "abc", "invalid replacement"), ("b", "\\n", "abc", "a\nc", None),
        ("[a&&b]", "_", "a&b", "___", None), ("b", "\\q", "abc", "abc", "invalid replacement"),
        ("b", "\\\\", "abc", "a\\c", None), ("b", "$1", "abc", "a$1c", None), ("(b)(c)", "\\2\\1", "abc", "acb", None),
        ("[[]x", "y", "[x", "[x", "invalid regex"), ("a(b", "y", "ab", "ab", "invalid regex"), ("c\\Z", "d", "cc", "cd", None),
        ("\\w+", "w", "żółw", "w", None), ("b", "\\g<name>", "abc", "abc", "invalid replacement"), (None, "x", "abc", "abc", "incomplete"),
    ]
    rows = [(k, 1, p, r, True, True) for k, (p, r, *_) in enumerate(cases)]
    entries = spark.createDataFrame(rows, LEXICON)
    books = spark.createDataFrame([(k, c[2]) for k, c in enumerate(cases)], "book_id long, text string")
    got = {r.book_id: r.t for r in with_lexicon(books, entries).select("book_id", apply_lexicon(F.col("text"), F.col("lexicon")).alias("t")).collect()}
    errors = {r.book_id: r.error for r in C.check_lexicon(entries).collect()}
    for k, (pattern, _, _, want, reason) in enumerate(cases):
        assert got[k] == want, pattern
        assert (errors[k] or "").startswith(reason or "") and (errors[k] is None) == (reason is None), (pattern, errors[k])


def test_every_book_is_planned_or_rejected(spark):
    one = [("One", [("para", "Some words here.")])]
    books = spark.createDataFrame(
        [(1, "en", one), (2, "zh", one), (3, "fr", one), (4, None, one), (5, "en", []), (6, "de", [("A", [("skip", "note")])]), (7, "pl", None)], BOOKS
    )
    for registry, planned in ((None, {1, 2}), (NormalizerRegistry(), set())):
        plan = {r.book_id for r in R.chunk_plan(books, ["book_id"], registry=registry).collect()}
        rejects = {r.book_id: r.error for r in R.plan_rejects(books, ["book_id"], registry).collect()}
        assert plan == planned and plan | rejects.keys() == set(range(1, 8)) and not plan & rejects.keys()
    assert rejects[3] == "unsupported language: fr" and rejects[4] == "no language"


def test_large_books_are_dealt_out(spark):
    """A book by its blocks gives the plan of a book in its row, and its blocks are in many tasks."""
    r = iter(range(10_000))
    prose = lambda n: " ".join(f"Sentence {next(r)} costs $5 and ends here." for _ in range(n))
    chapters = [(f"C{c}", [("skip" if b % 7 == 3 else "para", prose(1 + b % 12) if b % 5 else " ") for b in range(40)]) for c in range(6)]
    rows = [(1, "en", chapters), (2, "de", chapters[:1]), (3, "en", [("Only", [("skip", "x")])]), (4, None, chapters[:1])]
    books = spark.createDataFrame(rows, BOOKS).withColumn("lexicon", F.lit(None).cast("array<struct<entry:int,is_regex:boolean,pattern:string,replacement:string>>"))
    small = R.chunk_plan(books, ["book_id"])
    large = R.chunk_plan(books.withColumn("large", F.col("book_id") != 2), ["book_id"])
    assert large.columns == small.columns and [f.dataType for f in large.schema] == [f.dataType for f in small.schema]
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        spread = R.plan_of_blocks(R.spoken_blocks(books.filter("book_id = 1"), ["book_id"]), ["book_id"])
        assert spread.groupBy(F.spark_partition_id()).count().count() >= 3
    finally:
        spark.conf.unset(coalesce)


def test_stage_intervals(spark):
    events = [
        (1, "a", "progress", 0.1), (1, "a", "start", None), (1, "a", "progress", 0.4), (1, "b", "start", None), (1, "a", "finish", None),
        (1, "a", "progress", 0.9), (1, "a", "start", None), (1, "b", "progress", 0.2), (1, "x", "cancel", None), (1, "b", "finish", None),
        (2, "x", "cancel", None), (2, "a", "start", None), (3, "a", "progress", 0.3), (4, "a", "start", None), (4, "a", "start", None),
    ]
    df = spark.createDataFrame([(j, s, k, p, i // 4, i, i) for i, (j, s, k, p) in enumerate(events)], "job_id int, stage string, kind string, progress double, day int, ts int, event_id int")
    got = {tuple(r) for r in R.stage_intervals(df, [["day"], ["ts", "event_id"]]).collect()}
    assert got == {
        (1, "a", 1, 1, 1.0, 4, "done"), (1, "a", 2, 6, 0.0, None, "running"), (1, "b", 1, 3, 0.2, None, "running"),
        (4, "a", 1, 13, 0.0, None, "running"), (4, "a", 2, 14, 0.0, None, "running"),
    }
    assert {tuple(r) for r in R.job_outcomes(df).collect()} == {(1, "cancelled", True), (2, "cancelled", False), (3, "queued", False), (4, "running", True)}
