import zipfile

from pyspark.sql import functions as F

from lectern.operators import fold, html, language, structured
from lectern.sources import files as S
from lectern.sources.sinks import write_catalog


def _chapters(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(c.title, [b.text for b in c.blocks]) for c in df.select(fold.text_chapters(F.col("text")).alias("c")).first().c]


def test_text_chapters(spark):
    text = (
        "Before it all.\r\n\r\nChapter 1: Low Water\r\n\r\nThe ferry lay\r\n  on the mud.\r\n \r\n\r\nSecond one.\n\n"
        "Chapter 2\n\nNext part.\n\nchapters of life. And so on."
    )
    assert _chapters(spark, text) == [
        ("Chapter 1", ["Before it all."]),
        ("Chapter 1: Low Water", ["The ferry lay on the mud.", "Second one."]),
        ("Chapter 2", ["Next part."]),
    ]
    assert _chapters(spark, "One Title\n\nOther Title") == [("Chapter 1", ["One Title", "Other Title"])]
    assert _chapters(spark, "  \n\n ") == []
    long = "Chapter " + "x" * 90
    assert _chapters(spark, long + "\n\nbody text here.")[0][0] == long[:77] + "..."


def test_heading_lines(spark):
    cases = {"Rozdział II": True, "第3章 开始": True, "A Short Title": True, "It ended.": False, "lower case": False, "": False, "X" * 61: False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.h for r in df.select("t", fold.looks_like_heading(F.col("t")).alias("h")).collect()} == cases


PAGE = """<!DOCTYPE html><html lang="en-US"><head><title>My &amp; Page</title><script>var x = '<p>no</p>';</script></head>
<body><nav><p>menu</p></nav><header><h1>chrome</h1></header><p>Lead in.</p><h1>First</h1><p>One <b>bold</b> word&#8212;here.</p>
<h3>Inner</h3><blockquote>Quoted.</blockquote><ul><li>item</li></ul><h2>Second</h2><p></p><p>Last&nbsp;</p><footer><p>foot</p></footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    row = df.select(
        html.html_chapters(F.col("html"), html.title(F.col("html"), F.lit("x"))).alias("c"),
        html.title(F.col("html"), F.lit("x")).alias("title"), html.language(F.col("html")).alias("lang"),
    ).first()
    assert (row.title, row.lang) == ("My & Page", "en")
    assert [(c.title, [(b.kind, b.text) for b in c.blocks]) for c in row.c] == [
        ("My & Page", [("para", "Lead in.")]),
        ("First", [("para", "One bold word—here."), ("heading", "Inner"), ("quote", "Quoted."), ("para", "item")]),
        ("Second", [("para", "Last")]),
    ]


def test_html_nesting_and_references(spark):
    cases = {
        "<aside>x<aside>y</aside><p>leak</p></aside><p>kept</p>": [("p", "kept")],
        "<blockquote>Intro<p>inner</p>outro</blockquote>": [("blockquote", "Intro"), ("p", "inner"), ("blockquote", "outro")],
        "<ul><li>one<ul><li>two</li></ul>more</li></ul>": [("li", "one"), ("li", "two"), ("li", "more")],
        "<ul><li>one<li>two</ul><p>a<p>b": [("li", "one"), ("li", "two"), ("p", "a"), ("p", "b")],
        "<blockquote><div>in a <i>box</i></div></blockquote><div>loose</div>": [("blockquote", "in a box")],
        "<nav><p>a</p></NAV ><p>b</p></nav><figure/><p>c</p><header>open": [("p", "b"), ("p", "c")],
        "<p>&iacute;&Aacute;&iquest;&#0008211;&#x0002013;&bogus;&amp;lt;</p>": [("p", "íÁ¿––&bogus;&lt;")],
        "<p>&#1114112;&#xD800;&#0;&#99999999999;&#x1F600;</p>": [("p", "\ufffd\ufffd\ufffd\ufffd\U0001f600")],
        "<script>'<nav>'</script><p>after</p>": [("p", "after")],
        "": [],
    }
    df = spark.createDataFrame([(k, h) for k, h in enumerate(cases)], "k int, html string").repartition(2)
    got = {r.k: [(b.tag, b.text) for b in r.b] for r in df.select("k", html.blocks(F.col("html")).alias("b")).collect()}
    for k, (page, want) in enumerate(cases.items()):
        assert got[k] == want, page


def _plain_walk(tokens):
    """(owner, text) of (tag, closes, text) tokens, by a stack."""
    text_tags = {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "p", "li", "dd", "figcaption"}
    stack, out = [], []
    for tag, closes, text in tokens:
        if closes:
            at = max((i for i, t in enumerate(stack) if t == tag), default=None)
            stack = stack if at is None else stack[:at]
        else:
            if stack and (stack[-1] in {"p", "h1", "h2"} or (stack[-1] == tag and tag in {"li", "dd", "dt"})):
                stack.pop()
            stack.append(tag)
        owner = next((t for t in reversed(stack) if t in text_tags), None)
        if owner and text:
            out.append((owner, text))
    return out


def test_html_walk_against_a_stack(spark):
    """Tag soup of many lengths, deep ones included, against a plain stack."""
    import random

    r, pages = random.Random(6), []
    for n in [1, 2, 3, 5, 10, 17, 50, 400, 3000]:
        tags = ["p", "h1", "h2", "li", "ul", "div", "blockquote", "section", "dd", "dt", "td"]
        pages.append([(r.choice(tags), r.random() < 0.45, r.choice(["", f"w{i}", f"x{i} y"])) for i in range(n)])
    pages.append([(["div", "section"][i % 2], False, f"t{i}") for i in range(2000)] + [("p", False, "end"), ("section", True, "after")])
    made = ["".join(f"<{'/' if c else ''}{t}>{x}" for t, c, x in page) for page in pages]
    df = spark.createDataFrame(list(enumerate(made)), "k int, html string").repartition(4)
    got = {row.k: [(b.tag, b.text) for b in row.b] for row in df.select("k", html.blocks(F.col("html")).alias("b")).collect()}
    for k, page in enumerate(pages):
        assert got[k] == _plain_walk(page), k


def test_length_is_filtered_before_files_are_opened(spark, tmp_path):
    for name, size in [("a", 10), ("b", 3000), ("c", 0)]:
        (tmp_path / name).write_bytes(b"x" * size)
    taken, rejected = S.read_files(spark, str(tmp_path), max_mb=1 / 1024)
    assert sorted(r.length for r in taken.collect()) == [10] and [r.length for r in rejected.collect()] == [3000]
    plan = lambda df: df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(length,1024)" in plan(taken) and "content:binary" in plan(taken)
    for metadata in (rejected, S.file_sizes(spark, str(tmp_path), F.lit("x"))):
        assert "content" not in plan(metadata).split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThan(length,1024)" in plan(rejected)


def test_rejects_and_metadata(spark):
    parts = spark.createDataFrame([(1, "yes", False, "<p>x"), (1, "no", False, "<p>y"), (2, "no", False, "<p>z"), (2, "yes", True, "<p>z"), (2, "yes", False, "<p> "), (3, "yes", False, None)], "doc int, linear string, is_nav boolean, html string")
    assert sorted((r.doc, r.error) for r in structured.spine_rejects(parts).collect()) == [(2, "no text in any spine item"), (3, "no text in any spine item")]
    pages = spark.createDataFrame([(1, "<p>x"), (2, "loose"), (3, None)], "doc int, html string")
    assert sorted(r.doc for r in structured.page_rejects(pages).collect()) == [2, 3]
    nodes = spark.createDataFrame([(1, "notes", 2, "p", "x"), (2, None, 1, "title", "x"), (2, None, 2, "image", "y"), (3, None, 2, "p", "z"), (4, None, 2, "cite", None)], "doc int, body_name string, depth int, tag string, text string")
    assert sorted((r.doc, r.error) for r in structured.section_rejects(nodes).collect()) == [(1, "no main body"), (2, "no text in any section"), (4, "no text in any section")]
    entries = [(1, 5, "title", "Second"), (1, 2, "title", "First"), (1, 3, "creator", "Ann"), (1, 4, "language", "En-GB")]
    docs = spark.createDataFrame([(1, "/a/b.epub"), (2, "/a/The.Book.epub"), (3, "plain")], "doc int, path string")
    got = structured.epub_metadata(spark.createDataFrame(entries, "doc int, pos int, name string, value string"), docs).collect()
    assert {tuple(r) for r in got} == {(1, "First", "Ann", "en"), (2, "The.Book", None, "und"), (3, "plain", None, "und")}


def test_sniff_and_resolve(spark, tmp_path):
    for name, member, body in [("a.bin", "mimetype", "application/epub+zip"), ("b.bin", "word/document.xml", "<x/>"), ("c.bin", "other", "x")]:
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, body)
    (tmp_path / "d.txt").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "e.xyz").write_bytes(b"{\\rtf1}")
    (tmp_path / "f.xyz").write_bytes(b"\xef\xbb\xbf <?xml version='1.0'?><FictionBook>")
    (tmp_path / "g.xyz").write_bytes(b"  <HTML>")
    (tmp_path / "h.xyz").write_bytes(b"." * 60 + b"BOOKMOBI" + b"." * 10)
    (tmp_path / "i.TXT").write_bytes(b"plain")
    (tmp_path / "j.xyz").write_bytes(b"?")
    files, rejected = S.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.sniffed, r.parser) for r in S.resolve_parsers(files).collect()}
    assert got == {
        "a.bin": ("epub", "epub"), "b.bin": ("docx", "docx"), "c.bin": ("", None), "d.txt": ("pdf", "pdf"), "e.xyz": ("rtf", "converter"),
        "f.xyz": ("fb2", "fb2"), "g.xyz": ("html", "html"), "h.xyz": ("mobi", "converter"), "i.TXT": ("", "txt"), "j.xyz": ("", None),
    }
    assert rejected.count() == 0
    small, big = S.split_by_size(spark.createDataFrame([("a", 10), ("b", 2 << 20)], "path string, length long"), 1)
    assert [r.path for r in small.collect()] == ["a"] and "1MB" in big.first().error


def test_parser_registry(spark):
    resolved = spark.createDataFrame([("a", "txt", None), ("b", "epub", None), ("c", None, "no parser")], "path string, parser string, error string")
    registry = S.ParserRegistry()
    registry.register("txt", lambda df: df.select("path", F.lit("para").alias("kind")))
    assert [r.path for r in registry.parse(resolved)["txt"].collect()] == ["a"]
    assert {r.path: r.error for r in registry.unregistered(resolved).collect()} == {"b": "no decoder registered for epub", "c": "no parser"}


def test_decode(spark):
    texts = [("Zażółć gęślą jaźń", "cp1250"), ("Zażółć", "utf-8"), ("Où est l’été, garçon ?".replace("’", "'"), "cp1252"), ("plain", "ascii")]
    df = spark.createDataFrame([(t, bytearray(t.encode(e))) for t, e in texts], "t string, b binary")
    assert all(r.t == r.d for r in df.select("t", S.decode_text(F.col("b")).alias("d")).collect())


def test_structured_books(spark):
    parts = spark.createDataFrame(
        [("d", 0, "yes", True, "nav.xhtml", "<p>toc</p>"), ("d", 1, "yes", False, "a.xhtml", "<h1>Own</h1><p>x</p>"),
         ("d", 2, "no", False, "b.xhtml", "<p>skip</p>"), ("d", 3, "yes", False, "c.xhtml", "<p> </p>"), ("d", 4, "yes", False, "e.xhtml", "<p>y</p>"),
         ("d", 5, "yes", False, "f.xhtml", "<p>z</p><header><p>kept</p></header>")],
        "doc string, spine_pos long, linear string, is_nav boolean, href string, html string",
    )
    toc = spark.createDataFrame([("d", "f.xhtml#2", 2, "Late"), ("d", "f.xhtml#1", 1, "Early")], "doc string, href string, pos int, title string")
    got = structured.epub_chapters(parts, toc).orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.title, len(r.blocks)) for r in got] == [(0, "Own", 2), (1, "Chapter 2", 1), (2, "Early", 2)]
    paras = spark.createDataFrame(
        [("d", 0, 0, "Normal", "intro"), ("d", 0, 1, "Heading 1", "One"), ("d", 0, 2, "heading 2", "sub"), ("d", 0, 3, "Intense Quote", "q"),
         ("d", 0, 4, "Heading 1", "Empty"), ("d", 0, 5, "Heading 1", "Two"), ("d", 0, 6, None, "end")],
        "doc string, slab int, pos int, style string, text string",
    )
    got = structured.docx_chapters(paras, [["slab"], ["pos"]]).orderBy("chapter_index", "block_index").collect()
    assert [(r.chapter_index, r.title, r.block_index, r.kind, r.text) for r in got] == [
        (0, "Chapter 1", 0, "para", "intro"), (1, "One", 0, "heading", "sub"), (1, "One", 1, "quote", "q"), (2, "Two", 0, "para", "end")]
    xml = "<FictionBook xmlns='http://x'><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title><lang>PL-pl</lang></title-info></description></FictionBook>"
    row = spark.createDataFrame([(xml,)], "x string").select(*structured.fb2_metadata(F.col("x"))).first()
    assert tuple(row) == ("T", "A B", "pl")


def test_language(spark):
    blocks = spark.createDataFrame([("a", 0, i, "x" * 300) for i in range(4)] + [("b", 0, 0, "short")], "d string, slab int, pos int, text string")
    got = {r.d: r.sample for r in language.language_sample(blocks, "d", [["slab"], ["pos"]]).collect()}
    assert len(got["a"]) == 800 and got["b"] == "short"
    train = [("en", "the weather is nice and the children are playing in the garden"), ("de", "das Wetter ist schön und die Kinder spielen im Garten")]
    model = language.train(spark.createDataFrame(train, "language string, sample string"))
    probe = spark.createDataFrame([(1, "the children are nice and playing"), (2, "die Kinder spielen und das ist schön"), (3, "tiny")], "k int, sample string")
    for bound in (0, 10**6):
        assert {r.k: r.detected for r in language.detect(probe, model, "k", bound).collect()} == {1: "en", 2: "de", 3: None}
    row = spark.range(1).select(
        language.resolve(F.lit("und"), F.lit("pl")).alias("a"), language.resolve(F.lit("fr"), F.lit("pl")).alias("b"),
        language.resolve(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert tuple(row) == ("pl", "fr", "en")


def test_persist(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Chapter 1\n\nHello there, you.\n\nChapter 2\n\nGood bye, you.")], "doc_id long, text string")
    tables = fold.catalog_tables(docs.select("doc_id", fold.text_chapters(F.col("text")).alias("chapters")), "doc_id")
    write_catalog(tables, str(tmp_path))
    back = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    joined = back["books"].join(back["chapters"], "book_id").join(back["blocks"].withColumnRenamed("index", "b"), "chapter_id")
    assert sorted((r["index"], r.title, r.b, r.text) for r in joined.collect()) == [(0, "Chapter 1", 0, "Hello there, you."), (1, "Chapter 2", 0, "Good bye, you.")]


def test_encodings(spark):
    russian = "Паром ушёл в полдень. Никто не махал рукой, и на берегу остались только чайки. " * 3
    simple = "渡船中午就走了。没有人挥手,岸上只有海鸟。他们在那里等了一个下午,不知道要到哪里去。"
    full = "渡船中午就走了。沒有人揮手,岸上只有海鳥。他們在那裡等了一個下午,不知道要到哪裡去。"
    polish, french = "Prom odpłynął w południe, żaden człowiek nie machał ręką.", "Le bac est parti à midi ; personne n'a agité la main, hélas."
    cases = [
        (russian, "cp1251"), (russian, "koi8-r"), (simple, "gb18030"), (full, "big5"), (polish, "cp1250"), (french, "cp1252"),
        (french, "utf-16"), (simple, "utf-16"), (french, "utf-16-le"), (french, "utf-16-be"), (full, "utf-8"), (polish, "utf-8-sig"), ("", "utf-8"),
    ]
    rows = [(k, bytearray(text.encode(name))) for k, (text, name) in enumerate(cases)]
    df = spark.createDataFrame([*rows, (99, None)], "k int, content binary").repartition(3)
    got = {r.k: r.t for r in df.select("k", S.decode_text(F.col("content")).alias("t")).collect()}
    for k, (text, name) in enumerate(cases):
        assert got[k] == text, name
    assert got[99] is None
    texts = spark.createDataFrame([("a", None), ("b", " \n\t"), ("c", "x")], "path string, text string")
    assert {r.path: r.error for r in S.text_rejects(texts).collect()} == {"a": "no text encoding fits", "b": "contains no text"}


def test_language_of_documents_not_trained_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = docs.select("doc_id", F.col("lang").alias("language"), F.substring("text", 1, 800).alias("sample")).cache()
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(samples.filter(~held_out).select("language", "sample"))
    found = language.detect(samples.filter(held_out & (F.length("sample") >= 100)), model, "doc_id").join(samples, "doc_id").collect()
    assert len(found) > 20 and sum(r.detected == r.language for r in found) >= 0.95 * len(found)
