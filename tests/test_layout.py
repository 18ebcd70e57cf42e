from pyspark.sql import functions as F

from lectern.operators import layout as L

BLOCK = "doc long, page int, pos long, x0 double, y0 double, x1 double, y1 double, text string, max_size double"
PAGES = "doc long, n_pages long, width double, height double"
OUTLINE = "doc long, level int, page int, pos int, title string"


def _novel(spark):
    """Three pages, two columns, a running head, page numbers, a heading, a drop cap, a footnote."""
    rows = []
    for page in range(3):
        rows += [
            (1, page, 0, 200.0, 20.0, 300.0, 32.0, "SAMPLE NOVEL", 9.0),
            (1, page, 1, 280.0, 200.0, 450.0, 260.0, f"right {page} col-\numn text", 11.0),
            (1, page, 2, 40.0, 200.0, 210.0, 260.0, f"left {page}\ncolumn", 11.0),
            (1, page, 3, 245.0, 670.0, 255.0, 680.0, str(page + 1), 9.0),
        ]
    rows += [
        (1, 0, 4, 40.0, 100.0, 460.0, 120.0, "Opening", 16.0),
        (1, 1, 5, 40.0, 100.0, 60.0, 130.0, "T", 33.0),
        (1, 1, 6, 40.0, 140.0, 200.0, 150.0, "he city stirred and woke at last", 11.0),
        (1, 2, 7, 40.0, 580.0, 210.0, 590.0, "a note", 7.0),
    ]
    return spark.createDataFrame(rows, BLOCK), spark.createDataFrame([(1, 3, 500.0, 700.0), (2, 4, 500.0, 700.0)], PAGES)


def test_novel_by_headings(spark):
    blocks, pages = _novel(spark)
    ready = L.prepare(blocks, pages)
    none = spark.createDataFrame([], OUTLINE)
    got = [(r.chapter_index, r.title, r.kind, r.text) for r in L.chapters(ready, none).orderBy("chapter_index", "block_index").collect()]
    assert got == [
        (0, "Opening", "para", "left 0 column"), (0, "Opening", "para", "right 0 column text"),
        (0, "Opening", "para", "The city stirred and woke at last"), (0, "Opening", "para", "left 1 column"), (0, "Opening", "para", "right 1 column text"),
        (0, "Opening", "para", "left 2 column"), (0, "Opening", "skip", "a note"), (0, "Opening", "para", "right 2 column text"),
    ]
    assert [r.doc for r in L.without_text(pages, ready).collect()] == [2]


def test_novel_by_outline(spark):
    blocks, pages = _novel(spark)
    outline = spark.createDataFrame(
        [(1, 1, 2, 0, "Same page, empty"), (1, 1, 2, 1, "Second"), (1, 2, 3, 2, "deep"), (1, 1, 3, 3, "Third")], OUTLINE
    )
    got = L.chapters(L.prepare(blocks, pages), outline).groupBy("chapter_index", "title").count().orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.title) for r in got] == [(0, "Front Matter"), (1, "Second"), (2, "Third")]


def test_line_drop_caps_consume_pairs(spark):
    lines = spark.createDataFrame(
        [(1, i, t, s) for i, (t, s) in enumerate([("A", 80.0), ("B", 40.0), ("C", 20.0), ("rest", 10.0), ("T", 33.0), ("he end", 11.0)])],
        "doc long, line_no long, text string, max_size double",
    )
    out = L.merge_drop_cap_lines(lines, ["doc"], ["line_no"])
    assert [r.text for r in out.orderBy("line_no").collect()] == ["AB", "Crest", "The end"]
    assert L.blocks_from_lines(out, ["doc"]).first() == (1, "AB\nCrest\nThe end", 40.0)


def test_small_rules(spark):
    row = spark.range(1).select(
        L.signature(F.lit(" Page  12\nof 99 ")).alias("sig"), L.clean_text(F.lit("Grö-\nße und\n  mehr ")).alias("clean"),
        L.is_page_number(F.lit("Page iv\nof 10")).alias("yes"), L.is_page_number(F.lit("Nota bene")).alias("no"),
    ).first()
    assert tuple(row) == ("page # of #", "Größe und mehr", True, False)
