"""Page layout over positioned text: clean-up, reading order, kinds and chapters.

Blocks are rows (doc, page, pos, x0, y0, x1, y1, text, max_size); ``pos`` is the
extraction order inside a page. Pages are rows (doc, n_pages, width, height).

A page, and a block of lines, is bounded by what fits on paper, so windows over one
page run in one task; a document is not, and is never windowed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.strings import strip
from lectern.operators.fold import CHAPTER_WORD, fold_rows
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
HEADER_ZONE, FOOTER_ZONE = 0.10, 0.90
FULL_WIDTH = 0.65
COLUMN_GAP = 40
MIN_PAGES = 3
BUCKET = 20
PAGE_NUMBER = r"(?iu)^\s*(page\s+)?[ivxlcdm0-9]+\s*(of\s+[ivxlcdm0-9]+)?\s*$"
DROP_CAP_CHARS, DROP_CAP_RATIO = 2, 1.8
FOOTNOTE_ZONE, FOOTNOTE_RATIO = 0.78, 0.85
HEADING_CHARS, HEADING_RATIO = 120, 1.3
FRONT_MATTER, FIRST_TITLE = "Front Matter", "Chapter 1"
# ------------------------------------------------------------ end fixed values


# ------------------------------------------------------------------- drop caps


def _short_word(text: Column) -> Column:
    word = strip(text)
    return (F.length(word) <= DROP_CAP_CHARS) & word.rlike(r"^\p{L}+$") & ~word.rlike(CHAPTER_WORD)


def _merge_forward(rows: DataFrame, keys: list[str], order: list[str], caps: Column) -> DataFrame:
    """Glue each row that ``caps`` selects to the next one, left to right.

    A consumed row cannot start a merge, so in a run of selected rows every
    second one starts. ``caps`` may use the next row as ``nxt``.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = [c for c in ("text", "max_size", "x1", "y1") if c in rows.columns]
    ahead = rows.withColumn("nxt", F.lead(F.struct(*carried)).over(line))
    marked = ahead.withColumn("cap", F.coalesce(caps, F.lit(False))).withColumn("at", F.row_number().over(line))
    # Rows since the last that is not selected: all windows share one sort.
    before = F.coalesce(F.last(F.when(~F.col("cap"), F.col("at")), ignorenulls=True).over(so_far), F.lit(0))
    started = marked.withColumn("starts", F.col("cap") & ((F.col("at") - before) % 2 == 1))
    kept = started.withColumn("consumed", F.lag("starts").over(line)).filter(~F.coalesce("consumed", F.lit(False)))
    merged = {c: F.when(F.col("starts"), F.col(f"nxt.{c}")).otherwise(F.col(c)) for c in carried}
    merged["text"] = F.when(F.col("starts"), F.concat(strip(F.col("text")), F.col("nxt.text"))).otherwise(F.col("text"))
    return kept.withColumns(merged).select(*rows.columns)


def merge_drop_cap_lines(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Inside a block: a lone big letter joins the markedly smaller line after it."""
    caps = (
        _short_word(F.col("text"))
        & (F.col("nxt.max_size") > 0)
        & (F.col("max_size") >= F.col("nxt.max_size") * DROP_CAP_RATIO)
    )
    return _merge_forward(lines, keys, order, caps)


def merge_drop_cap_blocks(blocks: DataFrame) -> DataFrame:
    """Across the ordered blocks of one page; ``blocks`` has body_size and page_no."""
    caps = (
        _short_word(F.col("text"))
        & (F.col("body_size") > 0)
        & (F.col("max_size") >= F.col("body_size") * DROP_CAP_RATIO)
        & F.col("nxt").isNotNull()
    )
    return _merge_forward(blocks, ["doc", "page"], ["page_no"], caps)


def blocks_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Block text and its largest line size; blocks without text are dropped."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n"
    )
    return (
        lines.groupBy(*keys)
        .agg(strip(joined).alias("text"), F.max("max_size").alias("max_size"))
        .filter("text <> ''")
    )


# ---------------------------------------------------------- headers and footers


def signature(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[0-9]+", "#"), r"(?U)\s+", " ")


def zone(y0: Column, y1: Column, height: Column) -> Column:
    return F.when(y1 <= height * HEADER_ZONE, "header").when(y0 >= height * FOOTER_ZONE, "footer")


def with_zones(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    sized = blocks.join(pages, "doc")
    return sized.withColumns(
        {
            "zone": zone(F.col("y0"), F.col("y1"), F.col("height")),
            "signature": signature(F.col("text")),
            "bucket": F.bround(F.col("x0") / BUCKET).cast("bigint"),
        }
    )


RECURRING_KEY = ["doc", "zone", "signature", "bucket"]


def recurring_signatures(zoned: DataFrame) -> DataFrame:
    """Signatures that return on at least half the pages, and three times or more."""
    need = F.greatest(F.lit(3).cast("bigint"), F.floor((F.col("n_pages") + 1) / 2))
    counted = zoned.filter(F.col("zone").isNotNull() & (F.col("n_pages") >= MIN_PAGES)).groupBy(
        *RECURRING_KEY, "n_pages"
    )
    return counted.agg(F.count("*").alias("n")).filter(F.col("n") >= need).select(*RECURRING_KEY)


def is_page_number(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" ")).rlike(PAGE_NUMBER)


def strip_headers_footers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    zoned = with_zones(blocks, pages)
    repeated = recurring_signatures(zoned)
    kept = zoned.join(repeated, RECURRING_KEY, "left_anti")
    number = F.col("zone").isNotNull() & (F.col("n_pages") >= MIN_PAGES) & is_page_number(F.col("text"))
    return kept.filter(~number).select(*blocks.columns)


# --------------------------------------------------------------- reading order



def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``page_no``, the reading position inside the page, from 0.

    Full-width blocks cut a page into bands; a band with exactly two columns is
    read left then right, any other by height. All windows share the shuffle by
    document and page.
    """
    page = Window.partitionBy("doc", "page")
    band = Window.partitionBy("doc", "page", "band", "is_full")
    wide = F.col("x1") - F.col("x0") >= F.col("width") * FULL_WIDTH
    above = page.orderBy("y0", "pos").rowsBetween(Window.unboundedPreceding, -1)
    banded = (
        blocks.join(pages.select("doc", "width"), "doc")
        .withColumn("is_full", F.when(wide, 1).otherwise(0))
        .withColumn("band", F.coalesce(F.sum("is_full").over(above), F.lit(0)))
    )
    by_x = band.orderBy("x0", "pos")
    gap = F.when(F.col("x0") - F.lag("x0").over(by_x) > COLUMN_GAP, 1).otherwise(0)
    clustered = banded.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(by_x))
    two = (F.max("cluster").over(band) == 1) & (F.col("is_full") == 0)
    placed = clustered.withColumns(
        {
            "column": F.when(two, F.col("cluster")).otherwise(0),
            "x_key": F.when(two, 0.0).otherwise(F.col("x0")),
        }
    )
    order = page.orderBy("band", "is_full", "column", "y0", "x_key", "pos")
    return placed.withColumn("page_no", F.row_number().over(order).cast("bigint") - 1).select(
        *blocks.columns, "page_no"
    )


def clean_text(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


# ------------------------------------------------------------------------ kinds


def body_sizes(blocks: DataFrame) -> DataFrame:
    """Font size with most characters in each document; the one read first wins ties.

    ``blocks`` has doc, page, page_no, max_size and text, or its number of characters (``chars``).
    """
    chars = F.col("chars") if "chars" in blocks.columns else F.length("text")
    sizes = blocks.groupBy("doc", F.bround("max_size").alias("size")).agg(
        F.sum(chars).alias("chars"), F.min(F.struct("page", "page_no")).alias("first")
    )
    earliest = F.struct("chars", -F.col("first.page"), -F.col("first.page_no"))
    return sizes.groupBy("doc").agg(F.max_by("size", earliest).alias("body_size"))


def is_footnote(y0: Column, size: Column, height: Column, body: Column) -> Column:
    return (body > 0) & (height > 0) & (y0 >= height * FOOTNOTE_ZONE) & (size <= body * FOOTNOTE_RATIO)


def is_heading(text: Column, size: Column, body: Column) -> Column:
    line = strip(text)
    fits = (F.length(line) <= HEADING_CHARS) & ~line.contains("\n")
    big = (F.length(line) > DROP_CAP_CHARS) & (body > 0) & (size >= body * HEADING_RATIO)
    return fits & (line.rlike(CHAPTER_WORD) | big)


def classify(blocks: DataFrame) -> DataFrame:
    """Add ``kind``: skip (footnote), heading or para. Needs height and body_size."""
    text, size, body = F.col("text"), F.col("max_size"), F.col("body_size")
    kind = (
        F.when(is_footnote(F.col("y0"), size, F.col("height"), body), "skip")
        .when(is_heading(text, size, body), "heading")
        .otherwise("para")
    )
    return blocks.withColumn("kind", kind)


# --------------------------------------------------------------------- chapters

READ_LEVELS = [["page"], ["page_no"]]
OUTPUT = ["doc", "chapter_index", "title", "block_index", "kind", "text"]


def chapters(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """Outline where a document has one, headings otherwise; one fold for both.

    With an outline, a block belongs to the last top-level entry at or before its
    page: entries and blocks are merged into one ordering and folded, so a block
    meets its entry without pairing every block with every entry of the document.
    Without one, heading blocks open the chapters. ``outline``: doc, level, page
    (from 1), pos, title.
    """
    top = outline.groupBy("doc").agg(F.min("level").alias("level"))
    none = F.lit(None).cast("string")
    entries = outline.join(top, ["doc", "level"]).select(
        "doc", (F.col("page") - 1).cast("bigint").alias("page"), F.lit(0).alias("rank"),
        F.col("pos").cast("bigint").alias("page_no"), none.alias("kind"), F.col("title").alias("text"),
        F.lit(True).alias("outlined"),
    )
    body = blocks.join(top.select("doc", F.lit(True).alias("found")), "doc", "left").select(
        "doc", F.col("page").cast("bigint").alias("page"), F.lit(1).alias("rank"), "page_no", "kind", "text",
        F.coalesce("found", F.lit(False)).alias("outlined"),
    )
    entry = F.col("rank") == 0
    folded = fold_rows(
        entries.unionByName(body),
        ["doc"],
        [["page", "rank"], ["page_no"]],
        entry | (~F.col("outlined") & (F.col("kind") == "heading")),
        F.when(entry, F.col("text")).otherwise(strip(F.col("text"))),
        none,
    )
    first = F.when(F.col("outlined"), FRONT_MATTER).otherwise(FIRST_TITLE)
    return folded.withColumns({"title": F.coalesce("title", first), "text": clean_text(F.col("text"))}).select(*OUTPUT)


def chapters_from_outline(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """Only the documents that have an outline."""
    return chapters(blocks.join(outline.select("doc").distinct(), "doc", "left_semi"), outline)


def chapters_from_headings(blocks: DataFrame) -> DataFrame:
    """All documents by their headings, whether or not they have an outline."""
    out = fold_rows(
        blocks, ["doc"], READ_LEVELS, F.col("kind") == "heading", strip(F.col("text")), F.lit(FIRST_TITLE)
    )
    return out.withColumn("text", clean_text(F.col("text"))).select(*OUTPUT)


def without_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents that give no block at all, with the reason."""
    return pages.join(blocks.select("doc").distinct(), "doc", "left_anti").select(
        "doc", F.lit("no extractable text (it may be a scanned document)").alias("error")
    )


def without_chapters(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """Documents (blocks with ``kind``) without an outline whose blocks are headings alone, with the reason."""
    told = blocks.join(outline.select("doc").distinct(), "doc", "left_anti").groupBy("doc").agg(F.max(F.col("kind") != "heading").alias("told"))
    return told.filter(~F.col("told")).select("doc", F.lit("headings but no text below them").alias("error"))


def settled_by_text(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (doc) with a block that stays and is no heading whatever its size, or the letter before it, may be.

    A text of several lines or too many characters is such, also behind a drop cap. Blocks that could be a header or
    footer are left aside, since only the count over all pages tells whether they stay.
    """
    line = strip(F.col("text"))
    long = blocks.filter((F.length(line) > HEADING_CHARS) | line.contains("\n")).select("doc", "y0", "y1")
    sized = long.join(pages.select("doc", "n_pages", "height"), "doc")
    stays = (F.col("n_pages") < MIN_PAGES) | zone(F.col("y0"), F.col("y1"), F.col("height")).isNull()
    return sized.filter(stays).select("doc").distinct()


def headings_alone(blocks: DataFrame, pages: DataFrame, outline: DataFrame) -> DataFrame:
    """``without_chapters`` of blocks that are not prepared: only the documents that their texts leave open are, and only these are kept."""
    known = settled_by_text(blocks, pages).union(outline.select("doc")).distinct()
    open_blocks = cut_lineage(blocks.join(known, "doc", "left_anti"))
    open_pages = cut_lineage(pages.join(open_blocks.select("doc").distinct(), "doc", "left_semi"))
    return without_chapters(prepare(open_blocks, open_pages), outline)


def order_without_text(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, pos, page_no, max_size and chars of the blocks without headers and footers: what is sorted has no text."""
    kept = strip_headers_footers(blocks, pages).withColumn("chars", F.length("text")).drop("text", "y1")
    return reading_order(kept, pages).select("doc", "page", "pos", "page_no", "max_size", "chars")


def sized_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks without headers and footers, with page_no, height and body_size.

    The order is kept without the text, which meets it by document, page and position.
    """
    order = cut_lineage(order_without_text(blocks, pages))
    places = order.select("doc", "page", "pos", "page_no")
    return blocks.join(places, ["doc", "page", "pos"]).join(body_sizes(order), "doc").join(pages.select("doc", "height"), "doc")


def prepare(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks without headers and footers, in reading order, with body size, drop caps and kinds."""
    return classify(merge_drop_cap_blocks(sized_blocks(blocks, pages)))
