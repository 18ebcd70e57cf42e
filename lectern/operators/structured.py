"""Structured book formats, given as tables of their decoded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import blank_to_null, strip
from lectern.operators import html as H
from lectern.operators.fold import chapter_title, fold_rows
from lectern.operators.ordered import Levels, row_numbers
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
QUOTE_STYLES = ["quote", "intense quote"]
QUOTE_TAGS = ["cite", "epigraph"]
# ------------------------------------------------------------ end fixed values


def epub_chapters(parts: DataFrame, toc: DataFrame) -> DataFrame:
    """One row per readable spine item: chapter_index, title and its blocks as an array.

    ``parts``: doc, spine_pos, linear, is_nav, href, html. ``toc``: doc, href, pos, title.
    """
    spine = parts.filter((F.col("linear") != "no") & ~F.col("is_nav")).select(
        "doc", "spine_pos", F.substring_index("href", "#", 1).alias("href"),
        H.blocks(F.col("html"), H.SKIPPED_TAGS_EPUB).alias("found"),
    )
    titles = toc.groupBy("doc", F.substring_index("href", "#", 1).alias("href")).agg(
        F.min_by("title", "pos").alias("toc_title")
    )
    slab = F.floor(F.col("spine_pos") / 1024)
    # Numbering reads the items again, so the parsed blocks are kept.
    readable = cut_lineage(spine.filter(F.size("found") > 0).withColumn("slab", slab))
    order = row_numbers(readable.select("doc", "slab", "spine_pos"), ["doc"], [["slab"], ["spine_pos"]], "chapter_index")
    named = readable.drop("slab").join(order.drop("slab"), ["doc", "spine_pos"]).join(titles, ["doc", "href"], "left")
    fallback = F.concat(F.lit("Chapter "), F.col("chapter_index") + 1)
    return named.select(
        "doc", "chapter_index", "spine_pos",
        F.coalesce(blank_to_null(F.col("toc_title")), H.first_heading(F.col("found")), fallback).alias("title"),
        F.transform("found", H.as_block).alias("blocks"),
    )


def epub_metadata(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, title, author, language): the first Dublin Core entry of each name.

    ``entries``: doc, pos, name (title, creator, language), value. ``docs``: doc, path; a book without a title has
    the name of its file, without its extension.
    """
    first = lambda name: F.min_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.col("pos")))
    found = entries.groupBy("doc").agg(first("title").alias("title"), first("creator").alias("author"), first("language").alias("code"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return docs.join(found, "doc", "left").select(
        "doc", F.coalesce("title", stem).alias("title"), "author",
        F.lower(F.substring_index(F.coalesce("code", F.lit("und")), "-", 1)).alias("language"),
    )


# ---------------------------------------------------------------------- rejects


def _rejects(docs: DataFrame, error: Column) -> DataFrame:
    return docs.select("doc", error.alias("error")).filter("error IS NOT NULL")


def page_rejects(pages: DataFrame) -> DataFrame:
    """Web pages (doc, html) that give no block, with the reason."""
    return _rejects(pages, F.when(~F.coalesce(H.readable(H.blocks(F.col("html"))), F.lit(False)), F.lit("no text in any text element")))


def spine_rejects(parts: DataFrame) -> DataFrame:
    """Books none of whose spine items gives a block; ``parts`` as for ``epub_chapters``."""
    told = (F.col("linear") != "no") & ~F.col("is_nav")
    found = F.coalesce(F.when(told, H.readable(H.blocks(F.when(told, F.col("html")), H.SKIPPED_TAGS_EPUB))), F.lit(False))
    return _rejects(parts.groupBy("doc").agg(F.max(found).alias("found")), F.when(~F.col("found"), F.lit("no text in any spine item")))


def section_rejects(nodes: DataFrame) -> DataFrame:
    """Books without an unnamed body, or without text in its sections; ``nodes`` as for ``fb2_chapters``."""
    main = F.col("body_name").isNull()
    told = F.col("tag").isin("title", "subtitle", "p", *QUOTE_TAGS) & ~((F.col("tag") == "title") & (F.col("depth") == 1))
    found = nodes.groupBy("doc").agg(
        F.max(main).alias("main"), F.max(F.coalesce(main & told & (strip(F.col("text")) != ""), F.lit(False))).alias("found")
    )
    return _rejects(found, F.when(~F.col("main"), F.lit("no main body")).when(~F.col("found"), F.lit("no text in any section")))


def paragraph_rejects(paras: DataFrame) -> DataFrame:
    """Documents all of whose paragraphs (doc, text) are blank."""
    found = paras.groupBy("doc").agg(F.max(F.coalesce(strip(F.col("text")) != "", F.lit(False))).alias("found"))
    return _rejects(found, F.when(~F.col("found"), F.lit("no text in any paragraph")))


# ------------------------------------------------------------------------ parts


def pick_cover(items: DataFrame) -> DataFrame:
    """Cover item of each document: named by metadata, else by property, else an image so called.

    ``items``: doc, pos, id, media_type, properties, is_meta_cover.
    """
    rank = (
        F.when(F.col("is_meta_cover"), 1)
        .when(F.array_contains(F.split("properties", " "), "cover-image"), 2)
        .when(F.col("media_type").startswith("image/") & F.lower("id").contains("cover"), 3)
    )
    ranked = items.withColumn("rank", rank).filter("rank IS NOT NULL")
    best = F.min_by(F.struct("id", "media_type"), F.struct("rank", "pos"))
    return ranked.groupBy("doc").agg(best.alias("cover")).select("doc", "cover.id", "cover.media_type")


def classify_style(style: Column) -> tuple[Column, Column]:
    """Block kind and heading level of a paragraph style."""
    level = F.regexp_extract(style, r"(?i)^heading\s+([0-9]+)$", 1)
    kind = (
        F.when(level != "", "heading").when(F.lower(strip(style)).isin(QUOTE_STYLES), "quote").otherwise("para")
    )
    return kind, blank_to_null(level).cast("int")


def docx_chapters(paras: DataFrame, levels: Levels) -> DataFrame:
    """``paras``: doc, pos, style, text (and the columns of ``levels``). Heading 1 opens a chapter."""
    kind, level = classify_style(F.coalesce("style", F.lit("")))
    rows = paras.withColumns({"text": strip(F.col("text")), "kind": kind, "level": level}).filter("text <> ''")
    return fold_rows(
        rows, ["doc"], levels, F.col("level") == 1, chapter_title(F.col("text")), F.lit("Chapter 1")
    ).drop("level")


def fb2_chapters(nodes: DataFrame, levels: Levels) -> DataFrame:
    """``nodes``: doc, pos, body_name, section_no, depth, tag, text. Sections of the unnamed body."""
    text = strip(F.col("text"))
    main = nodes.filter("body_name IS NULL").withColumn("text", text)
    own_title = (F.col("tag") == "title") & (F.col("depth") == 1)
    titles = main.filter(own_title & (F.col("text") != "")).groupBy("doc", "section_no").agg(
        F.min_by("text", "pos").alias("own")
    )
    kind = (
        F.when(F.col("tag").isin("title", "subtitle"), "heading")
        .when(F.col("tag").isin(QUOTE_TAGS), "quote")
        .when(F.col("tag") == "p", "para")
    )
    body = main.filter(~own_title & (F.col("text") != "")).withColumn("kind", kind).filter("kind IS NOT NULL")
    body = row_numbers(body, ["doc", "section_no"], levels, "block_index")
    sections = body.select("doc", "section_no").distinct().withColumn("slab", F.floor(F.col("section_no") / 1024))
    sections = row_numbers(sections, ["doc"], [["slab"], ["section_no"]], "chapter_index").drop("slab")
    fallback = F.concat(F.lit("Chapter "), F.col("section_no") + 1)
    named = sections.join(titles, ["doc", "section_no"], "left").withColumn("title", F.coalesce("own", fallback))
    return body.join(named.drop("own"), ["doc", "section_no"])


def fb2_metadata(xml: Column) -> tuple[Column, Column, Column]:
    """Title, author (first and last name) and language of a book's XML."""

    def value(path: str) -> Column:
        return blank_to_null(strip(F.xpath_string(xml, F.lit(path))))

    author = F.concat_ws(
        " ", value("//title-info/author[1]/first-name"), value("//title-info/author[1]/last-name")
    )
    lang = F.lower(F.substring_index(value("//title-info/lang"), "-", 1))
    return value("//title-info/book-title"), blank_to_null(author), F.coalesce(lang, F.lit("und"))
