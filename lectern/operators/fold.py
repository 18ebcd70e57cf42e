"""Chapter folds: turn a sequence of paragraphs into chapters of blocks.

A document that arrives as one row is folded inside the row, without a shuffle.
A document that arrives as block rows is folded with running counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import bind, excerpt, regex_split, strip
from lectern.operators.ordered import Levels, neighbour, row_numbers, running_sums
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
CHAPTER_WORD = r"(?iuU)^(chapter|rozdzia[łl]|kapitel|第\s*[0-9一二三四五六七八九十百千]+\s*[章节])"
STANDALONE_TITLE = r"^[A-ZĄĆĘŁŃÓŚŹŻÄÖÜß0-9][^.!?]{0,59}$"
DEFAULT_TITLE = "Chapter 1"
TITLE_LIMIT, TITLE_KEPT, TITLE_TAIL = 80, 77, "..."
# ------------------------------------------------------------ end fixed values


def split_paragraphs(text: Column) -> Column:
    """Trimmed, non-empty paragraphs between blank lines; any line ending."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    pieces = regex_split(lines, r"(?U)\n\s*\n+")
    return F.filter(F.transform(pieces, lambda p: strip(p)), lambda p: p != "")


def looks_like_heading(line: Column) -> Column:
    return bind(strip(line), lambda t: t.rlike(CHAPTER_WORD) | t.rlike(STANDALONE_TITLE))


def join_lines(paragraph: Column) -> Column:
    pieces = F.transform(F.split(paragraph, "\n"), lambda p: strip(p))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def chapter_title(text: Column) -> Column:
    return excerpt(text, TITLE_LIMIT, TITLE_KEPT, TITLE_TAIL)


def fold_array(
    items: Column,
    starts_chapter: Callable[[Column], Column],
    title: Callable[[Column], Column],
    first_title: Column,
    block: Callable[[Column], Column],
) -> Column:
    """Chapters of one row's item array, as array<struct<title, blocks>>.

    A starting item opens a chapter and is no block itself; chapters without
    blocks are dropped. Work is linear: chapters are slices between starts.
    """

    def cut(entries: Column) -> Column:
        marked = F.transform(entries, lambda e, i: F.when(starts_chapter(e), i))
        starts = F.concat(F.array(F.lit(-1)), F.filter(marked, lambda i: i.isNotNull()))
        return bind(starts, lambda s: F.filter(_chapters(entries, s), lambda c: F.size(c["blocks"]) > 0))

    def _chapters(entries: Column, starts: Column) -> Column:
        def chapter(start: Column, k: Column) -> Column:
            after = F.coalesce(F.get(starts, k + 1), F.size(entries))
            body = F.slice(entries, start + 2, after - start - 1)
            name = F.when(start < 0, first_title).otherwise(title(F.get(entries, start)))
            return F.struct(name.alias("title"), F.transform(body, block).alias("blocks"))

        return F.transform(starts, chapter)

    return bind(items, cut)


def _para(text: Column) -> Column:
    return F.struct(F.lit("para").alias("kind"), text.alias("text"))


def text_chapters(text: Column) -> Column:
    """Plain text: single-line headings open chapters; all headings means one chapter of all."""

    def fold(paragraphs: Column) -> Column:
        chapters = fold_array(
            paragraphs,
            lambda p: ~p.contains("\n") & looks_like_heading(p),
            chapter_title,
            F.lit(DEFAULT_TITLE),
            lambda p: _para(join_lines(p)),
        )
        everything = F.array(
            F.struct(
                F.lit(DEFAULT_TITLE).alias("title"),
                F.transform(paragraphs, lambda p: _para(F.replace(p, F.lit("\n"), F.lit(" ")))).alias("blocks"),
            )
        )
        return bind(
            chapters,
            lambda c: F.when((F.size(c) == 0) & (F.size(paragraphs) > 0), everything).otherwise(c),
        )

    return bind(split_paragraphs(text), fold)


def explode_chapters(docs: DataFrame, keys: list[str], chapters: str = "chapters") -> DataFrame:
    """Block rows (chapter_index, title, block_index, kind, text) of nested chapters."""
    opened = docs.select(*keys, F.posexplode(chapters).alias("chapter_index", "chapter"))
    blocks = opened.select(
        *keys, "chapter_index", F.col("chapter.title").alias("title"),
        F.posexplode("chapter.blocks").alias("block_index", "block"),
    )
    return blocks.select(*keys, "chapter_index", "title", "block_index", "block.kind", "block.text")


def catalog_tables(docs: DataFrame, key: str, chapters: str = "chapters") -> dict[str, DataFrame]:
    """Books, chapters and blocks with ordinals; ids are hashes of the document and ordinals."""
    books = docs.drop(chapters).withColumn("book_id", F.xxhash64(key))
    opened = docs.select(key, F.posexplode(chapters).alias("index", "chapter")).select(
        F.xxhash64(key).alias("book_id"), F.xxhash64(key, "index").alias("chapter_id"), "index",
        F.col("chapter.title").alias("title"), F.lit(True).alias("enabled"), "chapter.blocks",
    )
    blocks = opened.select("chapter_id", F.posexplode("blocks").alias("index", "block")).select(
        F.xxhash64("chapter_id", "index").alias("block_id"), "chapter_id", "index", "block.kind", "block.text"
    )
    return {"books": books, "chapters": opened.drop("blocks"), "blocks": blocks}


def fold_rows(
    rows: DataFrame, keys: list[str], levels: Levels, starts: Column, title: Column, first_title: Column
) -> DataFrame:
    """Chapters of documents given as rows: adds chapter_index, title and block_index.

    Rows that start a chapter are consumed; chapters without rows do not count. Keys and the columns of ``levels``
    name a row. Chapters are spans of positions: these are found from keys and ordinals alone, which are all that is
    kept on the way; the rows meet them in one join at the end.
    """
    ordinals = [c for level in levels for c in level]
    opens = F.coalesce(starts, F.lit(False))
    places = rows.select(*keys, *ordinals, opens.cast("bigint").alias("__opens"))
    sums = {"__heads": F.col("__opens"), "__at": F.lit(1).cast("bigint")}
    counted = running_sums(places, keys, levels, sums)
    # Read three times below.
    counted = cut_lineage(counted.withColumn("__group", F.col("__heads") + F.col("__opens")).drop("__heads"))
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("__rows"))
    none = [F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in ordinals]
    heads = (
        counted.filter("__opens = 1")
        .select(*keys, *ordinals, "__group", F.col("__at").alias("__head"))
        .unionByName(sizes.select(*keys, *none, F.lit(0).cast("bigint").alias("__group"), F.lit(-1).cast("bigint").alias("__head")))
        .withColumn("__slab", F.floor(F.col("__group") / 1024))
    )
    order = [["__slab"], ["__group"]]
    spans = neighbour(cut_lineage(heads), keys, order, F.col("__head"), "__next", ahead=True).join(sizes, keys)
    filled = cut_lineage(spans.filter(F.coalesce("__next", "__rows") - F.col("__head") > 1))
    titles = rows.filter(opens).select(*keys, *ordinals, title.alias("__title"))
    chapters = row_numbers(filled, keys, order, "chapter_index").join(titles, [*keys, *ordinals], "left").select(
        *keys, "__group", "__head", "chapter_index",
        F.when(F.col("__group") == 0, first_title).otherwise(F.col("__title")).alias("title"),
    )
    placed = counted.filter("__opens = 0").join(chapters, [*keys, "__group"]).select(
        *keys, *ordinals, "chapter_index", "title", (F.col("__at") - F.col("__head") - 1).alias("block_index")
    )
    return rows.join(placed, [*keys, *ordinals])
