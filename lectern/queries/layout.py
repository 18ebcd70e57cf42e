"""Layout queries: line items as positioned blocks, suppliers as documents, ship years as pages."""

from pyspark.sql import functions as F

from lectern.functions.strings import WHITESPACE
from lectern.operators import layout as L
from lectern.queries.ingest import LINES, lines
from lectern.queries.registry import query, table
from lectern.queries.views import sql
from lectern.session import cut_lineage

_CHAPTER_WORD = "'(?i)^(chapter|rozdzia[łl]|kapitel|第\\s*[0-9一二三四五六七八九十百千]+\\s*[章节])'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def blocks(spark, sf):
    """Small orders of a year print the running head, the largest one the page number."""
    li = table(spark, sf, "lineitem")
    page = F.year("l_shipdate") - 1995
    y0 = F.col("l_quantity") * 14 - 10
    x0 = F.when(F.col("l_linestatus") == "F", 40.0).otherwise(280.0) + F.round(F.col("l_tax") * 100)
    cap = (F.col("l_discount") == 0.0) & (F.col("l_returnflag") == "R")
    size = F.when(cap, 33.0).when(F.col("l_discount") == 0.09, 16.0).when(F.col("l_discount") == 0.08, 8.0).otherwise(11.0)
    text = (
        F.when(F.col("l_quantity") <= 3, F.concat(F.lit("Running  HEAD "), page))
        .when(F.col("l_quantity") == 50, page.cast("string"))
        .when(cap, "T")
        .when(F.col("l_partkey") < 40, F.concat(F.lit("Chapter "), F.col("l_partkey")))
        .otherwise(F.concat(F.lit("Part-\nnumber "), F.col("l_partkey"), F.lit(" \n of order "), F.col("l_orderkey")))
    )
    return li.select(
        F.col("l_suppkey").alias("doc"), page.alias("page"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2097152 + F.col("l_partkey")).alias("pos"),
        x0.alias("x0"), y0.alias("y0"),
        (x0 + F.when(F.col("l_discount") == 0.1, 400.0).otherwise(150.0)).alias("x1"), (y0 + 12).alias("y1"),
        text.alias("text"), size.alias("max_size"),
    )


_BLOCKS = """SELECT *, y0 + 12 AS y1, x0 + wide AS x1 FROM (SELECT l_suppkey AS doc, year(l_shipdate) - 1995 AS page, (l_orderkey * 8 + l_linenumber) * 2097152 + l_partkey AS pos,
  CASE WHEN l_linestatus = 'F' THEN 40.0::DOUBLE ELSE 280.0::DOUBLE END + round(l_tax * 100) AS x0, l_quantity * 14 - 10 AS y0,
  CASE WHEN l_discount = 0.1 THEN 400.0::DOUBLE ELSE 150.0::DOUBLE END AS wide,
  CASE WHEN l_quantity <= 3 THEN 'Running  HEAD ' || (year(l_shipdate) - 1995) WHEN l_quantity = 50 THEN CAST(year(l_shipdate) - 1995 AS VARCHAR)
    WHEN l_discount = 0 AND l_returnflag = 'R' THEN 'T' WHEN l_partkey < 40 THEN 'Chapter ' || l_partkey
    ELSE 'Part-' || chr(10) || 'number ' || l_partkey || ' ' || chr(10) || ' of order ' || l_orderkey END AS text,
  CASE WHEN l_discount = 0 AND l_returnflag = 'R' THEN 33.0::DOUBLE WHEN l_discount = 0.09 THEN 16.0::DOUBLE WHEN l_discount = 0.08 THEN 8.0::DOUBLE ELSE 11.0::DOUBLE END AS max_size
  FROM lineitem)"""


def pages(spark, sf):
    """Each supplier's number of pages; every supplier is a document, with or without blocks."""
    counts = blocks(spark, sf).select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n_pages"))
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"))
    return docs.join(counts, "doc", "left").select(
        "doc", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.lit(500.0).alias("width"), F.lit(700.0).alias("height")
    )


_PAGES = """SELECT s_suppkey AS doc, coalesce(n, 0) AS n_pages FROM supplier LEFT JOIN (
  SELECT doc, count(DISTINCT page) AS n FROM blocks GROUP BY 1) b ON b.doc = s_suppkey"""
_ZONED = f"""SELECT b.*, n_pages, CASE WHEN y1 <= 70 THEN 'header' WHEN y0 >= 630 THEN 'footer' END AS zone,
  regexp_replace(regexp_replace(lower(trim(text, {_WS})), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS signature,
  CAST(round_even(x0 / 20, 0) AS BIGINT) AS bucket FROM blocks b JOIN pages USING (doc)"""
_RECURRING = """SELECT doc, zone, signature, bucket FROM zoned WHERE zone IS NOT NULL AND n_pages >= 3
  GROUP BY ALL HAVING count(*) >= greatest(3, (any_value(n_pages) + 1) // 2)"""
_PAGE_NO = "regexp_matches(replace(text, chr(10), ' '), '(?i)^\\s*(page\\s+)?[ivxlcdm0-9]+\\s*(of\\s+[ivxlcdm0-9]+)?\\s*$')"
_KEPT = f"""SELECT * FROM zoned z WHERE NOT EXISTS (SELECT 1 FROM recurring r WHERE r.doc = z.doc AND r.zone = z.zone AND r.signature = z.signature AND r.bucket = z.bucket)
  AND NOT (zone IS NOT NULL AND n_pages >= 3 AND {_PAGE_NO})"""
_BANDED = """SELECT *, CAST(x1 - x0 >= 325 AS INTEGER) AS is_full, coalesce(sum(CAST(x1 - x0 >= 325 AS INTEGER)) OVER (
  PARTITION BY doc, page ORDER BY y0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM kept"""
_COLUMNS = """SELECT *, CASE WHEN is_full = 0 AND last = 1 THEN cluster ELSE 0 END AS col, CASE WHEN is_full = 0 AND last <> 1 THEN x0 ELSE 0 END AS x_key FROM (
  SELECT *, max(cluster) OVER (PARTITION BY doc, page, band, is_full) AS last FROM (
    SELECT *, sum(CAST(coalesce(x0 - prev > 40, false) AS INTEGER)) OVER (PARTITION BY doc, page, band, is_full ORDER BY x0, pos) AS cluster FROM (
      SELECT *, lag(x0) OVER (PARTITION BY doc, page, band, is_full ORDER BY x0, pos) AS prev FROM banded)))"""
_ORDERED = """SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, band, is_full, col, y0, x_key, pos) - 1 AS read_no,
  row_number() OVER (PARTITION BY doc, page ORDER BY band, is_full, col, y0, x_key, pos) - 1 AS page_no FROM columns"""
_SIZES = """SELECT doc, arg_max(size, {'chars': chars, 'first': -first}) AS body_size FROM (
  SELECT doc, round_even(max_size, 0) AS size, sum(length(text)) AS chars, min(read_no) AS first FROM ordered GROUP BY ALL) GROUP BY 1"""
# A run of candidate drop caps merges every second one with its follower.
_MERGED = f"""SELECT doc, page, read_no, page_no, y0, body_size, CASE WHEN starts THEN trim(text, {_WS}) || nxt ELSE text END AS text,
  CASE WHEN starts THEN nxt_size ELSE max_size END AS max_size FROM (
  SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc ORDER BY read_no), false) AS consumed FROM (
    SELECT *, cap AND (row_number() OVER (PARTITION BY doc, run, cap ORDER BY read_no) % 2 = 1) AS starts FROM (
      SELECT *, sum(CAST(NOT cap AS INTEGER)) OVER (PARTITION BY doc ORDER BY read_no) AS run FROM (
        SELECT o.*, body_size, lead(text) OVER w AS nxt, lead(max_size) OVER w AS nxt_size,
          coalesce(regexp_matches(trim(text, {_WS}), '^\\pL{{1,2}}$') AND max_size >= body_size * 1.8 AND lead(page) OVER w = page, false) AS cap
        FROM ordered o JOIN sizes USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY read_no)))))
  WHERE NOT consumed"""
_CLEAN = f"trim(regexp_replace(regexp_replace(text, '([0-9A-Za-z_])-\\n([0-9A-Za-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'), {_WS})"
_KINDS = f"""SELECT *, CASE WHEN y0 >= 700 * 0.78 AND max_size <= body_size * 0.85 THEN 'skip'
  WHEN length(trim(text, {_WS})) <= 120 AND NOT contains(trim(text, {_WS}), chr(10)) AND (regexp_matches(trim(text, {_WS}), {_CHAPTER_WORD})
    OR (length(trim(text, {_WS})) > 2 AND max_size >= body_size * 1.3)) THEN 'heading' ELSE 'para' END AS kind FROM merged"""
_TO_KEPT = {"blocks": _BLOCKS, "pages": _PAGES, "zoned": _ZONED, "recurring": _RECURRING, "kept": _KEPT}
_TO_ORDER = {**_TO_KEPT, "banded": _BANDED, "columns": _COLUMNS, "ordered": _ORDERED}
_TO_KINDS = {**_TO_ORDER, "sizes": _SIZES, "merged": _MERGED, "kinds": _KINDS}


@query("layout_signatures", sql("SELECT doc, page, pos, zone, signature, bucket FROM zoned", blocks=_BLOCKS, pages=_PAGES, zoned=_ZONED))
def layout_signatures(spark, sf):
    zoned = L.with_zones(blocks(spark, sf), pages(spark, sf))
    return zoned.select("doc", "page", "pos", "zone", "signature", "bucket")


@query("recurring_headers", sql("SELECT * FROM recurring", blocks=_BLOCKS, pages=_PAGES, zoned=_ZONED, recurring=_RECURRING))
def recurring_headers(spark, sf):
    return L.recurring_signatures(L.with_zones(blocks(spark, sf), pages(spark, sf)))


@query("page_numbers", sql(f"SELECT doc, page, pos FROM zoned WHERE zone IS NOT NULL AND {_PAGE_NO}", blocks=_BLOCKS, pages=_PAGES, zoned=_ZONED))
def page_numbers(spark, sf):
    zoned = L.with_zones(blocks(spark, sf), pages(spark, sf))
    return zoned.filter(F.col("zone").isNotNull() & L.is_page_number(F.col("text"))).select("doc", "page", "pos")


@query("strip_headers_footers", sql("SELECT doc, page, pos, text FROM kept", **_TO_KEPT))
def strip_headers_footers(spark, sf):
    return L.strip_headers_footers(blocks(spark, sf), pages(spark, sf)).select("doc", "page", "pos", "text")


@query("column_order", sql("SELECT doc, page, pos, page_no FROM ordered", **{**_TO_ORDER, "kept": "SELECT * REPLACE (least(x1, x0 + 324) AS x1) FROM blocks"}))
def column_order(spark, sf):
    """Full-width blocks made as narrow as the others: columns alone decide."""
    narrow = blocks(spark, sf).withColumn("x1", F.least("x1", F.col("x0") + 324))
    return L.reading_order(narrow, pages(spark, sf)).select("doc", "page", "pos", "page_no")


@query("reading_order", sql("SELECT doc, page, pos, page_no FROM ordered", **{**_TO_ORDER, "kept": "SELECT * FROM blocks"}))
def reading_order(spark, sf):
    return L.reading_order(blocks(spark, sf), pages(spark, sf)).select("doc", "page", "pos", "page_no")


@query("layout_text", sql(f"SELECT doc, page, pos, {_CLEAN} AS text FROM blocks", blocks=_BLOCKS))
def layout_text(spark, sf):
    return blocks(spark, sf).select("doc", "page", "pos", L.clean_text(F.col("text")).alias("text"))


@query("body_font_size", sql("SELECT * FROM sizes", **_TO_ORDER, sizes=_SIZES))
def body_font_size(spark, sf):
    return L.body_sizes(L.order_without_text(blocks(spark, sf), pages(spark, sf)))


@query("block_drop_caps", sql("SELECT doc, page, page_no, text, max_size FROM merged", **_TO_ORDER, sizes=_SIZES, merged=_MERGED))
def block_drop_caps(spark, sf):
    return L.merge_drop_cap_blocks(L.sized_blocks(blocks(spark, sf), pages(spark, sf))).select("doc", "page", "page_no", "text", "max_size")


def kinds(spark, sf):
    return L.prepare(blocks(spark, sf), pages(spark, sf))


_FLAGS = """SELECT doc, page, pos, y0 >= 700 * 0.78 AND max_size <= 11.0 * 0.85 AS footnote,
  length(trim(text, {ws})) <= 120 AND NOT contains(trim(text, {ws}), chr(10)) AND (regexp_matches(trim(text, {ws}), {cw})
    OR (length(trim(text, {ws})) > 2 AND max_size >= 11.0 * 1.3)) AS heading FROM blocks"""


@query("footnotes_and_headings", sql(_FLAGS.format(ws=_WS, cw=_CHAPTER_WORD), blocks=_BLOCKS))
def footnotes_and_headings(spark, sf):
    body = F.lit(11.0)
    return blocks(spark, sf).select(
        "doc", "page", "pos",
        L.is_footnote(F.col("y0"), F.col("max_size"), F.lit(700.0), body).alias("footnote"),
        L.is_heading(F.col("text"), F.col("max_size"), body).alias("heading"),
    )


@query("block_kinds", sql("SELECT doc, page, page_no, kind, text FROM kinds", **_TO_KINDS))
def block_kinds(spark, sf):
    return kinds(spark, sf).select("doc", "page", "page_no", "kind", "text")


_OUTLINE = """SELECT p_size * 2 + p_partkey % 2 AS doc, CASE WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS level, p_partkey % 7 + 1 AS page, p_partkey AS pos,
  p_name || ' ' || p_partkey AS title FROM part WHERE p_brand <> 'Brand#1'"""


def outline(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(F.col("p_brand") != "Brand#1").select(
        (F.col("p_size") * 2 + F.col("p_partkey") % 2).alias("doc"),
        F.when(F.col("p_type") == "PROMO", 2).otherwise(1).alias("level"),
        (F.col("p_partkey") % 7 + 1).alias("page"), F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.lit(" "), "p_partkey").alias("title"),
    )


_BY_OUTLINE = f"""SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY g) - 1 AS chapter_index, coalesce(t, 'Front Matter') AS title,
  row_number() OVER (PARTITION BY doc, g ORDER BY read_no) - 1 AS block_index, kind, text FROM (
  SELECT k.doc, k.read_no, k.kind, {_CLEAN.replace('text', 'k.text')} AS text, coalesce(e.g, 0) AS g, e.title AS t
  FROM (SELECT * FROM kinds WHERE doc IN (SELECT doc FROM outline)) k ASOF LEFT JOIN (
    SELECT doc, page, max(g) AS g, arg_max(title, g) AS title FROM (
      SELECT doc, page - 1 AS page, title, row_number() OVER (PARTITION BY doc ORDER BY page, pos) AS g FROM outline o
      WHERE level = (SELECT min(level) FROM outline i WHERE i.doc = o.doc)) GROUP BY ALL) e ON e.doc = k.doc AND e.page <= k.page)"""
_BY_HEADING = f"""SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY g) - 1 AS chapter_index, coalesce(h, 'Chapter 1') AS title,
  row_number() OVER (PARTITION BY doc, g ORDER BY read_no) - 1 AS block_index, kind, {_CLEAN} AS text FROM (
  SELECT *, max(CASE WHEN kind = 'heading' THEN trim(text, {_WS}) END) OVER (PARTITION BY doc, g) AS h FROM (
    SELECT *, sum(CAST(kind = 'heading' AS INTEGER)) OVER (PARTITION BY doc ORDER BY read_no) AS g FROM kinds)) WHERE kind <> 'heading'"""


@query("outline_chapters", sql(_BY_OUTLINE, **_TO_KINDS, outline=_OUTLINE))
def outline_chapters(spark, sf):
    return L.chapters_from_outline(cut_lineage(kinds(spark, sf)), outline(spark, sf))


@query("heading_chapters", sql(_BY_HEADING, **_TO_KINDS))
def heading_chapters(spark, sf):
    return L.chapters_from_headings(cut_lineage(kinds(spark, sf)))


@query("layout_chapters", sql(f"({_BY_OUTLINE}) UNION ALL (SELECT * FROM ({_BY_HEADING}) WHERE doc NOT IN (SELECT doc FROM outline))", **_TO_KINDS, outline=_OUTLINE))
def layout_chapters(spark, sf):
    return L.chapters(cut_lineage(kinds(spark, sf)), outline(spark, sf))


@query(
    "documents_without_text",
    """SELECT c_custkey AS doc, 'no extractable text (it may be a scanned document)' AS error FROM customer
  WHERE c_custkey NOT IN (SELECT l_suppkey FROM lineitem)""",
)
def documents_without_text(spark, sf):
    """Customers stand for the uploaded documents; only those with a supplier's number have blocks."""
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"))
    return L.without_text(docs, blocks(spark, sf))


@query(
    "documents_without_chapters",
    sql(
        "SELECT doc, 'headings but no text below them' AS error FROM kinds WHERE doc NOT IN (SELECT doc FROM outline) GROUP BY doc HAVING bool_and(kind = 'heading')",
        **{**_TO_KINDS, "blocks": f"SELECT doc * 1000 + pos // 16777216 % 1000 AS doc, * EXCLUDE (doc) FROM ({_BLOCKS})",
           "pages": "SELECT doc, count(DISTINCT page) AS n_pages FROM blocks GROUP BY 1"}, outline=_OUTLINE,
    ),
)
def documents_without_chapters(spark, sf):
    """Documents of a few blocks each, one for an order of a supplier."""
    small = blocks(spark, sf).withColumn("doc", F.col("doc") * 1000 + F.floor(F.col("pos") / 16777216) % 1000)
    sizes = small.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    leaves = sizes.select("doc", "n_pages", F.lit(500.0).alias("width"), F.lit(700.0).alias("height"))
    return L.headings_alone(small, leaves, outline(spark, sf))


# ----------------------------------------------------------- lines inside blocks

_SIZED = "SELECT doc_id AS doc, pos // 4 AS block, pos AS line_no, CASE WHEN length(text) < 20 THEN substr(text, 1, 2) ELSE text END AS text, CASE WHEN length(text) < 20 THEN 60.0::DOUBLE / length(text) ELSE 6.0::DOUBLE END AS max_size FROM lines"
# All that the operator takes for white space at the ends of a text.
WHITE = "' ' || " + " || ".join(f"chr({ord(c)})" for c in sorted(set(WHITESPACE) - {" "}))
_GLUED = """SELECT doc, block, line_no, CASE WHEN starts THEN word || nxt ELSE text END AS text, CASE WHEN starts THEN nxt_size ELSE max_size END AS max_size FROM (
  SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc, block ORDER BY line_no), false) AS consumed FROM (
    SELECT *, cap AND (row_number() OVER (PARTITION BY doc, block, run, cap ORDER BY line_no) % 2 = 1) AS starts FROM (
      SELECT *, sum(CAST(NOT cap AS INTEGER)) OVER (PARTITION BY doc, block ORDER BY line_no) AS run FROM (
        SELECT *, lead(text) OVER w AS nxt, lead(max_size) OVER w AS nxt_size, coalesce(regexp_matches(word, '^\\pL{1,2}$') AND max_size >= lead(max_size) OVER w * 1.8, false) AS cap
        FROM (SELECT *, trim(text, WHITE) AS word FROM sized) WINDOW w AS (PARTITION BY doc, block ORDER BY line_no))))) WHERE NOT consumed""".replace("WHITE", WHITE)


def sized_lines(spark, sf):
    """Short document lines stand for big letters, four lines for a block."""
    size = F.length("text")
    return lines(spark, sf).select(
        F.col("doc_id").alias("doc"), F.floor(F.col("pos") / 4).alias("block"), F.col("pos").alias("line_no"),
        F.when(size < 20, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("text"),
        F.when(size < 20, F.lit(60.0) / size).otherwise(6.0).alias("max_size"),
    )


@query("line_drop_caps", sql("SELECT doc, block, line_no, text FROM glued", lines=LINES, sized=_SIZED, glued=_GLUED))
def line_drop_caps(spark, sf):
    out = L.merge_drop_cap_lines(sized_lines(spark, sf), ["doc", "block"], ["line_no"])
    return out.select("doc", "block", "line_no", "text")


@query(
    "block_text",
    sql(f"SELECT doc, block, trim(string_agg(text, chr(10) ORDER BY line_no), {WHITE}) AS text, max(max_size) AS max_size FROM glued GROUP BY ALL", lines=LINES, sized=_SIZED, glued=_GLUED),
)
def block_text(spark, sf):
    merged = L.merge_drop_cap_lines(sized_lines(spark, sf), ["doc", "block"], ["line_no"])
    return L.blocks_from_lines(merged, ["doc", "block"])
