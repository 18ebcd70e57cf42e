"""Ingest queries over documents, pages and events."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import strip
from lectern.operators import catalog as C
from lectern.operators import fold, html, language, structured
from lectern.queries.registry import query, table, texts
from lectern.queries.views import sql
from lectern.session import cut_lineage, local_fallback, shared_folder
from lectern.sources import files as S
from lectern.sources import model as M
from lectern.sources.sinks import write_text_files

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
LINE_LEVELS = [["slab"], ["pos"]]
LINES = f"""SELECT doc_id, lang, source, pos, trim(line, {WS}) AS text FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents) WHERE trim(line, {WS}) <> ''"""
HEADING = (
    "(regexp_matches({t}, '(?i)^(chapter|rozdzia[łl]|kapitel|第\\s*[0-9一二三四五六七八九十百千]+\\s*[章节])')"
    " OR regexp_matches({t}, '^[A-ZĄĆĘŁŃÓŚŹŻÄÖÜß0-9][^.!?]{{0,59}}$'))"
)
CUT_TITLE = "CASE WHEN length({t}) <= 80 THEN {t} ELSE substr({t}, 1, 77) || '...' END"


def lines(spark, sf):
    """Non-empty trimmed lines of the documents with their position."""
    docs = texts(spark, sf, "documents")
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return (
        rows.select("doc_id", "lang", "source", F.col("pos").cast("bigint").alias("pos"), strip(F.col("line")).alias("text"))
        .filter("text <> ''")
        .withColumn("slab", F.floor(F.col("pos") / 1024))
    )


def spaced_documents(spark, sf):
    """Documents whose lines are set apart by blank lines, as plain-text books are."""
    return texts(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n \r\n")))


# ----------------------------------------------------------------------- files


#: Documents of one area that share a file, in the files that the queries write.
SHELF = 256
SHELVES = f"""SELECT source AS area, doc_id // {SHELF} AS shelf, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS length FROM documents GROUP BY ALL"""


def _area():
    """Area of a path; null where the documents had none."""
    return F.when(F.col("path").rlike("/area=[^/]*/[^/]*$"), F.url_decode(F.regexp_extract("path", "/area=([^/]*)/[^/]*$", 1)))


def shelved(spark, sf):
    """The documents as text files, one for each area and shelf; their folder."""
    folder = f"{shared_folder(spark, local_fallback(spark))}/shelves-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.col("source").alias("area"), F.floor(F.col("doc_id") / SHELF).alias("shelf"), "text")
    write_text_files(docs, folder, "area", "shelf", "text")
    return folder


@query(
    "intake_limit",
    sql(
        """SELECT area, count(*) FILTER (length <= 32768) AS accepted, count(*) FILTER (length > 32768) AS rejected,
  CAST(coalesce(sum(length) FILTER (length <= 32768), 0) AS BIGINT) AS accepted_bytes, max(CASE WHEN length > 32768 THEN 'file exceeds the 0.03125MB upload limit' END) AS error FROM shelves GROUP BY 1""",
        shelves=SHELVES,
    ),
)
def intake_limit(spark, sf):
    """Files against a limit of 32 KiB; the accepted are read whole, the rejected not at all."""
    taken, rejected = S.read_files(spark, shelved(spark, sf), max_mb=1 / 32)
    both = taken.select("path", F.octet_length("content").alias("bytes"), F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("path", F.lit(None).cast("int").alias("bytes"), "error")
    )
    return both.groupBy(_area().alias("area")).agg(
        F.count_if(F.col("error").isNull()).alias("accepted"), F.count("error").alias("rejected"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("accepted_bytes"), F.max("error").alias("error"),
    )


@query("storage_usage", sql("SELECT area, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM shelves GROUP BY 1", shelves=SHELVES))
def storage_usage(spark, sf):
    """Files and bytes of each area, without opening a file."""
    return C.storage_usage(S.file_sizes(spark, shelved(spark, sf), _area()))


def sniffable(spark, sf):
    """Events dressed as files of various kinds, and the pages."""
    e = table(spark, sf, "events")
    kind, tail = F.col("event_type"), F.col("props")
    body = (
        F.when(kind == "view", F.concat(F.lit("%PDF-1.7 "), tail))
        .when(kind == "click", F.concat(F.lit("{\\rtf1 "), tail))
        .when(kind == "purchase", F.concat(F.lit("\ufeff <?xml version='1.0'?><FictionBook>"), tail))
        .when(kind == "signup", F.concat(F.lit("PK\x03\x04......mimetypeapplication/epub+zip"), tail))
        .otherwise(F.concat(F.lpad(tail, 60, "."), F.lit("BOOKMOBI ........")))
    )
    name = F.concat(F.lit("e/"), F.col("event_id"), F.when(F.col("value") > 50, ".LIT").when(F.col("value") > 20, ".txt").otherwise(""))
    page = texts(spark, sf, "pages")
    docs = texts(spark, sf, "documents")
    ext = M.choose(F.col("lang"), {"en": ".txt", "fr": ".HTM", "de": ".rtf"}, ".xyz")
    return (
        e.select(name.alias("path"), body.cast("binary").alias("content"))
        .unionByName(page.select(F.concat(F.lit("p/"), "page_id").alias("path"), F.col("html").cast("binary").alias("content")))
        .unionByName(docs.select(F.concat(F.lit("d/"), F.col("doc_id"), ext).alias("path"), F.col("text").cast("binary").alias("content")))
    )


_SNIFF = """SELECT 'e/' || event_id || CASE WHEN value > 50 THEN '.LIT' WHEN value > 20 THEN '.txt' ELSE '' END AS path,
  CASE event_type WHEN 'view' THEN 'pdf' WHEN 'click' THEN 'rtf' WHEN 'purchase' THEN 'fb2' WHEN 'signup' THEN 'epub' ELSE 'mobi' END AS sniffed FROM events
  UNION ALL SELECT 'p/' || page_id, CASE WHEN lower(substr(html, 1, 5)) IN ('<html', '<!doc') THEN 'html' ELSE '' END FROM pages
  UNION ALL SELECT 'd/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.HTM' WHEN 'de' THEN '.rtf' ELSE '.xyz' END,
  CASE WHEN lower(substr(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 5)) IN ('<html', '<!doc') THEN 'html' ELSE '' END FROM documents"""


@query("sniff_format", sql("SELECT path, sniffed FROM sniff", sniff=_SNIFF))
def sniff_format(spark, sf):
    return sniffable(spark, sf).select("path", S.sniff_format(F.col("content")).alias("sniffed"))


_PARSER = """CASE {x} WHEN 'epub' THEN 'epub' WHEN 'docx' THEN 'docx' WHEN 'pdf' THEN 'pdf' WHEN 'fb2' THEN 'fb2' WHEN 'html' THEN 'html'
  WHEN 'htm' THEN 'html' WHEN 'mobi' THEN 'converter' WHEN 'azw' THEN 'converter' WHEN 'azw3' THEN 'converter' WHEN 'lit' THEN 'converter'
  WHEN 'pdb' THEN 'converter' WHEN 'rtf' THEN 'converter' WHEN 'txt' THEN 'txt' END"""
_RESOLVED = f"""SELECT path, sniffed, coalesce({_PARSER.format(x='sniffed')}, {_PARSER.format(x="lower(regexp_extract(path, '[.]([^./]*)$', 1))")}) AS parser FROM sniff"""


@query(
    "parser_resolution",
    sql(
        """SELECT path, parser, CASE WHEN parser IS NULL THEN 'no parser recognizes ' || path || ' (sniffed format: ' ||
  CASE WHEN sniffed = '' THEN 'unknown' ELSE sniffed END || ')' END AS error FROM resolved""",
        sniff=_SNIFF, resolved=_RESOLVED,
    ),
)
def parser_resolution(spark, sf):
    return S.resolve_parsers(sniffable(spark, sf)).select("path", "parser", "error")


@query(
    "converter_files",
    sql(
        "SELECT path, 'requires an external e-book converter' AS note FROM resolved WHERE parser = 'converter'",
        sniff=_SNIFF, resolved=_RESOLVED,
    ),
)
def converter_files(spark, sf):
    return S.needs_converter(S.resolve_parsers(sniffable(spark, sf))).select("path", "note")


@query(
    "format_listing",
    sql(
        """SELECT extension, k.parser <> 'converter' AS available, count(r.path) AS files FROM (
  SELECT unnest(['epub','docx','pdf','fb2','html','htm','mobi','azw','azw3','lit','pdb','rtf','txt']) AS extension) f
  JOIN LATERAL (SELECT """ + _PARSER.format(x="extension") + """ AS parser) k ON true
  LEFT JOIN resolved r ON lower(regexp_extract(r.path, '[.]([^./]*)$', 1)) = extension GROUP BY 1, 2""",
        sniff=_SNIFF, resolved=_RESOLVED,
    ),
)
def format_listing(spark, sf):
    """Known extensions, whether usable, and how many given files carry them."""
    counts = sniffable(spark, sf).groupBy(S.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))
    return S.formats(spark).join(counts, "extension", "left").select(
        "extension", "available", F.coalesce("files", F.lit(0)).alias("files")
    )


LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
#: What Latin letters become for the sources whose files are in other scripts, and the encoding of these.
SCRIPTS = {
    "src6": ("gb18030", "的一是不了人我在有他这中大来上国个到说们为子和你地出"),
    "src7": ("big5", "的一是不了人我在有他這中大來上國個到說們為子和你地出"),
    "src8": ("cp1251", "оеаинтсрвлкмдпуяыьгзбчйхжш"),
    "src9": ("koi8-r", "оеаинтсрвлкмдпуяыьгзбчйхжш"),
    "src10": ("cp1250", "łtąośnsżrdlućmfwypvbgkjqxz"),
}


def _in_script(text, letters):
    """Lower case, in other letters; what was beyond ASCII reads as the first of them."""
    return F.translate(F.regexp_replace(F.lower(text), "[^\\x00-\\x7f]", "e"), LETTERS, letters)


def _bytes_in(text, encoding, letters):
    """The text's bytes in an encoding that the engine cannot write: each letter by its own bytes."""
    for letter in letters:
        raw = letter.encode(encoding)
        if letter.encode("utf-8") != raw:
            text = F.replace(text, F.lit(letter), F.lit(raw.decode("latin-1")))
    return F.encode(text, "ISO-8859-1")


_DECODED = "CASE source " + " ".join(
    f"WHEN '{source}' THEN translate(regexp_replace(lower(text), '[^\\x00-\\x7f]', 'e', 'g'), '{LETTERS}', '{letters}')" for source, (_, letters) in SCRIPTS.items()
) + " ELSE text END"


@query("decode_text", f"SELECT doc_id, {_DECODED} AS text FROM documents")
def decode_text(spark, sf):
    """Each source in an encoding of its own: three of UTF-16, Latin, Chinese and Cyrillic ones; the rest in UTF-8."""
    docs = texts(spark, sf, "documents")
    text, source = F.col("text"), F.col("source")
    content = (
        F.when(source == "src3", F.encode(text, "UTF-16"))
        .when(source == "src4", F.encode(text, "UTF-16LE"))
        .when(source == "src5", F.encode(text, "UTF-16BE"))
    )
    for name, (encoding, letters) in SCRIPTS.items():
        content = content.when(source == name, _bytes_in(_in_script(text, letters), encoding, letters))
    latin = (F.col("lang") != "en") & ~text.rlike("[^\\x00-\\x7f\u00a0-\u00ff]") & text.rlike("[\u00e0-\u00f6\u00f8-\u00ff]")
    content = content.when(latin, F.encode(F.when(latin, text), "ISO-8859-1")).otherwise(text.cast("binary"))
    return docs.select("doc_id", content.alias("content")).select("doc_id", S.decode_text(F.col("content")).alias("text"))


@query(
    "registered_parsers",
    sql(
        """SELECT 'd/' || doc_id AS path, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, text FROM lines JOIN documents d USING (doc_id) WHERE d.lang = 'en'
  UNION ALL SELECT 'd/' || doc_id, -1, CASE lang WHEN 'fr' THEN 'no decoder registered for rtf' ELSE 'no parser' END FROM documents WHERE lang IS NULL OR lang <> 'en'""".replace("text FROM lines JOIN", "l.text FROM lines l JOIN"),
        lines=LINES,
    ),
)
def registered_parsers(spark, sf):
    """Texts through a registered parser, and the files that no parser takes with the reason (position -1)."""
    lang = F.col("lang")
    resolved = spaced_documents(spark, sf).select(
        F.concat(F.lit("d/"), "doc_id").alias("path"),
        F.when(lang == "en", "txt").when(lang == "fr", "rtf").alias("parser"),
        F.when(lang.isNull() | ~lang.isin("en", "fr"), "no parser").alias("error"), "text",
    )
    registry = S.ParserRegistry()
    registry.register("txt", lambda files: files.select("path", F.posexplode(fold.split_paragraphs(F.col("text"))).alias("pos", "text")))
    rejects = registry.unregistered(resolved).select("path", F.lit(-1).alias("pos"), F.col("error").alias("text"))
    return registry.parse(resolved)["txt"].unionByName(rejects).withColumn("pos", F.col("pos").cast("bigint"))


# ------------------------------------------------------------------ plain text


@query("paragraphs", sql("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, text FROM lines", lines=LINES))
def paragraphs(spark, sf):
    docs = spaced_documents(spark, sf)
    return docs.select("doc_id", F.posexplode(fold.split_paragraphs(F.col("text"))).alias("pos", "text"))


@query("heading_lines", sql(f"SELECT doc_id, pos, {HEADING.format(t='text')} AS heading FROM lines", lines=LINES))
def heading_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", fold.looks_like_heading(F.col("text")).alias("heading"))


@query("joined_lines", sql("SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM lines GROUP BY 1", lines=LINES))
def joined_lines(spark, sf):
    joined = texts(spark, sf, "documents").select("doc_id", fold.join_lines(F.col("text")).alias("text"))
    return joined.filter("text <> ''")


TEXT_CHAPTERS = f"""SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chapter_index,
  coalesce({CUT_TITLE.format(t='h')}, 'Chapter 1') AS title, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) - 1 AS block_index, 'para' AS kind, text
  FROM (SELECT *, max(CASE WHEN head THEN text END) OVER (PARTITION BY doc_id, g) AS h FROM (
    SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (
      SELECT doc_id, pos, text, {HEADING.format(t='text')} AND NOT bool_and({HEADING.format(t='text')}) OVER (PARTITION BY doc_id) AS head FROM lines)))
  WHERE NOT head"""


@query("text_chapters", sql(TEXT_CHAPTERS, lines=LINES))
def text_chapters(spark, sf):
    docs = spaced_documents(spark, sf).select("doc_id", fold.text_chapters(F.col("text")).alias("chapters"))
    return fold.explode_chapters(docs, ["doc_id"])


@query(
    "catalog_sizes",
    sql(
        """SELECT doc_id, count(DISTINCT chapter_index) AS chapters, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM folded GROUP BY 1""",
        lines=LINES, folded=TEXT_CHAPTERS,
    ),
)
def catalog_sizes(spark, sf):
    """Books, chapters and blocks as they are persisted, counted per book."""
    docs = spaced_documents(spark, sf).select("doc_id", fold.text_chapters(F.col("text")).alias("chapters"))
    t = fold.catalog_tables(docs, "doc_id")
    per_chapter = t["blocks"].groupBy("chapter_id").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("size")
    )
    return (
        t["books"]
        .join(t["chapters"], "book_id")
        .join(per_chapter, "chapter_id")
        .groupBy("doc_id")
        .agg(F.count("*").alias("chapters"), F.sum("n").alias("blocks"), F.sum("size").alias("chars"))
    )


@query("catalog_rows", sql("SELECT doc_id, chapter_index, title, block_index, kind, sha256(text) AS text_sha256 FROM folded", lines=LINES, folded=TEXT_CHAPTERS))
def catalog_rows(spark, sf):
    """The persisted rows put together again by their ids: every block under its chapter and book, once."""
    docs = spaced_documents(spark, sf).select("doc_id", fold.text_chapters(F.col("text")).alias("chapters"))
    t = fold.catalog_tables(docs, "doc_id")
    chapters = t["chapters"].select("book_id", "chapter_id", F.col("index").alias("chapter_index"), "title")
    blocks = t["blocks"].dropDuplicates(["block_id"]).select(
        "chapter_id", F.col("index").alias("block_index"), "kind", F.sha2("text", 256).alias("text_sha256")
    )
    return t["books"].join(chapters, "book_id").join(blocks, "chapter_id").select("doc_id", "chapter_index", "title", "block_index", "kind", "text_sha256")


# ------------------------------------------------------------------------ html


def _strip_sql(tags):
    out = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        if tag != "img":
            out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({out}, '(?i)<img\\b[^>]*>', '', 'g')"


def _inner_sql(x):
    plain = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')".format("p")
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda p: trim({plain}, {WS})), lambda p: p <> ''), ' ')"


_TEXT = "h[1-6]|blockquote|p|li|dd|figcaption"
_BREAK = _TEXT + "|div|section|article|main|ul|ol|dl|dt|table|tr|td|th|pre|body|html|head|title"


def _blocks_sql(tags):
    return f"""SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, tag, text FROM (
  SELECT page_id, url, i, lower(regexp_extract(p, '(?is)^<({_TEXT})\\b', 1)) AS tag, {_inner_sql("regexp_extract(p, '(?is)^<(?:" + _TEXT + ")\\b[^>]*>(.*)$', 1)")} AS text FROM (
    SELECT page_id, url, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (
      SELECT page_id, url, string_split(regexp_replace({_strip_sql(tags)}, '(?i)<(/?(?:{_BREAK})\\b)', chr(30) || '<\\1', 'g'), chr(30)) AS a FROM pages)))
  WHERE tag <> '' AND text <> ''"""


_HTML_BLOCKS = _blocks_sql(html.SKIPPED_TAGS)
_EPUB_BLOCKS = _blocks_sql(html.SKIPPED_TAGS_EPUB)
_KIND = "CASE WHEN regexp_matches({t}, '^h[1-6]$') THEN 'heading' WHEN {t} = 'blockquote' THEN 'quote' ELSE 'para' END"
_META = f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title\\b') THEN {_inner_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)")} ELSE url END AS title,
  lower(coalesce(nullif(split_part(regexp_extract(html, '(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), '-', 1), ''), 'und')) AS language FROM pages"""


@query("html_boilerplate", f"SELECT page_id, {_strip_sql(html.SKIPPED_TAGS)} AS html FROM pages")
def html_boilerplate(spark, sf):
    return texts(spark, sf, "pages").select("page_id", html.strip_boilerplate(F.col("html")).alias("html"))


@query("html_blocks", sql(f"SELECT page_id, pos, {_KIND.format(t='tag')} AS kind, text FROM b", b=_HTML_BLOCKS))
def html_blocks(spark, sf):
    rows = texts(spark, sf, "pages").select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("pos", "b"))
    return rows.select("page_id", "pos", html.kind_of(F.col("b.tag")).alias("kind"), "b.text")


@query("html_metadata", _META)
def html_metadata(spark, sf):
    return texts(spark, sf, "pages").select(
        "page_id", html.title(F.col("html"), F.col("url")).alias("title"), html.language(F.col("html")).alias("language")
    )


@query(
    "html_chapters",
    sql(
        f"""SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY g) - 1 AS chapter_index, coalesce({CUT_TITLE.format(t='h')}, title) AS title,
  row_number() OVER (PARTITION BY page_id, g ORDER BY pos) - 1 AS block_index, {_KIND.format(t='tag')} AS kind, text FROM (
  SELECT *, max(CASE WHEN head THEN text END) OVER (PARTITION BY page_id, g) AS h FROM (
    SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos) AS g FROM (SELECT *, tag IN ('h1','h2') AS head FROM b)))
  JOIN (SELECT page_id, title FROM meta) USING (page_id) WHERE NOT head""",
        b=_HTML_BLOCKS, meta=_META,
    ),
)
def html_chapters(spark, sf):
    docs = texts(spark, sf, "pages").select(
        "page_id", html.html_chapters(F.col("html"), html.title(F.col("html"), F.col("url"))).alias("chapters")
    )
    return fold.explode_chapters(docs, ["page_id"])


# ------------------------------------------------------------ structured books


def _host(url):
    return F.regexp_extract(url, "https?://([^/]+)", 1)


_PARTS = """SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS doc, page_id AS spine_pos, CASE WHEN contains(url, 'page=9') THEN 'no' ELSE 'yes' END AS linear,
  starts_with(url, 'https') AND contains(url, '#top') AS is_nav, 'p' || page_id || '.xhtml' AS href FROM pages"""
_TOC = """SELECT doc, 'p' || spine_pos || '.xhtml' AS href, spine_pos * 2 + k AS pos, 'Entry ' || (spine_pos * 2 + k) AS title FROM _parts, (VALUES (0), (1)) t(k)
  WHERE NOT ends_with(doc, '.com')"""


def epub_parts(spark, sf):
    p = texts(spark, sf, "pages")
    return p.select(
        _host("url").alias("doc"), F.col("page_id").alias("spine_pos"),
        F.when(F.col("url").contains("page=9"), "no").otherwise("yes").alias("linear"),
        (F.col("url").startswith("https") & F.col("url").contains("#top")).alias("is_nav"),
        F.concat(F.lit("p"), F.col("page_id"), F.lit(".xhtml")).alias("href"), "html",
    )


def epub_toc(spark, sf):
    """Two entries for each page outside .com hosts, so that titles also come from headings."""
    parts = epub_parts(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    pos = F.col("spine_pos") * 2 + F.col("k")
    return parts.filter(~F.col("doc").endswith(".com")).select(
        "doc", F.concat("href", F.lit("#x"), "k").alias("href"), pos.alias("pos"), F.concat(F.lit("Entry "), pos).alias("title")
    )


@query(
    "epub_chapters",
    sql(
        """SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY spine_pos) - 1 AS chapter_index, spine_pos,
  coalesce(t.title, h.heading, 'Chapter ' || row_number() OVER (PARTITION BY doc ORDER BY spine_pos)) AS title, h.n AS blocks
  FROM _parts p JOIN (SELECT page_id AS spine_pos, count(*) AS n, arg_min(text, pos) FILTER (regexp_matches(tag, '^h[1-6]$')) AS heading FROM b GROUP BY 1) h USING (spine_pos)
  LEFT JOIN (SELECT doc, href, arg_min(title, pos) AS title FROM toc GROUP BY ALL) t USING (doc, href) WHERE linear <> 'no' AND NOT is_nav""",
        b=_EPUB_BLOCKS, _parts=_PARTS, toc=_TOC,
    ),
)
def epub_chapters(spark, sf):
    out = structured.epub_chapters(epub_parts(spark, sf), epub_toc(spark, sf))
    return out.select("doc", "chapter_index", "spine_pos", "title", F.size("blocks").cast("bigint").alias("blocks"))


_ENTRIES = """SELECT 'b' || c_nationkey AS doc, c_custkey AS pos, CASE c_mktsegment WHEN 'BUILDING' THEN 'title' WHEN 'AUTOMOBILE' THEN 'creator' WHEN 'MACHINERY' THEN 'language' ELSE 'publisher' END AS name,
  CASE c_mktsegment WHEN 'MACHINERY' THEN CASE WHEN c_acctbal < 0 THEN 'PL' ELSE 'En-GB' END ELSE c_name END AS value FROM customer"""


@query(
    "epub_metadata",
    sql(
        """SELECT doc, coalesce(arg_min(value, pos) FILTER (name = 'title'), any_value(stem)) AS title, arg_min(value, pos) FILTER (name = 'creator') AS author,
  lower(split_part(coalesce(arg_min(value, pos) FILTER (name = 'language'), 'und'), '-', 1)) AS language
  FROM (SELECT 'b' || n_nationkey AS doc, n_name AS stem FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region) LEFT JOIN entries USING (doc) GROUP BY doc""",
        entries=_ENTRIES,
    ),
)
def epub_metadata(spark, sf):
    """Customers give the entries of their nation's book; the books of regions have none."""
    kind = F.col("c_mktsegment")
    code = F.when(F.col("c_acctbal") < 0, "PL").otherwise("En-GB")
    entries = table(spark, sf, "customer").select(
        F.concat(F.lit("b"), "c_nationkey").alias("doc"), F.col("c_custkey").alias("pos"),
        M.choose(kind, {"BUILDING": "title", "AUTOMOBILE": "creator", "MACHINERY": "language"}, "publisher").alias("name"),
        F.when(kind == "MACHINERY", code).otherwise(F.col("c_name")).alias("value"),
    )
    books = lambda name, id, stem: table(spark, sf, name).select(id.alias("doc"), F.concat(F.lit("/in/"), stem, F.lit(".epub")).alias("path"))
    docs = books("nation", F.concat(F.lit("b"), "n_nationkey"), "n_name").unionByName(books("region", F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    return structured.epub_metadata(entries, docs)


_ITEMS = """SELECT p_brand AS doc, p_partkey AS pos, CASE p_type WHEN 'PROMO' THEN 'Cover-' ELSE 'item-' END || p_partkey AS id,
  CASE WHEN p_size > 25 THEN 'image/jpeg' ELSE 'text/css' END AS media_type,
  CASE WHEN p_type = 'SMALL' AND p_size > 45 THEN 'svg cover-image' ELSE '' END AS properties, p_type = 'LARGE' AND p_size = 50 AS is_meta_cover FROM part"""


@query(
    "epub_cover",
    sql(
        """SELECT doc, id, media_type FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank, pos) AS rn FROM (
  SELECT *, CASE WHEN is_meta_cover THEN 1 WHEN contains(properties, 'cover-image') THEN 2
    WHEN starts_with(media_type, 'image/') AND contains(lower(id), 'cover') THEN 3 END AS rank FROM items) WHERE rank IS NOT NULL) WHERE rn = 1""",
        items=_ITEMS,
    ),
)
def epub_cover(spark, sf):
    items = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"),
        F.concat(F.when(F.col("p_type") == "PROMO", "Cover-").otherwise("item-"), F.col("p_partkey")).alias("id"),
        F.when(F.col("p_size") > 25, "image/jpeg").otherwise("text/css").alias("media_type"),
        F.when((F.col("p_type") == "SMALL") & (F.col("p_size") > 45), "svg cover-image").otherwise("").alias("properties"),
        ((F.col("p_type") == "LARGE") & (F.col("p_size") == 50)).alias("is_meta_cover"),
    )
    return structured.pick_cover(items)


_STYLED = """SELECT *, CASE WHEN length(text) < 40 THEN 1 WHEN length(text) < 60 THEN 2 END AS level,
  CASE WHEN length(text) < 60 THEN 'heading' WHEN length(text) < 80 THEN 'quote' ELSE 'para' END AS kind FROM lines"""


@query(
    "docx_chapters",
    sql(
        f"""SELECT doc_id AS doc, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chapter_index, coalesce({CUT_TITLE.format(t='h')}, 'Chapter 1') AS title,
  row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) - 1 AS block_index, kind, text FROM (
  SELECT *, max(CASE WHEN head THEN text END) OVER (PARTITION BY doc_id, g) AS h FROM (
    SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (SELECT *, coalesce(level = 1, false) AS head FROM styled)))
  WHERE NOT head""",
        lines=LINES, styled=_STYLED,
    ),
)
def docx_chapters(spark, sf):
    """Short lines stand for headings, by length."""
    size = F.length("text")
    style = F.when(size < 40, "Heading 1").when(size < 60, "heading  2").when(size < 80, "Intense Quote").otherwise("Normal")
    paras = lines(spark, sf).select(F.col("doc_id").alias("doc"), "pos", "slab", style.alias("style"), "text")
    out = structured.docx_chapters(paras, LINE_LEVELS)
    return out.select("doc", "chapter_index", "title", "block_index", "kind", "text")


_NODES = """SELECT doc_id AS doc, pos, CASE WHEN length(text) > 400 THEN 'notes' END AS body_name, pos // 5 AS section_no,
  CASE WHEN length(text) < 45 THEN 1 ELSE 2 END AS depth, CASE WHEN length(text) < 60 THEN 'title' WHEN length(text) < 90 THEN 'subtitle'
  WHEN length(text) < 120 THEN 'cite' WHEN length(text) < 130 THEN 'image' ELSE 'p' END AS tag, text FROM lines"""


@query(
    "fb2_chapters",
    sql(
        """SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY section_no) - 1 AS chapter_index, coalesce(own, 'Chapter ' || (section_no + 1)) AS title,
  row_number() OVER (PARTITION BY doc, section_no ORDER BY pos) - 1 AS block_index, CASE tag WHEN 'title' THEN 'heading' WHEN 'subtitle' THEN 'heading' WHEN 'cite' THEN 'quote' ELSE 'para' END AS kind, text
  FROM nodes LEFT JOIN (SELECT doc, section_no, arg_min(text, pos) AS own FROM nodes WHERE body_name IS NULL AND tag = 'title' AND depth = 1 GROUP BY ALL) USING (doc, section_no)
  WHERE body_name IS NULL AND NOT (tag = 'title' AND depth = 1) AND tag <> 'image'""",
        lines=LINES, nodes=_NODES,
    ),
)
def fb2_chapters(spark, sf):
    out = structured.fb2_chapters(fb2_nodes(spark, sf), LINE_LEVELS)
    return out.select("doc", "chapter_index", "title", "block_index", "kind", "text")


def fb2_nodes(spark, sf):
    size = F.length("text")
    tag = F.when(size < 60, "title").when(size < 90, "subtitle").when(size < 120, "cite").when(size < 130, "image").otherwise("p")
    return lines(spark, sf).select(
        F.col("doc_id").alias("doc"), "pos", "slab", F.when(size > 400, "notes").alias("body_name"),
        F.floor(F.col("pos") / 5).alias("section_no"), F.when(size < 45, 1).otherwise(2).alias("depth"), tag.alias("tag"), "text",
    )


@query(
    "fb2_metadata",
    """SELECT c_custkey, c_name AS title, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE 'Ann ' || c_mktsegment END AS author,
  CASE WHEN c_nationkey > 12 THEN 'en' ELSE 'und' END AS language FROM customer""",
)
def fb2_metadata(spark, sf):
    c = table(spark, sf, "customer")
    first = F.when(F.col("c_acctbal") < 0, "").otherwise("<first-name>Ann</first-name>")
    lang = F.when(F.col("c_nationkey") > 12, "<lang>EN-gb</lang>").otherwise("")
    xml = F.concat(
        F.lit("<FictionBook><description><title-info><author>"), first, F.lit("<last-name>"), F.col("c_mktsegment"),
        F.lit("</last-name></author><book-title> "), F.col("c_name"), F.lit(" </book-title>"), lang,
        F.lit("</title-info></description><body><section><p>x</p></section></body></FictionBook>"),
    )
    title, author, language_ = structured.fb2_metadata(xml)
    return c.select("c_custkey", title.alias("title"), author.alias("author"), language_.alias("language"))


# --------------------------------------------------------------------- rejects

_CUT_SQL = "contains(url, '?page=')"
_REJECTS = f"""SELECT 'html' AS format, 'p' || page_id AS doc, 'no text in any text element' AS error FROM pages WHERE {_CUT_SQL} OR page_id NOT IN (SELECT page_id FROM b)
  UNION ALL SELECT 'epub', doc, 'no text in any spine item' FROM (SELECT regexp_extract(url, 'https?://([^/]+)/([a-z]+)', 1) || regexp_extract(url, 'https?://([^/]+)/([a-z]+)', 2) AS doc,
    NOT {_CUT_SQL} AND NOT (starts_with(url, 'https') AND contains(url, '#top')) AND page_id IN (SELECT page_id FROM e) AS told FROM pages) GROUP BY doc HAVING NOT bool_or(told)
  UNION ALL SELECT 'fb2', 'd' || doc, CASE WHEN bool_and(body_name IS NOT NULL) THEN 'no main body' ELSE 'no text in any section' END FROM nodes GROUP BY doc
    HAVING NOT bool_or(body_name IS NULL AND tag <> 'image' AND NOT (tag = 'title' AND depth = 1))
  UNION ALL SELECT 'docx', 'd' || doc_id, 'no text in any paragraph' FROM lines GROUP BY doc_id HAVING bool_and(length(text) > 60)
  UNION ALL SELECT 'txt', 'd' || doc_id, CASE WHEN source = 'src1' THEN 'no text encoding fits' ELSE 'contains no text' END FROM documents WHERE source IN ('src1', 'src2') OR regexp_full_match(text, '\\s*')"""


@query("parser_rejects", sql(_REJECTS, b=_HTML_BLOCKS, e=_EPUB_BLOCKS, lines=LINES, nodes=_NODES))
def parser_rejects(spark, sf):
    """What each parser cannot read, with the reason: pages of a series lose their body, long lines their words, and so on."""
    page = texts(spark, sf, "pages")
    cut = F.when(F.col("url").contains("?page="), F.regexp_extract("html", r"(?s)^(.*?)<body", 1)).otherwise(F.col("html"))
    host = F.concat(F.regexp_extract("url", "https?://([^/]+)/([a-z]+)", 1), F.regexp_extract("url", "https?://([^/]+)/([a-z]+)", 2))
    parts = page.select(
        host.alias("doc"), F.lit("yes").alias("linear"), (F.col("url").startswith("https") & F.col("url").contains("#top")).alias("is_nav"), cut.alias("html")
    )
    name = lambda letter, id: F.concat(F.lit(letter), id).alias("doc")
    line = lines(spark, sf)
    paras = line.select(name("d", "doc_id"), F.when(F.length("text") > 60, " ").otherwise(F.col("text")).alias("text"))
    source, text = F.col("source"), F.col("text")
    files = texts(spark, sf, "documents").select(
        name("d", "doc_id").alias("path"), F.when(source == "src2", F.regexp_replace(text, r"\S", "")).when(source != "src1", text).alias("text")
    )
    found = {
        "html": structured.page_rejects(page.select(name("p", "page_id"), cut.alias("html"))),
        "epub": structured.spine_rejects(parts),
        "fb2": structured.section_rejects(fb2_nodes(spark, sf).withColumn("doc", name("d", "doc"))),
        "docx": structured.paragraph_rejects(paras),
        "txt": S.text_rejects(files).withColumnRenamed("path", "doc"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("format"), "doc", "error") for kind, df in found.items()])


# -------------------------------------------------------------------- language

_SAMPLES = """SELECT doc_id, lang, CASE WHEN sum(length(text)) >= 800 THEN substr(string_agg(text, ' ' ORDER BY pos), 1, 800) ELSE string_agg(text, ' ' ORDER BY pos) END AS sample
  FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM lines)
  WHERE seen < 800 GROUP BY ALL"""


def samples(spark, sf):
    return language.language_sample(lines(spark, sf), "doc_id", LINE_LEVELS)


@query("language_sample", sql("SELECT doc_id, sample FROM samples", lines=LINES, samples=_SAMPLES))
def language_sample(spark, sf):
    return samples(spark, sf)


_DETECT = """SELECT s.doc_id, s.lang, d.detected FROM samples s LEFT JOIN (
  SELECT doc_id, arg_max(language, {'s': score, 'l': language}) AS detected FROM (
    SELECT doc_id, language, sum(n * weight) + max(base) * any_value(size) AS score
    FROM (SELECT doc_id, gram, count(*) AS n FROM grams WHERE usable GROUP BY ALL) JOIN model USING (gram)
    JOIN (SELECT doc_id, count(*) AS size FROM grams GROUP BY 1) z USING (doc_id) GROUP BY ALL) GROUP BY 1) d USING (doc_id)"""
_GRAMS = f"""SELECT doc_id, lang, length(t) >= 20 AS usable, substr(t, i, 3) AS gram FROM (
  SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, lang, lower(trim(sample, {WS})) AS t FROM samples))"""
_MODEL = """SELECT lang AS language, gram, CAST(round(ln(n + 1) * 1000000) AS BIGINT) AS weight,
  CAST(round(-ln(sum(n + 1) OVER (PARTITION BY lang)) * 1000000) AS BIGINT) AS base FROM (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL)"""


def _detected(spark, sf):
    """The samples, of bounded length, are kept: model, grams, sizes and labels are all of these."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda t: strip(t)), lambda t: t != "")
    labelled = cut_lineage(texts(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("language"), language.sample_of(kept).alias("sample")
    ))
    model = language.train(labelled.select("language", "sample"))
    found = language.detect(labelled.select("doc_id", "sample"), model, "doc_id")
    return found.join(labelled.select("doc_id", "language"), "doc_id")


@query(
    "language_detection",
    sql("SELECT doc_id, detected FROM detected", lines=LINES, samples=_SAMPLES, grams=_GRAMS, model=_MODEL, detected=_DETECT),
)
def language_detection(spark, sf):
    return _detected(spark, sf).select("doc_id", "detected")


@query(
    "language_resolution",
    sql(
        """SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN NULL ELSE lang END, detected, 'en') AS language FROM detected""",
        lines=LINES, samples=_SAMPLES, grams=_GRAMS, model=_MODEL, detected=_DETECT,
    ),
)
def language_resolution(spark, sf):
    """English documents claim "und" and French ones nothing."""
    claimed = F.when(F.col("language") == "en", "und").when(F.col("language") == "fr", "").otherwise(F.col("language"))
    return _detected(spark, sf).select("doc_id", language.resolve(claimed, F.col("detected")).alias("language"))
