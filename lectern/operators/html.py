"""HTML pages to chapters of blocks, inside the row.

Block-level tags cut the page into pieces. A walk over the pieces keeps the open tags;
each piece of text is a block of the nearest open text tag, so text before, between and
behind nested blocks is kept once, in order. Text outside of all text tags is left out.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.strings import bind, blank_to_null, regex_split, regex_transform, scan, strip
from lectern.operators.fold import chapter_title, fold_array

# ---------------------------------------------------------------- fixed values
SKIPPED_TAGS = ["script", "style", "nav", "header", "footer", "svg", "img", "figure", "aside"]
SKIPPED_TAGS_EPUB = ["script", "style", "nav", "svg", "img", "figure"]
TEXT_TAGS = "h[1-6]|blockquote|p|li|dd|figcaption"
BREAKING_TAGS = TEXT_TAGS + "|div|section|article|main|ul|ol|dl|dt|table|tr|td|th|pre|body|html|head|title"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "sbquo": "‚", "bdquo": "„", "laquo": "«", "raquo": "»",
    "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢", "frac12": "½", "shy": "\xad", "auml": "ä", "ouml": "ö", "uuml": "ü",
    "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "ntilde": "ñ", "oacute": "ó",
}
# ------------------------------------------------------------ end fixed values

CUT = "\x1e"
UNREADABLE = "\ufffd"
#: Elements whose content is no markup, so that they end with their first end tag.
RAW_TAGS = ("script", "style")


def strip_boilerplate(html: Column, tags: list[str] = SKIPPED_TAGS) -> Column:
    """Without comments and the named elements, however these are nested.

    An element that is never closed takes the rest of the page with it; an end tag
    without a start is dropped.
    """
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in tags:
        if tag in RAW_TAGS:
            out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    if "img" in tags:
        out = F.regexp_replace(out, r"(?i)<img\b[^>]*>", "")
    nested = "|".join(t for t in tags if t != "img" and t not in RAW_TAGS)
    return bind(out, lambda x: F.when(x.rlike(rf"(?i)</?(?:{nested})\b"), _outside(x, nested)).otherwise(x))


def _outside(html: Column, names: str) -> Column:
    """The parts at depth 0 of the named elements."""
    pieces = F.split(F.regexp_replace(html, rf"(?i)<(?=/?(?:{names})\b)", CUT + "<"), CUT, -1)
    opening, closing, single = rf"(?i)^<(?:{names})\b", rf"(?i)^</(?:{names})\b", r"^<[^>]*/>"

    def depth(before: Column, piece: Column) -> Column:
        step = F.when(piece.rlike(closing), -1).when(piece.rlike(opening) & ~piece.rlike(single), 1).otherwise(0)
        return F.greatest(before + step, F.lit(0))

    def rest(now: Column, piece: Column) -> Column:
        tagged = piece.rlike(opening) | piece.rlike(closing)
        return F.when(now == 0, F.when(tagged, F.regexp_replace(piece, "^<[^>]*>?", "")).otherwise(piece))

    return F.array_join(scan(pieces, F.lit(0), "string", depth, rest), "")


def unescape(text: Column) -> Column:
    """Named and numeric character references, in one pass; references to no character become U+FFFD."""
    common = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    every = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k[-1] == ";"})), "map<string,string>")

    def read(hit: Column) -> Column:
        name = F.substring(hit, F.lit(2), F.length(hit) - 2)
        hexed = name.rlike("^#[xX]")
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        short = F.when(F.length(digits) <= 7, digits)
        code = F.when(hexed, F.conv(short, 16, 10)).otherwise(short).try_cast("bigint")
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code)), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(common, name), F.try_element_at(every, name), hit)
        return F.when(name.startswith("#"), F.coalesce(char, F.lit(UNREADABLE))).otherwise(named)

    return regex_transform(text, "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", read, hint="&[#A-Za-z]")


def inner_text(markup: Column) -> Column:
    """Texts between tags, trimmed, empty ones dropped, joined by a blank."""
    pieces = F.transform(regex_split(markup, "<[^>]*>"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def blocks(html: Column, tags: list[str] = SKIPPED_TAGS) -> Column:
    """Blocks in document order as array<struct<tag, text>>; empty ones dropped."""
    marked = F.regexp_replace(strip_boilerplate(html, tags), rf"(?i)<(?=/?(?:{BREAKING_TAGS})\b)", CUT + "<")
    name = r"(?i)^</?([a-z][a-z0-9]*)"
    pieces = F.transform(
        F.split(marked, CUT, -1),
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, name, 1)).alias("tag"),
            p.startswith("</").alias("closes"),
            inner_text(F.regexp_replace(p, "^<[^>]*>?", "")).alias("text"),
        ),
    )
    # The open tags are one text of "/tag:owner", with the text tag that owns the text there: steps copy their state.
    top = lambda open_: F.substring_index(open_, "/", -1)
    owner = lambda open_: F.substring_index(top(open_), ":", -1)

    def walk(open_: Column, piece: Column) -> Column:
        tag, last = piece["tag"], F.substring_index(top(open_), ":", 1)
        # a paragraph or heading ends where the next block begins, an item where the next item does
        ended = last.rlike("^(?:p|h[1-6])$") | ((last == tag) & tag.isin("li", "dd", "dt"))
        without_top = F.left(open_, F.length(open_) - F.length(top(open_)) - 1)
        opened = bind(
            F.when(ended, without_top).otherwise(open_),
            lambda now: F.concat(
                now, F.lit("/"), tag, F.lit(":"), F.when(tag.rlike(f"^(?:{TEXT_TAGS})$"), tag).otherwise(owner(now))
            ),
        )
        mark = F.concat(F.lit("/"), tag, F.lit(":"))
        # what is open inside the last one of its name goes with it
        rest = F.length(F.call_function("substring_index", open_, mark, F.lit(-1))) + F.length(mark)
        closed = F.when(last == tag, without_top).when(F.contains(open_, mark), F.left(open_, F.length(open_) - rest)).otherwise(open_)
        return F.when(tag == "", open_).when(piece["closes"], closed).otherwise(opened)

    def block(now: Column, piece: Column) -> Column:
        held = F.struct(owner(now).alias("tag"), piece["text"].alias("text"))
        return F.when((owner(now) != "") & (piece["text"] != ""), held)

    return scan(pieces, F.lit(""), "struct<tag:string,text:string>", walk, block)


def kind_of(tag: Column) -> Column:
    return F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "blockquote", "quote").otherwise("para")


def as_block(entry: Column) -> Column:
    return F.struct(kind_of(entry["tag"]).alias("kind"), entry["text"].alias("text"))


def title(html: Column, fallback: Column) -> Column:
    found = inner_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))
    return F.when(html.rlike(r"(?i)<title\b"), found).otherwise(fallback)


def language(html: Column) -> Column:
    lang = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.lower(F.coalesce(blank_to_null(F.substring_index(lang, "-", 1)), F.lit("und")))


def html_chapters(html: Column, doc_title: Column) -> Column:
    """h1 and h2 open chapters; text before the first takes the document title."""
    return fold_array(
        blocks(html),
        lambda b: b["tag"].isin("h1", "h2"),
        lambda b: chapter_title(b["text"]),
        doc_title,
        as_block,
    )


def first_heading(found: Column) -> Column:
    return F.get(F.filter(found, lambda b: b["tag"].rlike("^h[1-6]$")), F.lit(0))["text"]


def readable(found: Column) -> Column:
    return bind(found, lambda f: F.size(f) > 0)
