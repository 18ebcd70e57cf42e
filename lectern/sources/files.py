"""Raw files: intake limit, format sniffing, parser resolution, text decoding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
MAX_UPLOAD_MB = 200
SNIFF_BYTES = 2048
# Parser → extensions, in order of preference.
PARSER_EXTENSIONS = {
    "epub": ["epub"],
    "docx": ["docx"],
    "pdf": ["pdf"],
    "fb2": ["fb2"],
    "html": ["html", "htm"],
    "converter": ["mobi", "azw", "azw3", "lit", "pdb", "rtf"],
    "txt": ["txt"],
}
CONVERTER_NOTE = "requires an external e-book converter"
CODE_PAGES = ["cp1252", "cp1250"]
# Letters that speak for a code page when they appear.
CODE_PAGE_LETTERS = {
    "cp1250": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻäöüßÄÖÜ",
    "cp1252": "àâçéèêëîïôùûüÿñáíóúäöüßÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚÄÖÜ",
}
# Encodings with their script's range and its most frequent letters.
WIDE_ENCODINGS = [
    ("gb18030", "\u3400", "\u9fff", "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后"),
    ("big5", "\u3400", "\u9fff", "的一是不了人我在有他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後"),
    ("cp1251", "\u0400", "\u04ff", "оеаинтсрвл"),
    ("koi8-r", "\u0400", "\u04ff", "оеаинтсрвл"),
]
DOUBLE_BYTE = ["gb18030", "big5"]
SHORT = 30  # letters beyond ASCII, below which their frequencies prove little
# ------------------------------------------------------------ end fixed values


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder (path, modificationTime, length, content); a column that is not asked for is not read.

    Empty files give no row.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, max_mb: float = MAX_UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    """Files within the size limit, and the rejected ones with the reason.

    The scan leaves out files by their length before it opens them; of rejected ones only metadata is read.
    """
    return split_by_size(scan_files(spark, path), max_mb)


def split_by_size(files: DataFrame, max_mb: float = MAX_UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    limit = int(max_mb * 1024 * 1024)
    rejected = files.filter(F.col("length") > limit).select("path", "length")
    reason = F.lit(f"file exceeds the {max_mb:g}MB upload limit")
    return files.filter(F.col("length") <= limit), rejected.withColumn("error", reason)


def file_sizes(spark: SparkSession, path: str, area: Column) -> DataFrame:
    """(area, path, length) of the files below a folder, from their metadata; ``area`` is taken of the path."""
    return scan_files(spark, path).select(area.alias("area"), "path", "length")


def formats(spark: SparkSession, converter_available: bool = False) -> DataFrame:
    """The format dimension: one row per extension, in order of preference."""
    rows = [
        (rank, parser, ext, parser != "converter" or converter_available,
         None if parser != "converter" or converter_available else CONVERTER_NOTE)
        for rank, (parser, exts) in enumerate(PARSER_EXTENSIONS.items())
        for ext in exts
    ]
    return spark.createDataFrame(rows, "rank int, parser string, extension string, available boolean, note string")


def sniff_format(content: Column) -> Column:
    """Format by magic bytes, "" if none is known. Zip members are searched in the whole file."""
    head = F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1")
    text = F.ltrim(head, F.lit("\xef\xbb\xbf \t\r\n"))
    low = F.lower(head)
    whole = F.decode(content, "ISO-8859-1")
    is_zip = head.startswith("PK\x03\x04")
    is_xml = text.startswith("<?xml")
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("{\\rtf"), "rtf")
        .when(is_xml & head.contains("FictionBook"), "fb2")
        .when(is_xml & (low.contains("<html") | low.contains("<!doctype html")), "html")
        .when(F.lower(F.substring(text, 1, 5)).isin("<html", "<!doc"), "html")
        .when(is_zip & whole.contains("mimetypeapplication/epub+zip"), "epub")
        .when(is_zip & whole.contains("word/document.xml"), "docx")
        .when((F.length(head) > 68) & F.substring(head, 61, 8).isin("BOOKMOBI", "TEXtREAd"), "mobi")
        .otherwise("")
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def parser_for(fmt: Column) -> Column:
    """Parser of a format or extension; null if none. The dimension is a literal map."""
    pairs = [F.lit(x) for parser, exts in PARSER_EXTENSIONS.items() for ext in exts for x in (ext, parser)]
    return F.try_element_at(F.create_map(*pairs), fmt)


def resolve_parsers(files: DataFrame) -> DataFrame:
    """Add sniffed format, parser and error: content first, then the extension of ``path``."""
    sniffed = files.withColumn("sniffed", sniff_format(F.col("content")))
    parser = F.coalesce(parser_for(F.col("sniffed")), parser_for(extension(F.col("path"))))
    shown = F.when(F.col("sniffed") == "", "unknown").otherwise(F.col("sniffed"))
    return sniffed.withColumn("parser", parser).withColumn(
        "error",
        F.when(
            F.col("parser").isNull(),
            F.concat(F.lit("no parser recognizes "), F.col("path"), F.lit(" (sniffed format: "), shown, F.lit(")")),
        ),
    )


def needs_converter(files: DataFrame) -> DataFrame:
    """Files only an external converter could read."""
    return files.filter(F.col("parser") == "converter").withColumn("note", F.lit(CONVERTER_NOTE))


_HIGH = "".join(chr(b) for b in range(128, 256))


def _code_page_text(content: Column, page: str) -> Column:
    """Bytes as Latin-1, whose upper half is then mapped to the code page."""
    mapped = bytes(range(128, 256)).decode(page, errors="replace")
    return F.translate(F.decode(content, "ISO-8859-1"), _HIGH, mapped)


def _latin_text(content: Column) -> Column:
    """The code page with most of its own letters; earlier pages win ties; null if all leave undefined bytes."""
    best = F.lit(None).cast("string")
    score = F.lit(-1)
    for page in CODE_PAGES:
        text = _code_page_text(content, page)
        letters = F.length(F.regexp_replace(text, f"[^{CODE_PAGE_LETTERS[page]}]", ""))
        bad = F.length(F.regexp_replace(text, "[^\ufffd\x80-\x9f]", ""))
        fit = letters - bad * 10
        best = F.when(fit > score, text).otherwise(best)
        score = F.greatest(fit, score)
    return best


def _charset_text(content: Column, charset: str) -> Column:
    """Bytes through one of the JVM's own charsets; what it cannot read becomes U+FFFD."""
    escaped = F.regexp_replace(F.hex(content), "(..)", "%$1")
    return F.reflect(F.lit("java.net.URLDecoder"), F.lit("decode"), escaped, F.lit(charset))


def _two_byte_text(content: Column) -> Column:
    """UTF-16: a mark tells the order of the bytes, else the places of the zero bytes."""
    latin1 = F.decode(content, "ISO-8859-1")
    zeros = lambda place: F.regexp_count(F.regexp_replace(latin1, "(?s)(.)(.)", place), F.lit("\\x00"))
    little = _charset_text(content, "UTF-16LE")
    return (
        F.when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), _charset_text(content, "UTF-16"))
        .when(zeros("$2") >= zeros("$1"), little)
        .otherwise(_charset_text(content, "UTF-16BE"))
    )


def _script_text(content: Column, encodings: list[tuple[str, str, str, str]] = WIDE_ENCODINGS, least: float = 0.05) -> Column:
    """Text whose letters are mostly bytes beyond ASCII (Chinese, Cyrillic); null if no encoding fits.

    A candidate must read every byte, and nearly all that is beyond ASCII must be letters of its script and outnumber
    ASCII letters; the share of the script's most frequent letters decides between those left, earlier ones win ties.
    Small letters are not followed by capitals. A short text proves less: there letters beyond ASCII must outnumber
    the others by far.
    """
    best, score = F.lit(None).cast("string"), F.lit(least)
    for name, low, high, frequent in encodings:
        text = _charset_text(content, name)
        many = lambda letters, text=text: F.regexp_count(text, F.lit(letters))
        beyond = many("[^\\x00-\\x7f]")
        own = many(f"[{low}-{high}\u3000-\u303f\uff00-\uffef«»—–…№„“”‘’]")
        mixed = F.when(beyond < SHORT, 5).otherwise(2) * many("[A-Za-z]") <= beyond
        turned = many("[а-яё][А-ЯЁ]")
        fits = ~text.contains("\ufffd") & (own >= 0.95 * beyond) & mixed & (10 * turned <= beyond)
        share = F.when(fits, many(f"[{frequent}]") / F.nullif(beyond, F.lit(0)))
        best = F.when(share > score, text).otherwise(best)
        score = F.greatest(score, share)
    return best


def _few_cyrillic_letters(content: Column) -> Column:
    """A text of a few letters, none of them ASCII, as Russian; null if it may as well be Latin.

    Too few letters to count are told by their case, since capitals of one code page are small letters of the other:
    words are small throughout, or begin with a capital and have mostly frequent letters.
    """
    small, capitalised = [], []
    for name, _, _, frequent in WIDE_ENCODINGS:
        if name in DOUBLE_BYTE:
            continue
        text = _charset_text(content, name)
        letters = F.regexp_replace(text, "[^а-яёА-ЯЁ]", "")
        known = 2 * F.regexp_count(F.lower(letters), F.lit(f"[{frequent}]")) > F.length(letters)
        fits = ~text.rlike("[^\\x00-\\x7fа-яёА-ЯЁ]") & (letters != "")
        small.append(F.when(fits & (letters == F.lower(letters)), text))
        words = text.rlike("^[^а-яё]*[А-ЯЁ]") & ~text.rlike("[а-яёА-ЯЁ][А-ЯЁ]")
        capitalised.append(F.when(fits & words & known, text))
    return F.coalesce(*small, *capitalised)


def decode_text(content: Column) -> Column:
    """Text of a file's bytes; null if no encoding fits.

    A byte order mark decides; then UTF-8 where valid, UTF-16 where every other byte is mostly zero, Chinese and
    Cyrillic encodings where bytes beyond ASCII come in runs, else the Latin code pages. Where such bytes stand alone
    but are many, as in Chinese whose second bytes are ASCII, the Chinese encodings are tried first. A few letters
    without an ASCII one among them are Cyrillic rather than Latin. Ideographs of UTF-8 none of which is frequent are
    letters of a code page if all their bytes are. Only functions of the engine read the bytes, and those of a kind
    only rows of that kind.
    """
    raw = content.cast("string")
    latin1 = F.decode(content, "ISO-8859-1")
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    zeros = F.regexp_count(latin1, F.lit("\\x00"))
    two_bytes = marked | (zeros * 3 > F.octet_length(content))
    runs = F.regexp_count(latin1, F.lit("[\\x80-\\xff]+"))
    high = F.regexp_count(latin1, F.lit("[\\x80-\\xff]"))
    dense = high > 1.6 * runs
    paired = high > 0.4 * F.regexp_count(latin1, F.lit("[A-Za-z\\x80-\\xff]"))
    few = (high < SHORT) & (high > 0) & ~latin1.rlike("[A-Za-z]")
    chinese = [e for e in WIDE_ENCODINGS if e[0] in DOUBLE_BYTE]
    common = "".join(frequent for _, _, _, frequent in chinese)
    letters = CODE_PAGE_LETTERS["cp1250"].encode("cp1250").decode("latin-1")
    chance = (
        (high > 0) & (high < SHORT) & ~latin1.rlike(f"[^\\x00-\\x7f{letters}]")
        & ~raw.rlike(f"[^\\x00-\\x7f\u3400-\u9fff]|[{common}]")
    )
    plain = F.is_valid_utf8(raw) & ~two_bytes
    return (
        F.when(plain & ~chance, F.regexp_replace(raw, "^\ufeff", ""))
        .when(plain, _latin_text(content))
        .when(two_bytes, _two_byte_text(content))
        .when(few, F.coalesce(_script_text(content, chinese, 0.5), _few_cyrillic_letters(content), _script_text(content), _latin_text(content)))
        .when(dense, F.coalesce(_script_text(content), _latin_text(content)))
        .when(paired, F.coalesce(_script_text(content, chinese), _latin_text(content)))
        .otherwise(_latin_text(content))
    )


def text_rejects(files: DataFrame) -> DataFrame:
    """Files (path, text) that give no text, with the reason."""
    blank = F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == ""
    return files.select(
        "path",
        F.when(F.col("text").isNull(), F.lit("no text encoding fits")).when(blank, F.lit("contains no text")).alias("error"),
    ).filter("error IS NOT NULL")


Parser = Callable[[DataFrame], DataFrame]


@dataclass
class ParserRegistry:
    """Parser name → function from resolved files to block rows.

    Container formats need a decoder of the user's own (for example a
    ``mapInPandas`` over the binary column); it is registered the same way.
    """

    parsers: dict[str, Parser] = field(default_factory=dict)

    def register(self, name: str, parser: Parser) -> None:
        self.parsers[name] = parser

    def parse(self, files: DataFrame) -> dict[str, DataFrame]:
        """Blocks per registered parser, each over its own files."""
        return {name: parser(files.filter(F.col("parser") == name)) for name, parser in self.parsers.items()}

    def unregistered(self, files: DataFrame) -> DataFrame:
        known = list(self.parsers)
        return files.filter(F.col("parser").isNull() | ~F.col("parser").isin(known)).withColumn(
            "error", F.coalesce(F.col("error"), F.concat(F.lit("no decoder registered for "), F.col("parser")))
        )
