"""Display text for sizes, durations, timestamps and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.strings import bind, blank_to_null, word_count

# ---------------------------------------------------------------- fixed values
WORDS_PER_MINUTE = 150
CHARS_PER_MINUTE_ZH = 240
MEDIA_TYPES = {
    "mp3": "audio/mpeg", "m4b": "audio/mp4", "opus": "audio/ogg", "flac": "audio/flac", "wav": "audio/wav",
    "srt": "application/x-subrip", "vtt": "text/vtt", "mp4": "video/mp4", "chapters": "text/plain",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
UPLOAD_UNSAFE, UPLOAD_DEFAULT = "[^A-Za-z0-9._-]+", "upload"
TITLE_UNSAFE, TITLE_DEFAULT = "[^A-Za-z0-9 ._-]+", "book"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# ------------------------------------------------------------ end fixed values


def minutes_text(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    rest = F.floor(minutes % 60 + 0.5)
    return (
        F.when(minutes < 1, "<1 min")
        .when(hours > 0, F.concat(hours, F.lit("h "), rest, F.lit("m")))
        .otherwise(F.concat(rest, F.lit(" min")))
    )


def passage_length(text: Column, language: Column) -> Column:
    """Characters for Chinese, words for every other language."""
    return F.when(language == "zh", F.length(text).cast("bigint")).otherwise(word_count(text))


def target_length(language: Column, minutes: Column) -> Column:
    pace = F.when(language == "zh", CHARS_PER_MINUTE_ZH).otherwise(WORDS_PER_MINUTE)
    return F.greatest(F.lit(1).cast("bigint"), F.floor(minutes * pace))


def utc_iso(ts: Column) -> Column:
    """ISO text with offset; microseconds only where they are not zero."""
    micros = F.unix_micros(ts) % 1000000
    tail = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("+00:00"))


def bytes_text(size: Column) -> Column:
    """Size in the largest fitting unit, one decimal under ten; rounded half up, exactly."""

    def read(n: Column) -> Column:
        out = None
        for power in reversed(range(len(SIZE_UNITS))):
            scale = 1024**power
            tenths = F.shiftright(n * 20 + scale, 10 * power + 1)
            one = F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10)
            whole = F.shiftright(n * 2 + scale, 10 * power + 1).cast("string")
            if power == 0:
                text = n.cast("string")
            elif power == len(SIZE_UNITS) - 1:
                text = one
            else:
                text = F.when(n < 10 * scale, one).otherwise(whole)
            text = F.concat(text, F.lit(SIZE_UNITS[power]))
            out = text if out is None else F.when(n < 1024 ** (power + 1), text).otherwise(out)
        return out

    return bind(size.cast("bigint"), read)


def media_type(fmt: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, fmt), F.lit(DEFAULT_MEDIA_TYPE))


def upload_name(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)[/\\]*$", 1)
    return F.coalesce(blank_to_null(F.regexp_replace(base, UPLOAD_UNSAFE, "_")), F.lit(UPLOAD_DEFAULT))


def title_name(title: Column) -> Column:
    safe = F.btrim(F.regexp_replace(title, TITLE_UNSAFE, "_"))
    return F.coalesce(blank_to_null(safe), F.lit(TITLE_DEFAULT))
