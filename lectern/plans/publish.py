"""Subtitles, chapter lists, descriptions and chapter metadata as ordered lines.

A document is rows (job_id, line_no, line); written in order, one newline after
each row, they make the file. A long job is never one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import strip
from lectern.operators.ordered import Levels, row_numbers
from lectern.plans.timeline import assemble

# ---------------------------------------------------------------- fixed values
VTT_HEADER = "WEBVTT"
METADATA_HEADER = ";FFMETADATA1"
METADATA_ESCAPED = r"([=;#\\\n])"
# ------------------------------------------------------------ end fixed values


def _milliseconds(seconds: Column) -> Column:
    return F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")


def _clock(ms: Column, mark: str) -> Column:
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d",
        F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )


def srt_timestamp(seconds: Column) -> Column:
    return _clock(_milliseconds(seconds), ",")


def vtt_timestamp(seconds: Column) -> Column:
    return _clock(_milliseconds(seconds), ".")


def chapter_timestamp(seconds: Column) -> Column:
    """H:MM:SS from one hour on, else M:SS."""
    total = F.greatest(F.lit(0).cast("bigint"), F.bround(seconds).cast("bigint"))
    return F.when(
        total >= 3600,
        F.format_string("%d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60),
    ).otherwise(F.format_string("%d:%02d", F.floor(total / 60), total % 60))


def subtitle_cues(segments: DataFrame) -> DataFrame:
    """Timed segments with text; blank or untimed ones give no cue."""
    text = strip(F.col("text"))
    return segments.filter((text != "") & F.col("start_s").isNotNull() & F.col("duration_s").isNotNull()).withColumns(
        {"text": text, "end_s": F.col("start_s") + F.col("duration_s")}
    )


def is_spoken() -> Column:
    """Whether a segment that is not yet timed gives a cue."""
    return F.coalesce((strip(F.col("text")) != "") & F.col("samples").isNotNull() & F.col("sample_rate").isNotNull(), F.lit(False))


def timed_cues(segments: DataFrame, levels: Levels) -> DataFrame:
    """Cues of the jobs' segments with their number in the job (``no``, from 0), times and text.

    Samples and spoken segments are summed in one pass, so the segments meet their offsets once. ``segments``: job_id, the
    columns of ``levels``, text, samples, sample_rate and pause_after_s.
    """
    timed = assemble(segments, ["job_id"], levels, {"no": is_spoken().cast("bigint")})
    return subtitle_cues(timed).drop("samples", "sample_rate", "pause_after_s")


def _numbered(cues: DataFrame, levels: Levels) -> DataFrame:
    return cues if "no" in cues.columns else row_numbers(cues, ["job_id"], levels, "no")


def _without_rows(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    # Distinct first: a long job then crosses the network as a few rows.
    return jobs.select("job_id").join(rows.select("job_id").distinct(), "job_id", "left_anti")


def _lines(df: DataFrame, number: Column, line: Column) -> DataFrame:
    return df.select("job_id", number.cast("bigint").alias("line_no"), line.alias("line"))


def srt_lines(cues: DataFrame, jobs: DataFrame, levels: Levels, told: DataFrame | None = None) -> DataFrame:
    """``told``: rows with the job_id of every job that has cues, where they cost less than the cues."""
    numbered = _numbered(cues, levels)
    span = F.concat(srt_timestamp(F.col("start_s")), F.lit(" --> "), srt_timestamp(F.col("end_s")))
    gap = F.when(F.col("no") > 0, "\n").otherwise("")
    block = F.concat(gap, F.col("no") + 1, F.lit("\n"), span, F.lit("\n"), F.col("text"))
    return _lines(numbered, F.col("no") + 1, block).unionByName(
        _lines(_without_rows(jobs, cues if told is None else told), F.lit(1), F.lit(""))
    )


def vtt_lines(cues: DataFrame, jobs: DataFrame, levels: Levels, told: DataFrame | None = None) -> DataFrame:
    """``told`` as for SRT."""
    numbered = _numbered(cues, levels)
    span = F.concat(vtt_timestamp(F.col("start_s")), F.lit(" --> "), vtt_timestamp(F.col("end_s")))
    gap = F.when(F.col("no") > 0, "\n").otherwise("")
    return (
        _lines(jobs, F.lit(0), F.lit(VTT_HEADER + "\n"))
        .unionByName(_lines(numbered, F.col("no") + 1, F.concat(gap, span, F.lit("\n"), F.col("text"))))
        .unionByName(_lines(_without_rows(jobs, cues if told is None else told), F.lit(1), F.lit("")))
    )


def chapter_list_lines(markers: DataFrame) -> DataFrame:
    """``0:00 Title`` for each numbered marker (idx from 0)."""
    text = F.concat(chapter_timestamp(F.col("start_s")), F.lit(" "), F.col("title"))
    return _lines(markers, F.col("idx") + 1, text)


def description_lines(markers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Title, author if there is one, an empty line, then the chapter list."""
    author = F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.concat(F.lit("\n"), F.col("author"))).otherwise("")
    head = _lines(jobs, F.lit(0), F.concat(F.col("title"), author, F.lit("\n")))
    none = _lines(_without_rows(jobs, markers), F.lit(1), F.lit(""))
    return head.unionByName(chapter_list_lines(markers)).unionByName(none)


def escape_metadata(value: Column) -> Column:
    return F.regexp_replace(value, METADATA_ESCAPED, r"\\$1")


def metadata_lines(markers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Header and tags of a job, then one entry per chapter in milliseconds."""

    def tag(name: str, column: str) -> Column:
        value = F.col(column)
        return F.when(value != "", F.concat(F.lit(f"{name}="), escape_metadata(value)))

    head = F.concat_ws("\n", F.lit(METADATA_HEADER), tag("title", "title"), tag("artist", "author"), tag("album", "title"))
    entry = F.concat_ws(
        "\n",
        F.lit("[CHAPTER]"),
        F.lit("TIMEBASE=1/1000"),
        F.concat(F.lit("START="), F.bround(F.col("start_s") * 1000).cast("bigint")),
        F.concat(F.lit("END="), F.bround(F.col("end_s") * 1000).cast("bigint")),
        F.concat(F.lit("title="), escape_metadata(F.col("title"))),
    )
    return _lines(jobs, F.lit(0), head).unionByName(_lines(markers, F.col("idx") + 1, entry))


def part_filename(base: Column, extension: Column, index: Column, total: Column) -> Column:
    part = F.concat(F.lit(" - Part "), index, F.lit(" of "), total)
    return F.concat(base, F.when(total <= 1, "").otherwise(part), F.lit("."), extension)


def part_title(title: Column, index: Column, total: Column) -> Column:
    part = F.concat(F.lit(" — Part "), index, F.lit(" of "), total)
    return F.concat(title, F.when(total <= 1, "").otherwise(part))
