"""Catalog operators: books, chapters, jobs, voices, settings, storage.

Lists that a client would nest come back flat with a position column, so that no
group is ever gathered into one row.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions.lexicon import with_errors
from lectern.operators.ordered import Levels, row_numbers

# ---------------------------------------------------------------- fixed values
LANGUAGE_ROUTING = {"en": "kokoro", "zh": "kokoro", "pl": "piper", "de": "piper"}
VOICE_LANGUAGES = {
    "a": "en", "b": "en", "e": "es", "f": "fr", "h": "hi", "i": "it", "j": "ja", "p": "pt", "z": "zh",
}
VOICE_GENDERS = {"f": "female", "m": "male"}
DEFAULT_SAMPLE_RATE = 22050
EXPORT_FORMATS = ["mp3", "m4b", "opus", "flac", "wav", "srt", "vtt", "mp4", "chapters"]
DEFAULT_FORMATS = ["mp3"]
VIDEO_STYLES = ["static", "waveform", "kenburns"]
STAGES = ["prepare", "synthesize", "assemble", "master", "export"]
SETTING_DEFAULTS = {
    "tts_workers": "4",
    "loudness_target_i": "-19.0",
    "loudness_target_tp": "-3.0",
    "loudness_target_lra": "7.0",
    "mp4_part_limit_s": "42300",
}
# ------------------------------------------------------------ end fixed values


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


# ---------------------------------------------------------- books and chapters


def list_books(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Books newest first with their number of chapters and whether they have a cover."""
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count"))
    return (
        books.join(counts, "book_id", "left")
        .select(
            "book_id", "title", "author", "language", "created_at",
            F.col("cover_path").isNotNull().alias("has_cover"),
            F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
        )
        .orderBy(F.desc("created_at"), "book_id")
    )


def book_detail(chapters: DataFrame, blocks: DataFrame, levels: Levels) -> DataFrame:
    """Chapters of each book in order, with their number of blocks."""
    counts = blocks.groupBy("chapter_id").agg(F.count("*").alias("block_count"))
    return (
        row_numbers(chapters, ["book_id"], levels, "chapter_index")
        .join(counts, "chapter_id", "left")
        .withColumn("block_count", F.coalesce("block_count", F.lit(0)))
    )


def lookup(rows: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Point lookups in bulk: requested keys with ``found`` and the row's columns."""
    return requested.select(key).join(rows.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def chapter_blocks(blocks: DataFrame, levels: Levels) -> DataFrame:
    return row_numbers(blocks, ["chapter_id"], levels, "block_index")


def in_scope(claims: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """Claims whose parent and child really belong together."""
    return claims.join(owned, keys, "left_semi")


def out_of_scope(claims: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    return claims.join(owned, keys, "left_anti")


def apply_patch(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update with one patch row per key: null leaves the old value."""
    new = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    values = [F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(new, key, "left").select(*values)


def enabled_counts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    counts = chapters.groupBy("book_id").agg(F.count_if("enabled").alias("enabled_count"))
    return books.join(counts, "book_id", "left").select(
        "book_id", F.coalesce("enabled_count", F.lit(0)).alias("enabled_count")
    )


def enabled_chapters(chapters: DataFrame, levels: Levels) -> DataFrame:
    return row_numbers(chapters.filter("enabled"), ["book_id"], levels, "position")


def books_without_enabled(books: DataFrame, chapters: DataFrame) -> DataFrame:
    active = chapters.filter("enabled").select("book_id").distinct()
    return books.join(active, "book_id", "left_anti").withColumn(
        "error", F.concat(F.lit("book "), F.col("book_id"), F.lit(" has no enabled chapters"))
    )


# ----------------------------------------------------------- voices and routing


def all_voices(sources: list[DataFrame]) -> DataFrame:
    """Union of the engines' voices."""
    return reduce(DataFrame.unionByName, sources).distinct()


def decode_voice(voice_id: Column) -> tuple[Column, Column]:
    """Language and gender from the first two characters of a voice id."""
    language = F.coalesce(
        F.try_element_at(literal_map(VOICE_LANGUAGES), F.substring(voice_id, 1, 1)), F.lit("und")
    )
    return language, F.try_element_at(literal_map(VOICE_GENDERS), F.substring(voice_id, 2, 1))


def sidecar_metadata(config: Column) -> tuple[Column, Column, Column]:
    """Language, sample rate and quality from a voice's JSON sidecar, with defaults."""
    return (
        F.coalesce(F.get_json_object(config, "$.language.family"), F.lit("und")),
        F.coalesce(F.get_json_object(config, "$.audio.sample_rate").cast("int"), F.lit(DEFAULT_SAMPLE_RATE)),
        F.get_json_object(config, "$.audio.quality"),
    )


def voices_by_language(voices: DataFrame) -> DataFrame:
    """Voices listed under their language, sorted by id inside it.

    Openings of the ids are the coarse levels, so that a language with most of the voices is spread.
    """
    levelled = voices.withColumns({"__a": F.left("voice_id", F.lit(3)), "__b": F.left("voice_id", F.lit(8))})
    return row_numbers(levelled, ["language"], [["__a"], ["__b"], ["voice_id"]], "position").drop("__a", "__b")


def matching_voices(books: DataFrame, voices: DataFrame) -> DataFrame:
    """For each book the number of voices in its language and the first of them."""
    offer = voices.groupBy("language").agg(
        F.count("*").alias("voice_count"), F.min("voice_id").alias("first_voice")
    )
    return books.join(offer, "language", "left").withColumn(
        "voice_count", F.coalesce("voice_count", F.lit(0))
    )


def route(rows: DataFrame) -> DataFrame:
    """Engine for the row's language, or the error that there is none."""
    engine = F.try_element_at(literal_map(LANGUAGE_ROUTING), F.col("language"))
    known = ", ".join(sorted(LANGUAGE_ROUTING))
    error = F.concat(F.lit("no engine for language "), F.col("language"), F.lit(f" (known: {known})"))
    return rows.withColumn("engine", engine).withColumn("error", F.when(engine.isNull(), error))


def resolve_voices(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests (voice, engine, error) checked against the voice catalog; first error stays."""
    offer = voices.select(F.col("voice_id").alias("voice"), F.col("engine").alias("voice_engine")).distinct()
    unknown = F.when(F.col("voice_engine").isNull(), F.concat(F.lit("no voice named "), F.col("voice")))
    foreign = F.when(
        F.col("voice_engine") != F.col("engine"),
        F.concat(F.lit("voice "), F.col("voice"), F.lit(" belongs to engine "), F.col("voice_engine")),
    )
    return requests.join(offer, "voice", "left").withColumn("error", F.coalesce("error", unknown, foreign))


def parse_formats(csv: Column) -> Column:
    """Trimmed non-empty formats of a CSV string; the default list if none is left."""
    named = F.filter(F.transform(F.split(csv, ","), lambda f: F.trim(f)), lambda f: f != "")
    return F.when(F.size(named) > 0, named).otherwise(F.lit(DEFAULT_FORMATS))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Rules on formats and video style, in order; the first failing rule names the error."""
    named = F.filter(F.transform(F.split(F.col("formats"), ","), lambda f: F.trim(f)), lambda f: f != "")
    unknown = F.array_sort(F.array_except(named, F.lit(EXPORT_FORMATS)))
    return requests.withColumn(
        "error",
        F.coalesce(
            F.col("error"),
            F.when(F.size(named) == 0, "at least one output format is required"),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unsupported formats: "), F.array_join(unknown, ", "))),
            F.when(
                ~F.col("video_style").isin(VIDEO_STYLES),
                F.concat(F.lit("unsupported video style: "), F.col("video_style")),
            ),
        ),
    )


# ------------------------------------------------------------------------ jobs


def job_detail(stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stages by id and artifacts by format and part, one row per entry of a job."""
    stage_rows = row_numbers(
        stages.withColumn("day", F.to_date("ts")), ["job_id"], [["day"], ["ts", "event_id"]], "position"
    ).select("job_id", F.lit("stage").alias("entry"), "position", F.col("stage").alias("label"))
    parts = artifacts.withColumn("part_order", F.coalesce("part_index", F.lit(0)))
    artifact_rows = row_numbers(parts, ["job_id"], [["format", "part_order"], ["path"]], "position").select(
        "job_id", F.lit("artifact").alias("entry"), "position", F.col("path").alias("label")
    )
    return stage_rows.unionByName(artifact_rows)


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    """Jobs of a book numbered from the newest; days are the coarse level."""
    age = -F.unix_micros("created_at")
    ordered = jobs.withColumns({"__day": F.floor(age / 86_400_000_000), "__age": age})
    return row_numbers(ordered, ["book_id"], [["__day"], ["__age", "job_id"]], "position").drop("__day", "__age")


def pick_artifact(artifacts: DataFrame, part: int | None = None) -> DataFrame:
    """The artifact of each job and format: a given part, else the lowest (null counts as 1)."""
    number = F.coalesce("part_index", F.lit(1))
    chosen = artifacts if part is None else artifacts.filter(number == part)
    return chosen.groupBy("job_id", "format").agg(F.min_by("path", F.struct(number, F.col("path"))).alias("path"))


def artifacts_by_format(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id", "format").agg(
        F.count("*").alias("files"), F.min("part_index").alias("first_part"), F.max("part_index").alias("last_part")
    )


def cancel(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested jobs that are queued or running become cancelled; all others stay."""
    asked = requested.select("job_id").distinct().withColumn("asked", F.lit(True))
    stops = F.col("asked") & F.col("status").isin("queued", "running")
    return (
        jobs.join(asked, "job_id", "left")
        .withColumn("status", F.when(stops, "cancelled").otherwise(F.col("status")))
        .drop("asked")
    )


RETRYABLE = ["failed", "cancelled"]


def retry(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """New queued jobs with the settings of failed or cancelled ones."""
    return (
        jobs.join(requested.select("job_id").distinct(), "job_id", "left_semi")
        .filter(F.col("status").isin(RETRYABLE))
        .select(
            F.concat(F.lit("retry-"), F.col("job_id")).alias("job_id"), "book_id",
            F.lit("queued").alias("status"), "voice", "speed", "formats", "video_style",
        )
    )


def retry_conflicts(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    asked = jobs.join(requested.select("job_id").distinct(), "job_id", "left_semi")
    return asked.filter(~F.col("status").isin(RETRYABLE)).withColumn(
        "error", F.concat(F.lit("job is "), F.col("status"), F.lit(", not failed or cancelled"))
    )


def elapsed_seconds(started: Column, finished: Column, now: Column) -> Column:
    return (F.unix_micros(F.coalesce(finished, now)) - F.unix_micros(started)) / 1e6


def stage_board(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Every known stage of every job; a stage never reported is queued at 0."""
    last = stages.groupBy("job_id", "stage").agg(
        F.max_by("progress", F.struct("ts", "event_id")).alias("progress")
    )
    board = jobs.select("job_id", F.posexplode(F.lit(STAGES)).alias("stage_no", "stage"))
    return board.join(last, ["job_id", "stage"], "left").select(
        "job_id", "stage_no", "stage",
        F.when(F.col("progress").isNull(), "queued").when(F.col("progress") >= 1, "done").otherwise("running").alias("status"),
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
    )


# -------------------------------------------------------------------- settings


def effective_settings(scopes: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults of every scope, overridden by its stored rows; unknown keys are ignored."""
    defaults = scopes.select("scope", F.explode(literal_map(SETTING_DEFAULTS)).alias("key", "fallback"))
    return defaults.join(stored, ["scope", "key"], "left").select(
        "scope", "key", F.coalesce("value", "fallback").try_cast("double").alias("value")
    )


def check_settings(updates: DataFrame) -> DataFrame:
    number = F.col("value").try_cast("double")
    return updates.withColumn(
        "error",
        F.coalesce(
            F.when(~F.col("key").isin(list(SETTING_DEFAULTS)), F.concat(F.lit("unknown setting: "), F.col("key"))),
            F.when((F.col("key") == "tts_workers") & (number < 1), "tts_workers must be at least 1"),
            F.when((F.col("key") == "mp4_part_limit_s") & (number <= 0), "mp4_part_limit_s must be positive"),
        ),
    )


def upsert_settings(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored rows after the valid updates; one update per scope and key."""
    valid = check_settings(updates).filter("error IS NULL").select("scope", "key", F.col("value").alias("new"))
    return stored.join(valid, ["scope", "key"], "full_outer").select(
        "scope", "key", F.coalesce("new", "value").alias("value")
    )


# --------------------------------------------------------------------- storage


def storage_usage(files: DataFrame) -> DataFrame:
    """Files and bytes per area, from file metadata (path, length, area)."""
    return files.groupBy("area").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def unreferenced(cache: DataFrame, segments: DataFrame) -> DataFrame:
    """Cache entries no segment uses."""
    return cache.join(segments.select("cache_key").distinct(), "cache_key", "left_anti")


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A manifest entry is valid if present, of its size, and of its hash where one is known."""
    found = files.select(
        "dest",
        F.octet_length("content").cast("bigint").alias("found_size"),
        F.sha2(F.col("content"), 256).alias("found_sha256"),
    )
    return manifest.join(found, "dest", "left").select(
        "dest",
        F.col("found_size").isNotNull().alias("present"),
        (
            F.coalesce(F.col("found_size") == F.col("size"), F.lit(False))
            & F.coalesce(F.col("found_sha256") == F.col("sha256"), F.col("sha256").isNull())
        ).alias("valid"),
    )


# --------------------------------------------------------------------- lexicon


def compiles(patterns: Column) -> Column:
    """Whether each pattern is a valid regular expression."""

    # Local, so that it travels to executors by value.
    def check(batch: pd.Series) -> pd.Series:
        import re

        def ok(pattern):
            try:
                re.compile(pattern)
            except (re.error, TypeError):
                return False
            return True

        return batch.map(ok)

    return F.pandas_udf(check, BooleanType())(patterns)


def check_lexicon(entries: DataFrame) -> DataFrame:
    """Entries with an error where a regex or its replacement cannot be used.

    A pattern must be one for the rule language and one that the engine runs once translated.
    """
    bad = entries.filter("is_regex").select("pattern").distinct().filter(~compiles(F.col("pattern")))
    flagged = bad.withColumn("bad", F.lit(True))
    invalid = F.col("is_regex") & F.coalesce("bad", F.lit(False))
    return (
        with_errors(entries)
        .join(flagged, "pattern", "left")
        .withColumn("error", F.when(invalid, F.concat(F.lit("invalid regex: "), F.col("pattern"))).otherwise(F.col("error")))
        .select(*entries.columns, "error")
    )


def create_lexicon(entries: DataFrame, new: DataFrame, books: DataFrame) -> DataFrame:
    """Entries with the valid new ones of existing books."""
    valid = check_lexicon(new.join(books, "book_id", "left_semi")).filter("error IS NULL").drop("error")
    return entries.unionByName(valid)


def delete_lexicon(entries: DataFrame, doomed: DataFrame) -> DataFrame:
    return entries.join(doomed, ["book_id", "entry"], "left_anti")
