"""Chunk plan: blocks to ordered, keyed chunks, and what of them is still to do.

A book that is one row (nested chapters) is planned inside the row: lexicon,
normalization, sentence split, packing, pauses and segment numbers need no
shuffle. Later steps exchange keys and counts, not texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.lexicon import apply_lexicon
from lectern.functions.normalize import NormalizerRegistry, default_registry
from lectern.functions.segment import MAX_CHARS, segment_text
from lectern.functions.strings import bind, excerpt, word_count
from lectern.operators.catalog import LANGUAGE_ROUTING, literal_map
from lectern.operators.ordered import Levels, neighbour, row_numbers, running_sums
from lectern.plans.timeline import PAUSE_CHAPTER_S, PAUSE_PARAGRAPH_S, PAUSE_SENTENCE_S
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
ENGINE_VERSIONS = {"kokoro": "kokoro-v1.0", "piper": "piper-1.8.0"}
KEY_SEPARATOR = "\x1f"
BATCH_SIZE = 50
PREVIEW_CHARS, PREVIEW_TAIL = 80, "…"
COVER_FORMATS = ["mp3", "m4b", "mp4"]
TERMINAL = ["done", "failed", "cancelled"]
# ------------------------------------------------------------ end fixed values

PLACE = ["chapter_index", "block_index"]


def pause_after(last_chunk: Column, last_block: Column, last_chapter: Column) -> Column:
    return (
        F.when(~last_chunk, PAUSE_SENTENCE_S)
        .when(~last_block, PAUSE_PARAGRAPH_S)
        .when(~last_chapter, PAUSE_CHAPTER_S)
        .otherwise(0.0)
    )


def spoken_array(chapters: Column) -> Column:
    """The blocks to read of nested chapters as array<struct<chapter_index, block_index, last_block, last_chapter, text>>; null if all are blank.

    Skip blocks are left out before positions count, so a trailing one takes no
    pause. A last block without chunks gives its pause to nobody.
    """

    def flat(all_chapters: Column) -> Column:
        def one(chapter: Column, i: Column) -> Column:
            return bind(
                F.filter(chapter["blocks"], lambda b: b["kind"] != "skip"),
                lambda blocks: F.transform(
                    blocks,
                    lambda b, j: F.struct(
                        i.alias("chapter_index"), j.alias("block_index"), (j == F.size(blocks) - 1).alias("last_block"),
                        (i == F.size(all_chapters) - 1).alias("last_chapter"), b["text"].alias("text"),
                    ),
                ),
            )

        return F.flatten(F.transform(all_chapters, one))

    return bind(bind(chapters, flat), lambda told: F.when(F.exists(told, lambda b: F.trim(b["text"]) != ""), told))


def plan_error(registry: NormalizerRegistry | None = None) -> Column:
    """Why a book (language, chapters) has no chunks, null if it has: no rules for its language, or nothing to read."""
    known = (registry or default_registry()).languages()
    language, chapters = F.col("language"), F.col("chapters")
    spoken = F.exists(
        chapters, lambda c: F.exists(c["blocks"], lambda b: (b["kind"] != "skip") & (F.trim(b["text"]) != ""))
    )
    return (
        F.when(language.isNull(), F.lit("no language"))
        .when(~language.isin(known), F.concat(F.lit("unsupported language: "), language))
        .when(~F.coalesce(spoken, F.lit(False)), F.lit("nothing to read"))
    )


def plan_rejects(books: DataFrame, keys: list[str], registry: NormalizerRegistry | None = None) -> DataFrame:
    """The books that ``chunk_plan`` with the same registry leaves out, each with its reason."""
    return books.select(*keys, "language", plan_error(registry).alias("error")).filter("error IS NOT NULL")


def chunk_plan(books: DataFrame, keys: list[str], **options) -> DataFrame:
    """Numbered chunks of books given as (keys, language, chapters[, lexicon][, large]).

    A book is planned inside its row, without a shuffle. Where ``large`` is true its blocks become rows, which are
    dealt out; ``large`` should come of something cheap, such as the length of the text, since it splits the input.
    Books that cannot be planned are not here but in ``plan_rejects``.
    """
    if "large" not in books.columns:
        return _plan_in_rows(books, keys, **options)
    blocks, others = _by_size(books, keys, options.get("registry"))
    return _plan_in_rows(others, keys, **options).unionByName(plan_of_blocks(blocks, keys, **options))


def _by_size(books: DataFrame, keys: list[str], registry: NormalizerRegistry | None) -> tuple[DataFrame, DataFrame]:
    """The blocks of the large books that can be planned, and the other books. Size is asked first: it costs no fold."""
    is_large = F.coalesce("large", F.lit(False))
    large = books.filter(is_large).filter(plan_error(registry).isNull()).drop("large")
    return spoken_blocks(large, keys), books.filter(~is_large).drop("large")


def _told(books: DataFrame, keys: list[str], rules: NormalizerRegistry) -> DataFrame:
    """(keys, language[, lexicon], __blocks). Blank books are told apart inside the row: as a filter that would fold every text twice."""
    lexicon = ["lexicon"] if "lexicon" in books.columns else []
    known = books.filter(F.col("language").isin(rules.languages()))
    return known.select(*keys, "language", *lexicon, spoken_array(F.col("chapters")).alias("__blocks"))


def _plan_in_rows(
    books: DataFrame, keys: list[str], registry: NormalizerRegistry | None = None, max_chars: int = MAX_CHARS
) -> DataFrame:
    rules = registry or default_registry()
    told = _told(books, keys, rules)
    language = F.col("language")

    def spoken(text: Column) -> Column:
        return apply_lexicon(text, F.col("lexicon")) if "lexicon" in told.columns else text

    # One column after the other: the analyzer takes each by itself, all nested in one are too deep for it.
    read = told.withColumn("__texts", F.transform("__blocks", lambda b: spoken(b["text"])))
    for step in rules.steps():
        read = read.withColumn("__texts", F.transform("__texts", lambda t: step(t, language)))  # noqa: B023
    cut = read.withColumn("__chunks", F.transform("__texts", lambda t: segment_text(t, language, max_chars)))

    def place(block: Column, chunks: Column) -> Column:
        return F.transform(
            chunks,
            lambda chunk, k: F.struct(
                block["chapter_index"].alias("chapter_index"), block["block_index"].alias("block_index"), k.alias("chunk_index"), chunk.alias("text"),
                pause_after(k == F.size(chunks) - 1, block["last_block"], block["last_chapter"]).alias("pause_after_s"),
            ),
        )

    chunks = F.flatten(F.zip_with("__blocks", "__chunks", place))
    numbered = cut.select(*keys, "language", F.posexplode(chunks).alias("segment_index", "chunk"))
    return numbered.select(*keys, "language", "segment_index", "chunk.*")


def spoken_blocks(books: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks to read of nested books as rows: (keys, language[, lexicon], chapter_index, block_index, last_block, last_chapter, text)."""
    carried = [*keys, "language", *(["lexicon"] if "lexicon" in books.columns else [])]
    chapters = books.select(*carried, F.size("chapters").alias("__chapters"), F.posexplode("chapters").alias("chapter_index", "__chapter"))
    spoken = F.filter("__chapter.blocks", lambda b: b["kind"] != "skip")
    blocks = chapters.select(
        *carried, "chapter_index", (F.col("chapter_index") == F.col("__chapters") - 1).alias("last_chapter"),
        F.size(spoken).alias("__blocks"), F.posexplode(spoken).alias("block_index", "__block"),
    )
    return blocks.select(
        *carried, "chapter_index", "block_index", (F.col("block_index") == F.col("__blocks") - 1).alias("last_block"), "last_chapter", "__block.text"
    )


def plan_of_blocks(
    blocks: DataFrame, keys: list[str], registry: NormalizerRegistry | None = None, max_chars: int = MAX_CHARS
) -> DataFrame:
    """The chunk plan of books whose blocks are rows, as ``spoken_blocks`` gives them.

    Each block is read by itself, so a book of any length is spread over all tasks. The chunks are kept once; their
    numbers are running sums of the blocks' counts, over chapters and slabs of blocks, without text.
    """
    rules = registry or default_registry()
    text = apply_lexicon(F.col("text"), F.col("lexicon")) if "lexicon" in blocks.columns else F.col("text")
    read = blocks.repartition(*keys, *PLACE).withColumn("__text", text)
    for step in rules.steps():
        read = read.withColumn("__text", step(F.col("__text"), F.col("language")))
    chunks = segment_text(F.col("__text"), F.col("language"), max_chars)
    return _numbered(cut_lineage(read.select(*keys, "language", *PLACE, "last_block", "last_chapter", chunks.alias("__chunks"))), keys)


def _numbered(told: DataFrame, keys: list[str]) -> DataFrame:
    """The plan of kept blocks with their chunks (``__chunks``)."""
    place = PLACE
    counts = told.select(*keys, *place, F.floor(F.col("block_index") / 1024).alias("__slab"), F.size("__chunks").cast("bigint").alias("__n"))
    levels = [["chapter_index"], ["__slab"], ["block_index"]]
    first = running_sums(counts, keys, levels, {"__first": F.col("__n")}).select(*keys, *place, "__first")
    each = told.join(first, [*keys, *place]).select(
        *keys, "language", *place, "last_block", "last_chapter", "__first", F.size("__chunks").alias("__size"),
        F.posexplode("__chunks").alias("chunk_index", "text"),
    )
    last = F.col("chunk_index") == F.col("__size") - 1
    return each.select(
        *keys, "language", (F.col("__first") + F.col("chunk_index")).cast("int").alias("segment_index"), *place, "chunk_index", "text",
        pause_after(last, F.col("last_block"), F.col("last_chapter")).alias("pause_after_s"),
    )


def mark_pauses(chunks: DataFrame, book: str, levels: Levels) -> DataFrame:
    """The pause rule for chunks that arrive as rows with chapter and block ordinals.

    A chunk is last in its block if the next chunk of the book is in another
    block, and so on; blocks without chunks should be left out beforehand.
    """
    ahead = neighbour(chunks, [book], levels, F.struct("chapter_index", "block_index"), "nxt", ahead=True)
    same_chapter = F.coalesce(F.col("nxt.chapter_index") == F.col("chapter_index"), F.lit(False))
    same_block = same_chapter & (F.col("nxt.block_index") == F.col("block_index"))
    return ahead.withColumn(
        "pause_after_s", pause_after(~same_block, ~same_chapter, F.col("nxt").isNull())
    ).drop("nxt")


# ------------------------------------------------------------------------- keys


def content_key(
    text: Column, voice: Column, engine: Column, engine_version: Column, speed: Column, normalizer: Column
) -> Column:
    """SHA-256 over everything that changes a chunk's sound; null if any field is null."""
    fields = [text, voice, engine, engine_version, F.format_string("%.3f", speed), normalizer]
    complete = F.lit(True)
    for field in [text, voice, engine, engine_version, speed, normalizer]:
        complete = complete & field.isNotNull()
    return F.when(complete, F.sha2(F.concat_ws(KEY_SEPARATOR, *fields), 256))


def segment_key(text: Column, voice: Column, speed: Column, registry: NormalizerRegistry | None = None) -> Column:
    """Key of a chunk's text; the row has its ``language``."""
    engine = F.try_element_at(literal_map(LANGUAGE_ROUTING), F.col("language"))
    version = F.try_element_at(literal_map(ENGINE_VERSIONS), engine)
    normalizer = (registry or default_registry()).version(F.col("language"))
    return content_key(text, voice, engine, version, speed, normalizer)


def with_keys(chunks: DataFrame, voice: Column, speed: Column, registry: NormalizerRegistry | None = None) -> DataFrame:
    engine = F.try_element_at(literal_map(LANGUAGE_ROUTING), F.col("language"))
    return chunks.withColumn("cache_key", segment_key(F.col("text"), voice, speed, registry)).withColumn("engine", engine)


# ------------------------------------------------------------------------ cache


def cache_status(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Segments with ``cached``; the cache is reduced to distinct keys first."""
    known = cache.select("cache_key").distinct().withColumn("cached", F.lit(True))
    return segments.join(known, "cache_key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def requested(segments: DataFrame) -> DataFrame:
    """Each key once, with its text. Duplicates collapse on the map side, so a key that many segments share is no hot spot."""
    return segments.groupBy("cache_key").agg(F.min("text").alias("text"))


def work_list(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Each missing key once, with its text."""
    return requested(segments).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def batches(requests: DataFrame, levels: Levels, size: int = BATCH_SIZE) -> DataFrame:
    """Batch number of each request of a job, and the job's progress once that batch is done."""
    totals = requests.groupBy("job_id").agg(F.count("*").alias("total"))
    numbered = row_numbers(requests, ["job_id"], levels, "n").join(totals, "job_id")
    batch = F.floor(F.col("n") / size)
    done = F.least((batch + 1) * size, F.col("total"))
    return numbered.withColumns({"batch": batch, "progress": done / F.col("total")}).drop("n", "total")


def job_progress(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Done over total per job; a job without requests is complete."""
    counts = requests.groupBy("job_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))
    return jobs.select("job_id").join(counts, "job_id", "left").select(
        "job_id", F.when(F.coalesce("total", F.lit(0)) == 0, 1.0).otherwise(F.col("done") / F.col("total")).alias("progress")
    )


def merge_results(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Status and duration by key: failed where the result has an error, queued where there is none."""
    got = results.select("cache_key", F.col("duration_s").alias("got_s"), "error", F.lit(True).alias("answered"))
    joined = segments.join(got, "cache_key", "left")
    failed = F.col("error").isNotNull()
    status = F.when(F.col("answered").isNull(), "queued").when(failed, "failed").otherwise("done")
    return joined.withColumns({"status": status, "duration_s": F.when(~failed, F.col("got_s"))}).drop("got_s", "answered")


def failure_summary(segments: DataFrame, order: list[str]) -> DataFrame:
    """Jobs with failures: how many of how many, and the first failed text and error."""
    bad = F.col("status") == "failed"
    first = F.min_by(F.when(bad, F.struct("text", "error")), F.when(bad, F.struct(*order)))
    out = segments.groupBy("job_id").agg(F.count_if(bad).alias("failed"), F.count("*").alias("total"), first.alias("first"))
    preview = excerpt(F.col("first.text"), PREVIEW_CHARS, PREVIEW_CHARS, PREVIEW_TAIL)
    message = F.concat(
        F.lit("synthesis failed on "), F.col("failed"), F.lit(" of "), F.col("total"),
        F.lit(' chunks; first: "'), preview, F.lit('": '), F.coalesce("first.error", F.lit("unknown error")),
    )
    return out.filter("failed > 0").select("job_id", "failed", "total", message.alias("message"))


def change_of(old_key: Column, new_key: Column) -> Column:
    return (
        F.when(old_key.isNull(), "added")
        .when(new_key.isNull(), "removed")
        .when(old_key == new_key, "same")
        .otherwise("changed")
    )


def run_diff(old: DataFrame, new: DataFrame, position: list[str]) -> DataFrame:
    """Segments of two runs side by side: same, changed, added or removed."""
    a = old.select(*position, F.col("cache_key").alias("old_key"))
    b = new.select(*position, F.col("cache_key").alias("new_key"))
    return a.join(b, position, "full_outer").withColumn("change", change_of(F.col("old_key"), F.col("new_key")))


def lexicon_diff(
    books: DataFrame, keys: list[str], voice: Column, speed: Column,
    registry: NormalizerRegistry | None = None, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """(keys, segment_index, change): ``run_diff`` of the keyed plans of ``books`` without and with their lexicon.

    One pass reads both: a block that the lexicon leaves as it is is normalized and cut once, and the plans meet inside
    the book's row. Only the chunks of large books, which are rows, meet in a join.
    """
    rules = registry or default_registry()
    if "large" not in books.columns:
        return _diff_in_rows(books, keys, voice, speed, rules, max_chars)
    blocks, others = _by_size(books, keys, rules)
    return _diff_in_rows(others, keys, voice, speed, rules, max_chars).unionByName(
        _diff_of_blocks(blocks, keys, voice, speed, rules, max_chars)
    )


def _diff_in_rows(
    books: DataFrame, keys: list[str], voice: Column, speed: Column, rules: NormalizerRegistry, max_chars: int
) -> DataFrame:
    language = F.col("language")

    def unless_same(item: Column, before: Column, made: Column, make: Callable[[Column], Column]) -> Column:
        return F.when(item.eqNullSafe(before), made).otherwise(make(item))

    def read(text: Column) -> Column:
        return rules.normalize(text, language)

    def cut(text: Column) -> Column:
        return segment_text(text, language, max_chars)

    told = _told(books, keys, rules).withColumn("__lexed", F.transform("__blocks", lambda b: apply_lexicon(b["text"], F.col("lexicon"))))
    told = told.withColumn("__old", F.transform("__blocks", lambda b: read(b["text"])))
    same_text = lambda t, i: unless_same(t, F.get("__blocks", i)["text"], F.get("__old", i), read)
    told = told.withColumn("__new", F.transform("__lexed", same_text))
    told = told.withColumn("__old_chunks", F.transform("__old", cut))
    same_chunks = lambda t, i: unless_same(t, F.get("__old", i), F.get("__old_chunks", i), cut)
    told = told.withColumn("__new_chunks", F.transform("__new", same_chunks))
    none = F.array().cast("array<string>")
    both = F.arrays_zip(
        F.coalesce(F.flatten("__old_chunks"), none).alias("old"), F.coalesce(F.flatten("__new_chunks"), none).alias("new")
    )
    pairs = told.select(*keys, "language", F.posexplode(both).alias("segment_index", "__pair"))
    old_key, new_key = (segment_key(F.col(f"__pair.{side}"), voice, speed, rules) for side in ("old", "new"))
    return pairs.select(*keys, "segment_index", change_of(old_key, new_key).alias("change"))


def _diff_of_blocks(
    blocks: DataFrame, keys: list[str], voice: Column, speed: Column, rules: NormalizerRegistry, max_chars: int
) -> DataFrame:
    language = F.col("language")
    dealt = blocks.repartition(*keys, *PLACE).withColumn("__lexed", apply_lexicon(F.col("text"), F.col("lexicon")))
    dealt = dealt.withColumn("__old", rules.normalize(F.col("text"), language))
    same = F.col("__lexed").eqNullSafe(F.col("text"))
    dealt = dealt.withColumn("__new", F.when(same, F.col("__old")).otherwise(rules.normalize(F.col("__lexed"), language)))
    chunks = [segment_text(F.col(side), language, max_chars).alias(side) for side in ("__old", "__new")]
    told = cut_lineage(dealt.select(*keys, "language", *PLACE, "last_block", "last_chapter", *chunks))
    old, new = (
        with_keys(_numbered(told.withColumn("__chunks", F.col(side)).drop("__old", "__new"), keys), voice, speed, rules)
        for side in ("__old", "__new")
    )
    position = [*keys, "segment_index"]
    return run_diff(old, new, position).select(*position, "change")


def reuse_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many distinct keys of the new run the old one already has."""
    known = old.select("cache_key").distinct().withColumn("known", F.lit(1))
    keys = new.select("cache_key").distinct().join(known, "cache_key", "left")
    return keys.agg(F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("fresh"))


# ------------------------------------------------------------------------- jobs


def current_state(log: DataFrame) -> DataFrame:
    """Last status of each job from its event log (job_id, ts, event_id, status)."""
    return log.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events")
    )


def _before_cancel(events: DataFrame) -> DataFrame:
    """Events before the job's first cancellation: nothing runs from then on."""
    order = F.struct("ts", "event_id")
    cancels = events.where("kind = 'cancel'").groupBy("job_id").agg(F.min(order).alias("__cancel"))
    return events.join(cancels, "job_id", "left").where(F.col("__cancel").isNull() | (order < F.col("__cancel"))).drop("__cancel")


def stage_intervals(events: DataFrame, levels: Levels) -> DataFrame:
    """(job_id, stage, run, started_at, progress, finished_at, status): one row for each run of a stage.

    ``events``: job_id, stage, kind (start, progress, finish or cancel), progress, ts, event_id (and the columns of
    ``levels``). A run goes from a start to the first finish, or to the next start of its stage; a finish makes its
    progress 1. Progress outside of a run has no stage to go to. A cancelled job leaves its runs as they are, without
    a finish; one that is cancelled before it starts has none.
    """
    keys = ["job_id", "stage"]
    living = running_sums(_before_cancel(events), keys, levels, {"__starts": (F.col("kind") == "start").cast("bigint")})
    numbered = living.withColumn("run", F.col("__starts") + (F.col("kind") == "start").cast("bigint")).where("run > 0")
    order = F.struct("ts", "event_id")
    ends = numbered.where("kind = 'finish'").groupBy(*keys, "run").agg(F.min(order).alias("__end"))
    inside = numbered.join(ends, [*keys, "run"], "left").where(F.col("__end").isNull() | (order <= F.col("__end")))
    last = F.max_by(F.when(F.col("kind") == "progress", F.col("progress")), F.when(F.col("kind") == "progress", order))
    done = F.col("finished_at").isNotNull()
    return (
        inside.groupBy(*keys, "run")
        .agg(F.min("ts").alias("started_at"), last.alias("progress"), F.first("__end.ts").alias("finished_at"))
        .withColumn("progress", F.when(done, 1.0).otherwise(F.coalesce("progress", F.lit(0.0))))
        .withColumn("status", F.when(done, "done").otherwise("running"))
    )


def job_outcomes(events: DataFrame) -> DataFrame:
    """(job_id, status, ran): whether a job was cancelled, and whether any stage started before that."""
    order = F.struct("ts", "event_id")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, order))
    found = events.groupBy("job_id").agg(first("start").alias("start"), first("cancel").alias("cancel"))
    started = F.col("start").isNotNull()
    return found.select(
        "job_id",
        F.when(F.col("cancel").isNotNull(), "cancelled").when(started, "running").otherwise("queued").alias("status"),
        F.coalesce(F.col("start") < F.col("cancel"), started).alias("ran"),
    )


def illegal_transitions(log: DataFrame, levels: Levels) -> DataFrame:
    """Events that leave a terminal status, or return to queued."""
    seen = neighbour(log, ["job_id"], levels, F.col("status"), "previous")
    leaves_end = F.col("previous").isin(TERMINAL)
    requeued = F.col("status") == "queued"
    return seen.filter(F.col("previous").isNotNull() & (leaves_end | requeued))


def primary_artifact(artifacts: DataFrame) -> DataFrame:
    """The mp3 if there is one, else the artifact requested first (``request_no``)."""
    first = F.struct(F.col("format") != "mp3", F.col("request_no"), F.col("path"))
    return artifacts.groupBy("job_id").agg(F.min_by("path", first).alias("path"))


def artifact_rows(jobs: DataFrame, parts: DataFrame, formats: Column) -> DataFrame:
    """One row per requested format; mp4 has one per part, numbered only if there are several."""
    totals = parts.groupBy("job_id").agg(F.max("part_index").alias("part_total"))
    wanted = jobs.select("job_id", F.posexplode(formats).alias("request_no", "format"))
    split = wanted.filter(F.col("format") == "mp4").join(parts.select("job_id", "part_index"), "job_id", "left")
    split = split.join(totals, "job_id", "left")
    several = F.col("part_total") > 1
    none = F.lit(None).cast("bigint")
    rest = wanted.filter(F.col("format") != "mp4")
    return split.select(
        "job_id", "request_no", "format",
        F.when(several, F.col("part_index")).alias("part_index"), F.when(several, F.col("part_total")).alias("part_total"),
    ).unionByName(rest.select("job_id", "request_no", "format", none.alias("part_index"), none.alias("part_total")))


def needs_cover(cover_path: Column, formats: Column) -> Column:
    return cover_path.isNull() & F.arrays_overlap(formats, F.lit(COVER_FORMATS))


def throughput(runs: DataFrame, gate: float = 1.0) -> DataFrame:
    """Elapsed over audio time per language (both in whole milliseconds), and whether it passes."""
    ratio = F.sum("elapsed_ms") / F.nullif(F.sum("audio_ms"), F.lit(0).cast("bigint"))
    return runs.groupBy("language").agg(ratio.alias("ratio")).withColumn(
        "passes", F.coalesce(F.col("ratio") < gate, F.lit(False))
    )


# -------------------------------------------------------------------- durations

Provider = Callable[[DataFrame], DataFrame]


def estimated_durations(requests: DataFrame, words_per_minute: int = 150) -> DataFrame:
    """The default provider: seconds from the number of words; every request succeeds."""
    return requests.select(
        "cache_key",
        (word_count(F.col("text")) * 60 / words_per_minute).alias("duration_s"),
        F.lit(None).cast("string").alias("error"),
    )


def resolve_durations(segments: DataFrame, cache: DataFrame, provider: Provider = estimated_durations) -> DataFrame:
    """Cached and newly provided results of all keys.

    A provider maps requests (cache_key, text) to (cache_key, duration_s, error);
    only missing keys reach it, each once.
    """
    fresh = provider(work_list(segments, cache))
    return cache.select("cache_key", "duration_s", F.lit(None).cast("string").alias("error")).unionByName(fresh)
