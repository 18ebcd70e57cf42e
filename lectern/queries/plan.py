"""Plan, cache and job queries."""

import re

from pyspark.sql import functions as F

from lectern.functions.lexicon import with_lexicon
from lectern.functions.normalize import default_registry
from lectern.functions.segment import segment_text
from lectern.operators import catalog as C
from lectern.operators import fold
from lectern.operators.ordered import row_numbers
from lectern.plans import narration as R
from lectern.plans import timeline as T
from lectern.queries import sqltext as Q
from lectern.queries.ingest import LINES, TEXT_CHAPTERS, spaced_documents
from lectern.queries.registry import query, table, texts
from lectern.queries.timeline import parted, track
from lectern.queries.timeline import _PARTED, _TO_MARKERS, _TRACK
from lectern.queries.views import sql
from lectern.session import cut_lineage, spread
from lectern.sources import model as M

LANGUAGES = ["en", "de"]  # of the documents that an engine can read
LARGE_BOOK = 1_000_000  # characters, from which on a book's blocks are dealt out
VOICES = {"en": "af_heart", "de": "de_DE-thorsten-high"}

# ------------------------------------------------------------- chunks of documents


def documents(spark, sf, with_rules=True):
    """Documents as books: nested chapters, and their lexicon where they have one.

    Lines of one blank-free run are skip blocks, as footnotes are.
    """
    docs = spread(spaced_documents(spark, sf), "doc_id").select(
        F.col("doc_id").alias("book_id"), F.col("lang").alias("language"), fold.text_chapters(F.col("text")).alias("chapters"),
        (F.length("text") > LARGE_BOOK).alias("large"),
    )

    def mark(block):
        return F.struct(F.when(block["text"].contains(" "), "para").otherwise("skip").alias("kind"), block["text"].alias("text"))

    marked = F.transform("chapters", lambda c: F.struct(c["title"].alias("title"), F.transform(c["blocks"], mark).alias("blocks")))
    books = docs.withColumn("chapters", marked)
    return with_lexicon(books, M.lexicon(spark, sf)) if with_rules else books


def chunks(spark, sf, with_rules=True):
    return R.chunk_plan(documents(spark, sf, with_rules), ["book_id"], registry=default_registry(LANGUAGES))


def keyed_chunks(spark, sf, with_rules=True):
    voice = M.choose(F.col("language"), VOICES)
    return R.with_keys(chunks(spark, sf, with_rules), voice, F.lit(1.0), default_registry(LANGUAGES))


_LEXED = """SELECT f.doc_id, d.lang, f.chapter_index, f.block_index, CASE WHEN quality = 0 THEN replace(b, '.', ' $.') ELSE b END AS t FROM (
  SELECT *, CASE WHEN toxic = 0 THEN regexp_replace(a, '([aeiou])nt', '\\1mt', 'g') ELSE a END AS b FROM (
    SELECT g.*, quality, toxic, CASE WHEN quality = 1 THEN replace(text, 'the ', 'thee ') ELSE text END AS a
    FROM folded g LEFT JOIN labels USING (doc_id))) f JOIN documents d USING (doc_id) WHERE contains(f.text, ' ')"""
_PLAIN = """SELECT f.doc_id, d.lang, f.chapter_index, f.block_index, f.text AS t FROM folded f JOIN documents d USING (doc_id) WHERE contains(f.text, ' ')"""


def _chunk_ctes(source):
    """Positions are those of the blocks that are not skipped; chapters keep their numbers."""
    ctes = {"lines": LINES, "folded": TEXT_CHAPTERS, "texts": source}
    for lang in LANGUAGES:
        ctes.update(Q.normalized(lang, f"SELECT doc_id, lang, chapter_index, block_index, t FROM texts WHERE lang = '{lang}'"))
    ctes["chapters_of"] = "SELECT doc_id, max(chapter_index) AS last_chapter FROM folded GROUP BY 1"
    ctes["placed"] = """SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY block_index) - 1 AS block_no,
      count(*) OVER (PARTITION BY doc_id, chapter_index) AS n_blocks FROM (SELECT * FROM en_out UNION ALL SELECT * FROM de_out)"""
    ctes["chunked"] = f"""SELECT *, unnest(p) AS chunk, generate_subscripts(p, 1) - 1 AS chunk_index FROM (
      SELECT *, {Q.packed('a', 350)} AS p FROM (SELECT *, {Q.sentences('t')} AS a FROM placed))"""
    ctes["planned"] = """SELECT doc_id AS book_id, lang AS language, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, block_no, chunk_index) - 1 AS segment_index,
      chapter_index, block_no AS block_index, chunk_index, chunk AS text,
      CASE WHEN chunk_index < len(p) - 1 THEN 0.35::DOUBLE WHEN block_no < n_blocks - 1 THEN 0.6::DOUBLE WHEN chapter_index < last_chapter THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END AS pause_after_s
      FROM chunked JOIN chapters_of USING (doc_id)"""
    ctes["keyed"] = """SELECT *, CASE language WHEN 'en' THEN 'kokoro' ELSE 'piper' END AS engine, sha256(text || chr(31) || CASE language WHEN 'en' THEN 'af_heart' ELSE 'de_DE-thorsten-high' END || chr(31) ||
      CASE language WHEN 'en' THEN 'kokoro' || chr(31) || 'kokoro-v1.0' ELSE 'piper' || chr(31) || 'piper-1.8.0' END || chr(31) || '1.000' || chr(31) || language || '-1') AS cache_key FROM planned"""
    return ctes


_CHUNKS = _chunk_ctes(_LEXED)
_CHUNKS_PLAIN = _chunk_ctes(_PLAIN)


@query(
    "chunk_plan",
    sql("SELECT book_id, language, segment_index, chapter_index, block_index, chunk_index, text, pause_after_s FROM planned", **_CHUNKS),
)
def chunk_plan(spark, sf):
    return chunks(spark, sf)


@query(
    "plan_rejects",
    sql(
        """SELECT doc_id AS book_id, lang AS language, CASE WHEN lang IS NULL THEN 'no language' WHEN lang NOT IN ('en','de') THEN 'unsupported language: ' || lang ELSE 'nothing to read' END AS error
  FROM documents WHERE lang IS NULL OR lang NOT IN ('en','de') OR doc_id NOT IN (SELECT doc_id FROM folded WHERE contains(text, ' '))""",
        lines=LINES, folded=TEXT_CHAPTERS,
    ),
)
def plan_rejects(spark, sf):
    """Every document without chunks, with the reason; the plan runs with rules for two languages."""
    return R.plan_rejects(documents(spark, sf, False), ["book_id"], default_registry(LANGUAGES))


@query("segment_keys", sql("SELECT book_id, segment_index, engine, cache_key FROM keyed", **_CHUNKS))
def segment_keys(spark, sf):
    return keyed_chunks(spark, sf).select("book_id", "segment_index", "engine", "cache_key")


#: The cache of an earlier run, in which chunks of more than 60 characters read otherwise.
_CACHED = "SELECT CASE WHEN length(text) <= 60 THEN cache_key ELSE sha256(cache_key || ' before') END AS cache_key FROM keyed"


def _cached_key(short):
    return F.when(short, F.col("cache_key")).otherwise(F.sha2(F.concat("cache_key", F.lit(" before")), 256)).alias("cache_key")


@query(
    "cache_hits",
    sql("SELECT book_id, segment_index, cache_key IN (FROM cached) AS cached FROM keyed", **_CHUNKS_PLAIN, cached=_CACHED),
)
def cache_hits(spark, sf):
    """Keys and positions alone are kept for the join; the text is not."""
    keyed = keyed_chunks(spark, sf, with_rules=False)
    keys = cut_lineage(keyed.select("book_id", "segment_index", "cache_key", (F.length("text") <= 60).alias("short")))
    return R.cache_status(keys, keys.select(_cached_key(F.col("short")))).select("book_id", "segment_index", "cached")


@query(
    "work_list",
    sql(
        "SELECT cache_key, min(text) AS text FROM keyed WHERE cache_key NOT IN (FROM cached) GROUP BY 1",
        **_CHUNKS_PLAIN, cached=_CACHED,
    ),
)
def work_list(spark, sf):
    """Both sides read one exchange, of each key and its text."""
    each = R.requested(keyed_chunks(spark, sf, with_rules=False))
    return R.work_list(each, each.select(_cached_key(F.length("text") <= 60)))


@query(
    "estimated_durations",
    sql(
        "SELECT cache_key, len(string_split_regex(min(text), '\\s+')) * 60 / 150.0::DOUBLE AS duration_s, CAST(NULL AS VARCHAR) AS error FROM keyed GROUP BY 1",
        **_CHUNKS_PLAIN,
    ),
)
def estimated_durations(spark, sf):
    """The default result provider over an empty cache."""
    keyed = cut_lineage(keyed_chunks(spark, sf, with_rules=False))
    empty = keyed.filter(F.lit(False)).select("cache_key", F.lit(0.0).alias("duration_s"))
    return R.resolve_durations(keyed, empty)


def _two_runs():
    """The CTEs of the plain run beside those of the run with rules; only names differ."""
    own = [k for k in _CHUNKS_PLAIN if k in ("texts", "placed", "chunked", "planned", "keyed") or k[:3] in ("en_", "de_")]
    renamed = {}
    for name in own:
        body = _CHUNKS_PLAIN[name]
        for other in own:
            body = re.sub(rf"\bFROM {other}\b", f"FROM plain_{other}", body)
        renamed[f"plain_{name}"] = body
    return {**_CHUNKS, **renamed}


@query(
    "lexicon_changes",
    sql(
        """SELECT book_id, segment_index, CASE WHEN b.cache_key IS NULL THEN 'added' WHEN a.cache_key IS NULL THEN 'removed' WHEN a.cache_key = b.cache_key THEN 'same' ELSE 'changed' END AS change
  FROM keyed a FULL JOIN (SELECT book_id, segment_index, cache_key FROM plain_keyed) b USING (book_id, segment_index)""",
        **_two_runs(),
    ),
)
def lexicon_changes(spark, sf):
    """Two runs of the same documents, without and with their lexicon."""
    voice = M.choose(F.col("language"), VOICES)
    return R.lexicon_diff(documents(spark, sf), ["book_id"], voice, F.lit(1.0), default_registry(LANGUAGES))


# ------------------------------------------------------ chunks that arrive as rows

TURN_LEVELS = [["chapter_index"], ["block_index", "chunk_index"]]
_TURNS = f"""SELECT conv_id // 16 AS book_id, conv_id AS chapter_index, turn AS block_index, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_index FROM (
  SELECT conv_id, turn, {Q.packed('a', 350)} AS p FROM (SELECT conv_id, turn, {Q.sentences('text')} AS a FROM conversations WHERE role <> 'system'))"""


def turns(spark, sf):
    """Conversations as chapters, sixteen to a book; system turns are skip blocks."""
    spoken = texts(spark, sf, "conversations").filter(F.col("role") != "system")
    rows = spoken.select(
        F.floor(F.col("conv_id") / 16).alias("book_id"), F.col("conv_id").alias("chapter_index"), F.col("turn").alias("block_index"),
        F.posexplode(segment_text(F.col("text"), F.lit("en"))).alias("chunk_index", "text"),
    )
    return rows


@query(
    "pause_rule",
    sql(
        """SELECT book_id, chapter_index, block_index, chunk_index, CASE WHEN lead(chapter_index) OVER w IS NULL THEN 0.0::DOUBLE WHEN lead(chapter_index) OVER w <> chapter_index THEN 1.2::DOUBLE
  WHEN lead(block_index) OVER w <> block_index THEN 0.6::DOUBLE ELSE 0.35::DOUBLE END AS pause_after_s FROM turns WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index, block_index, chunk_index)""",
        turns=_TURNS,
    ),
)
def pause_rule(spark, sf):
    marked = R.mark_pauses(cut_lineage(turns(spark, sf)), "book_id", TURN_LEVELS)
    return marked.select("book_id", "chapter_index", "block_index", "chunk_index", "pause_after_s")


@query(
    "segment_numbers",
    sql(
        "SELECT book_id, chapter_index, block_index, chunk_index, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, block_index, chunk_index) - 1 AS segment_index FROM turns",
        turns=_TURNS,
    ),
)
def segment_numbers(spark, sf):
    out = row_numbers(cut_lineage(turns(spark, sf)), ["book_id"], TURN_LEVELS, "segment_index")
    return out.select("book_id", "chapter_index", "block_index", "chunk_index", "segment_index")


# ------------------------------------------------------------- batches and results

_REQ_LEVELS = [["placed_on"], ["chapter_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]]
_ORDER = "placed_on, chapter_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    "batches",
    sql(
        f"""SELECT job_id, chapter_id, l_linenumber, l_partkey, l_suppkey, n // 50 AS batch, least((n // 50 + 1) * 50, total) / total AS progress FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_ORDER}) - 1 AS n, CAST(count(*) OVER (PARTITION BY job_id) AS DOUBLE) AS total FROM track)""",
        track=_TRACK,
    ),
)
def batches(spark, sf):
    out = R.batches(track(spark, sf), _REQ_LEVELS)
    return out.select("job_id", "chapter_id", "l_linenumber", "l_partkey", "l_suppkey", "batch", "progress")


@query(
    "job_progress",
    """SELECT o_orderkey AS job_id, CASE WHEN count(l_orderkey) = 0 THEN 1.0::DOUBLE ELSE CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) END AS progress
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def job_progress(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    requests = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linestatus") == "F").alias("done")
    )
    return R.job_progress(jobs, requests)


def _requests(spark, sf):
    """Line items ask for parts; the key is that of the part's text. Large items want it once more, which nobody has made."""
    text = F.concat(F.lit("Part "), F.col("l_partkey"), F.when(F.col("l_quantity") > 45, " again").otherwise(""))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_suppkey", "l_partkey", text.alias("text"), F.sha2(text, 256).alias("cache_key")
    )


def _part_key(*tail):
    return F.sha2(F.concat(F.lit("Part "), F.col("p_partkey"), *tail), 256).alias("cache_key")


def _results(spark, sf):
    """Promotional parts fail."""
    failed = F.col("p_type") == "PROMO"
    return table(spark, sf, "part").select(
        _part_key(),
        F.when(~failed, F.col("p_retailprice") / 100).alias("duration_s"),
        F.when(failed, F.concat(F.lit("cannot say "), F.col("p_name"))).alias("error"),
    )


_MERGED = """SELECT l_orderkey AS job_id, l_linenumber, l_suppkey, l_partkey, CASE WHEN p_partkey IS NULL THEN 'queued' WHEN p_type = 'PROMO' THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN p_type <> 'PROMO' THEN p_retailprice / 100 END AS duration_s, CASE WHEN p_type = 'PROMO' THEN 'cannot say ' || p_name END AS error
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_quantity <= 45"""


def merged(spark, sf):
    return R.merge_results(_requests(spark, sf), _results(spark, sf))


@query("merged_results", sql("SELECT job_id, l_linenumber, l_suppkey, l_partkey, status, duration_s FROM merged", merged=_MERGED))
def merged_results(spark, sf):
    return merged(spark, sf).select("job_id", "l_linenumber", "l_suppkey", "l_partkey", "status", "duration_s")


@query(
    "failure_summary",
    sql(
        """SELECT job_id, failed, total, 'synthesis failed on ' || failed || ' of ' || total || ' chunks; first: "Part ' || f.part || '": ' || f.error AS message FROM (
  SELECT job_id, count(*) FILTER (status = 'failed') AS failed, count(*) AS total,
    arg_min({'part': l_partkey, 'error': error}, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) FILTER (status = 'failed') AS f FROM merged GROUP BY 1) WHERE failed > 0""",
        merged=_MERGED,
    ),
)
def failure_summary(spark, sf):
    return R.failure_summary(merged(spark, sf), ["l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "run_diff",
    """SELECT position, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM (
  SELECT p_partkey AS position, p_name || CASE WHEN p_type = 'SMALL' THEN '!' ELSE '' END AS a FROM part)
  FULL JOIN (SELECT CASE WHEN p_size >= 48 THEN -p_partkey ELSE p_partkey END AS position, p_name AS b FROM part) USING (position)""",
)
def run_diff(spark, sf):
    """Large parts have moved in the new run, small ones have lost an exclamation mark."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    old = p.select(
        key.alias("position"), F.sha2(F.concat("p_name", F.when(F.col("p_type") == "SMALL", "!").otherwise("")), 256).alias("cache_key")
    )
    new = p.select(F.when(F.col("p_size") >= 48, -key).otherwise(key).alias("position"), F.sha2("p_name", 256).alias("cache_key"))
    return R.run_diff(old, new, ["position"]).select("position", "change")


@query(
    "reuse_report",
    """SELECT count(*) FILTER (known) AS reused, count(*) FILTER (NOT known) AS fresh FROM (
  SELECT DISTINCT l_partkey, l_quantity > 45 AS again, l_quantity <= 45 AND p_size < 20 AS known FROM lineitem JOIN part ON p_partkey = l_partkey)""",
)
def reuse_report(spark, sf):
    """In the old run parts of size 20 and more read otherwise."""
    old = table(spark, sf, "part").select(_part_key(F.when(F.col("p_size") >= 20, " of old").otherwise("")))
    return R.reuse_report(old, _requests(spark, sf))


# ------------------------------------------------------------------------- jobs

STATUS = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "failed"}
LOG_LEVELS = [["day"], ["ts", "event_id"]]
_LOG = """SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events"""


def log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("user_id").alias("job_id"), "ts", F.to_date("ts").alias("day"), M.choose(F.col("event_type"), STATUS).alias("status")
    )


@query(
    "current_job_state",
    sql("SELECT job_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, count(*) AS events FROM log GROUP BY 1", log=_LOG),
)
def current_job_state(spark, sf):
    return R.current_state(log(spark, sf))


#: Of a stage's events: signups start it, purchases finish it, errors cancel the whole job; the rest is progress.
KIND = {"signup": "start", "purchase": "finish", "error": "cancel"}
_STAGE_EVENTS = """SELECT user_id AS job_id, event_id, ts, CASE WHEN value < 20 THEN 'prepare' WHEN value < 60 THEN 'synthesize' ELSE 'export' END AS stage,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN CASE WHEN value > 150 THEN 'cancel' ELSE 'progress' END ELSE 'progress' END AS kind,
  least(round(value) / 500, 1.0::DOUBLE) AS progress FROM events"""


def stage_events(spark, sf):
    """Events as a job's stage log; only large errors cancel, so that some jobs run for long."""
    value, kind = F.col("value"), M.choose(F.col("event_type"), KIND, "progress")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "ts", F.to_date("ts").alias("day"),
        F.when(value < 20, "prepare").when(value < 60, "synthesize").otherwise("export").alias("stage"),
        F.when((kind == "cancel") & (value <= 150), "progress").otherwise(kind).alias("kind"),
        F.least(F.round("value") / 500, F.lit(1.0)).alias("progress"),
    )


@query(
    "stage_intervals",
    sql(
        """SELECT job_id, stage, CAST(run AS BIGINT) AS run, min(ts) AS started_at, CASE WHEN bool_or(kind = 'finish') THEN 1.0::DOUBLE ELSE
    coalesce(arg_max(progress, {'t': ts, 'e': event_id}) FILTER (kind = 'progress'), 0.0::DOUBLE) END AS progress, min(ts) FILTER (kind = 'finish') AS finished_at,
    CASE WHEN bool_or(kind = 'finish') THEN 'done' ELSE 'running' END AS status FROM valid WHERE ended = 0 AND run > 0 GROUP BY 1, 2, 3""",
        stage_events=_STAGE_EVENTS,
        living="""SELECT * FROM (SELECT *, sum(CAST(kind = 'cancel' AS INTEGER)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS cancelled FROM stage_events) WHERE cancelled = 0""",
        runs="SELECT *, sum(CAST(kind = 'start' AS INTEGER)) OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) AS run FROM living",
        valid="""SELECT *, coalesce(sum(CAST(kind = 'finish' AS INTEGER)) OVER (PARTITION BY job_id, stage, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM runs""",
    ),
)
def stage_intervals(spark, sf):
    """Every run of every stage with its start, last progress and finish."""
    return R.stage_intervals(stage_events(spark, sf), LOG_LEVELS)


@query(
    "job_outcomes",
    sql(
        """SELECT job_id, CASE WHEN cancels > 0 THEN 'cancelled' WHEN starts = 0 THEN 'queued' ELSE 'running' END AS status,
    coalesce(first_start < first_cancel, first_start IS NOT NULL) AS ran FROM (SELECT job_id, count(*) FILTER (kind = 'cancel') AS cancels, count(*) FILTER (kind = 'start') AS starts,
    min({'t': ts, 'e': event_id}) FILTER (kind = 'start') AS first_start, min({'t': ts, 'e': event_id}) FILTER (kind = 'cancel') AS first_cancel FROM stage_events GROUP BY 1)""",
        stage_events=_STAGE_EVENTS,
    ),
)
def job_outcomes(spark, sf):
    """A job that is cancelled while it is queued never runs."""
    return R.job_outcomes(stage_events(spark, sf))


@query(
    "illegal_transitions",
    sql(
        """SELECT job_id, event_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM log)
  WHERE previous IN ('done','failed','cancelled') OR (previous IS NOT NULL AND status = 'queued')""",
        log=_LOG,
    ),
)
def illegal_transitions(spark, sf):
    return R.illegal_transitions(log(spark, sf), LOG_LEVELS).select("job_id", "event_id", "previous", "status")


@query(
    "primary_artifacts",
    sql(
        "SELECT job_id, arg_min(path, {'a': format <> 'mp3', 'b': coalesce(part_index, 0), 'c': path}) AS path FROM artifacts GROUP BY 1",
        "artifacts",
    ),
)
def primary_artifacts(spark, sf):
    rows = M.artifacts(spark, sf).withColumn("request_no", F.coalesce("part_index", F.lit(0)))
    return R.primary_artifact(rows)


_FORMATS = "list_filter(list_transform(string_split(formats, ','), lambda f: trim(f)), lambda f: f <> '')"
_WANTED = f"SELECT o_custkey AS job_id, formats FROM (SELECT o_custkey, max(o_orderpriority) AS pr FROM orders GROUP BY 1) JOIN (VALUES ('1-URGENT', 'mp3,m4b'),('2-HIGH','mp4'),('3-MEDIUM',''),('4-NOT SPECIFIED','srt, mp4'),('5-LOW','mp4,chapters')) v(p, formats) ON p = pr"


@query(
    "artifact_rows",
    sql(
        f"""SELECT job_id, request_no, format, CASE WHEN format = 'mp4' AND total > 1 THEN part_index END AS part_index, CASE WHEN format = 'mp4' AND total > 1 THEN total END AS part_total FROM (
  SELECT job_id, unnest(f) AS format, generate_subscripts(f, 1) - 1 AS request_no FROM (SELECT job_id, CASE WHEN len({_FORMATS}) = 0 THEN ['mp3'] ELSE {_FORMATS} END AS f FROM wanted)) r
  LEFT JOIN (SELECT job_id, CAST(part_index AS BIGINT) AS part_index, CAST(max(part_index) OVER (PARTITION BY job_id) AS BIGINT) AS total FROM (SELECT DISTINCT job_id, part_index FROM parted)) p
  ON p.job_id = r.job_id AND r.format = 'mp4'""".replace("SELECT job_id, request_no, format,", "SELECT r.job_id, request_no, format,", 1),
        **_TO_MARKERS, parted=_PARTED, wanted=_WANTED,
    ),
)
def artifact_rows(spark, sf):
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.max("o_orderpriority").alias("p"))
    csv = M.choose(F.col("p"), {"1-URGENT": "mp3,m4b", "2-HIGH": "mp4", "3-MEDIUM": "", "4-NOT SPECIFIED": "srt, mp4"}, "mp4,chapters")
    jobs = best.select("job_id", csv.alias("formats"))
    parts = cut_lineage(T.part_spans(parted(spark, sf)).select("job_id", "part_index"))
    return R.artifact_rows(jobs, parts, C.parse_formats(F.col("formats")))


@query(
    "cover_needed",
    sql(
        f"""SELECT job_id, cover_path IS NULL AND len(list_intersect(CASE WHEN len({_FORMATS}) = 0 THEN ['mp3'] ELSE {_FORMATS} END, ['mp3','m4b','mp4'])) > 0 AS needed
  FROM jobs JOIN books USING (book_id)""",
        "jobs", "books",
    ),
)
def cover_needed(spark, sf):
    covers = M.books(spark, sf).select("book_id", "cover_path")
    jobs = M.jobs(spark, sf).join(covers, "book_id")
    return jobs.select("job_id", R.needs_cover(F.col("cover_path"), C.parse_formats(F.col("formats"))).alias("needed"))


@query(
    "throughput",
    sql(
        """SELECT language, CAST(sum(e) AS DOUBLE) / nullif(sum(a), 0) AS ratio, coalesce(CAST(sum(e) AS DOUBLE) / nullif(sum(a), 0) < 1, false) AS passes FROM (
  SELECT language, CAST(round(l_extendedprice) AS BIGINT) AS e, CASE WHEN language = 'fr' THEN 0 ELSE CAST(l_quantity AS BIGINT) * CASE language WHEN 'en' THEN 4000 ELSE 1000 END END AS a
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN books ON book_id = o_custkey) GROUP BY 1""",
        "books",
    ),
)
def throughput(spark, sf):
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("book_id"))
    rows = table(spark, sf, "lineitem").join(owner, "l_orderkey").join(M.books(spark, sf).select("book_id", "language"), "book_id")
    pace = F.when(F.col("language") == "en", 4000).otherwise(1000)
    audio = F.when(F.col("language") == "fr", F.lit(0).cast("bigint")).otherwise(F.col("l_quantity").cast("bigint") * pace)
    runs = rows.select("language", F.round("l_extendedprice").cast("bigint").alias("elapsed_ms"), audio.alias("audio_ms"))
    return R.throughput(runs)

