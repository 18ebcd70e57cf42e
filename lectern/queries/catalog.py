"""Catalog queries over the model tables."""

from pyspark.sql import functions as F

from lectern.functions import display as D
from lectern.operators import catalog as C
from lectern.operators.ordered import row_numbers
from lectern.queries.registry import query, table
from lectern.queries.views import iso, sql
from lectern.sources import model as M

# Fixed values on the SQL side.
_ENGINES = "CASE language WHEN 'en' THEN 'kokoro' WHEN 'zh' THEN 'kokoro' WHEN 'pl' THEN 'piper' WHEN 'de' THEN 'piper' END"
_VOICE_LANG = (
    "CASE substr(voice_id,1,1) WHEN 'a' THEN 'en' WHEN 'b' THEN 'en' WHEN 'e' THEN 'es' WHEN 'f' THEN 'fr' "
    "WHEN 'h' THEN 'hi' WHEN 'i' THEN 'it' WHEN 'j' THEN 'ja' WHEN 'p' THEN 'pt' WHEN 'z' THEN 'zh' ELSE 'und' END"
)
_WORDS = (
    "CASE WHEN trim({t}, chr(32)||chr(9)||chr(10)||chr(13)) = '' THEN 0 ELSE "
    "len(string_split_regex(trim({t}, chr(32)||chr(9)||chr(10)||chr(13)), '\\s+')) END"
)
_FORMATS = "list_filter(list_transform(string_split(formats, ','), lambda f: trim(f)), lambda f: f <> '')"
_KNOWN = "['mp3','m4b','opus','flac','wav','srt','vtt','mp4','chapters']"


@query(
    "books_newest_first",
    sql(
        f"""SELECT book_id, title, author, language, {iso('created_at')} AS created_at, cover_path IS NOT NULL AS has_cover,
  (SELECT count(*) FROM chapters c WHERE c.book_id = b.book_id) AS chapter_count FROM books b""",
        "books", "chapters",
    ),
)
def books_newest_first(spark, sf):
    out = C.list_books(M.books(spark, sf), M.chapters(spark, sf))
    return out.withColumn("created_at", D.utc_iso(F.col("created_at")))


@query(
    "book_detail",
    sql(
        """SELECT c.book_id, c.chapter_id, c.idx AS chapter_index, c.title, c.enabled, coalesce(n, 0) AS block_count
  FROM chapters c LEFT JOIN (SELECT chapter_id, count(*) n FROM segments GROUP BY 1) s USING (chapter_id)""",
        "chapters", "segments",
    ),
)
def book_detail(spark, sf):
    out = C.book_detail(M.chapters(spark, sf), M.segments(spark, sf), M.CHAPTER_LEVELS)
    return out.select("book_id", "chapter_id", "chapter_index", "title", "enabled", "block_count")


@query(
    "book_lookup",
    sql(
        """SELECT l.doc_id AS book_id, b.book_id IS NOT NULL AS found, b.title FROM labels l
  LEFT JOIN books b ON b.book_id = l.doc_id""",
        "books",
    ),
)
def book_lookup(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("book_id"))
    return C.lookup(M.books(spark, sf), wanted, "book_id").select("book_id", "found", "title")


@query("chapter_blocks", sql("SELECT chapter_id, idx AS block_index, text FROM segments", "segments"))
def chapter_blocks(spark, sf):
    return C.chapter_blocks(M.segments(spark, sf), M.SEGMENT_LEVELS).select("chapter_id", "block_index", "text")


_CLAIMS = "SELECT l_orderkey AS chapter_id, l_suppkey AS book_id, l_linenumber FROM lineitem"


def _claims(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chapter_id"), F.col("l_suppkey").alias("book_id"), "l_linenumber"
    )


@query(
    "scope_accepted",
    sql("SELECT * FROM claims SEMI JOIN chapters USING (chapter_id, book_id)", "chapters", claims=_CLAIMS),
)
def scope_accepted(spark, sf):
    out = C.in_scope(_claims(spark, sf), M.chapters(spark, sf), ["chapter_id", "book_id"])
    return out.select("chapter_id", "book_id", "l_linenumber")


@query(
    "scope_rejected",
    sql("SELECT * FROM claims ANTI JOIN chapters USING (chapter_id, book_id)", "chapters", claims=_CLAIMS),
)
def scope_rejected(spark, sf):
    out = C.out_of_scope(_claims(spark, sf), M.chapters(spark, sf), ["chapter_id", "book_id"])
    return out.select("chapter_id", "book_id", "l_linenumber")


@query(
    "partial_update",
    sql(
        """SELECT b.book_id, coalesce(p.title, b.title) AS title, coalesce(p.author, b.author) AS author, b.language
  FROM books b LEFT JOIN patch p USING (book_id)""",
        "books",
        patch="""SELECT doc_id AS book_id, CASE WHEN quality = 1 THEN 'Title ' || doc_id END AS title,
  CASE WHEN toxic = 1 THEN 'Unknown' END AS author FROM labels""",
    ),
)
def partial_update(spark, sf):
    patch = table(spark, sf, "labels").select(
        F.col("doc_id").alias("book_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Title "), F.col("doc_id"))).alias("title"),
        F.when(F.col("toxic") == 1, "Unknown").alias("author"),
    )
    out = C.apply_patch(M.books(spark, sf), patch, "book_id", ["title", "author"])
    return out.select("book_id", "title", "author", "language")


@query(
    "enabled_chapters",
    sql(
        """SELECT book_id, chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY placed_on, chapter_id) - 1 AS position
  FROM chapters WHERE enabled""",
        "chapters",
    ),
)
def enabled_chapters(spark, sf):
    out = C.enabled_chapters(M.chapters(spark, sf), M.CHAPTER_LEVELS)
    return out.select("book_id", "chapter_id", "position")


@query(
    "books_without_enabled",
    sql(
        """SELECT book_id, 'book ' || book_id || ' has no enabled chapters' AS error FROM books
  WHERE book_id NOT IN (SELECT book_id FROM chapters WHERE enabled)""",
        "books", "chapters",
    ),
)
def books_without_enabled(spark, sf):
    return C.books_without_enabled(M.books(spark, sf), M.chapters(spark, sf)).select("book_id", "error")


@query(
    "enabled_counts",
    sql(
        """SELECT book_id, count(chapter_id) FILTER (enabled) AS enabled_count FROM books LEFT JOIN chapters USING (book_id)
  GROUP BY book_id""",
        "books", "chapters",
    ),
)
def enabled_counts(spark, sf):
    return C.enabled_counts(M.books(spark, sf), M.chapters(spark, sf))


@query(
    "reading_estimate",
    f"""SELECT doc_id, words, CASE WHEN words < 150 THEN '<1 min' WHEN words >= 9000
  THEN (words // 9000) || 'h ' || CAST(floor((words / 150.0::DOUBLE) % 60 + 0.5) AS BIGINT) || 'm'
  ELSE CAST(floor((words / 150.0::DOUBLE) % 60 + 0.5) AS BIGINT) || ' min' END AS reading_time
  FROM (SELECT doc_id, CAST({_WORDS.format(t='text')} AS BIGINT) AS words FROM documents)""",
)
def reading_estimate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", D.word_count(F.col("text")).alias("words"))
    return docs.withColumn("reading_time", D.minutes_text(F.col("words") / D.WORDS_PER_MINUTE))


@query(
    "passage_length",
    f"""SELECT doc_id, CAST(CASE WHEN lang = 'es' THEN length(text) ELSE {_WORDS.format(t='text')} END AS BIGINT) AS size,
  greatest(1, CAST(floor(n_chars / 1000.0::DOUBLE * CASE WHEN lang = 'es' THEN 240 ELSE 150 END) AS BIGINT)) AS target FROM documents""",
)
def passage_length(spark, sf):
    """Spanish stands for Chinese here, which the test documents lack."""
    lang = F.when(F.col("lang") == "es", "zh").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id",
        D.passage_length(F.col("text"), lang).alias("size"),
        D.target_length(lang, F.col("n_chars") / 1000.0).alias("target"),
    )


def _decoded_voices(spark, sf):
    language, gender = C.decode_voice(F.col("voice_id"))
    return M.voices(spark, sf).select("voice_id", "engine", language.alias("language"), gender.alias("gender"))


_DECODED = f"""SELECT voice_id, engine, {_VOICE_LANG} AS language,
  CASE substr(voice_id,2,1) WHEN 'f' THEN 'female' WHEN 'm' THEN 'male' END AS gender FROM voices"""


@query("voice_catalog", sql("SELECT DISTINCT voice_id, engine FROM voices", "voices"))
def voice_catalog(spark, sf):
    voices = M.voices(spark, sf)
    return C.all_voices([voices.filter(F.col("engine") == e) for e in sorted(set(C.LANGUAGE_ROUTING.values()))])


@query("voice_decode", sql("SELECT * FROM decoded", "voices", decoded=_DECODED))
def voice_decode(spark, sf):
    return _decoded_voices(spark, sf)


@query(
    "voice_sidecars",
    """SELECT event_id, coalesce(config->>'$.language.family', 'und') AS language,
  coalesce(CAST(config->>'$.audio.sample_rate' AS INTEGER), 22050) AS sample_rate, config->>'$.audio.quality' AS quality FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN '{"language": {"family": "de"}, "audio": ' || props || '}'
    WHEN 'click' THEN '{"audio": {"sample_rate": 16000, "quality": "high"}, "x": ' || props || '}' ELSE props END AS config FROM events)""",
)
def voice_sidecars(spark, sf):
    kind, props = F.col("event_type"), F.col("props")
    config = (
        F.when(kind == "view", F.concat(F.lit('{"language": {"family": "de"}, "audio": '), props, F.lit("}")))
        .when(
            kind == "click",
            F.concat(F.lit('{"audio": {"sample_rate": 16000, "quality": "high"}, "x": '), props, F.lit("}")),
        )
        .otherwise(props)
    )
    language, rate, quality = C.sidecar_metadata(config)
    return table(spark, sf, "events").select(
        "event_id", language.alias("language"), rate.alias("sample_rate"), quality.alias("quality")
    )


@query(
    "voices_by_language",
    sql(
        "SELECT language, voice_id, row_number() OVER (PARTITION BY language ORDER BY voice_id) - 1 AS position FROM decoded",
        "voices", decoded=_DECODED,
    ),
)
def voices_by_language(spark, sf):
    return C.voices_by_language(_decoded_voices(spark, sf)).select("language", "voice_id", "position")


@query(
    "matching_voices",
    sql(
        """SELECT b.book_id, b.language, coalesce(n, 0) AS voice_count, first_voice FROM books b LEFT JOIN (
  SELECT language, count(*) AS n, min(voice_id) AS first_voice FROM decoded GROUP BY 1) v USING (language)""",
        "books", "voices", decoded=_DECODED,
    ),
)
def matching_voices(spark, sf):
    out = C.matching_voices(M.books(spark, sf), _decoded_voices(spark, sf))
    return out.select("book_id", "language", "voice_count", "first_voice")


_ROUTE_ERROR = f"CASE WHEN {_ENGINES} IS NULL THEN 'no engine for language ' || language || ' (known: de, en, pl, zh)' END"


@query(
    "engine_routing",
    sql(f"SELECT book_id, language, {_ENGINES} AS engine, {_ROUTE_ERROR} AS error FROM books", "books"),
)
def engine_routing(spark, sf):
    return C.route(M.books(spark, sf)).select("book_id", "language", "engine", "error")


_STUDIO = "SELECT * FROM (VALUES ('af_heart','kokoro'),('zf_xiaobei','kokoro'),('pl_PL-gosia-medium','piper'),('de_DE-thorsten-high','piper')) t(voice_id, engine)"


def _requests(spark, sf):
    routed = C.route(M.books(spark, sf)).select("book_id", "language", "engine", "error")
    return M.jobs(spark, sf).join(routed, "book_id")


def _all_voices(spark, sf):
    """Decoded supplier voices and the four studio voices that jobs name."""
    studio = spark.createDataFrame(
        [("af_heart", "kokoro"), ("zf_xiaobei", "kokoro"), ("pl_PL-gosia-medium", "piper"), ("de_DE-thorsten-high", "piper")],
        "voice_id string, engine string",
    )
    return C.all_voices([M.voices(spark, sf), studio])


_RESOLVED = f"""SELECT j.*, engine, coalesce(route_error,
    CASE WHEN v.voice_engine IS NULL THEN 'no voice named ' || j.voice END,
    CASE WHEN v.voice_engine <> engine THEN 'voice ' || j.voice || ' belongs to engine ' || v.voice_engine END) AS error
  FROM jobs j JOIN (SELECT book_id, {_ENGINES} AS engine, {_ROUTE_ERROR} AS route_error FROM books) r USING (book_id)
  LEFT JOIN (SELECT voice_id, engine AS voice_engine FROM voices UNION SELECT voice_id, engine FROM studio) v ON v.voice_id = j.voice"""


@query(
    "voice_resolution",
    sql("SELECT job_id, voice, engine, error FROM resolved", "books", "jobs", "voices", studio=_STUDIO, resolved=_RESOLVED),
)
def voice_resolution(spark, sf):
    out = C.resolve_voices(_requests(spark, sf), _all_voices(spark, sf))
    return out.select("job_id", "voice", "engine", "error")


@query(
    "request_validation",
    sql(
        f"""SELECT job_id, coalesce(error, CASE WHEN len(f) = 0 THEN 'at least one output format is required' END,
   CASE WHEN len(u) > 0 THEN 'unsupported formats: ' || array_to_string(u, ', ') END,
   CASE WHEN video_style NOT IN ('static','waveform','kenburns') THEN 'unsupported video style: ' || video_style END) AS error
  FROM (SELECT *, {_FORMATS} AS f, list_sort(list_filter({_FORMATS}, lambda x: NOT list_contains({_KNOWN}, x))) AS u FROM resolved)""",
        "books", "jobs", "voices", studio=_STUDIO, resolved=_RESOLVED,
    ),
)
def request_validation(spark, sf):
    resolved = C.resolve_voices(_requests(spark, sf), _all_voices(spark, sf))
    return C.validate_requests(resolved).select("job_id", "error")


@query(
    "job_detail",
    sql(
        """SELECT job_id, 'stage' AS entry, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS position, stage AS label FROM stage_log
  UNION ALL SELECT job_id, 'artifact', row_number() OVER (PARTITION BY job_id ORDER BY format, coalesce(part_index, 0), path) - 1, path FROM artifacts""",
        "stage_log", "artifacts",
    ),
)
def job_detail(spark, sf):
    return C.job_detail(M.stage_log(spark, sf), M.artifacts(spark, sf))


@query(
    "jobs_newest_first",
    sql(
        "SELECT book_id, job_id, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, job_id) - 1 AS position FROM jobs",
        "jobs",
    ),
)
def jobs_newest_first(spark, sf):
    return C.jobs_newest_first(M.jobs(spark, sf)).select("book_id", "job_id", "position")


_PICK = """SELECT job_id, format, path FROM (SELECT *, row_number() OVER (PARTITION BY job_id, format
  ORDER BY coalesce(part_index, 1), path) AS rn FROM artifacts{where}) WHERE rn = 1"""


@query("artifact_default", sql(_PICK.format(where=""), "artifacts"))
def artifact_default(spark, sf):
    return C.pick_artifact(M.artifacts(spark, sf))


@query("artifact_part", sql(_PICK.format(where=" WHERE coalesce(part_index, 1) = 2"), "artifacts"))
def artifact_part(spark, sf):
    return C.pick_artifact(M.artifacts(spark, sf), part=2)


@query(
    "format_lists",
    sql(
        f"SELECT job_id, array_to_string(CASE WHEN len({_FORMATS}) = 0 THEN ['mp3'] ELSE {_FORMATS} END, '|') AS formats FROM jobs",
        "jobs",
    ),
)
def format_lists(spark, sf):
    return M.jobs(spark, sf).select("job_id", F.array_join(C.parse_formats(F.col("formats")), "|").alias("formats"))


@query(
    "artifacts_by_format",
    sql(
        "SELECT job_id, format, count(*) AS files, min(part_index) AS first_part, max(part_index) AS last_part FROM artifacts GROUP BY ALL",
        "artifacts",
    ),
)
def artifacts_by_format(spark, sf):
    return C.artifacts_by_format(M.artifacts(spark, sf))


def _asked(spark, sf):
    """Jobs with a returned line item are asked to stop or to run again."""
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("job_id"))


_ASKED = "SELECT l_orderkey AS job_id FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "cancel_jobs",
    sql(
        """SELECT job_id, CASE WHEN status IN ('queued','running') AND job_id IN (SELECT job_id FROM asked) THEN 'cancelled'
  ELSE status END AS status FROM jobs""",
        "jobs", asked=_ASKED,
    ),
)
def cancel_jobs(spark, sf):
    return C.cancel(M.jobs(spark, sf), _asked(spark, sf)).select("job_id", "status")


@query(
    "retry_jobs",
    sql(
        """SELECT 'retry-' || job_id AS job_id, book_id, 'queued' AS status, voice, speed, formats, video_style FROM jobs
  WHERE status IN ('failed','cancelled') AND job_id IN (SELECT job_id FROM asked)""",
        "jobs", asked=_ASKED,
    ),
)
def retry_jobs(spark, sf):
    return C.retry(M.jobs(spark, sf), _asked(spark, sf))


@query(
    "retry_conflicts",
    sql(
        """SELECT job_id, 'job is ' || status || ', not failed or cancelled' AS error FROM jobs
  WHERE status NOT IN ('failed','cancelled') AND job_id IN (SELECT job_id FROM asked)""",
        "jobs", asked=_ASKED,
    ),
)
def retry_conflicts(spark, sf):
    return C.retry_conflicts(M.jobs(spark, sf), _asked(spark, sf)).select("job_id", "error")


@query(
    "elapsed_seconds",
    sql(
        """SELECT job_id, (epoch_us(coalesce(finished_at, TIMESTAMP '2002-01-01')) - epoch_us(started_at)) / 1e6 AS elapsed_s
  FROM jobs""",
        "jobs",
    ),
)
def elapsed_seconds(spark, sf):
    now = F.lit("2002-01-01").cast("timestamp")
    return M.jobs(spark, sf).select(
        "job_id", C.elapsed_seconds(F.col("started_at"), F.col("finished_at"), now).alias("elapsed_s")
    )


@query(
    "stage_board",
    sql(
        """SELECT job_id, stage_no, stage, CASE WHEN progress IS NULL THEN 'queued' WHEN progress >= 1 THEN 'done' ELSE 'running' END AS status,
  coalesce(progress, 0.0::DOUBLE) AS progress FROM (SELECT job_id FROM jobs) j
  CROSS JOIN (VALUES (0,'prepare'),(1,'synthesize'),(2,'assemble'),(3,'master'),(4,'export')) s(stage_no, stage)
  LEFT JOIN (SELECT job_id, stage, arg_max(progress, {'ts': ts, 'id': event_id}) AS progress FROM stage_log GROUP BY ALL) l USING (job_id, stage)""",
        "jobs", "stage_log",
    ),
)
def stage_board(spark, sf):
    return C.stage_board(M.jobs(spark, sf), M.stage_log(spark, sf))


_KEYS = ["tts_workers", "loudness_target_i", "loudness_target_tp", "loudness_target_lra", "mp4_part_limit_s", "theme"]
_STORED = """SELECT s_suppkey AS scope, (['tts_workers','loudness_target_i','loudness_target_tp','loudness_target_lra',
  'mp4_part_limit_s','theme'])[s_nationkey % 6 + 1] AS key, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS value FROM supplier"""
_UPDATES = """SELECT c_custkey AS scope, (['tts_workers','loudness_target_i','loudness_target_tp','loudness_target_lra',
  'mp4_part_limit_s','theme'])[c_nationkey % 6 + 1] AS key, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS value FROM customer"""


def _setting_rows(df, key, nation, amount):
    return df.select(
        F.col(key).alias("scope"),
        F.get(F.lit(_KEYS), F.col(nation) % 6).alias("key"),
        F.floor(amount).cast("string").alias("value"),
    )


def _stored(spark, sf):
    return _setting_rows(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")


def _updates(spark, sf):
    return _setting_rows(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_acctbal")


@query(
    "settings_overlay",
    sql(
        """SELECT scope, key, CAST(coalesce(value, fallback) AS DOUBLE) AS value FROM (SELECT s_suppkey AS scope FROM supplier)
  CROSS JOIN (VALUES ('tts_workers','4'),('loudness_target_i','-19.0'),('loudness_target_tp','-3.0'),('loudness_target_lra','7.0'),('mp4_part_limit_s','42300')) d(key, fallback)
  LEFT JOIN stored USING (scope, key)""",
        stored=_STORED,
    ),
)
def settings_overlay(spark, sf):
    stored = _stored(spark, sf)
    return C.effective_settings(stored.select("scope"), stored)


_CHECKED = """SELECT scope, key, value, CASE WHEN key = 'theme' THEN 'unknown setting: theme'
  WHEN key = 'tts_workers' AND CAST(value AS DOUBLE) < 1 THEN 'tts_workers must be at least 1'
  WHEN key = 'mp4_part_limit_s' AND CAST(value AS DOUBLE) <= 0 THEN 'mp4_part_limit_s must be positive' END AS error FROM updates"""


@query("settings_check", sql("SELECT * FROM checked", updates=_UPDATES, checked=_CHECKED))
def settings_check(spark, sf):
    return C.check_settings(_updates(spark, sf))


@query(
    "settings_upsert",
    sql(
        """SELECT scope, key, coalesce(u.value, s.value) AS value FROM stored s
  FULL JOIN (SELECT * FROM checked WHERE error IS NULL) u USING (scope, key)""",
        stored=_STORED, updates=_UPDATES, checked=_CHECKED,
    ),
)
def settings_upsert(spark, sf):
    return C.upsert_settings(_stored(spark, sf), _updates(spark, sf))


@query(
    "cache_unreferenced",
    """SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT p_partkey, p_size AS size FROM part
  WHERE (p_partkey, p_size) NOT IN (SELECT (l_partkey, CAST(l_quantity AS INT)) FROM lineitem))""",
)
def cache_unreferenced(spark, sf):
    """Parts stand for cached files, line items for the segments; a text names the part and its size or quantity."""
    key = lambda part, size: F.sha2(F.concat(F.lit("Part "), part, F.lit(" x"), F.col(size).cast("int")), 256).alias("cache_key")
    cache = table(spark, sf, "part").select(key(F.col("p_partkey"), "p_size"), F.col("p_size").alias("length"))
    used = table(spark, sf, "lineitem").select(key(F.col("l_partkey"), "l_quantity"))
    left = C.unreferenced(cache, used)
    return left.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query(
    "manifest_check",
    """SELECT 'doc/' || doc_id AS dest, lang <> 'es' AS present,
  lang <> 'es' AND NOT (source = 'src1' AND contains(text, ' ')) AND NOT (lang = 'fr' AND contains(text, 'e')) AS valid
  FROM documents""",
)
def manifest_check(spark, sf):
    """Spanish files are missing, one source lost its blanks, French files changed a letter; German hashes are unknown."""
    docs = table(spark, sf, "documents").withColumn("dest", F.concat(F.lit("doc/"), F.col("doc_id")))
    manifest = docs.select(
        "dest",
        F.octet_length("text").cast("bigint").alias("size"),
        F.when(F.col("lang") != "de", F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"),
    )
    content = F.when(F.col("source") == "src1", F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    content = F.when(F.col("lang") == "fr", F.translate(content, "e", "a")).otherwise(content)
    files = docs.filter(F.col("lang") != "es").select("dest", content.cast("binary").alias("content"))
    return C.check_manifest(manifest, files)


@query("utc_iso_text", f"SELECT event_id, {iso('ts')} AS at FROM events")
def utc_iso_text(spark, sf):
    return table(spark, sf, "events").select("event_id", D.utc_iso(F.col("ts")).alias("at"))


def _bytes_sql(n):
    parts = []
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        s = 1024**power
        one = f"((({n} * 20 + {s}) >> {10 * power + 1}) // 10) || '.' || ((({n} * 20 + {s}) >> {10 * power + 1}) % 10)"
        whole = f"CAST(({n} * 2 + {s}) >> {10 * power + 1} AS VARCHAR)"
        if power == 0:
            body = f"CAST({n} AS VARCHAR)"
        elif power == 4:
            body = one
        else:
            body = f"CASE WHEN {n} < {10 * s} THEN {one} ELSE {whole} END"
        parts.append(f"WHEN {n} < {s * 1024 if power < 4 else 2**62} THEN {body} || '{unit}'")
    return "CASE " + " ".join(parts) + " END"


@query(
    "size_text",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_bytes_sql('n')} AS size FROM (SELECT *,
  CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(power(32, l_linenumber - 1) AS BIGINT) AS n FROM lineitem)""",
)
def size_text(spark, sf):
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    n = price * F.pow(F.lit(32), F.col("l_linenumber") - 1).cast("bigint")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", D.bytes_text(n).alias("size")
    )


@query(
    "media_types",
    sql(
        """SELECT job_id, format, path, CASE format WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4'
  WHEN 'srt' THEN 'application/x-subrip' ELSE 'application/octet-stream' END AS media_type
  FROM (SELECT job_id, path, CASE WHEN part_index = 1 THEN 'tar' ELSE format END AS format FROM artifacts)""",
        "artifacts",
    ),
)
def media_types(spark, sf):
    fmt = F.when(F.col("part_index") == 1, "tar").otherwise(F.col("format"))
    return M.artifacts(spark, sf).select("job_id", "path", fmt.alias("format"), D.media_type(fmt).alias("media_type"))


@query(
    "safe_names",
    r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '([^/\\]*)[/\\]*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'upload') AS upload_name,
  coalesce(nullif(trim(regexp_replace(title, '[^A-Za-z0-9 ._-]+', '_', 'g')), ''), 'book') AS title_name
  FROM (SELECT page_id, url, regexp_extract(html, '(?i)<title>([^<]*)', 1) AS title FROM pages)""",
)
def safe_names(spark, sf):
    title = F.regexp_extract("html", "(?i)<title>([^<]*)", 1)
    return table(spark, sf, "pages").select(
        "page_id", D.upload_name(F.col("url")).alias("upload_name"), D.title_name(title).alias("title_name")
    )


# -------------------------------------------------------------------- lexicon


def _new_entries(spark, sf):
    """One proposed entry for each customer; some are bad regexes, some name no labelled book."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("book_id"),
        F.lit(9).alias("entry"),
        M.choose(F.col("c_mktsegment"), {"BUILDING": "a(b", "AUTOMOBILE": "[x", "MACHINERY": "a+"}, "word").alias("pattern"),
        F.col("c_name").alias("replacement"),
        (F.col("c_acctbal") > 0).alias("is_regex"),
        F.lit(True).alias("enabled"),
    )


_NEW = """SELECT c_custkey AS book_id, 9 AS entry, CASE c_mktsegment WHEN 'BUILDING' THEN 'a(b' WHEN 'AUTOMOBILE' THEN '[x'
  WHEN 'MACHINERY' THEN 'a+' ELSE 'word' END AS pattern, c_name AS replacement, c_acctbal > 0 AS is_regex, true AS enabled FROM customer"""


@query(
    "lexicon_check",
    sql(
        """SELECT book_id, pattern, CASE WHEN is_regex AND pattern IN ('a(b','[x') THEN 'invalid regex: ' || pattern END AS error
  FROM proposed""",
        proposed=_NEW,
    ),
)
def lexicon_check(spark, sf):
    return C.check_lexicon(_new_entries(spark, sf)).select("book_id", "pattern", "error")


@query(
    "lexicon_create",
    sql(
        """SELECT book_id, entry, pattern, enabled FROM lexicon UNION ALL SELECT book_id, entry, pattern, enabled FROM proposed
  WHERE NOT (is_regex AND pattern IN ('a(b','[x')) AND book_id IN (SELECT doc_id FROM labels)""",
        "lexicon", proposed=_NEW,
    ),
)
def lexicon_create(spark, sf):
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("book_id"))
    out = C.create_lexicon(M.lexicon(spark, sf), _new_entries(spark, sf), known)
    return out.select("book_id", "entry", "pattern", "enabled")


@query(
    "lexicon_update",
    sql(
        """SELECT l.book_id, l.entry, coalesce(CASE WHEN l.entry = 3 THEN p.pattern END, l.pattern) AS pattern,
  coalesce(CASE WHEN l.entry = 3 THEN p.replacement END, l.replacement) AS replacement
  FROM lexicon l LEFT JOIN proposed p USING (book_id)""",
        "lexicon", proposed=_NEW,
    ),
)
def lexicon_update(spark, sf):
    entries = M.lexicon(spark, sf).withColumn("id", F.struct("book_id", "entry"))
    patch = _new_entries(spark, sf).select(
        F.struct("book_id", F.lit(3).alias("entry")).alias("id"), "pattern", "replacement"
    )
    return C.apply_patch(entries, patch, "id", ["pattern", "replacement"]).select(
        "book_id", "entry", "pattern", "replacement"
    )


@query(
    "lexicon_delete",
    sql(
        """SELECT book_id, entry, pattern FROM lexicon WHERE NOT (entry = 2 AND book_id IN (SELECT book_id FROM proposed WHERE is_regex))""",
        "lexicon", proposed=_NEW,
    ),
)
def lexicon_delete(spark, sf):
    doomed = _new_entries(spark, sf).filter("is_regex").select("book_id", F.lit(2).alias("entry"))
    return C.delete_lexicon(M.lexicon(spark, sf), doomed).select("book_id", "entry", "pattern")


@query("lexicon_list", sql("SELECT book_id, entry, pattern, entry - 1 AS position FROM lexicon", "lexicon"))
def lexicon_list(spark, sf):
    return row_numbers(M.lexicon(spark, sf), ["book_id"], [["entry"]], "position").select(
        "book_id", "entry", "pattern", "position"
    )
