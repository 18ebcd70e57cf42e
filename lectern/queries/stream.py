"""Streaming queries, each run to the end over a table that arrives in several deliveries."""

from datetime import timedelta

from pyspark.sql import functions as F

from lectern.functions.segment import segment_text
from lectern.operators import fold
from lectern.queries import sqltext as Q
from lectern.queries.ingest import LINES, TEXT_CHAPTERS
from lectern.queries.plan import _LOG, LOG_LEVELS, STATUS, log
from lectern.queries.registry import query, table
from lectern.queries.views import sql
from lectern.sources import model as M
from lectern.streaming import feeds as S

_CHANGES = """SELECT job_id, event_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous,
  coalesce(sum(CAST(status IN ('done','failed','cancelled') AS INTEGER)) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM log) WHERE status IS DISTINCT FROM previous AND ended = 0"""


def in_deliveries(spark, sf, name, by, run, deliveries=3):
    """The table arrives in several deliveries, in the order of ``by``; after each the stream ``run`` goes on.

    ``run`` is handed a function that opens the stream in a session, and the folder that it keeps between runs.
    """
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    low, high = rows.agg(F.min(by).cast("double"), F.max(by).cast("double")).first()
    number = F.floor((by.cast("double") - F.lit(low)) / F.lit((high - low) / deliveries + 1e-3))
    source, folder = S.stream_folder(spark, f"{name}-arriving"), S.stream_folder(spark, f"{name}-stream")
    for i in range(deliveries):
        rows.where(number == i).write.mode("append").parquet(source)
        out = run(lambda session: S.read_new_files(session, source, rows.schema), folder)
    return out


@query("job_changes", sql(_CHANGES, log=_LOG))
def job_changes(spark, sf):
    return S.job_changes(log(spark, sf), LOG_LEVELS).select("job_id", "event_id", "status")


@query("job_changes_stream", sql(_CHANGES, log=_LOG))
def job_changes_stream(spark, sf):
    """Job ids come up again all through this log, so ended jobs are remembered for longer than it lasts."""

    def run(stream, folder):
        log = lambda session: stream(session).select(
            "event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
            M.choose(F.col("event_type"), STATUS).alias("status"),
        )
        return S.run_job_changes(spark, log, folder, keep=timedelta(days=3650))

    return in_deliveries(spark, sf, "events", F.col("ts").cast("timestamp"), run).select("job_id", "event_id", "status")


@query(
    "stage_board_stream",
    sql("SELECT job_id, stage, arg_max(progress, {'t': ts, 'e': event_id}) AS progress FROM stage_log GROUP BY ALL", "stage_log"),
)
def stage_board_stream(spark, sf):
    run = lambda stream, folder: S.run_stage_board(spark, M.stage_columns(stream(spark)), folder)
    return in_deliveries(spark, sf, "events", F.col("ts").cast("timestamp"), run)


@query("intake_stream", sql(TEXT_CHAPTERS, lines=LINES))
def intake_stream(spark, sf):
    def prepare(docs):
        spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
        return fold.explode_chapters(docs.select("doc_id", fold.text_chapters(spaced).alias("chapters")), ["doc_id"])

    return in_deliveries(spark, sf, "documents", F.col("doc_id"), lambda stream, folder: S.run_intake(spark, stream(spark), prepare, folder))


@query(
    "chunk_dedupe_stream",
    f"""SELECT sha256(chunk) AS cache_key, chunk AS text FROM (SELECT DISTINCT unnest({Q.packed('a', 350)}) AS chunk FROM (SELECT {Q.sentences('text')} AS a FROM documents))
  WHERE chunk NOT IN (SELECT text FROM benchmark)""",
)
def chunk_dedupe_stream(spark, sf):
    """Chunks of the documents; the benchmark texts were made before."""
    known = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("cache_key"))

    def run(stream, folder):
        chunks = stream(spark).select(F.explode(segment_text(F.col("text"), F.lit("en"))).alias("text"))
        return S.run_dedupe(spark, chunks.withColumn("cache_key", F.sha2("text", 256)), known, folder)

    return in_deliveries(spark, sf, "documents", F.col("doc_id"), run)
