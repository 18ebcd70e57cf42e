"""Streams over files that arrive in between: each run takes only what is new, with what it knew before."""

from pyspark.sql import functions as F

from lectern.streaming import feeds as S

LOG = "job_id long, event_id long, ts timestamp, status string, stage string, progress double"


def _add(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _log(rows):
    from datetime import datetime

    return [(j, e, datetime(2024, 1, 1, 0, 0, e), s, g, p) for j, e, s, g, p in rows]


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def _batches(spark, out):
    return spark.read.parquet(f"{out}/data").select("batch").distinct().count()


def test_runs_resume(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "doc_id long, text string"
    chunks = lambda: _stream(spark, source, schema).select("text", F.sha2("text", 256).alias("cache_key"))
    known = spark.createDataFrame([("made before",)], "text string").select(F.sha2("text", 256).alias("cache_key"))
    intake, dedupe = str(tmp_path / "intake"), str(tmp_path / "dedupe")
    upper = lambda d: d.select("doc_id", F.upper("text").alias("text"))

    _add(spark, source, "a", [(1, "one"), (2, "two"), (3, "made before")], schema)
    _add(spark, source, "b", [(4, "two"), (5, "five")], schema)
    assert S.run_intake(spark, _stream(spark, source, schema), upper, intake).count() == 5
    assert sorted(r.text for r in S.run_dedupe(spark, chunks(), known, dedupe).collect()) == ["five", "one", "two"]
    assert _batches(spark, intake) == 2
    _add(spark, source, "c", [(6, "five"), (7, "seven"), (7, "seven")], schema)
    got = S.run_intake(spark, _stream(spark, source, schema), upper, intake)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7, 7]
    assert spark.read.parquet(f"{intake}/data/batch=2").count() == 3
    assert sorted(r.text for r in S.run_dedupe(spark, chunks(), known, dedupe).collect()) == ["five", "one", "seven", "two"]
    assert S.run_intake(spark, _stream(spark, source, schema), upper, intake).count() == 8  # nothing new


def test_state_goes_on_over_runs(spark, tmp_path):
    source, feed, board = (str(tmp_path / x) for x in ("in", "feed", "board"))
    _add(spark, source, "a", _log([(1, 1, "queued", "plan", 0.0), (1, 2, "running", "plan", 0.5), (2, 3, "queued", "plan", 0.1)]), LOG)
    log = lambda: _stream(spark, source, LOG)
    status = lambda own: _stream(own, source, LOG)
    first = S.run_job_changes(spark, status, feed)
    assert sorted((r.job_id, r.status) for r in first.collect()) == [(1, "queued"), (1, "running"), (2, "queued")]
    _add(spark, source, "b", _log([(1, 4, "running", "plan", 0.9), (1, 5, "done", "speak", 1.0), (2, 6, "running", "plan", 0.2)]), LOG)
    _add(spark, source, "c", _log([(1, 7, "running", "plan", 0.95)]), LOG)  # after its end: silent
    changes = S.run_job_changes(spark, status, feed)
    assert sorted((r.event_id, r.status) for r in changes.collect()) == [(1, "queued"), (2, "running"), (3, "queued"), (5, "done"), (6, "running")]
    stages = log().select("job_id", "event_id", "ts", "stage", "progress")
    got = {(r.job_id, r.stage): r.progress for r in S.run_stage_board(spark, stages, board).collect()}
    assert got == {(1, "plan"): 0.95, (1, "speak"): 1.0, (2, "plan"): 0.2}


def test_ended_jobs_are_forgotten(spark, tmp_path):
    """An event within ``keep`` of a job's end is silent; when the watermark is beyond, the job begins anew."""
    from datetime import datetime, timedelta

    source, feed = str(tmp_path / "in"), str(tmp_path / "feed")
    at = lambda d, h=0: datetime(2024, 1, d, h)
    provider = spark.conf.get(S.STATE_PROVIDER, None)

    def run(name, rows):
        _add(spark, source, name, rows, S.FEED)
        got = S.run_job_changes(spark, lambda own: _stream(own, source, S.FEED), feed, late="1 hour", keep=timedelta(days=2))
        return {(r.job_id, r.event_id, r.status) for r in got.collect()}

    rows = [(1, at(1), 1, "queued"), (1, at(1, 2), 2, "done"), (1, at(1, 3), 3, "running"), (2, at(1), 9, None), (2, at(1, 1), 5, "running"), (2, at(1, 2), 6, "running")]
    first = {(1, 1, "queued"), (1, 2, "done"), (2, 5, "running")}
    assert run("a", rows) == first
    second = first | {(3, 7, "queued")}
    assert run("b", [(1, at(2), 8, "running"), (3, at(2), 7, "queued")]) == second  # a day after its end: silent
    third = second | {(3, 10, "done")}
    assert run("c", [(3, at(9), 10, "done")]) == third  # moves the watermark on
    assert run("d", [(1, at(10), 11, "queued"), (3, at(10), 12, "queued")]) == third | {(1, 11, "queued")}
    assert run("e", [(4, at(3), 13, "queued")]) == third | {(1, 11, "queued")}  # before the watermark
    assert spark.conf.get(S.STATE_PROVIDER, None) == provider


def test_dedupe_reads_the_prefixes_of_its_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT", 2)
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "text string"
    known = spark.createDataFrame([], "cache_key string")
    want = set()
    for n, texts in enumerate([range(0, 60), range(40, 90), range(10, 12), range(85, 120), [5, 200], range(0, 130)]):
        _add(spark, source, str(n), [(f"chunk {i}",) for i in texts], schema)
        chunks = _stream(spark, source, schema).select("text", F.sha2("text", 256).alias("cache_key"))
        got = [r.text for r in S.run_dedupe(spark, chunks, known, out).collect()]
        want |= {f"chunk {i}" for i in texts}
        assert sorted(got) == sorted(want)
    every = S.earlier_keys(spark, out, 6, base=4)
    assert every.count() == len(want) and every.select("cache_key").distinct().count() == len(want)
    held = sorted({r.prefix for r in every.limit(3).collect()})
    files = lambda df: df.select("cache_key", "prefix", "_metadata.file_path").select("file_path").distinct().count()
    last = spark.read.schema(S.KEYS).parquet(f"{out}/keys/before=4")
    assert files(last) > 20
    some = last.where(F.col("prefix").isin(held))
    assert 0 < files(some) <= len(held)
    assert "PartitionFilters: [isnotnull(prefix" in (plan := some._jdf.queryExecution().toString()) or "PartitionFilters: [prefix" in plan
