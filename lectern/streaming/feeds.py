"""Live feeds: job changes, the current stage board, document intake, chunk dedupe.

Streams read folders of files, so each run takes what is new and stops
(``availableNow``). A run given the ``folder`` of an earlier one goes on where that
ended; without it a fresh folder is made and all is read. Sinks are files; a repeated
micro-batch overwrites its own folder, which makes every sink safe to replay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.operators.ordered import Levels, neighbour
from lectern.plans.narration import TERMINAL, work_list
from lectern.session import local_fallback, shared_folder

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEED = "job_id long, ts timestamp, event_id long, status string"
KEYS, WORKED = "cache_key string, prefix string", "cache_key string, text string"
#: Hexadecimal digits of a key that name its folder; batches after which the keys are put together.
PREFIX, COMPACT = 2, 16


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, for a stream's output and checkpoint."""
    return f"{shared_folder(spark, local_fallback(spark))}/{name}-{uuid.uuid4().hex}"


def read_new_files(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """A stream over Parquet files that match ``pattern``; the schema is fixed beforehand."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def run_once(stream: DataFrame, folder: str, mode: str, per_batch: Callable[[DataFrame, int], None]) -> None:
    """Process everything available now through ``per_batch``, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(per_batch)
        .start()
    )
    query.awaitTermination()


def _keep_batches(folder: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return write


# ---------------------------------------------------------------- job changes


def job_changes(log: DataFrame, levels: Levels) -> DataFrame:
    """Batch form: a status that differs from the one before, up to the first terminal one.

    ``log``: job_id, ts, event_id, status (and the columns of ``levels``).
    """
    order = F.struct("ts", "event_id")
    ends = log.filter(F.col("status").isin(TERMINAL)).groupBy("job_id").agg(F.min(order).alias("end"))
    seen = neighbour(log, ["job_id"], levels, F.col("status"), "previous").join(ends, "job_id", "left")
    changed = ~F.col("status").eqNullSafe(F.col("previous"))
    return seen.filter(changed & (F.col("end").isNull() | (order <= F.col("end")))).select(
        "job_id", "ts", "event_id", "status"
    )


def _change_processor(terminal: list[str], keep_ms: int) -> StatefulProcessor:
    """Defined locally, so that it travels to executors by value."""

    class ChangeFeed(StatefulProcessor):
        """State of a job: its last status, and whether it has ended.

        An ended job sets a timer; when the watermark has passed its end by ``keep_ms`` its state goes.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "status string, ended boolean")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            before, ended = self.last.get() if self.last.exists() else (None, False)
            seen = pd.concat(list(rows))  # of one job in one micro-batch; the trigger sets its size
            if ended or seen.empty:
                return
            seen = seen.sort_values(["ts", "event_id"])[["job_id", "ts", "event_id", "status"]]
            status = seen["status"].to_numpy(dtype=object)
            last = np.isin(status.astype(str), terminal)
            stop = int(last.argmax()) + 1 if last.any() else len(status)
            status = status[:stop]
            changed = status != np.concatenate([[before], status[:-1]])
            self.last.update((status[-1], bool(last.any())))
            if last.any():
                ended_at = pd.Timestamp(seen["ts"].iloc[stop - 1])
                self.handle.registerTimer(int(ended_at.timestamp() * 1000) + keep_ms)
            yield seen.iloc[:stop][changed.astype(bool)]

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            self.last.clear()
            return iter([])

        def close(self) -> None:
            pass

    return ChangeFeed()


def job_change_stream(log: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """Streaming form: the same rows, with one small state for each job that runs or has ended of late.

    The watermark follows the latest ``ts`` by ``late``; events before it are dropped. A job's state is cleared when
    the watermark is ``keep`` beyond its end, and an event that comes later still begins the job anew.
    """
    columns = ["job_id", "ts", "event_id", "status"]
    return (
        log.select(*columns)
        .withWatermark("ts", late)
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=_change_processor(list(TERMINAL), int(keep.total_seconds() * 1000)),
            outputStructType=FEED,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def run_job_changes(
    spark: SparkSession, log: Callable[[SparkSession], DataFrame], folder: str | None = None, **expiry: Any
) -> DataFrame:
    """Run the change feed over what is there and read its output back.

    ``log`` opens the stream in the session it is given: one of the feed's own, whose state store keeps timers.
    """
    folder = folder or stream_folder(spark, "job-changes")
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(STATE_PROVIDER, ROCKSDB)
    run_once(job_change_stream(log(own), **expiry), folder, "append", _keep_batches(folder))
    return spark.read.schema(FEED).parquet(f"{folder}/data/*")


# ----------------------------------------------------------------- stage board


def run_stage_board(spark: SparkSession, log: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest progress per job and stage. Batches write only changed rows; the last batch wins."""
    folder = folder or stream_folder(spark, "stage-board")
    latest = log.groupBy("job_id", "stage").agg(F.max(F.struct("ts", "event_id", "progress")).alias("last"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("job_id", "stage", "last.progress", F.lit(batch_id).alias("batch_no"))
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    run_once(latest, folder, "update", write)
    schema = "job_id long, stage string, progress double, batch_no long"
    changes = spark.read.schema(schema).parquet(f"{folder}/data/*")
    return changes.groupBy("job_id", "stage").agg(F.max_by("progress", "batch_no").alias("progress"))


# ------------------------------------------------------------- document intake


def run_intake(
    spark: SparkSession, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> DataFrame:
    """Run the batch ingest functions on new documents; they are narrow, so no state is kept."""
    folder = folder or stream_folder(spark, "intake")
    prepared = prepare(stream)
    schema = prepared.schema
    run_once(prepared, folder, "append", _keep_batches(folder))
    return spark.read.schema(schema).parquet(f"{folder}/data/*")


# ----------------------------------------------------------------- chunk dedupe


def _prefix(key: Column) -> Column:
    return F.substring(key, 1, PREFIX)


def _write_keys(rows: DataFrame, folder: str) -> None:
    """Keys alone, a folder for each prefix."""
    keys = rows.select("cache_key", _prefix(F.col("cache_key")).alias("prefix"))
    keys.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)


def earlier_keys(
    spark: SparkSession, folder: str, batch_id: int, prefixes: list[str] | None = None, base: int | None = None
) -> DataFrame:
    """(cache_key, prefix) of all batches before ``batch_id``; only files of the ``prefixes`` are read.

    Every ``COMPACT`` batches the keys of all batches before are put together (``base``), so that a prefix has one
    folder there and one for each batch since.
    """
    base = batch_id // COMPACT * COMPACT if base is None else base
    folders = [f"{folder}/keys/before={base}"] * (base > 0) + [f"{folder}/keys/batch={n}" for n in range(base, batch_id)]
    out = spark.createDataFrame([], KEYS)
    for one in folders:
        keys = spark.read.schema(KEYS).option("basePath", one).parquet(one)
        out = out.unionByName(keys if prefixes is None else keys.where(F.col("prefix").isin(prefixes)))
    return out


def run_dedupe(spark: SparkSession, chunks: DataFrame, known: DataFrame, folder: str | None = None) -> DataFrame:
    """Each key is worked once over all batches: anti-join with the keys of earlier batches, then once per batch.

    The keys put out are the memory, so no unbounded stream state is needed. They lie by prefix, and a batch reads
    the prefixes that it holds. A replayed batch overwrites its own keys and output and reads those before it alone.
    """
    folder = folder or stream_folder(spark, "chunk-dedupe")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id and batch_id % COMPACT == 0:
            _write_keys(earlier_keys(session, folder, batch_id, base=batch_id - COMPACT), f"{folder}/keys/before={batch_id}")
        batch = batch.persist()
        try:
            held = [r[0] for r in batch.select(_prefix(F.col("cache_key"))).distinct().collect() if r[0] is not None]  # 16 ** PREFIX at most
            done = known.select("cache_key").unionByName(earlier_keys(session, folder, batch_id, held).select("cache_key"))
            work_list(batch, done).write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")
        finally:
            batch.unpersist()
        _write_keys(session.read.schema(WORKED).parquet(f"{folder}/data/batch={batch_id}"), f"{folder}/keys/batch={batch_id}")

    run_once(chunks, folder, "append", write)
    return spark.read.schema(WORKED).parquet(f"{folder}/data/*")
