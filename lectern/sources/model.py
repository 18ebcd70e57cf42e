"""The catalog tables as views over the given star-schema and event tables.

Customers stand for books, orders for chapters and for jobs, line items for
segments and artifacts, events for the stage log, suppliers for voices, labels
for lexicon entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; zone-less timestamps are taken as instants, as the catalog keeps them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def choose(column: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("book_id"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("author"),
        choose(
            F.col("c_mktsegment"),
            {"BUILDING": "en", "AUTOMOBILE": "de", "MACHINERY": "pl", "HOUSEHOLD": "zh"},
            "fr",
        ).alias("language"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("/covers/"), F.col("c_custkey"), F.lit(".jpg"))).alias(
            "cover_path"
        ),
        F.lit("txt").alias("source_format"),
        F.timestamp_seconds(F.lit(EPOCH) + cents(F.col("c_acctbal"))).alias("created_at"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("chapter_id"),
        F.col("o_custkey").alias("book_id"),
        F.col("o_orderdate").alias("placed_on"),
        F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_orderkey")).alias("title"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
    )


# Reading order of chapters in a book, and of segments in a chapter, coarse to fine.
CHAPTER_LEVELS = [["placed_on"], ["chapter_id"]]
SEGMENT_LEVELS = [["l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("chapter_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" of lot "), F.col("l_suppkey")).alias("text"),
        F.when(F.col("l_tax") < 0.08, F.col("l_quantity")).alias("duration_s"),
        choose(F.col("l_returnflag"), {"A": "done", "N": "queued", "R": "failed"}).alias("status"),
        (F.col("l_linenumber") == 7).alias("last_of_block"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    status = (
        F.when((F.col("o_orderstatus") == "F") & urgent, "failed")
        .when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "P", "running")
        .when(low, "cancelled")
        .otherwise("queued")
    )
    started = F.when(
        status != "queued", F.timestamp_micros(F.unix_micros("o_orderdate") + cents(F.col("o_totalprice")) * 1000)
    )
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("book_id"),
        status.alias("status"),
        choose(
            F.col("o_orderpriority"),
            {
                "1-URGENT": "af_heart",
                "2-HIGH": "zf_xiaobei",
                "3-MEDIUM": "pl_PL-gosia-medium",
                "4-NOT SPECIFIED": "de_DE-thorsten-high",
            },
            "xx_missing",
        ).alias("voice"),
        F.lit(1.0).alias("speed"),
        choose(
            F.col("o_orderpriority"),
            {"1-URGENT": "m4b, mp3", "2-HIGH": "srt,,vtt ", "3-MEDIUM": "", "4-NOT SPECIFIED": "mp4,ogg"},
            "chapters",
        ).alias("formats"),
        choose(F.col("o_orderstatus"), {"P": "static", "O": "waveform"}, "spin").alias("video_style"),
        F.col("o_orderdate").alias("created_at"),
        started.alias("started_at"),
        F.when(
            status.isin("done", "failed"),
            F.timestamp_micros(F.unix_micros("o_orderdate") + cents(F.col("o_totalprice")) * 3000),
        ).alias("finished_at"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    kind = choose(F.col("l_returnflag"), {"A": "mp3", "N": "mp4", "R": "srt"})
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        kind.alias("format"),
        F.concat(F.lit("/out/"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey"), F.lit("."), kind).alias("path"),
        F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")).alias("part_index"),
    )


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return stage_columns(e)


def stage_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id"),
        F.col("user_id").alias("job_id"),
        "ts",
        choose(
            F.col("event_type"),
            {"signup": "prepare", "view": "synthesize", "click": "assemble", "purchase": "master"},
            "export",
        ).alias("stage"),
        F.least(F.round(F.col("value")) / 100, F.lit(1.0)).alias("progress"),
    )


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(
        F.concat(
            F.substring(F.lit("abefhijpzq"), F.col("s_nationkey") % 10 + 1, F.lit(1)),
            F.when(F.col("s_acctbal") < 0, "n").when(F.col("s_acctbal") < 5000, "f").otherwise("m"),
            F.lit("_"),
            F.col("s_name"),
        ).alias("voice_id"),
        F.when(F.col("s_acctbal") < 3000, "piper").otherwise("kokoro").alias("engine"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries for each labelled document."""
    rows = read(spark, sf_dir, "labels")
    entries = F.array(
        F.struct(
            F.lit(1).alias("entry"), F.lit("the ").alias("pattern"), F.lit("thee ").alias("replacement"),
            F.lit(False).alias("is_regex"), (F.col("quality") == 1).alias("enabled"),
        ),
        F.struct(
            F.lit(2).alias("entry"), F.lit("([aeiou])nt").alias("pattern"), F.lit("\\1mt").alias("replacement"),
            F.lit(True).alias("is_regex"), (F.col("toxic") == 0).alias("enabled"),
        ),
        F.struct(
            F.lit(3).alias("entry"), F.lit(".").alias("pattern"), F.lit(" $.").alias("replacement"),
            F.lit(False).alias("is_regex"), (F.col("quality") == 0).alias("enabled"),
        ),
    )
    return rows.select(F.col("doc_id").alias("book_id"), F.inline(entries))
