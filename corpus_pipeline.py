"""From documents to packed training windows, in five stages.

Each stage takes all that its predecessor kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text. Rows with a null text or doc_id pass the
filters that have nothing to hold against them.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lines, ngrams, packing, passages, quality
from lectern.llm.common import GAPS, small_batches, stored, table
from lectern.llm.queries import trains_quality

ORACLE_SQL = None  # no stage but the fourth can be said in SQL; tests compare each with a brute-force version


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.classified(docs, labels, trains_quality())
    return scored.where("quality_score >= 0.5").select(*docs.columns)


def _shortened(docs: DataFrame, cut: DataFrame, removed: str) -> DataFrame:
    """Texts after a stage that cuts; a document of which nothing is left goes."""
    empty = F.btrim(F.col("text"), F.lit(GAPS)) == ""
    left = cut.where(~((F.col(removed) > 0) & empty))
    new = {"n_chars": F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")}
    return left.select(*[new.get(c, F.col(c)) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks of lines go from the later of two overlapping documents."""
    return _shortened(docs, lines.deduplicated(docs, "__total", "__removed"), "__removed")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles the one with the smallest id stays: five words, Jaccard 0.8 or more."""
    return ngrams.one_of_each(docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the document with the smallest id."""
    return _shortened(docs, passages.deduplicated(docs, total="__total", removed="__removed"), "__removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens, with their ids."""
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), words=200_000)  # workers hold those of earlier stages too
    return rows.withColumn("ids_crc32", F.crc32("ids"))


def _bounded(stage):
    """The stage with small batches between the engine and its Python workers, which go on from stage to stage."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _bounded(keep_quality)),
    ("lines", _bounded(drop_repeated_lines)),
    ("near_duplicates", _bounded(keep_one_of_each_group)),
    ("passages", _bounded(drop_repeated_passages)),
    ("packing", _bounded(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
