"""Language of a document: sample, trigram model, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import strip
from lectern.operators.ordered import Levels, running_sums
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
SAMPLE_CHARS = 800
MIN_CHARS = 20
UNKNOWN = ["", "und"]
DEFAULT_LANGUAGE = "en"
# ------------------------------------------------------------ end fixed values

# A model of up to this many rows (about 100 MB) is sent to every executor.
BROADCAST_ROWS = 1000000

SCALE = 1000000  # log weights are summed as whole numbers, so sums do not depend on order


def language_sample(blocks: DataFrame, key: str, levels: Levels, limit: int = SAMPLE_CHARS) -> DataFrame:
    """Leading blocks of each document up to ``limit`` characters, joined by a blank.

    Only blocks that begin inside the limit are gathered, so a group stays small
    whatever the document's length; blocks must not be empty.
    """
    length = F.length("text").cast("bigint")
    counted = running_sums(blocks, [key], levels, {"seen": length}).filter(F.col("seen") < limit)
    order = [c for level in levels for c in level]
    gathered = counted.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("parts"), F.sum(length).alias("total")
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    cut = F.when(F.col("total") >= limit, F.left(joined, F.lit(limit))).otherwise(joined)
    return gathered.select(key, cut.alias("sample"))


def sample_of(blocks: Column, limit: int = SAMPLE_CHARS) -> Column:
    """The same sample where a document's blocks are an array of its own row."""
    total = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b))
    joined = F.array_join(blocks, " ")
    return F.when(total >= limit, F.left(joined, F.lit(limit))).otherwise(joined)


def trigrams(text: Column) -> Column:
    """All overlapping runs of three characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def train(labelled: DataFrame) -> DataFrame:
    """Trigram weights per language from rows (language, sample).

    Columns: language, gram, weight (over an unseen gram), base (of an unseen gram).
    """
    grams = labelled.select("language", F.explode(trigrams(F.col("sample"))).alias("gram"))
    counts = grams.groupBy("language", "gram").agg(F.count("*").alias("n"))
    totals = counts.groupBy("language").agg((F.sum("n") + F.count("*")).alias("total"))
    scaled = totals.withColumn("base", F.round(-F.log(F.col("total")) * SCALE).cast("bigint"))
    return counts.join(scaled, "language").select(
        "language", "gram", F.round(F.log(F.col("n") + 1) * SCALE).cast("bigint").alias("weight"), "base"
    )


def detect(samples: DataFrame, model: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Most likely language per row (key, sample); null under 20 characters or without known grams.

    A language none of whose grams occur is no candidate. The model's size is
    checked: a small one goes to the grams, and only the sums move. Otherwise
    each document's grams are counted first and then meet the model in a shuffle.
    """
    model = cut_lineage(model)
    text = strip(F.col("sample"))
    usable = samples.filter(F.length(text) >= MIN_CHARS)
    grams = usable.select(key, F.explode(trigrams(text)).alias("gram"))
    if model.count() <= broadcast_rows:
        met = grams.withColumn("n", F.lit(1)).join(F.broadcast(model), "gram")
    else:
        met = grams.groupBy(key, "gram").agg(F.count("*").alias("n")).join(model, "gram")
    hits = met.groupBy(key, "language").agg(
        F.sum(F.col("n") * F.col("weight")).alias("fit"), F.max("base").alias("base")
    )
    # Sizes are taken beside the explode: above it they would be computed for every gram.
    sizes = usable.select(key, F.greatest(F.length(F.lower(text)) - 2, F.lit(0)).alias("size"))
    scored = hits.join(sizes, key).withColumn("score", F.col("fit") + F.col("base") * F.col("size"))
    best = scored.groupBy(key).agg(F.max_by("language", F.struct("score", "language")).alias("detected"))
    return samples.select(key).join(best, key, "left")


def resolve(language: Column, detected: Column) -> Column:
    """The declared language unless it is unknown, then the detected one, then English."""
    declared = F.when(~language.isin(UNKNOWN), language)
    return F.coalesce(declared, detected, F.lit(DEFAULT_LANGUAGE))
