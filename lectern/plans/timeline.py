"""Durations laid out on a timeline: starts, chapter markers, size-limited parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import Levels, neighbour, row_numbers, running_sums
from lectern.session import cut_lineage

# ---------------------------------------------------------------- fixed values
PAUSE_SENTENCE_S = 0.35
PAUSE_PARAGRAPH_S = 0.6
PAUSE_CHAPTER_S = 1.2
PART_LIMIT_S = 42300.0  # 11 h 45 min
# ------------------------------------------------------------ end fixed values

# Jobs with more chapters than this are split by pointer doubling, not in one row.
FOLD_LIMIT = 20000


def pause_samples(pause_s: Column, rate: Column) -> Column:
    return F.when(pause_s > 0, F.bround(pause_s * rate).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def assemble(segments: DataFrame, keys: list[str], levels: Levels, sums: dict[str, Column] | None = None) -> DataFrame:
    """Start and duration of each segment, counted in whole samples; ``sums`` are summed along.

    Needs ``samples``, ``sample_rate`` and ``pause_after_s``. Integers are summed,
    so the result does not depend on the order of partial sums.
    """
    length = F.col("samples") + pause_samples(F.col("pause_after_s"), F.col("sample_rate"))
    timed = running_sums(segments, keys, levels, {"cursor": length, **(sums or {})})
    return timed.withColumns(
        {"start_s": F.col("cursor") / F.col("sample_rate"), "duration_s": F.col("samples") / F.col("sample_rate")}
    ).drop("cursor")


def mixed_rates(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose segments do not share one sample rate."""
    rates = segments.groupBy(*keys).agg(F.min("sample_rate").alias("low"), F.max("sample_rate").alias("high"))
    return rates.filter("low <> high")


def total_durations(segments: DataFrame, keys: list[str]) -> DataFrame:
    length = F.col("samples") + pause_samples(F.col("pause_after_s"), F.col("sample_rate"))
    return segments.groupBy(*keys).agg((F.sum(length) / F.max("sample_rate")).alias("total_s"))


def chapter_markers(timed: DataFrame, chapter_columns: list[str], levels: Levels) -> DataFrame:
    """One marker per chapter with segments, up to the next chapter's start.

    ``timed`` has job_id, ``chapter_columns``, start_s and duration_s; the last
    chapter ends with its last segment.
    """
    spans = timed.groupBy("job_id", *chapter_columns).agg(
        F.min("start_s").alias("start_s"),
        F.max(F.col("start_s") + F.coalesce("duration_s", F.lit(0.0))).alias("own_end_s"),
    )
    # One row per chapter; kept, because finding the next chapter reads it again.
    following = neighbour(cut_lineage(spans), ["job_id"], levels, F.col("start_s"), "next_start_s", ahead=True)
    return following.withColumn("end_s", F.coalesce("next_start_s", "own_end_s")).drop("own_end_s", "next_start_s")


# ------------------------------------------------------------------------ parts


def split_into_parts(markers: DataFrame, limit_s: float = PART_LIMIT_S, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Add ``part_index`` (from 1): chapters are packed until the next one passes the limit.

    ``markers`` has job_id, idx (0, 1, … inside the job), start_s and end_s. The
    greedy rule is sequential. Jobs of ordinary size fold over their markers
    inside one row; larger jobs use pointer doubling, which takes the same
    decisions, to the last bit, without gathering the job anywhere.
    """
    markers = cut_lineage(markers.withColumn("idx", F.col("idx").cast("bigint")))
    sizes = markers.groupBy("job_id").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > fold_limit).select("job_id")
    if not large.take(1):
        return _fold_parts(markers, limit_s)
    small = markers.join(large, "job_id", "left_anti")
    rest = markers.join(large, "job_id", "left_semi")
    return _fold_parts(small, limit_s).unionByName(_jump_parts(rest, limit_s))


def _fold_parts(markers: DataFrame, limit_s: float) -> DataFrame:
    others = [c for c in markers.columns if c not in ("job_id", "idx")]
    jobs = markers.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", *others))).alias("spans"))

    def place(state: Column, marker: Column) -> Column:
        opens = state["started"].isNull() | (marker["end_s"] - state["started"] > limit_s)
        return F.struct(
            F.when(opens, marker["start_s"]).otherwise(state["started"]).alias("started"),
            F.when(opens, F.array_append(state["firsts"], marker["idx"])).otherwise(state["firsts"]).alias("firsts"),
        )

    empty = F.struct(F.lit(None).cast("double").alias("started"), F.array().cast("array<bigint>").alias("firsts"))
    split = jobs.withColumn("firsts", F.aggregate("spans", empty, place, lambda s: s["firsts"]))
    parts = split.select("job_id", "spans", "firsts", F.posexplode("firsts").alias("part", "first"))
    after = F.coalesce(F.get("firsts", F.col("part") + 1), F.size("spans").cast("bigint"))
    members = F.slice("spans", F.col("first").cast("int") + 1, (after - F.col("first")).cast("int"))
    return parts.select("job_id", F.inline(members), (F.col("part") + 1).cast("bigint").alias("part_index")).select(
        *markers.columns, "part_index"
    )


def _latest_end(start_s: Column, limit_s: float) -> Column:
    """The largest number whose distance to the start, as floating point subtracts it, is within the limit.

    ``start + limit`` is rounded and may be a unit or two in the last place off, so its neighbours are tried:
    comparing ends with this number is then the same as comparing ``end - start`` with the limit.
    """
    near = start_s + F.lit(float(limit_s))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(near), F.lit(1e-300)))) - 52)
    tries = F.array(*[near + k * unit for k in range(-3, 4)])
    return F.coalesce(F.array_max(F.filter(tries, lambda x: x - start_s <= limit_s)), near)


def _number_parts(markers: DataFrame, flags: DataFrame) -> DataFrame:
    marked = markers.join(flags, ["job_id", "idx"], "left").withColumn("slab", F.floor(F.col("idx") / 4096))
    opens = F.coalesce("opens", F.lit(0)).cast("bigint")
    out = running_sums(marked, ["job_id"], [["slab"], ["idx"]], {"before": opens})
    return out.withColumn("part_index", F.col("before") + opens).drop("before", "opens", "slab")


def _jump_parts(markers: DataFrame, limit_s: float) -> DataFrame:
    """Each chapter points to the first chapter of the part after its own, were it
    to open one. The openers are what chapter 0 reaches; hops double every round."""
    spans = markers.select("job_id", "idx", "start_s", "end_s")
    ends = spans.select("job_id", F.col("end_s").alias("at"), F.lit(0).alias("kind"), "idx")
    asks = spans.select("job_id", _latest_end(F.col("start_s"), limit_s).alias("at"), F.lit(1).alias("kind"), "idx")
    line = ends.unionByName(asks).withColumn("slab", F.floor(F.col("at") / 600))
    is_end = F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")
    counted = running_sums(line, ["job_id"], [["slab"], ["at", "kind", "idx"]], {"reach": is_end})
    hops = (
        counted.filter("kind = 1")
        .select("job_id", "idx", F.greatest(F.col("idx") + 1, F.col("reach")).alias("next"))
        .join(spans.select("job_id", F.col("idx").alias("next")), ["job_id", "next"], "left_semi")
    )
    hops = cut_lineage(hops)
    reached = cut_lineage(spans.filter("idx = 0").select("job_id", "idx"))
    while hops.take(1):
        further = reached.join(hops, ["job_id", "idx"]).select("job_id", F.col("next").alias("idx"))
        reached = cut_lineage(reached.unionByName(further).distinct())
        second = hops.select("job_id", F.col("idx").alias("next"), F.col("next").alias("after"))
        hops = cut_lineage(
            hops.join(second, ["job_id", "next"]).select("job_id", "idx", F.col("after").alias("next"))
        )
    return _number_parts(markers, reached.withColumn("opens", F.lit(1)))


def part_spans(parted: DataFrame) -> DataFrame:
    return parted.groupBy("job_id", "part_index").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("chapters")
    )


def rebase(parted: DataFrame) -> DataFrame:
    """Markers counted from their own part's start."""
    origin = part_spans(parted).select("job_id", "part_index", F.col("start_s").alias("origin_s"))
    return (
        parted.join(origin, ["job_id", "part_index"])
        .withColumns({"start_s": F.col("start_s") - F.col("origin_s"), "end_s": F.col("end_s") - F.col("origin_s")})
        .drop("origin_s")
    )


def frame_range(start_s: Column, end_s: Column, rate: Column, frames: Column) -> tuple[Column, Column]:
    """First frame and number of frames of a cut, clamped to the track."""
    first = F.greatest(F.lit(0).cast("bigint"), F.bround(start_s * rate).cast("bigint"))
    last = F.least(frames, F.bround(end_s * rate).cast("bigint"))
    return first, F.greatest(F.lit(0).cast("bigint"), last - first)


def number_markers(markers: DataFrame, levels: Levels) -> DataFrame:
    return row_numbers(markers, ["job_id"], levels, "idx")
