"""Quality rules whose cutoffs are certified on labelled documents.

Counts of a text are expressions over its words and lines. For each stratum and
rule the cutoffs of a grid are tested from lenient to strict, as long as the exact
binomial probability of so few rejected good documents, were the true share of
false rejections at its limit, stays below the error level. The level is divided
by the number of strata and rules (Bonferroni); inside one rule the fixed order of
tests needs no further correction. The limit is divided by the number of rules, so
that all rules together reject at most ``risk`` of the good documents of a stratum,
with probability ``1 - error`` over all strata at once.

Only functions of the engine are used. What is compared are whole thousandths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GAPS, WORD_GAP, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Strata with thresholds of their own; further values of the column share one stratum.
MAX_STRATA = 63
OTHER = "(other)"


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * value / base is above the cutoff (below it, with ``below``)."""

    name: str
    value: str
    base: str
    cutoffs: tuple[int, ...]  # from lenient to strict
    below: bool = False


SHARES = (700, 500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20, 10, 5)
RULES = (
    Rule("symbols", "n_symbols", "word_chars", SHARES),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", SHARES),
    Rule("repeated_words", "n_repeat_words", "n_words", SHARES),
    Rule("long_words", "word_chars", "n_words", (30000, 20000, 15000, 12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500, 7000)),
    Rule("short_words", "word_chars", "n_words", (1200, 1500, 2000, 2500, 3000, 3500, 4000), below=True),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(docs: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """``keep`` and the counts of each text; a null text has none of anything."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    without = lambda signs: F.length(F.translate(t, signs, ""))
    solid = F.btrim(t, F.lit(GAPS))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    df = docs.select(
        *keep,
        F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, WORD_GAP, -1)).alias("__w"),
        lines.alias("__l"),
        without(GAPS).cast("bigint").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
    )
    n = F.size("__w")
    gram = lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])
    df = df.select(
        *keep, "word_chars", "n_symbols", n.cast("bigint").alias("n_words"),
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), gram)).alias("__g"),
    )
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    df = df.withColumn(
        "__s", F.when(some, F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    hash_at = lambda j: F.get("__s", j)["h"]
    twice = F.filter(
        F.sequence(F.lit(0), F.size("__s") - 1),
        lambda j: ((j > 0) & (hash_at(j) == hash_at(F.greatest(j - 1, F.lit(0)))))
        | F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False)),
    )
    df = df.withColumn(
        "__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.transform(twice, lambda j: F.get("__s", j)["i"])))
    )
    step = lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get("__p", F.greatest(k - 1, F.lit(0)))))  # noqa: E731, E501
    covered = F.aggregate(F.transform("__p", step), F.lit(0), lambda a, b: a + b)
    return df.select(*keep, *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(rule: Rule) -> Column:
    """Thousandths, null where the base is 0: the rule then keeps."""
    return F.floor(1000 * F.col(rule.value) / F.nullif(F.col(rule.base), F.lit(0)))


def hits(rule: Rule, cutoff: Column) -> Column:
    return measure(rule) < cutoff if rule.below else measure(rule) > cutoff


def log_gamma(x: Column) -> Column:
    """Of whole x >= 1: a table below 16, from there the Stirling series (relative error under 1e-12)."""
    table = F.array(*[F.lit(math.lgamma(i)) for i in range(1, 17)])
    y = x.cast("double")
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return F.when(x <= 16, F.get(table, x.cast("int") - 1)).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials with chance p, for k below n * p; 1 above it.

    The terms fall from k downwards; they are added over ten standard deviations.
    """
    log_top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 + 10 * F.sqrt(n * p))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), start, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def thresholds(good: DataFrame, stratum: str, risk: float, error: float, n_strata: int) -> DataFrame:
    """(stratum, cutoffs: map of rule to the strictest certified cutoff) from counts of good documents.

    The table has at most ``MAX_STRATA`` + 1 rows.
    """
    def passes(rule: Rule) -> Column:  # how many cutoffs, from lenient on, let the document pass
        return F.size(F.filter(F.lit(list(rule.cutoffs)), lambda c: ~F.coalesce(hits(rule, c), F.lit(False))))

    place = [F.struct(F.lit(r.name).alias("rule"), passes(r).alias("passes")) for r in RULES]
    placed = good.select(F.col(stratum).alias("stratum"), F.inline(F.array(*place))).groupBy("stratum", "rule", "passes").agg(F.count("*").alias("n"))
    totals = placed.groupBy("stratum", "rule").agg(F.sum("n").alias("n"))
    grid = F.create_map(*[x for r in RULES for x in (F.lit(r.name), F.lit(list(r.cutoffs)))])
    tests = totals.select("*", F.posexplode(grid[F.col("rule")]).alias("at", "cutoff"))
    rejected = placed.withColumnsRenamed({"n": "m"}).join(tests, ["stratum", "rule"]).where("passes <= at").groupBy("stratum", "rule", "at").agg(F.sum("m").alias("k"))
    tested = tests.join(rejected, ["stratum", "rule", "at"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    level = error / (max(1, n_strata) * len(RULES))
    passed = tested.where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= level)
    return (
        passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", "at").alias("cutoff"))
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, stratum, base_failed, kept of every row of ``docs``.

    ``labels``: doc_id and label (1: good); a repeated id is good if one of its labels is. Rows with a null
    id or label certify nothing. A stratum without certified cutoffs keeps whatever passes the base rules;
    so does an empty table of labels.
    """
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("__own"), "text")
    counts = stored(counted(rows, ["doc_id", "__own"], F.col("text")), "rules-counts")
    marked = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    good = counts.join(marked.where("label = 1").select("doc_id"), "doc_id")
    common = good.where("__own is not null").groupBy("__own").count().orderBy(F.desc("count"), "__own").limit(MAX_STRATA)
    names = [r[0] for r in common.collect()]
    name = F.when(F.col("__own").isin(names), F.col("__own")).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)
    found = thresholds(good.withColumn("stratum", name), "stratum", risk, error, len(names) + 1)
    whole = counts.withColumn("stratum", name).withColumn("base_failed", base_failed())
    joined = whole.join(F.broadcast(found), "stratum", "left")  # at most MAX_STRATA + 1 rows
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(hits(r, F.col("cutoffs")[r.name]), F.lit(False))
    return joined.select("doc_id", *COUNTS, "stratum", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
