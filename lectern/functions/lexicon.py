r"""User pronunciation rules as data: literal or regex substitutions, in order.

Rules are written for Python's regular expressions and run by the engine's. They are
translated, and checked against the engine itself before use: a rule that cannot be run
is set aside with its reason and never reaches the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes and character classes, which hide brackets and parentheses from the rules below.
HIDDEN = r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]"
NAMED = r"\(\?P?<([A-Za-z][A-Za-z0-9]*)>"


def java_pattern(pattern: Column) -> Column:
    r"""Unicode classes, ``(?P<name>…)`` groups, ``(?P=name)``, ``\Z`` and ``&&`` as the engine writes them."""
    out = F.replace(pattern, F.lit("(?P<"), F.lit("(?<"))
    out = F.regexp_replace(out, r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<$1>")
    out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\Z", r"$1\\z")
    return F.concat(F.lit("(?U)"), F.replace(out, F.lit("&&"), F.lit("&\\&")))


def java_replacement(replacement: Column) -> Column:
    r"""``\1``, ``\g<1>``, ``\g<name>`` and the escapes ``\n \t \r \\``; a dollar sign stands for itself."""
    kept = "\x01"  # an escaped backslash, while the others are read
    text = F.replace(replacement, F.lit("\\\\"), F.lit(kept))
    text = F.replace(text, F.lit("$"), F.lit("\\$"))
    text = F.regexp_replace(text, r"\\g<([0-9]+)>", "\\$$1")
    text = F.regexp_replace(text, r"\\g<([A-Za-z][A-Za-z0-9]*)>", "\\${$1}")
    text = F.regexp_replace(text, r"\\([1-9][0-9]?)", "\\$$1")
    for name, sign in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        text = F.replace(text, F.lit("\\" + name), F.lit(sign))
    return F.replace(text, F.lit(kept), F.lit("\\\\"))


def _pattern_error(pattern: Column) -> Column:
    bare = F.regexp_replace(pattern, r"\\.", "")
    # The engine reads a bracket inside a class as a class of its own.
    nested = bare.rlike(r"\[\^?\]?[^\]]*\[")
    runs = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java_pattern(pattern)).isNotNull()
    return nested | ~runs


def _replacement_error(pattern: Column, replacement: Column) -> Column:
    """Back-references to groups that the pattern lacks, and escapes that mean nothing."""
    shown = F.regexp_replace(pattern, HIDDEN, "")
    groups = F.regexp_count(shown, F.lit(r"\((?!\?)|\(\?P?<(?![=!])"))
    names = F.regexp_extract_all(shown, F.lit(NAMED), F.lit(1))
    text = F.replace(replacement, F.lit("\\\\"), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"\\(?:g<)?([0-9]+)"), F.lit(1))
    wanted = F.regexp_extract_all(text, F.lit(r"\\g<([^0-9>][^>]*)>"), F.lit(1))
    missing = F.exists(numbers, lambda n: (F.length(n) > 2) | (F.try_to_number(n, F.lit("999")) > groups))
    zero = text.rlike(r"\\0")
    unnamed = F.exists(wanted, lambda n: ~F.array_contains(names, n))
    rest = F.regexp_replace(text, r"\\(?:[1-9][0-9]?|g<[A-Za-z0-9]+>|[ntr])", "")
    return missing | zero | unnamed | rest.contains("\\")


def rule_error(is_regex: Column, pattern: Column, replacement: Column) -> Column:
    """Why a rule cannot be run, null if it can. A missing pattern or replacement is an error as well."""
    bad = F.coalesce(_pattern_error(pattern), F.lit(True))
    wrong = F.coalesce(_replacement_error(pattern, replacement), F.lit(True))
    return (
        F.when(pattern.isNull() | replacement.isNull(), F.lit("incomplete rule"))
        .when(is_regex & bad, F.concat(F.lit("invalid regex: "), pattern))
        .when(is_regex & wrong, F.concat(F.lit("invalid replacement: "), replacement))
    )


def with_errors(entries: DataFrame) -> DataFrame:
    """Entries with ``error`` (null where the rule can be run)."""
    error = rule_error(F.col("is_regex"), F.col("pattern"), F.col("replacement"))
    return entries.drop("error").withColumn("error", error)


def entry_lists(entries: DataFrame) -> DataFrame:
    """Enabled entries of each book that can be run, as one ordered array; a lexicon is written by hand, so it is short."""
    rule = F.struct(
        "entry", "is_regex",
        F.when(F.col("is_regex"), java_pattern(F.col("pattern"))).otherwise(F.col("pattern")).alias("pattern"),
        F.when(F.col("is_regex"), java_replacement(F.col("replacement"))).otherwise(F.col("replacement")).alias("replacement"),
    )
    sound = with_errors(entries.filter("enabled")).filter("error IS NULL")
    return sound.groupBy("book_id").agg(F.array_sort(F.collect_list(rule)).alias("lexicon"))


def apply_lexicon(text: Column, lexicon: Column) -> Column:
    def substitute(t: Column, e: Column) -> Column:
        by_regex = F.regexp_replace(t, e["pattern"], e["replacement"])
        return F.when(e["is_regex"], by_regex).otherwise(F.replace(t, e["pattern"], e["replacement"]))

    return F.when(lexicon.isNull(), text).otherwise(F.aggregate(lexicon, text, substitute))


def with_lexicon(books: DataFrame, entries: DataFrame) -> DataFrame:
    """Books with their rule array (null if none). Books stay where they are: only lists move."""
    return books.join(entry_lists(entries), "book_id", "left")
