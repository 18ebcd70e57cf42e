"""Column helpers for text: binding, regex callbacks, Unicode trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      "
    "          　"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    A rule that mentions its input twice doubles the expression at every link of
    a chain; the one-element transform keeps the chain linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def scan(
    items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column], value: Callable[[Column, Column], Column]
) -> Column:
    """Walk an array with a state, by ``step`` of state and item; the ``value`` of each next state and item, nulls left out.

    Appending copies an array, so the walk goes in slices as long as the root of the array: values, of type
    ``kind``, are appended to their slice's array, and that to the array of slices.
    """

    def inside(state: Column, part: Column) -> Column:
        def one(at: Column, item: Column) -> Column:
            grown = lambda v: F.when(v.isNotNull(), F.array_append(at["out"], v)).otherwise(at["out"])
            return bind(
                step(at["state"], item), lambda now: F.struct(now.alias("state"), bind(value(now, item), grown).alias("out"))
            )

        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def walk(all_items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_items))).cast("int"), F.lit(1))
        first = F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), width)
        parts = F.transform(first, lambda i: F.slice(all_items, i, width))
        return F.aggregate(
            parts,
            F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda at, part: bind(
                inside(at["state"], part),
                lambda r: F.struct(r["state"].alias("state"), F.array_append(at["out"], r["out"]).alias("out")),
            ),
            lambda at: F.flatten(at["out"]),
        )

    return bind(items, walk)


SEPARATOR = "\x1e"


def regex_split(text: Column, pattern: str) -> Column:
    """Pieces between the matches of ``pattern``.

    ``split`` compiles its pattern for every row, ``regexp_replace`` once per
    task; so matches become one separator character, unless the text has it.
    """
    quick = F.split(F.regexp_replace(text, pattern, SEPARATOR), SEPARATOR, -1)
    return F.when(text.contains(SEPARATOR), F.split(text, pattern, -1)).otherwise(quick)


def regex_transform(
    value: Column, pattern: str, body: Callable[[Column], Column], hint: str | None = None
) -> Column:
    """Replace every match of ``pattern`` by ``body(match)``; all JVM-side.

    One pass marks the matches, so that gaps and matches alternate; a text that has the separator itself is
    read twice. ``hint`` is a cheaper pattern that every text with a match contains; texts without it are
    passed on at once.
    """

    def step(text: Column) -> Column:
        marked = F.regexp_replace(text, pattern, SEPARATOR + "$0" + SEPARATOR)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.array(gap, hit))
        pieces = F.when(text.contains(SEPARATOR), F.flatten(pairs)).otherwise(F.split(marked, SEPARATOR, -1))
        read = lambda piece, at: F.when(at % 2 == 0, piece).when(piece.isNotNull(), body(piece))
        return F.when(text.rlike(hint or pattern), F.array_join(F.transform(pieces, read), "")).otherwise(text)

    return bind(value, step)


def word_count(value: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(value, F.lit(r"(?U)\S+")).cast("bigint")


def excerpt(value: Column, limit: int, keep: int, tail: str) -> Column:
    """``value`` unless longer than ``limit``; then its first ``keep`` characters and ``tail``."""
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.substring(value, 1, keep), F.lit(tail))
    )
