"""Sentence split and greedy chunk packing, inside one row and without UDFs.

The splitter is rule-based: a run of terminators, its closing quotes or brackets,
then white space ends a sentence. A single capital initial does not. Chinese full
stops end a sentence with or without white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.strings import bind, strip

# ---------------------------------------------------------------- fixed values
MAX_CHARS = 350
NO_SPACE_LANGUAGES = ["zh"]
# ------------------------------------------------------------ end fixed values

BREAK, INITIAL_DOT = "\x1e", "\x1d"
CLOSERS = "[\"'”’»)\\]」』）]*"
LATIN_END = "([.!?…]+" + CLOSERS + ")[ \t\r\n]+"
CHINESE_END = "([。！？!?]+" + CLOSERS + ")[ \t\r\n]*"
INITIAL = "(^|[ \t\r\n])([A-Z])[.]([ \t\r\n])"


def split_sentences(text: Column, language: Column) -> Column:
    """Array of trimmed, non-empty sentences in order; their text is unchanged."""

    def latin(t: Column) -> Column:
        for _ in range(2):  # neighbouring initials share their separating blank
            t = F.regexp_replace(t, INITIAL, "$1$2" + INITIAL_DOT + "$3")
        return F.regexp_replace(t, LATIN_END, "$1" + BREAK)

    def chinese(t: Column) -> Column:
        return F.regexp_replace(t, CHINESE_END, "$1" + BREAK)

    def split(t: Column) -> Column:
        marked = F.when(language.isin(NO_SPACE_LANGUAGES), chinese(t)).otherwise(latin(t))
        pieces = F.split(F.translate(marked, INITIAL_DOT, "."), BREAK, -1)
        return F.filter(F.transform(pieces, strip), lambda s: s != "")

    return bind(text, split)


def pack_chunks(sentences: Column, joiner: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pack whole sentences greedily up to ``max_chars``; a longer sentence stands alone.

    The fold carries only lengths and emits each sentence's chunk number, so its
    state does not grow with the text; the texts are joined once at the end.
    """
    width = F.length(joiner)

    def place(state: Column, sentence: Column) -> Column:
        size = F.length(sentence)
        opens = (state["used"] < 0) | (state["used"] + width + size > max_chars)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], state["seen"])).otherwise(state["starts"]).alias("starts"),
            F.when(opens, size).otherwise(state["used"] + width + size).alias("used"),
            (state["seen"] + 1).alias("seen"),
        )

    empty = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(-1).alias("used"), F.lit(1).alias("seen")
    )

    def cut(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, k: F.call_function(
                "array_join",
                F.slice(
                    sentences,
                    start,
                    F.coalesce(F.get(starts, k + 1), F.size(sentences) + 1) - start,
                ),
                joiner,
            ),
        )

    return bind(F.aggregate(sentences, empty, place, lambda s: s["starts"]), cut)


def joiner_for(language: Column) -> Column:
    return F.when(language.isin(NO_SPACE_LANGUAGES), "").otherwise(" ")


def segment_text(text: Column, language: Column, max_chars: int = MAX_CHARS) -> Column:
    return bind(
        split_sentences(text, language),
        lambda sentences: pack_chunks(sentences, joiner_for(language), max_chars),
    )
