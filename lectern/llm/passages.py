"""Substring dedup by level-wise doubling of repeated word windows.

First level: windows of half the target length. Of each stretch in which a window of the
next level can lie, the window with the smallest hash stands for the stretch (winnowing):
equal stretches choose equal windows, so a stretch can only repeat if its choice does, and
about one window in thirteen has to be shuffled. Next levels: only stretches whose choice
repeats in another document are extended to twice the length and looked up again, and so on
until no candidate survives or the target is reached. Words under surviving windows that a
document with a smaller id holds as well are removed. Everything is judged on the input.

Counts are grouped minima with map-side combine; the way back to the holders is a join
that adaptive execution splits where one window is held by many. Equal texts are treated
once: only the one with the smallest id goes through the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lectern.llm.common import (
    OTHER_BASE,
    Words,
    checked_broadcast,
    content_key,
    mix,
    stored,
    text_parts,
    window_hashes,
)

TARGET = 50
#: Rows of an Arrow batch sent back.
ROWS = 200_000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each run of ``width``; by doubling spans."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


def choices(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, choice, first, last) for each stretch of twice ``length`` words, neighbours with one choice put together.

    first and last: positions in the text of the first and last stretch.
    """
    half = window_hashes(hashes, length)
    width = length + 1
    if len(half) < width:
        return (np.empty(0, np.int64),) * 4
    at = sliding_argmin(half, width)
    inside = np.flatnonzero(words.doc[: len(at)] == words.doc[2 * length - 1 : 2 * length - 1 + len(at)])
    at, doc = at[inside], words.doc[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    text = doc[first]
    origin = words.bounds[text]
    return text, half[at[first]].view(np.int64), inside[first] - origin, inside[last] - origin


def batches_of(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, max(1, len(whole)), ROWS):
        yield whole.slice(i, ROWS)


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (content), text; rows without id or text are left out."""
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), content_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string")
    )


def first_level(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, n_words, choices) of each row; choices: array of struct(h, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(2)):
                w = Words(texts)
                text, h, first, last = choices(w, w.hashes(), length)
                struct = pa.StructArray.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["h", "first", "last"]
                )
                ends = np.searchsorted(text, np.arange(len(w.counts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(w.counts, pa.int64()), lists], ["doc_id", "key", "n_words", "choices"]
                )

    key = rows.schema["key"].dataType
    made = StructType([StructField("h", LongType()), StructField("first", IntegerType()), StructField("last", IntegerType())])
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("key", key), StructField("n_words", LongType()), StructField("choices", ArrayType(made))]
    )
    return rows.mapInArrow(run, schema)


def repeated(windows: DataFrame, by: list[str]) -> DataFrame:
    """The windows that more than one document holds, with the smallest of these: (by, least).

    Stored, so that the join back has an exchange on both sides and hot windows can be split.
    """
    ends = windows.groupBy(*by).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return stored(ends.where("least < most").drop("most"), "passages-repeated")


def extended(texts: DataFrame, length: int, again: bool) -> DataFrame:
    """Windows of ``length`` words at the candidate positions of each text.

    ``texts``: doc_id, key, text, spans (array of struct(first, last)). With ``again`` the rows are those of a
    stretch's choice (h, first, last) for the next doubling, else each window: (h, c, at).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(2)):
                w, spans = Words(texts), batch.column(3).slice(part.start, len(texts)).to_pylist()
                one = w.hashes()
                starts = np.zeros(len(one) + 1, np.int32)  # how many spans cover a position, by differences
                for i, mine in enumerate(spans):
                    edge = np.array([(s["first"], s["last"] + 1) for s in mine], np.int64).reshape(-1, 2) + w.bounds[i]
                    np.add.at(starts, edge[:, 0], 1)
                    np.add.at(starts, edge[:, 1], -1)
                wanted = np.cumsum(starts[:-1]) > 0
                if again:
                    text, h, first, last = choices(w, one, length)
                    sums = np.concatenate([[0], np.cumsum(wanted)])
                    origin = w.bounds[text]
                    held = sums[origin + last + 1] > sums[origin + first] if len(text) else np.empty(0, bool)
                    columns = [h[held], first[held].astype(np.int32), last[held].astype(np.int32)]
                    text, names = text[held], ["h", "first", "last"]
                else:
                    h = window_hashes(one, length)
                    at = np.flatnonzero(wanted[: len(h)])
                    at = at[w.doc[at] == w.doc[at + length - 1]] if len(at) else at
                    c = window_hashes(mix(one ^ np.uint64(OTHER_BASE)), length, OTHER_BASE)[at]
                    text = w.doc[at]
                    columns = [h[at].view(np.int64), (c >> np.uint64(32)).astype(np.uint32).view(np.int32), (at - w.bounds[text]).astype(np.int32)]
                    names = ["h", "c", "at"]
                row = pa.array(text + part.start)
                yield from batches_of([batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, columns)], ["doc_id", "key", *names])

    key = texts.schema["key"].dataType.simpleString()
    tail = "h long, first int, last int" if again else "h long, c int, at int"
    return texts.select("doc_id", "key", "text", "spans").mapInArrow(run, f"doc_id long, key {key}, {tail}")


def candidates(windows: DataFrame, name: str) -> DataFrame:
    """(doc_id, key, spans) of the choices that repeat: the positions to extend; stored."""
    held = windows.join(repeated(windows, ["h"]).select("h"), "h")
    return stored(
        held.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), name
    )  # never more than the windows of one document


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    return rows.join(checked_broadcast(spans, F.size("spans")), ["doc_id", "key"])


def covered(docs: DataFrame, target: int = TARGET, levels: int | None = None) -> DataFrame:
    """(doc_id, key, n_removed, gone): runs [first, last] of words to remove, of each text that loses any.

    ``target`` is halved as often as it is even and ``levels`` (all but one word by default) allow; the first
    level has the shortest windows, at least 12 words long.
    """
    length, doublings = target, 0
    while length % 2 == 0 and length // 2 >= 12 and (levels is None or doublings < levels):
        length, doublings = length // 2, doublings + 1
    if not doublings:
        raise ValueError("the target must be even, and 24 words at least")
    rows = keys_of(docs)
    read = stored(first_level(rows, length), "passages-first")
    # of equal texts the smallest id goes on; the others lose every word that a window covers
    classes = read.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    several = stored(classes.where("n > 1").drop("n"), "passages-copies")
    copies = read.select("doc_id", "key").join(several, "key").where("least < doc_id and n_words >= " + str(target)).distinct()
    firsts = read.join(several.select("key", "least"), "key", "left").where("least is null or least = doc_id")
    windows = firsts.select("doc_id", "key", F.inline("choices"))
    spans = candidates(windows, "passages-candidates")
    for _ in range(doublings - 1):
        length *= 2
        windows = stored(extended(with_spans(rows, spans), length, True), "passages-windows")
        spans = candidates(windows, "passages-candidates")
    windows = stored(extended(with_spans(rows, spans), target, False), "passages-target")
    least = repeated(windows, ["h", "c"])
    later = windows.join(least, ["h", "c"]).where("least < doc_id").select("doc_id", "key", "at")
    gone = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("at")).mapInArrow(
        merge(target), f"doc_id long, key {rows.schema['key'].dataType.simpleString()}, n_removed long, gone array<struct<first: int, last: int>>"
    )
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).cast("int").alias("last")))
    return gone.union(copies.select("doc_id", "key", F.col("n_words").alias("n_removed"), whole.alias("gone")))


def merge(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, gone = [], []
            for at in batch.column(2):
                at = at.values.to_numpy()
                new = np.concatenate([[True], np.diff(at) > length])
                first = at[new]
                last = at[np.concatenate([new[1:], [True]])] + length - 1
                removed.append(int((last - first + 1).sum()))
                gone.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(gone, kind)], ["doc_id", "key", "n_removed", "gone"]
            )

    return run


def deduplicated(docs: DataFrame, target: int = TARGET, total: str = "words_total", removed: str = "words_removed") -> DataFrame:
    """All columns of ``docs``; a text that loses words becomes its kept words joined by one space.

    Adds the two counts (they replace columns of these names). A text that loses nothing is left as it is, a null
    text stays null with 0 words. A row without doc_id is left as it is and counts for no other. Rows that repeat
    a doc_id remove nothing from one another.
    """
    cut = stored(covered(docs, target), "passages-gone").select(
        F.col("doc_id").alias("__pd_id"), F.col("key").alias("__pd_key"), F.col("gone").alias("__pd_gone")
    )
    joined = docs.join(
        checked_broadcast(cut, F.size("__pd_gone")),
        (docs["doc_id"].cast("bigint") == F.col("__pd_id")) & (content_key(docs["text"].cast("string")) == F.col("__pd_key")),
        "left",
    ).select(*[docs[c] for c in docs.columns if c not in (total, removed)], F.col("__pd_gone"))
    names = joined.columns[:-1]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(at)):
                w, spans = Words(texts), batch.column(len(names)).slice(part.start, len(texts)).to_pylist()
                out, n = [], []
                for i, (text, gone) in enumerate(zip(texts, spans, strict=True)):
                    if not gone:
                        out.append(text)
                        n.append(0)
                        continue
                    keep = np.ones(int(w.counts[i]), bool)
                    for s in gone:
                        keep[s["first"] : s["last"] + 1] = False
                    n.append(int((~keep).sum()))
                    left = np.flatnonzero(keep) + w.bounds[i]
                    out.append(b" ".join([w.raw[a:b] for a, b in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True)]).decode())
                columns = [c.slice(part.start, part.stop - part.start) for c in batch.columns[: len(names)]]
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.counts, pa.int64()), pa.array(n, pa.int64())], [*names, total, removed])

    fields = [joined.schema[c] for c in names]
    return joined.mapInArrow(run, StructType([*fields, StructField(total, LongType()), StructField(removed, LongType())]))
