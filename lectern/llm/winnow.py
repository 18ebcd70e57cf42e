"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of signs beyond ASCII, A-Z read as a-z.
The windows of an item are all its runs of ``length`` words, or all its words if it has
fewer. Of each window the k-gram with the smallest hash stands for it, k being half its
length: equal windows choose equal k-grams, so every span of ``length`` words that a
document shares with an item shares a fingerprint. Documents keep the fingerprints that
an item may have, which a bitmap of all fingerprints tells, extend them to the windows
that chose them, and are joined with the items' windows; shorter items are looked for in
the same way at their own lengths, so they are found as surely.

Scale: a text is read once and never moves. The bitmap grows with the items up to
``MOST_BITS`` and only decides what is joined, so a full one costs time, never a result.
The items' windows are broadcast after they are counted; beyond the bound both sides are
shuffled. Hits are those of distinct texts: copies, however many, are joined once, and
the items behind a set of windows are gathered once for all texts with that set.

Defined results: a null or empty text, and one without words, has no windows and no
hits. Items with a null id or without words are left out; equal items each count, rows
that repeat an item count once. Rows of documents that repeat, or have a null id, are
rows like others. Windows are compared by 128 bits. A text of any length is one chunk of
flat arrays, some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from lectern.llm.common import OTHER_BASE, Words, checked_broadcast, content_key, mix, stored, text_parts, window_hashes
from lectern.llm.passages import sliding_argmin

LENGTH = 10
#: Bits for each window or fingerprint of the items, and the least and most bits of the bitmap.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
#: Bits of one row of the bitmap while it is built.
BUCKET = 1 << 15
_FOUND = ArrayType(
    StructType().add("length", IntegerType()).add("a", LongType()).add("b", LongType()).add("starts", ArrayType(IntegerType()))
)


def _word_bytes() -> bytes:
    """Translates A-Z to a-z and what is no word to a space."""
    keep = bytearray(b" " * 256)
    keep[128:] = range(128, 256)
    for first, last in ("09", "az"):
        keep[ord(first) : ord(last) + 1] = range(ord(first), ord(last) + 1)
    keep[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    return bytes(keep)


WORD_BYTES = _word_bytes()


def words_of(texts: list[bytes | None]) -> Words:
    return Words([(t or b"").translate(WORD_BYTES) for t in texts])


def gram_length(length: int) -> int:
    return (length + 1) // 2


def windows_of(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(one hash of each word, start of each window inside a text, hash of each k-gram, place of each window's k-gram)."""
    one, k = w.hashes(), gram_length(length)
    if len(one) < length:
        return one, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = window_hashes(one, k)
    at = sliding_argmin(grams, length - k + 1)[: max(0, len(one) - length + 1)]
    start = np.flatnonzero(w.doc[: len(at)] == w.doc[length - 1 : length - 1 + len(at)])
    return one, start, grams, at[start]


def window_keys(one: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(one, length), window_hashes(mix(one ^ np.uint64(OTHER_BASE)), length, OTHER_BASE)


def item_windows(items: DataFrame, id: str, length: int) -> DataFrame:
    """(item, length, g, a, b): the distinct windows of each item, with the hash of the k-gram that stands for it; stored."""
    rows = items.where(F.col(id).isNotNull() & F.col("text").isNotNull()).select(F.col(id).alias("item"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1)):
                w = words_of(texts)
                size = np.minimum(w.counts, length)
                for n in np.unique(size[size > 0]).tolist():
                    one, start, grams, at = windows_of(w, n)
                    mine = size[w.doc[start]] == n
                    start, at = start[mine], at[mine]
                    a, b = window_keys(one, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(w.doc[start] + part.start)),
                            pa.array(np.full(len(start), n, np.int32)),
                            *[pa.array(x.view(np.int64)) for x in (grams[at], a[start], b[start])],
                        ],
                        ["item", "length", "g", "a", "b"],
                    )

    kind = rows.schema["item"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"item {kind}, length int, g long, a long, b long").distinct(), "winnow-items")


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """A bit for each fingerprint and each window: the low bits of the hash say which. Its size has a fixed bound."""
    n, size = 2 * BITS_EACH * windows.count(), LEAST_BITS
    while size < n and size < MOST_BITS:
        size *= 2
    bits = windows.select(F.explode(F.array("g", "a")).alias("h")).select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("p"))
    rows = bits.groupBy(F.floor(F.col("p") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % BUCKET).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:  # size / BUCKET rows at most
        out[r["bucket"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _grouped(doc: np.ndarray, length: int, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """(document of each row, rows) with the places of equal windows of a document in one row."""
    order = np.lexsort((place, b, a, doc))
    doc, a, b, place = doc[order], a[order], b[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
    columns = [pa.array(np.full(len(first), length, np.int32)), pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), starts]
    return doc[first], pa.StructArray.from_arrays(columns, ["length", "a", "b", "starts"])


def fingerprinted(docs: DataFrame, keep: Sequence[str], lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """The kept columns, (``__key``: content, n_words, ``__found``: windows that an item may have); stored."""
    rows = docs.select(*keep, content_key(F.col("text").cast("string")).alias("__key"), F.col("text").cast("binary").alias("__text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(len(names))):
                w = words_of(texts)
                n, docs_of, found = part.stop - part.start, [], []
                for length in lengths:
                    one, start, grams, at = windows_of(w, length)
                    hit = np.flatnonzero(marked(bitmap, grams)[at])  # fingerprints that an item may have
                    if not len(hit):
                        continue
                    a, b = (x[start[hit]] for x in window_keys(one, length))  # extended to their windows
                    hit, a, b = (x[marked(bitmap, a)] for x in (hit, a, b))
                    doc = w.doc[start[hit]]
                    doc, made = _grouped(doc, length, a, b, start[hit] - w.bounds[doc])
                    docs_of.append(doc)
                    found.append(made)
                kind = pa.struct([("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("starts", pa.list_(pa.int32()))])
                whole = pa.concat_arrays(found) if found else pa.array([], kind)
                doc = np.concatenate(docs_of) if found else np.empty(0, np.int64)
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), whole.take(pa.array(order)))
                some = batch.slice(part.start, n)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(w.counts, pa.int64()), lists], [*names, "n_words", "__found"])

    schema = StructType([*rows.schema.fields[:-1]]).add("n_words", "long").add("__found", _FOUND)
    return stored(rows.mapInArrow(run, schema), "winnow-found")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hit words of each text from its (length, starts)."""
    for batch in batches:
        spans, n = [], []
        for cells in batch.column(2).to_pylist():
            start = np.concatenate([np.asarray(c["starts"], np.int64) for c in cells])
            end = np.concatenate([np.asarray(c["starts"], np.int64) + c["length"] for c in cells])
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            first, last = start[new], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1]) - 1
            n.append(int((last - first + 1).sum()))
            spans.append([{"first": x, "last": y} for x, y in zip(first.tolist(), last.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, kind)], ["__key", "__set", "n_hit", "spans"])


def hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(``__key``, n_hit, spans, items) of each distinct text with a hit; stored."""
    texts = found.where(F.size("__found") > 0).select("__key", "__found").dropDuplicates(["__key"])
    each = texts.select("__key", F.inline("__found"))
    known = windows.select("length", "a", "b").distinct()
    true = each.join(checked_broadcast(stored(known, "winnow-windows")), ["length", "a", "b"])
    of_text = true.groupBy("__key").agg(  # never more than the windows of one text
        F.sort_array(F.collect_list(F.struct("length", "a", "b"))).alias("__set"),
        F.collect_list(F.struct("length", "starts")).alias("at"),
    )
    key = found.schema["__key"].dataType.simpleString()
    sets = "array<struct<length: int, a: bigint, b: bigint>>"
    schema = f"__key {key}, __set {sets}, n_hit long, spans array<struct<first: int, last: int>>"
    covered = stored(of_text.mapInArrow(_covered, schema).withColumn("__id", F.sha2(F.to_json("__set"), 256)), "winnow-hits")
    distinct = covered.select("__id", "__set").dropDuplicates(["__id"]).select("__id", F.inline("__set"))
    named = distinct.join(windows.select("item", "length", "a", "b"), ["length", "a", "b"])
    items = named.groupBy("__id").agg(F.sort_array(F.collect_set("item")).alias("items"))  # the result itself holds this list
    return stored(covered.drop("__set").join(items, "__id").drop("__id"), "winnow-items-of")


def contaminated(docs: DataFrame, items: DataFrame, *, keep: Sequence[str] = ("doc_id",), id: str = "item_id", length: int = LENGTH) -> DataFrame:
    """The kept columns of each row of ``docs``, and n_words, n_hit, spans (runs [first, last] of hit words), items (sorted ids).

    ``keep`` must not name any of the four; the text itself may be kept.
    """
    windows = item_windows(items, id, length)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # ``length`` numbers at most
    found = fingerprinted(docs, keep, lengths, bitmap_of(windows))
    hit = hits(found, windows)
    whole = found.drop("__found").join(checked_broadcast(hit, F.size("items") + F.size("spans")), "__key", "left").drop("__key")
    nothing = {"n_hit": F.lit(0).cast("bigint"), "spans": F.array().cast("array<struct<first: int, last: int>>"), "items": F.array().cast(hit.schema["items"].dataType)}
    return whole.select(*keep, "n_words", *[F.coalesce(c, v).alias(c) for c, v in nothing.items()])
