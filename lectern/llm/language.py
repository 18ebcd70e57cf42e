"""Language labels for spans of mixed text.

The model holds, for each language, counts of hashed letter n-grams of its words
(two and three letters with word borders, and the whole word) in a table of fixed
size, and the scripts its letters are in. A word is scored only against languages
that use its script; a Viterbi pass over a text's words, with a penalty for each
switch, labels spans. The languages are those of the training rows; they are the
only thing besides the fixed-size tables that is broadcast, and their number is bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import chunks, mix, powers

BUCKETS = 1 << 16
MAX_LANGUAGES = 256
UNKNOWN = "und"

# First code points of script ranges, as the Unicode blocks give them; letters of a range share a script.
SCRIPT_STARTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE20, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([0] + [s for s, _ in SCRIPT_STARTS])
_CODES = np.array([SCRIPTS.index("Other")] + [SCRIPTS.index(n) for _, n in SCRIPT_STARTS])


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


class LetterRuns:
    """The words (runs of letters) of a chunk of texts, with hashed n-grams of each."""

    def __init__(self, texts: list[str | None]):
        joined = [(t or "") for t in texts]
        lengths = np.fromiter((len(t) + 1 for t in joined), np.int64, len(joined))
        whole = " ".join(joined) + " "
        lowered = whole.lower()
        if len(lowered) != len(whole):  # a few letters grow when lowered
            lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in whole)
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_letter]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.points = points
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.bounds = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.bounds)
        self.script = _CODES[np.searchsorted(_STARTS, points[self.start], side="right") - 1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of one of each word, and for every word the place among these."""
        up, down = powers(0x9E3779B97F4A7C15, len(self.points))
        total = np.concatenate([[np.uint64(0)], np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up[: len(self.points)])])
        _, at, inverse = np.unique(mix((total[self.end] - total[self.start]) * down[self.start]), return_index=True, return_inverse=True)
        return at, inverse

    def grams(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every n-gram of the words at these places (all by default), and where those of each word begin."""
        start = self.start if at is None else self.start[at]
        size = (self.end if at is None else self.end[at]) - start
        if not len(size):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        # each word with one border before and behind it
        width = size + 2
        first = np.concatenate([[0], np.cumsum(width)])
        place = np.arange(first[-1]) - np.repeat(first[:-1], width) - 1
        inside = (place >= 0) & (place < np.repeat(size, width))
        source = np.where(inside, np.repeat(start, width) + place, 0)
        c = np.where(inside, self.points[source].astype(np.uint64) + np.uint64(1), np.uint64(0))
        a = c * np.uint64(0x9E3779B97F4A7C15)
        two = a[:-1] + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
        up, down = powers(0x9E3779B97F4A7C15, len(c))
        total = np.concatenate([[np.uint64(0)], np.cumsum(c * up[: len(c)])])
        whole = (total[first[1:]] - total[first[:-1]]) * down[first[:-1]]
        # per word: width-1 pairs, width-2 triples, one whole word
        n = 2 * width - 2
        begin = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(begin[-1], np.uint64)
        pair_at = np.arange(first[-1])[np.arange(first[-1]) - np.repeat(first[:-1], width) < np.repeat(width - 1, width)]
        word_of_pair = np.repeat(np.arange(len(size)), width - 1)
        out[begin[word_of_pair] + pair_at - first[word_of_pair]] = two[pair_at]
        triple_at = np.arange(first[-1])[np.arange(first[-1]) - np.repeat(first[:-1], width) < np.repeat(width - 2, width)]
        word_of_triple = np.repeat(np.arange(len(size)), width - 2)
        out[begin[word_of_triple] + (width - 1)[word_of_triple] + triple_at - first[word_of_triple]] = three[triple_at]
        out[begin[1:] - 1] = whole + np.uint64(0x27D4EB2F165667C5)
        return (mix(out) % np.uint64(BUCKETS)).astype(np.int64), begin


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages) log probabilities
    allowed: np.ndarray  # (scripts, languages)


def train(rows: DataFrame, smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    """A model from ``text`` and ``lang`` of all rows where both are present.

    Each task sends one table of counts per language (of fixed size); they are summed by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks(texts, 1_000_000):
                runs = LetterRuns(texts[part])
                one, which = runs.distinct()
                grams, begin = runs.grams(one)
                for lang in set(langs[part]):
                    mine = np.repeat(np.array([x == lang for x in langs[part]]), runs.counts)
                    t = tables.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    times = np.repeat(np.bincount(which[mine], minlength=len(one)), np.diff(begin))
                    t[:BUCKETS] += np.bincount(grams, times, minlength=BUCKETS).astype(np.int64)
                    weight = (runs.end - runs.start)[mine]
                    t[BUCKETS:] += np.bincount(runs.script[mine], weight, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(t[at])], ["lang", "at", "n"])

    counted = (
        rows.where("lang is not null and text is not null")
        .select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(count, "lang string, at long, n long")
        .groupBy("lang", "at")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("all"))  # at most BUCKETS and the scripts
    )
    found = counted.limit(MAX_LANGUAGES + 1).toPandas().sort_values("lang")
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(found)))
    for j, all_ in enumerate(found["all"]):
        for at, n in all_:
            counts[at, j] = n
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    spread = max(1, int((grams.sum(axis=1) > 0).sum()))
    scores = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * spread))
    allowed = scripts >= script_share * np.maximum(scripts.sum(axis=0), 1)
    return Model(list(found["lang"]), scores.astype(np.float32), allowed)


def word_scores(model: Model, runs: LetterRuns) -> np.ndarray:
    """Mean log probability of each word's n-grams times the square root of their number, by language."""
    n = len(model.languages)
    if not len(runs.start):
        return np.empty((0, n), np.float32)
    one, which = runs.distinct()  # each distinct word of the chunk is scored once
    grams, begin = runs.grams(one)
    sums = np.empty((len(one), n), np.float32)
    for j in range(n):
        sums[:, j] = np.add.reduceat(model.scores[grams, j], begin[:-1])
    sums /= np.sqrt(np.diff(begin))[:, None]
    may = model.allowed[runs.script[one]]
    may[~may.any(axis=1)] = True  # a script that no language uses: all are candidates
    return np.where(may, sums, sums.min(axis=1, keepdims=True) - 1e3).astype(np.float32)[which]


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; texts of a chunk advance together, one word each per step."""
    labels = np.zeros(len(scores), np.int16)
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    starts, counts = bounds[:-1][order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    if not longest:
        return labels
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    back = np.zeros(scores.shape, np.int16)
    n = scores.shape[1]
    keep = np.arange(n, dtype=np.int16)
    state = scores[starts[: active[0]]].copy()
    final = np.zeros(len(counts), np.int16)
    for t in range(1, longest + 1):
        k = active[t] if t < longest else 0
        ended = slice(k, len(state))
        final[ended] = state[ended].argmax(axis=1)
        state = state[:k]
        if not k:
            break
        best = state.argmax(axis=1)
        jump = state[np.arange(k), best] - penalty
        stay = state >= jump[:, None]
        here = starts[:k] + t
        back[here] = np.where(stay, keep, best[:, None].astype(np.int16))
        state = np.where(stay, state, jump[:, None]) + scores[here]
    at = final.copy()
    for t in range(longest - 1, -1, -1):
        k = active[t]
        here = starts[:k] + t
        labels[here] = at[:k]
        if t:
            at[:k] = back[here, at[:k]]
    return labels


def label_spans(docs: DataFrame, model: Model, penalty: float = 12.0, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, lang_pred, score, spans of every row.

    ``spans``: array of struct(start, end, lang) over code points, from a span's first letter to its
    last. ``lang_pred`` has most letters (a tie goes to the first name), ``score`` is its share of the letters.
    A null text, or one without letters, is ``und`` with score 0 and no spans.
    """
    keep = keep or ["doc_id"]
    handed = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handed.value
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for part in chunks(texts, 1_000_000):
                runs = LetterRuns(texts[part])
                labels = viterbi(word_scores(model, runs), runs.bounds, penalty)
                size = (runs.end - runs.start).astype(np.float64)
                doc = np.repeat(np.arange(len(runs.counts)), runs.counts)
                n = len(model.languages)
                share = np.bincount(doc * n + labels, size, minlength=len(runs.counts) * n).reshape(-1, n)
                total = share.sum(axis=1)
                best = np.where(total > 0, share.argmax(axis=1), n)
                score = np.where(total > 0, share.max(axis=1), 0) / np.maximum(total, 1)
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(labels)]])[: len(first)] - 1
                origin = runs.text_start[doc[first]] if len(first) else first
                flat = pa.StructArray.from_arrays(
                    [
                        pa.array(runs.start[first] - origin, pa.int64()),
                        pa.array(runs.end[last] - origin, pa.int64()),
                        pa.array(np.array(names, object)[labels[first]], pa.string()),
                    ],
                    ["start", "end", "lang"],
                )
                ends = np.searchsorted(doc[first], np.arange(len(runs.counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c[part.start : part.stop] for c in batch.columns[: len(keep)]],
                        pa.array(np.array(names, object)[best], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends), flat, type=span),
                    ],
                    [*keep, "lang_pred", "score", "spans"],
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(label, schema)


def identified(docs: DataFrame, training: Column, **options) -> DataFrame:
    """Train on the rows where ``training`` holds and label all rows; without training rows all are ``und``."""
    model = train(docs.where(training))
    if not model.languages:
        model = Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.ones((len(SCRIPTS), 1), bool))
    return label_spans(docs, model, **options)
