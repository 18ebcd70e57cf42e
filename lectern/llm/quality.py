"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of word shapes, pairs of neighbouring shapes and
words; logarithmic counts times inverse document frequency, each of the three
blocks scaled to its share, are projected on the leading singular vectors of a
labelled sample of at most ``SAMPLE`` rows. The labelled vectors, of bounded size,
are broadcast; each task takes the exact cosines of its documents with all of
them, block by block, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.llm.common import Words, mix, powers, stored, text_parts

#: Most labelled rows that the model is fitted on and holds.
SAMPLE = 8192
DIMENSIONS = 64
#: Most tasks that read the stored sample: each hands a (WIDTH, DIMENSIONS + 16) array to the driver.
PARTS = 8
NEIGHBOURS = 25
BLOCK = 512
#: Hashed features and weight of each block: shapes, pairs of shapes, words.
BLOCKS = ((512, 0.6), (1024, 0.3), (512, 0.1))
WIDTH = sum(n for n, _ in BLOCKS)


def _classes() -> np.ndarray:
    """A byte's class: lower case and bytes beyond ASCII, upper case, digits, and each other sign for itself."""
    c = np.arange(256, dtype=np.uint64)
    c[ord("a") : ord("z") + 1] = 1
    c[128:] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    return c


CLASSES = _classes()


def features(texts: list[str | None]) -> np.ndarray:
    """Counts of the hashed features of each text; (texts, WIDTH)."""
    w = Words(texts)
    n, out = len(texts), np.zeros((len(texts), WIDTH), np.float32)
    if not len(w.start):
        return out
    kind = CLASSES[w.bytes]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    rank = np.concatenate([[0], np.cumsum(new)])
    up, down = powers(0x9E3779B97F4A7C15, len(kind))
    marks = np.where(new, (kind + np.uint64(1)) * up[np.minimum(rank[1:] - 1, len(kind) - 1)], np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(marks)])
    shape = mix((total[w.end] - total[w.start]) * down[rank[w.start]])
    word = w.hashes()
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = np.where(again, mix(shape + np.uint64(1)), shape)  # a word that repeats the one before
    before = np.concatenate([[np.uint64(0)], shape[:-1]])
    before[w.bounds[:-1][w.counts > 0]] = 0
    pair = mix(shape * np.uint64(3) + before)
    at = 0
    for values, (size, _) in zip((shape, pair, word), BLOCKS, strict=True):
        flat = w.doc * size + (values % np.uint64(size)).astype(np.int64)
        out[:, at : at + size] = np.bincount(flat, minlength=n * size).reshape(n, size)
        at += size
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # (WIDTH, dimensions)
    vectors: np.ndarray  # (sample, dimensions), of length 1
    labels: np.ndarray
    prior: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x, at = np.log1p(counts) * self.idf, 0
        for size, share in BLOCKS:
            part = x[:, at : at + size]
            part *= share / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
            at += size
        return x

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self.weighted(counts) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled rows; the prior counts as one vote of weight 0.1."""
        out = np.empty(len(counts))
        k = min(neighbours, len(self.labels))
        for i in range(0, len(counts), BLOCK):
            some = counts[i : i + BLOCK]
            cosines = self.project(some) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.arange(k)[None, :].repeat(len(some), 0)
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 4
            votes = (weight * self.labels[near]).sum(axis=1) + 0.1 * self.prior
            share = votes / (weight.sum(axis=1) + 0.1)
            out[i : i + BLOCK] = np.where(some.any(axis=1), share, self.prior)
        return np.clip(out, 0.0, 1.0)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows (at, n, ...) with their counts, (rows, WIDTH)."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            some = batch.slice(i, BLOCK)
            counts = np.zeros((len(some), WIDTH), np.float32)
            for row, at, n in zip(counts, some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
            yield some, counts


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of a block of counts; a task gives one array of ``shape``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, counts in _dense(batches):
            total += part(counts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = np.zeros(shape)
    for r in rows.select("at", "n").mapInArrow(run, "part binary").collect():  # at most PARTS
        total += np.frombuffer(r["part"], np.float64).reshape(shape)
    return total


def fit(rows: DataFrame, dimensions: int = DIMENSIONS) -> Model:
    """From the stored counts (doc_id, at, n, label) of the sample; without rows every score is 0.5.

    Singular vectors by subspace iteration from a fixed start. Counts stay in the tasks: an iteration sums one
    (WIDTH, dimensions + 16) array over them, in double precision, and the driver gets the short vectors alone.
    """
    known = rows.agg(F.count("*").alias("n"), F.avg((F.col("label") >= 0.5).cast("double")).alias("prior")).first()
    if not known["n"]:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.empty(0), 0.5)
    seen = _summed(rows, lambda counts: (counts > 0).sum(axis=0, dtype=np.float64), (WIDTH,))
    idf = (np.log((1 + known["n"]) / (1 + seen)) + 1).astype(np.float32)
    model = Model(idf, np.eye(WIDTH, 1, dtype=np.float32), np.empty(0), np.empty(0), known["prior"])
    rank = min(dimensions, known["n"], WIDTH)
    wide = min(rank + 16, WIDTH)
    axes = np.random.default_rng(7).standard_normal((WIDTH, wide)).astype(np.float32)
    for _ in range(6):

        def spread(counts: np.ndarray, axes: np.ndarray = axes) -> np.ndarray:
            x = model.weighted(counts)
            return x.T @ (x @ axes)

        axes, _ = np.linalg.qr(_summed(rows, spread, (WIDTH, wide)))
        axes = axes.astype(np.float32)

    def inner(counts: np.ndarray) -> np.ndarray:
        y = (model.weighted(counts) @ axes).astype(np.float64)
        return y.T @ y

    _, turn = np.linalg.eigh(_summed(rows, inner, (wide, wide)))
    model.axes = np.ascontiguousarray(axes @ turn[:, ::-1].astype(np.float32))[:, :rank]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, counts in _dense(batches):
            vectors = [v.tobytes() for v in model.project(counts)]
            yield pa.RecordBatch.from_arrays([some.column(2), some.column(3), pa.array(vectors, pa.binary())], ["doc_id", "label", "v"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.select("at", "n", "doc_id", "label").mapInArrow(project, f"doc_id {kind}, label double, v binary").collect()
    short.sort(key=lambda r: r["doc_id"])
    model.vectors = np.stack([np.frombuffer(r["v"], np.float32) for r in short])
    model.labels = np.array([float(r["label"] >= 0.5) for r in short])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """From ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    Rows with a null id, label or text do not count; of repeated ids the labels are averaged and one
    text is taken. The ``sample`` rows with the smallest hash of their id are used; they are stored as
    counts, and of equal cosines the rows with smaller ids come first.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string"))
    chosen = (
        texts.select("doc_id").join(known, "doc_id").dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, all_ in text_parts(batch.column(2)):
                at, n = [], []
                for texts_ in _blocks(all_):
                    for row in features(texts_):
                        hit = np.flatnonzero(row)
                        at.append(hit.astype(np.uint16).tobytes())
                        n.append(row[hit].tobytes())
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "label", "at", "n"]
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .select("doc_id", "label", "text").mapInArrow(sparse, f"doc_id {kind}, label double, at binary, n binary")
    )
    return fit(stored(rows, "quality-sample").coalesce(PARTS), dimensions)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``quality_score`` (0 to 1; replaces a column of this name).

    A null or empty text gets the share of label 1.
    """
    docs = docs.drop("quality_score")
    handed = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(at)):
                some = batch.slice(part.start, part.stop - part.start)
                got = np.concatenate([handed.value.score(features(t)) for t in _blocks(texts)])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got)], [*some.schema.names, "quality_score"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def _blocks(texts: list) -> Iterator[list]:
    for i in range(0, len(texts), BLOCK):
        yield texts[i : i + BLOCK]


def classified(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows where ``training`` holds (a condition on doc_id), score all rows."""
    return scored(docs, train(docs.where(training), labels.where(training), sample))
