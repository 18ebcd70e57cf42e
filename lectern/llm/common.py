"""What the operators share: stored intermediate tables, flat word arrays, rolling hashes, components.

Inside tasks texts are handled as one flat byte array per chunk of documents, so
that words, hashes and windows are whole-array operations; a chunk holds at most
``CHUNK`` bytes, or one document if that is longer.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import local_fallback, shared_folder

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\f\r"
CHUNK = 500_000
BATCH_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
#: Most rows of a table of ids that is broadcast, after they are counted.
BROADCAST_ROWS = 1_000_000
#: Most array entries of a broadcast table with arrays of small structs (some 80 bytes each, rows included).
BROADCAST_ENTRIES = 2_500_000


def small_batches(spark: SparkSession) -> None:
    """Let batches between the engine and Python hold ``BATCH_BYTES`` at most, from now on in this session.

    By default a batch of long texts grows to 64 MB, on both sides of each task.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = spark.conf.get(setting).rstrip("bB")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    return f"{shared_folder(spark, local_fallback(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps survive lost executors and scan only their columns."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def checked_broadcast(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """A broadcast hint if the (stored) table has at most ``BROADCAST_ROWS`` rows, or array entries where these are
    given at most ``BROADCAST_ENTRIES``; beyond the bound Spark shuffles both sides."""
    if entries is None:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    return F.broadcast(df) if (df.agg(F.sum(entries + 1)).first()[0] or 0) <= BROADCAST_ENTRIES else df


def content_key(text: Column) -> Column:
    """128 bits that stand for a whole text, null apart from empty."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text, F.length(text)).alias("b"))


def crc_mod(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def chunks(texts: list[str | bytes | None], limit: int = CHUNK) -> Iterator[slice]:
    """Consecutive runs of texts of about ``limit`` characters (or bytes); a longer text is alone."""
    first = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > limit:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def text_parts(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[slice, list]]:
    """Consecutive runs of a column of texts of about ``limit`` bytes, a longer text alone: where, and the texts.

    Python holds the texts of one run at a time, not of a whole batch.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + limit, "right")))
        yield slice(first, last), column.slice(first, last - first).to_pylist()
        first = last


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * CHUNK:  # of a giant text: used once
            return both[0], both[1]
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a chunk of texts: byte spans in ``raw`` and the text each belongs to."""

    def __init__(self, texts: list[str | bytes | None], lower_ascii: bool = False):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
        self.raw = b" ".join(parts) + b" "
        b = np.frombuffer(self.raw, np.uint8)
        if lower_ascii:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        self.bytes = b
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.bounds = np.searchsorted(self.start, self.text_start)  # of the words of each text
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(parts)), self.counts)

    def hashes(self, base: int = BASE) -> np.ndarray:
        up, down = powers(base, len(self.bytes))
        total = np.concatenate(
            [[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)])]
        )
        out = mix((total[self.end] - total[self.start]) * down[self.start])
        for i in np.flatnonzero(self.end - self.start > 256):  # long words could be built to collide
            word = self.bytes[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=str(base).encode()).digest(), "little")
        return out


def window_hashes(words: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words, over text borders too."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = powers(base, n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])])
    return mix((total[length:] - total[:-length]) * down[: n - length + 1] + np.uint64(length))


def _checksum(edges: DataFrame) -> tuple:
    """Number of the distinct edges and 128 bits over all of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b).

    Large-star and small-star steps in turn, each a grouped minimum and a join, with
    the links stored after each pair of steps; nothing is gathered in one place.
    """
    edges = stored(
        links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), name
    )
    before = _checksum(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        out = small.select(F.col("m").alias("u"), "v").union(
            small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        )
        edges = stored(out.distinct(), name)
        now = _checksum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
