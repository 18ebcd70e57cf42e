"""Jaccard join of documents by word shingles, with signature trees.

Documents with one and the same set of shingles are a class; the join runs over one
set for each class. Blocks bring together what may be linked: under a fixed order of
all shingles (by a sketch of their counts over the whole corpus, rarest first, then by
hash) two linked sets share one of their first n - ceil(0.85 n) + 1 shingles. In a block
the sets are the leaves of a signature tree, whose nodes hold OR-combined bitmaps of
their shingles and ranges of size; a dual traversal leaves out node pairs whose sizes or
largest possible overlap cannot reach the threshold. What is left is counted exactly.

Pairs that are already connected need no link, which keeps groups of near copies
linear: in each of the first rounds a set is in one block alone, by the prefix shingle
with the least hash of that round; the last round looks at all prefix shingles, but only
into blocks that still hold several components, once for each distinct membership. Links
are between components; a round hands its links on to the labels in two steps, which need
not be all there are, since equal labels only save work. Components are completed once,
before the last round, and its links, of components alone, are completed by themselves.
Sets are fetched only for members that the bitmaps do not rule out, once for blocks that
overlap. A block of more than ``BLOCK`` sets is dealt out as pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, checked_broadcast, components, mix, stored, text_parts, window_hashes

SHINGLE = 4
PERCENT = 85
#: Counters of the sketch that orders shingles; any order gives the same links.
SKETCH = 1 << 18
#: Least number of 64-bit words of a bitmap; it has a bit for each shingle or more, as a power of two.
BITMAP = 4
LEAF = 8
#: Rounds that look at one shingle of each set, before the round that looks at all of the prefix.
ROUNDS = 3
BLOCK = 1024


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their bounds."""
    w = Words(texts, lower_ascii=True)
    one = w.hashes()
    runs = window_hashes(one, size)
    at = np.flatnonzero(w.doc[: len(runs)] == w.doc[size - 1 : size - 1 + len(runs)]) if len(runs) else np.empty(0, np.int64)
    doc, h = w.doc[at], runs[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):  # the whole sequence is the one shingle
        whole = np.array([window_hashes(one[w.bounds[i] : w.bounds[i + 1]], int(w.counts[i]))[0] for i in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two arrays; 0 for empty sets."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """Words of the bitmap of a set of n shingles."""
    return np.maximum(BITMAP, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    width = int(bitmap_words(np.array([len(tokens)]))[0])
    out = np.zeros(width, np.uint64)
    bit = mix(tokens) & np.uint64(width * 64 - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of documents by shingle bucket, over all documents; of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, texts in text_parts(batch.column(0)):
                h, _ = shingles(texts, size)
                counts += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(counts[at[i : i + 100_000]])], ["at", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def signatures(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, n, a, b, prefix, bits) of every row; a and b stand for the set, prefix is in the order of the sketch."""
    handed = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1)):
                h, bounds = shingles(texts, size)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, handed.value[(h % np.uint64(SKETCH)).astype(np.int64)], doc))
                place = np.arange(len(h)) - bounds[doc]
                length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                prefix = h[order][place < length[doc]].view(np.int64)
                width = bitmap_words(n)
                first = np.concatenate([[0], np.cumsum(width)])
                bits = np.zeros(first[-1], np.uint64)
                bit = mix(h) & (width[doc] * 64 - 1).astype(np.uint64)
                np.bitwise_or.at(bits, first[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                a, b = set_keys(h, bounds)
                ends = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.array(n, pa.int64()), pa.array(a), pa.array(b),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix)),
                        pa.array([bits[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n", "a", "b", "prefix", "bits"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, a long, b long, prefix array<long>, bits binary")


class Roots:
    """Union-find over the members of one block."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


class Tree:
    """A signature tree over sets sorted by size: levels from the leaves (``LEAF`` sets each) to the root."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, names: np.ndarray):
        self.n, self.bits, self.names = n, bits, names
        self.spare = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # shingles beyond one for each bit
        level = (bits, n, n, self.spare)
        self.levels = []
        while True:
            cut = np.arange(0, len(level[1]), LEAF)
            level = (
                np.bitwise_or.reduceat(level[0], cut, axis=0), np.minimum.reduceat(level[1], cut),
                np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut),
            )
            self.levels.append(level)
            if len(cut) == 1:
                break

    def may(self, level: int, i: int, j: int, percent: int) -> bool:
        """Whether some set under node i and one under node j can be linked."""
        bits, low, high, spare = self.levels[level]
        if 100 * min(high[i], high[j]) < percent * max(low[i], low[j]):
            return False
        overlap = int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(spare[i], spare[j])
        return (100 + percent) * min(overlap, high[i], high[j]) >= percent * (low[i] + low[j])

    def leaf_pairs(self, percent: int, roots: Roots) -> Iterator[tuple[int, int]]:
        """Dual traversal from the root, down to the pairs of leaves that are left; pairs of nodes inside one component are not."""
        least = most = np.array([roots.find(k) for k in self.names])
        whole = []  # a member of the component that holds the whole node, or -1
        for _ in self.levels:
            cut = np.arange(0, len(least), LEAF)
            least, most = np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            whole.append(np.where(least == most, least, -1))
        work = [(len(self.levels) - 1, 0, 0)]
        while work:
            level, i, j = work.pop()
            x, y = whole[level][i], whole[level][j]
            if x >= 0 and y >= 0 and roots.find(x) == roots.find(y):
                continue
            if i != j and not self.may(level, i, j, percent):
                continue
            if not level:
                yield i, j
                continue
            size = len(self.levels[level - 1][1])
            left = range(i * LEAF, min(size, (i + 1) * LEAF))
            right = range(j * LEAF, min(size, (j + 1) * LEAF))
            work += [(level - 1, x, y) for x in left for y in right if i != j or x <= y]

    def pairs(self, percent: int, roots: Roots) -> Iterator[tuple[int, int]]:
        """Pairs of sets in different components that the bitmaps do not rule out."""
        n, total = self.n, len(self.n)
        for x, y in self.leaf_pairs(percent, roots):
            i = np.arange(x * LEAF, min(total, (x + 1) * LEAF))
            j = np.arange(y * LEAF, min(total, (y + 1) * LEAF))
            apart = np.array([roots.find(k) for k in self.names[i]])[:, None] != np.array([roots.find(k) for k in self.names[j]])
            if x == y:
                apart &= i[:, None] < j[None, :]
            if not apart.any():
                continue
            a, b = np.nonzero(apart)
            a, b = i[a], j[b]
            overlap = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1).astype(np.int64) + np.minimum(self.spare[a], self.spare[b])
            overlap = np.minimum(overlap, np.minimum(n[a], n[b]))
            good = (100 + percent) * overlap >= percent * (n[a] + n[b])
            yield from zip(self.names[a[good]].tolist(), self.names[b[good]].tolist(), strict=True)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def possible_pairs(n: np.ndarray, bits: list[np.ndarray], percent: int, roots: Roots) -> Iterator[tuple[int, int]]:
    """Pairs of a block that bitmaps and sizes allow, in different components as of the time they are drawn.

    There is a tree for each width of bitmap, which also holds the sets of the next width that are small enough to
    be linked with one of this; their bitmaps are folded.
    """
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):
        near = (width == w) | ((width == 2 * w) & (percent * n <= 100 * 64 * w))
        at = np.flatnonzero(near)
        at = at[np.argsort(n[at], kind="stable")]
        if len(at) > 1:
            folded = np.stack([np.bitwise_or.reduce(bits[i].reshape(-1, w), axis=0) for i in at])
            yield from Tree(n[at], folded, at).pairs(percent, roots)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first ``keys`` columns, from batches sorted by these."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cut = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for x, y in zip(cut, cut[1:]):
            now = tuple(marks[:, x].tolist())
            if waiting and now != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(x, y - x))
            last = now
    if waiting:
        yield pa.Table.from_batches(waiting)


def survivors(members: DataFrame, percent: int) -> DataFrame:
    """(block, part, cls, node, comp) of members with a possible partner in another component, by bitmaps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 2):
            n = t["n"].to_numpy()
            bits = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
            keep = np.zeros(len(n), bool)
            for a, b in possible_pairs(n, bits, percent, Roots(t["comp"].to_pylist())):
                keep[a] = keep[b] = True
            if keep.any():
                yield from t.select(["block", "part", "cls", "node", "comp"]).filter(pa.array(keep)).to_batches()

    rows = members.select("block", "part", "cls", "node", "comp", "n", "bits")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(
        run, "block long, part long, cls long, node long, comp long"
    )


def with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Add ``tokens`` (8-byte shingle hashes, ascending) to members; texts are scanned for the documents named."""
    named = stored(members.select("node", "cls").distinct(), "ngrams-named")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")).join(
        checked_broadcast(named), "node"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy()
            for part, texts in text_parts(batch.column(1)):
                h, bounds = shingles(texts, size)
                same = np.flatnonzero(set_keys(h, bounds)[0] == want[part])
                tokens = [h[bounds[i] : bounds[i + 1]].tobytes() for i in same]
                yield pa.RecordBatch.from_arrays([pa.array(want[part][same]), pa.array(tokens, pa.binary())], ["cls", "tokens"])

    sets = texts.select("cls", "text").mapInArrow(run, "cls long, tokens binary")
    return members.join(sets, "cls")


def links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components that meet inside a block, the least of them (a) with each other one; exact counts decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 2):
            sets = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            comp = t["comp"].to_pylist()
            roots, least = Roots(comp), {}
            for a, b in possible_pairs(n, [bitmap(x) for x in sets], percent, roots):
                if roots.find(a) != roots.find(b) and linked(sets[a], sets[b], percent):
                    roots.join(a, b)
            for i, c in enumerate(comp):
                root = roots.find(i)
                least[root] = min(least.get(root, c), c)
            out = {(a, c) for i, c in enumerate(comp) if (a := least[roots.find(i)]) != c}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(out))], ["a", "b"])

    rows = members.select("block", "part", "cls", "comp", "tokens")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, "a long, b long")


def parts(members: DataFrame, wide: bool) -> DataFrame:
    """Add ``part``: blocks of more than ``BLOCK`` sets are dealt out.

    The members of the block's smallest component are its lead; they are connected with one another. Where
    ``wide``, every pair with one that is not in the lead meets in some part; else each part has a share of the
    lead and one of the others, which is linear and leaves the rest to the next round.
    """
    lead = F.col("comp") == F.col("least")
    sizes = (
        members.groupBy("block").agg(F.count_if(lead).alias("lead_n"), F.count_if(~lead).alias("rest_n"))
        .where(F.col("lead_n") + F.col("rest_n") > BLOCK)
    )
    half = BLOCK // 2
    joined = members.join(sizes, "block", "left")
    kl, kr = (F.ceil(F.coalesce(c, F.lit(0)) / half) for c in ("lead_n", "rest_n"))
    own = F.pmod(F.xxhash64("cls"), F.greatest(F.when(lead, kl).otherwise(kr), F.lit(1)))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    span = F.lit(1 << 20)
    if wide:
        of_lead = F.transform(upto(kr), lambda i: i * span + kr + own)
        with_lead = F.transform(upto(kl), lambda j: own * span + kr + j)
        with_rest = F.transform(upto(kr), lambda j: F.least(own, j) * span + F.greatest(own, j))
        dealt = F.when(lead, of_lead).otherwise(F.concat(with_lead, with_rest))
    else:
        dealt = F.sequence(own, F.greatest(kl, kr) - 1, F.when(lead, kl).otherwise(kr))
    one = F.array(F.lit(0).cast("bigint"))
    return joined.withColumn("part", F.explode(F.when(F.col("lead_n").isNull(), one).otherwise(dealt))).drop("lead_n", "rest_n")


def relabelled(found: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) of components, a < b: each b takes its least a, and that one's in turn; stored.

    Nodes with one component are connected; that connected nodes have one is for ``components``.
    """
    up = more.groupBy("b").agg(F.min("a").alias("m"))
    far = up.join(up.select(F.col("b").alias("m"), F.col("m").alias("next")), "m", "left").select("b", F.coalesce("next", "m").alias("m"))
    moved = found.join(far.withColumnRenamed("b", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    new = far.select(F.col("b").alias("node"), F.col("m").alias("component"))
    return stored(moved.union(new).groupBy("node").agg(F.min("component").alias("component")), "ngrams-labels")


def once_each(members: DataFrame) -> DataFrame:
    """Of blocks (or parts) with the same members only one; stored."""
    same = members.groupBy("block", "part").agg(
        F.count("*").alias("m"), F.bit_xor("cls").alias("x"), F.bit_xor(F.xxhash64("cls")).alias("y")
    )
    kept = same.groupBy("m", "x", "y").agg(F.min(F.struct("block", "part")).alias("one")).select("one.block", "one.part")
    return stored(members.join(kept, ["block", "part"]), "ngrams-once")


def put_together(members: DataFrame) -> DataFrame:
    """Blocks that overlap become one, so that a set is fetched once.

    Members take the least node of their blocks, and of the blocks of these, and once more. Blocks whose members
    then agree go together, where these are ``BLOCK`` sets at most; the others stay.
    """
    label = members.select("node", F.col("node").alias("whole")).distinct()
    for _ in range(3):
        ends = members.select("block", "part", "node").join(label, "node").groupBy("block", "part").agg(F.min("whole").alias("whole"))
        label = stored(members.select("block", "part", "node").join(ends, ["block", "part"]).groupBy("node").agg(F.min("whole").alias("whole")), "ngrams-overlaps")
    named = members.join(label, "node")
    agreed = named.groupBy("block", "part").agg(F.min("whole").alias("least"), F.max("whole").alias("most"))
    named = stored(named.join(agreed, ["block", "part"]).withColumn("one", F.col("least") == F.col("most")).drop("least", "most"), "ngrams-sized")
    sizes = named.where("one").select("whole", "cls").distinct().groupBy("whole").agg(F.count("*").alias("m"))
    fitting = stored(sizes.where(F.col("m") <= BLOCK), "ngrams-fitting")
    sized = named.join(checked_broadcast(fitting), "whole", "left").withColumn("one", F.col("one") & F.col("m").isNotNull())
    small = sized.where("one").select(F.col("whole").alias("block"), F.lit(-1).cast("bigint").alias("part"), "cls", "node", "comp")
    return stored(small.distinct().union(once_each(sized.where("not one").select(*members.columns))), "ngrams-together")


def joined(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id``: the smallest doc_id reachable over links, its own without any. A text without words (or
    null) is linked with nothing. Rows that repeat a doc_id are one document, linked where any of its texts is.
    A row without doc_id has no component and links nothing.
    """
    signed = stored(signatures(docs, sketch(docs, size), size, percent), "ngrams-signatures")
    live = signed.where("n > 0 and doc_id is not null")
    several = stored(
        live.groupBy("a", "b", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"),
        "ngrams-classes",
    )
    copies = live.select("doc_id", "a", "b", "n").join(several, ["a", "b", "n"]).where("doc_id <> least")
    same = copies.select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    sets = live.join(checked_broadcast(several), ["a", "b", "n"], "left").where("least is null or least = doc_id").select(
        F.col("a").alias("cls"), F.col("doc_id").alias("node"), "n", "prefix", "bits"
    )

    def labelled(found: DataFrame) -> DataFrame:
        return sets.join(checked_broadcast(found), "node", "left").select("cls", "node", F.coalesce("component", "node").alias("comp"), "n", "prefix", "bits")

    def linked_in(members: DataFrame, wide: bool) -> DataFrame:
        dealt = parts(stored(members, "ngrams-members"), wide)
        left = stored(survivors(dealt, percent), "ngrams-survivors")
        return links(with_sets(docs, put_together(left) if wide else left, size), percent)

    found = stored(same.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "ngrams-labels")
    edges = [same]
    for r in range(ROUNDS):
        one = F.array_min(F.transform("prefix", lambda t: F.xxhash64(t, F.lit(r)))).alias("block")  # noqa: B023
        heads = labelled(found).select(one, "cls", "node", "comp", "n", "bits")
        met = heads.groupBy("block").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
        edges.append(stored(linked_in(heads.join(met.drop("most"), "block"), False), "ngrams-links"))
        found = relabelled(found, edges[-1])
    found = components(reduce(DataFrame.union, edges), "ngrams-components")

    last = labelled(found)
    keys = last.select(F.explode("prefix").alias("block"), "cls", "comp")
    mixed = (
        keys.groupBy("block")
        .agg(
            F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"),
            F.bit_xor("cls").alias("x"), F.bit_xor(F.xxhash64("cls")).alias("y"),
        )
        .where("least < most").groupBy("m", "x", "y").agg(F.min("block").alias("block"), F.min("least").alias("least"))
    )
    chosen = stored(mixed.select("block", "least"), "ngrams-blocks")
    held = stored(keys.select("block", "cls").join(checked_broadcast(chosen), "block"), "ngrams-held")
    more = linked_in(held.join(last.select("cls", "node", "comp", "n", "bits"), "cls"), True)
    final = components(more, "ngrams-components").select(F.col("node").alias("component"), F.col("component").alias("further"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")).join(final, "component", "left")
        .select("doc_id", "n_shingles", F.coalesce("further", "component").alias("component_id"))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that are linked to a document with a smaller id; rows without doc_id stay."""
    found = joined(docs.select("doc_id", "text"), **options)
    others = stored(found.where("component_id < doc_id").select(F.col("doc_id").alias("__ng_id")).distinct(), "ngrams-others")
    return docs.join(checked_broadcast(others), docs["doc_id"].cast("bigint") == F.col("__ng_id"), "left_anti")
