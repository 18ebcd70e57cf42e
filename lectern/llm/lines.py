"""Line dedup by pairwise alignment.

Documents are paired with the earlier ones they overlap by shared lines: a rare line (held
by at most ``RARE`` documents) names every earlier document that holds it, a frequent one
the first, so that a document has at most ``RARE`` - 1 partners for each of its shared
lines. Each pair is aligned by patience diff over line hashes, and the blocks of
the alignment that hold a line that is not blank are deleted from the later document. All
is judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GAPS, checked_broadcast, content_key, stored

#: A line counts as evidence from so many code points on (without white space around it): every line that is not blank.
MIN_CHARS = 1
#: Most documents that hold a rare line.
RARE = 32
#: About so many of the pairs that name one partner read one copy of its lines.
SHARE = 64


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: longest increasing run of items unique in both, and recursively
    what lies between; equal items at both ends of each part are aligned first."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a: dict = {}
        for i in range(a0, a1):
            seen_a[a[i]] = -1 if a[i] in seen_a else i
        seen_b: dict = {}
        for j in range(b0, b1):
            seen_b[b[j]] = -1 if b[j] in seen_b else j
        both = [(i, seen_b[x]) for x, i in seen_a.items() if i >= 0 and seen_b.get(x, -1) >= 0]
        both.sort()
        chain = increasing(both)
        if not chain:
            continue
        i0, j0 = a0, b0
        for i, j in chain:
            out.append((i, j))
            work.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        work.append((i0, a1, j0, b1))
    out.sort()
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, whose second numbers rise."""
    from bisect import bisect_left

    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            at.append(n)
        else:
            ends[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def blocks(aligned: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """[first, end) of the runs of ``aligned`` that go on line by line in both, by position in the first."""
    n = 0
    while n < len(aligned):
        m = n + 1
        while m < len(aligned) and aligned[m][0] == aligned[m - 1][0] + 1 and aligned[m][1] == aligned[m - 1][1] + 1:
            m += 1
        yield aligned[n][0], aligned[m - 1][0] + 1
        n = m


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lines): one row per distinct text of a document, lines with their hashes; null ids and texts are left out."""
    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    line = lambda x: F.struct(
        F.xxhash64(F.btrim(x)).alias("h"), (F.length(F.btrim(x, F.lit(GAPS))) >= MIN_CHARS).alias("counts")
    )
    return rows.select(
        "doc_id", content_key(F.col("text")).alias("key"), F.transform(F.split("text", "\n", -1), line).alias("lines")
    )


def nominations(lines: DataFrame) -> DataFrame:
    """(doc_id, key, partner): the earlier documents to align with."""
    each = lines.select("doc_id", "key", F.explode("lines").alias("line")).where("line.counts").select(
        "doc_id", "key", F.col("line.h").alias("h")
    )
    held = stored(  # so that the join back has an exchange on both sides and frequent lines can be split
        each.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("df")).where("df > 1"),
        "lines-held",
    )
    shared = stored(each.join(held, "h"), "lines-shared")
    rare = shared.where(F.col("df") <= RARE)
    holders = rare.groupBy("h").agg(F.collect_set("doc_id").alias("holders"))  # at most RARE each
    earlier = F.filter("holders", lambda p: p < F.col("doc_id"))
    some = rare.where("first < doc_id").join(holders, "h").select("doc_id", "key", F.explode(earlier).alias("partner"))
    often = shared.where((F.col("df") > RARE) & (F.col("first") < F.col("doc_id"))).select("doc_id", "key", F.col("first").alias("partner"))
    return some.union(often).distinct()


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for mine, theirs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, counts = [x["h"] for x in mine], [x["counts"] for x in mine]
            cut: list[int] = []
            for first, end in blocks(patience(a, theirs)):
                if any(counts[first:end]):
                    cut += range(first, end)
            gone.append(cut)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "key", "gone"]
        )


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, key, gone): positions of the lines to delete, from 0."""
    lines = stored(line_rows(docs).distinct(), "lines-hashes")
    named = stored(nominations(lines), "lines-pairs")
    # Many documents may name one partner: its lines are dealt out under as many salts as its pairs need.
    sizes = stored(named.groupBy("partner").agg(F.ceil(F.count("*") / SHARE).alias("salts")), "lines-partners")
    salted = named.join(sizes, "partner").withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), "salts")).drop("salts")
    others = (
        lines.select(F.col("doc_id").alias("partner"), F.col("lines.h").alias("theirs")).join(sizes, "partner")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    )
    pairs = salted.join(others, ["partner", "salt"]).join(lines, ["doc_id", "key"])
    key = lines.schema["key"].dataType.simpleString()
    cut = pairs.select("doc_id", "key", "lines", "theirs").mapInArrow(align, f"doc_id long, key {key}, gone array<int>")
    return (
        cut.select("doc_id", "key", F.explode("gone").alias("at")).groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set("at")).alias("gone"))
    )


def deduplicated(docs: DataFrame, total: str = "lines_total", removed: str = "lines_removed") -> DataFrame:
    """All columns of ``docs``, ``text`` without the deleted lines, and the two counts (which replace columns of these names).

    A null text stays null, with 0 lines; a row without doc_id is left as it is and is no partner. Rows that repeat a
    doc_id never delete from one another. A text all of whose lines go becomes empty.
    """
    cut = stored(deletions(docs), "lines-deleted").select(
        F.col("doc_id").alias("__ld_id"), F.col("key").alias("__ld_key"), F.col("gone").alias("__ld_gone")
    )
    text = F.col("text").cast("string")
    joined = docs.join(
        checked_broadcast(cut, F.size("__ld_gone")),
        (docs["doc_id"].cast("bigint") == F.col("__ld_id")) & (content_key(text) == F.col("__ld_key")),
        "left",
    ).withColumn("__ld_lines", F.split(text, "\n", -1))
    size = F.coalesce(F.size("__ld_lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_gone"))
    kept = F.concat_ws("\n", F.transform(left, lambda i: F.get("__ld_lines", i)))
    new = {
        "text": F.when(F.col("__ld_gone").isNull(), text).otherwise(kept),
        total: F.when(text.isNull(), F.lit(0)).otherwise(size).cast("bigint"),
        removed: F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("bigint"),
    }
    names = [c for c in docs.columns if c not in (total, removed)] + [total, removed]
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in names])
