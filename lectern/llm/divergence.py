"""Divergence of each source's word use from its language's, by in-mapper stripes.

A stripe is what is known of one term of one language: its document frequency and its
count in each source. A task folds whole documents into a hash table of stripes; when
the table holds ``CELLS`` counts it spills, and begins anew. Spilled stripes are dealt by
language and term, sorted and merged as they come, so a term that every document holds
costs one row for each spill and no group is ever gathered. Merged stripes give the
divergences directly: groups of stripes of one language meet the totals of its sources,
a large language in as many groups as its counts need, and each group folds its stripes
into sums for pairs of sources and the leading terms of each source.

A language with more than ``BLOCK`` sources is compared block by block; a group then
holds the counts of two blocks alone.

Defined results: a null language or source is the empty one, a null text has no terms.
A term is a run of ASCII letters and of signs beyond ASCII, A-Z read as a-z, compared
byte by byte. Every language and source that occurs is compared, with or without terms.
Rows that repeat count again; doc_id is not used. Equal values are ranked by item, in
byte order. A language without kept terms has pairs of value 0 and no terms. An empty
table has no rows. A long text is counted in slices, with its distinct terms in memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checked_broadcast, stored

#: A kept term stands in so many documents of its language at least.
LEAST_DOCUMENTS = 30
#: Shares are in billionths; so much is added to each count.
UNIT, ADDED = 1_000_000_000, 5
TERMS = 50
#: Counts that a task holds before it spills, bytes of a text counted at once, sources of a block, counts of a group.
CELLS, SLICE, BLOCK, GROUP = 400_000, 4_000_000, 256, 1_000_000
_STRIPE = "lang string, term binary, df long, sources array<string>, counts array<long>"
_NAMES = ["lang", "term", "df", "sources", "counts"]


def _term_bytes() -> bytes:
    """Translates A-Z to a-z and what is no term to a space."""
    keep = bytearray(b" " * 256)
    keep[128:] = range(128, 256)
    for i in range(26):
        keep[ord("a") + i] = keep[ord("A") + i] = ord("a") + i
    return bytes(keep)


TERM_BYTES = _term_bytes()


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term; the text is cut between terms."""
    text, counts, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def _rows(lang: list[str], term: list[bytes], df: list[int], ends: list[int], sources: list[str], counts: list[int]) -> pa.RecordBatch:
    offsets = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang, pa.string()),
            pa.array(term, pa.binary()),
            pa.array(df, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        _NAMES,
    )


def _spilled(tables: dict[str, dict[bytes, dict]]) -> Iterator[pa.RecordBatch]:
    """The stripes of a task; each stripe has its document frequency under None."""
    for lang, stripes in tables.items():
        terms = list(stripes)
        for i in range(0, len(terms), 20_000):
            df, ends, sources, counts = [], [0], [], []
            for term in terms[i : i + 20_000]:
                stripe = stripes[term]
                df.append(stripe.pop(None))
                sources += stripe.keys()
                counts += stripe.values()
                ends.append(len(sources))
            yield _rows([lang] * len(df), terms[i : i + 20_000], df, ends, sources, counts)


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents (text, lang, source) into stripes."""
    tables: dict[str, dict[bytes, dict]] = {}
    cells = 0
    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, lang, source in zip(batch.column(0), langs, sources, strict=True):
            stripes = tables.setdefault(lang, {})
            for term, n in term_counts(text.as_py()).items():
                stripe = stripes.get(term)
                if stripe is None:
                    stripes[term] = {None: 1, source: n}
                    cells += 1
                else:
                    stripe[None] += 1
                    if source in stripe:
                        stripe[source] += n
                    else:
                        stripe[source] = n
                        cells += 1
            if cells > CELLS:
                yield from _spilled(tables)
                tables, cells = {}, 0
    yield from _spilled(tables)


def _parents(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of a column of lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _merge(t: pa.Table) -> pa.RecordBatch:
    """Neighbouring stripes of one language and term put together."""
    lang, term, df, sources, counts = (t.column(c).combine_chunks() for c in _NAMES)
    new = np.ones(len(t), bool)
    differs = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
    new[1:] = differs.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    key = np.cumsum(new) - 1
    cell_key = key[_parents(counts)]
    code = sources.flatten().dictionary_encode()
    names, cell = code.dictionary, code.indices.to_numpy().astype(np.int64)
    cell, where = np.unique(cell_key * max(1, len(names)) + cell, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, where, counts.flatten().to_numpy())
    cell_key, cell = cell // max(1, len(names)), cell % max(1, len(names))
    offsets = pa.array(np.searchsorted(cell_key, np.arange(len(first) + 1)).astype(np.int32))
    kept = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [
            lang.take(kept),
            term.take(kept),
            pa.array(np.add.reduceat(df.to_numpy(), first)),
            pa.ListArray.from_arrays(offsets, names.take(pa.array(cell))),
            pa.ListArray.from_arrays(offsets, pa.array(total)),
        ],
        _NAMES,
    )


def merged(least: int):
    """Stripes sorted by language and term into one for each; those of fewer documents are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last stripe, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch.cast(rest.schema)])
            done = _merge(t)
            rest = done.slice(len(done) - 1)
            done = done.slice(0, len(done) - 1)
            yield done.filter(pc.greater_equal(done.column("df"), least))
        if rest is not None:
            yield rest.filter(pc.greater_equal(rest.column("df"), least))

    return run


def stripes(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term as bytes, df, sources, counts) of each term kept; stored."""
    texts = docs.select(
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    spilled = texts.mapInArrow(folded, _STRIPE)
    dealt = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return stored(dealt.mapInArrow(merged(least), _STRIPE), "divergence-stripes")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / total), exact for totals below 9 * 10**15: a long division in steps of 1,000."""
    rest, out = count + ADDED, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


_OUT = "lang string, source string, part string, item binary, value long"


def _result(lang: list[str], source: list[str], part: str, item: list[bytes], value: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(lang), pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def compared(terms: int):
    """One group of stripes with the totals of two blocks of sources: sums for pairs, and leading terms where the blocks are one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):  # no source hashes to this pair of blocks
            return _result([], [], "", [], np.empty(0, np.int64)).schema.empty_table()
        lang = right.column("lang")[0].as_py()
        same = right.column("bi")[0].as_py() == right.column("bj")[0].as_py()
        names = right.column("source").to_pylist()
        place = {s: i for i, s in enumerate(names)}
        block = right.column("block").to_numpy()
        rows, columns = np.flatnonzero(block == right.column("bi")[0].as_py()), np.flatnonzero(block == right.column("bj")[0].as_py())
        extra = ADDED * right.column("terms")[0].as_py()
        totals = right.column("n").to_numpy() + extra
        whole = right.column("lang_n")[0].as_py() + extra
        term, lang_count = left.column("term").combine_chunks(), left.column("total").to_numpy()
        pairs = np.zeros((len(rows), len(columns)), np.int64)
        best: list[tuple[np.ndarray, list[bytes]]] = [(np.empty(0, np.int64), []) for _ in rows]
        step = max(1, GROUP // max(1, len(names)))
        sources, counts = left.column("sources").combine_chunks(), left.column("counts").combine_chunks()
        for i in range(0, len(left), step):
            some = counts.slice(i, step)
            n = len(some)
            dense = np.zeros((n, len(names)), np.int64)
            code = sources.slice(i, step).flatten().dictionary_encode()
            to = np.array([place[s] for s in code.dictionary.to_pylist()], np.int64)
            if len(to):
                dense[_parents(some), to[code.indices.to_numpy()]] = some.flatten().to_numpy()
            p = share(dense, totals[None, :])
            for a, r in enumerate(rows):
                pairs[a] += np.abs(p[:, columns] - p[:, r : r + 1]).sum(0)
            if not same:
                continue
            ahead = p - share(lang_count[i : i + n], np.int64(whole))[:, None]
            for a, r in enumerate(rows):
                at = np.flatnonzero((dense[:, r] > 0) & (ahead[:, r] > 0))
                value = np.concatenate([best[a][0], ahead[at, r]])
                if len(value) > terms:  # all that reach the value of the last rank, then by item
                    held = value >= np.partition(value, len(value) - terms)[len(value) - terms]
                    old = len(best[a][0])
                    items = [x for x, k in zip(best[a][1], held[:old], strict=True) if k] + term.take(pa.array(at[held[old:]] + i)).to_pylist()
                    order = sorted(zip((-value[held]).tolist(), items, strict=True))[:terms]
                    best[a] = np.array([-v for v, _ in order], np.int64), [x for _, x in order]
                else:
                    best[a] = value, best[a][1] + term.take(pa.array(at + i)).to_pylist()
        out = []
        of = lambda at: [names[i] for i in at]
        for a, r in enumerate(rows):
            others = np.flatnonzero(columns != r)
            item = of(columns[others])
            out.append(_result([lang] * len(item), [names[r]] * len(item), "pair", [x.encode() for x in item], pairs[a, others]))
            if not same:
                out.append(_result([lang] * len(item), item, "pair", [names[r].encode()] * len(item), pairs[a, others]))
            out.append(_result([lang] * len(best[a][1]), [names[r]] * len(best[a][1]), "term", best[a][1], best[a][0]))
        return pa.Table.from_batches(out) if out else _result([], [], "", [], np.empty(0, np.int64)).schema.empty_table()

    return run


def audited(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, terms: int = TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows against each other source of the language, all ranks; ``term`` rows to rank ``terms``."""
    held = stripes(docs, least)
    groups = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    ).distinct()
    counted = held.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(
        F.sum("c.counts").alias("n")
    )
    groups = stored(groups.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    of_lang = held.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("counts")).alias("cells"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("in_lang"), F.sum("n").alias("lang_n")).join(of_lang, "lang", "left").select(
        "lang",
        "lang_n",
        F.coalesce("terms", F.lit(0)).alias("terms"),
        F.ceil(F.col("in_lang") / block).cast("int").alias("blocks"),
        F.ceil(F.coalesce(F.col("cells"), F.lit(1)) / GROUP).cast("int").alias("parts"),
    )
    langs = checked_broadcast(stored(langs, "divergence-langs"))
    of_block = lambda source: F.pmod(F.xxhash64(source), F.col("blocks")).cast("int")
    upto = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = (
        held.join(langs.select("lang", "blocks", "parts"), "lang")
        .withColumn("bi", F.explode(upto))
        .withColumn("bj", F.explode(F.sequence("bi", F.col("blocks") - 1)))
        .withColumn("c", F.filter(F.arrays_zip("sources", "counts"), lambda c: of_block(c["sources"]).isin(F.col("bi"), F.col("bj"))))
        .select(
            "lang",
            "bi",
            "bj",
            F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part_no"),
            "term",
            F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
            F.col("c.sources").alias("sources"),
            F.col("c.counts").alias("counts"),
        )
    )
    right = (
        groups.join(langs, "lang")
        .withColumn("block", of_block("source"))
        .withColumn("other", F.explode(upto))
        .withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "part_no", "block", "source", "n", "terms", "lang_n")
    )
    by = ["lang", "bi", "bj", "part_no"]
    found = stored(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compared(terms), _OUT), "divergence-found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order))]
    ranked.append(found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms))
    return ranked[0].unionByName(ranked[1]).withColumn("item", F.col("item").cast("string"))
