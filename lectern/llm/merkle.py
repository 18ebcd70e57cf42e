"""Merkle trees over sections, paragraphs and pieces of a text, as column expressions.

A text is cut at line feeds into paragraphs, a paragraph into pieces of up to 16
words. A paragraph whose hash falls on one in eight (or that is blank) closes a
section, so sections move with their content when text is put in before them. A
node's hash is SHA-256 over its children's; the root covers every code point:
equal roots mean equal texts. Only functions of the engine are used.

Null texts are empty texts; an empty text is one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.operators.ordered import neighbour

PIECE_WORDS = 16
#: Hexadecimal digits kept of the nodes below the root.
DIGITS = 10
#: Words with the white space behind them, or white space at the start.
PIECE = rf"\S+(?:\s+\S+){{0,{PIECE_WORDS - 1}}}\s*|\s+"


def tree(text: Column) -> Column:
    """paragraphs: array of struct(hash, pieces) of a text that is not null."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda p: F.struct(
            F.sha2(p, 256).substr(1, DIGITS).alias("hash"),
            F.transform(
                F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256).substr(1, DIGITS)
            ).alias("pieces"),
        ),
    )


def section_ends(paragraphs: Column) -> Column:
    """1-based positions of the paragraphs that close a section; the last always does."""
    n = F.size(paragraphs)
    closes = lambda i: (
        (i == n) | F.element_at(paragraphs, i)["hash"].substr(DIGITS, 1).isin("0", "8") | (F.size(F.element_at(paragraphs, i)["pieces"]) == 0)
    )
    return F.filter(F.sequence(F.lit(1), n), closes)


def with_tree(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: struct(root, sections) where sections is array of struct(hash, first, paragraphs)."""
    p, e, s = f"__{name}_p", f"__{name}_e", f"__{name}_s"
    kept = list(df.columns)
    df = df.withColumn(p, tree(F.coalesce(text, F.lit(""))))
    df = df.withColumn(e, section_ends(F.col(p)))

    def section(end: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(1)).otherwise(F.element_at(F.col(e), i) + 1)
        inside = F.slice(F.col(p), first, end - first + 1)
        whole = F.sha2(F.concat_ws(",", F.transform(inside, lambda x: x["hash"])), 256).substr(1, DIGITS)
        return F.struct(whole.alias("hash"), first.alias("first"), inside.alias("paragraphs"))

    df = df.withColumn(s, F.transform(F.col(e), section))
    root = F.sha2(F.concat_ws(":", F.sha2(F.coalesce(text, F.lit("")), 256), F.concat_ws(",", F.col(s)["hash"])), 256)
    return df.select(*kept, F.struct(root.alias("root"), F.col(s).alias("sections")).alias(name))


def fingerprint(made: Column) -> Column:
    """root|section;paragraph,piece,piece;... as text."""
    paragraph = lambda x: F.concat_ws(",", x["hash"], F.concat_ws(",", x["pieces"]))
    section = lambda x: F.concat_ws(";", x["hash"], F.concat_ws(";", F.transform(x["paragraphs"], paragraph)))
    return F.concat_ws("|", made["root"], F.concat_ws("|", F.transform(made["sections"], section)))


def pieces(print_: Column) -> Column:
    """The piece hashes that a fingerprint holds: hashes that follow a comma, once each."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(",([0-9a-f]+)"), F.lit(1)))


def likeness(a: Column, b: Column, pieces_a: Column, pieces_b: Column) -> Column:
    """1 for equal roots, else the Dice share of the pieces that both fingerprints hold, below 1."""
    total = F.size(pieces_a) + F.size(pieces_b)
    shared = 2.0 * F.size(F.array_intersect(pieces_a, pieces_b))
    same = F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1)
    return F.when(same, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.least(shared / total, F.lit(0.999999)))


def changed(old: Column, new: Column) -> Column:
    """Where two trees differ: 1-based paragraph positions in ``new`` under sections that ``old`` lacks.

    Sections with a hash known to the old tree are skipped whole; inside the others the
    paragraphs with unknown hashes are listed.
    """
    known = old["sections"]["hash"]
    held = F.flatten(F.transform(old["sections"], lambda s: s["paragraphs"]["hash"]))
    inside = lambda s: F.filter(
        F.transform(s["paragraphs"]["hash"], lambda h, i: F.when(~F.array_contains(held, h), s["first"] + i)),
        lambda x: x.isNotNull(),
    )
    return F.flatten(F.transform(F.filter(new["sections"], lambda s: ~F.array_contains(known, s["hash"])), inside))


def next_by_id(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and for the smallest id the largest; ids distinct, not null."""
    levelled = ids.select(
        "doc_id", F.shiftright("doc_id", 24).alias("__c"), F.shiftright("doc_id", 12).alias("__b"), F.lit(0).alias("__k")
    )
    near = neighbour(levelled, ["__k"], [["__c"], ["__b"], ["doc_id"]], F.struct(F.col("doc_id").alias("i")), "__n")
    last = ids.agg(F.max("doc_id").alias("__m"))
    return near.join(F.broadcast(last)).select("doc_id", F.coalesce(F.col("__n")["i"], F.col("__m")).alias("next_id"))


NO_ID = -(1 << 63)


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    made = f"__{name}_t"
    return with_tree(df, text, made).withColumn(name, fingerprint(F.col(made))).drop(made)


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint of each row.

    ``edited``: the last floor(n/3) code points replaced by the first as many (or all) of the next
    document's, which is the one with the next smaller doc_id, and for the smallest the one with the
    largest. A missing doc_id counts as smaller than all others. Of rows that repeat a doc_id, the
    one with the least opening stands for them as a next document. A single document is its own next.

    Texts are dealt by doc_id once: the join that takes the openings and the join that puts them
    to use read the same exchange, which also holds the fingerprint, made once for each text.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sizes = stored(rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")), "merkle-sizes")
    order = next_by_id(sizes.select("doc_id"))
    needs = order.join(sizes, "doc_id").select(
        "next_id", F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 3).cast("int").alias("need")
    )
    dealt = with_fingerprint(rows, F.col("text"), "fingerprint").repartition("doc_id")
    heads = (
        dealt.join(needs, F.col("doc_id") == F.col("next_id"))
        .select("for_id", F.col("text").substr(F.lit(1), F.col("need")).alias("head"), "fingerprint")
        .groupBy("for_id")
        .agg(F.min(F.struct("head", "fingerprint")).alias("next"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    both = dealt.join(heads, F.col("doc_id") == F.col("for_id")).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "text",
        F.concat(
            F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next.head").substr(F.lit(1), third)
        ).alias("edited"),
        "fingerprint",
        F.col("next.fingerprint").alias("next_fingerprint"),
    )
    return with_fingerprint(both, F.col("edited"), "edited_fingerprint")


def compared(docs: DataFrame) -> DataFrame:
    """The digest columns of ``edits``, with the likeness of each fingerprint to the edited and the next one."""
    df = edits(docs).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "next_fingerprint",
    )
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        df = df.withColumn(f"__{name}", pieces(F.col(name)))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), F.col("__fingerprint"), F.col(f"__{other}"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"),
    )
