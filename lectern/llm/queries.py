"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


@query(
    "op1_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_merkle")
def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.merkle import compared

    return compared(table(spark, sf_dir, "documents"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.language import identified

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return identified(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def trains_quality() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import classified

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("quality_score")
    return classified(docs, labels, trains_quality()).select(
        "doc_id", (~trains_quality()).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


@query("op9_rules")
def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.rules import judged

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return judged(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.packing import digest, packed

    return digest(packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its ids, and whether they decode to its text."""
    import public_tokenizers

    from lectern.llm.pieces import decoded, encoded

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decoded(encoded(docs, model), model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op8_lines")
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those deleted, and the digest of what is left."""
    from lectern.llm.lines import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("lines_total").alias("n_lines"),
        F.col("lines_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query(
    "op4_passages",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM s),
    m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM k) WHERE least < doc_id),
    g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM m) GROUP BY doc_id),
    j AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
    n AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, gone FROM j),
    r AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM n LEFT JOIN (SELECT doc_id, unnest(gone) AS p, TRUE AS cut FROM j) USING (doc_id, p) WHERE cut IS NULL GROUP BY doc_id)
    SELECT j.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM j LEFT JOIN r USING (doc_id)""",
)
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.common import GAPS, WORD_GAP
    from lectern.llm.passages import deduplicated

    kept = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(GAPS)), WORD_GAP, " ")
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("words_total").alias("n_words"),
        F.col("words_removed").alias("n_removed"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


@query("op10_ngrams")
def op10_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.ngrams import joined

    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds unrolled: a{r} assigns every vector, c{r} are the centroids after it."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INT) AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, c, CAST({distance} AS BIGINT) AS d FROM v, c{r} AS c"
            " QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
        )
        if r < rounds:
            parts.append(
                f"s{r} AS MATERIALIZED (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i), "
                f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{r} LEFT JOIN "
                f"(SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{r} GROUP BY c) USING (c))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, c AS \"cluster\", d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} AS k USING (c)"
    )


@query("op13_centroids", _cluster_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.centroids import clustered, with_inertia

    return with_inertia(*clustered(table(spark, sf_dir, "embeddings")))


@query(
    "op12_decontamination",
    r"""WITH t AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), text FROM benchmark),
    w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
    i AS (SELECT id AS item, least(len(w), 10) AS n, w FROM w WHERE kind = 'i' AND len(w) > 0),
    k AS (SELECT DISTINCT item, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
    d AS (SELECT CAST(id AS BIGINT) AS doc_id, w FROM w WHERE kind = 'd'),
    o AS (SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
    h AS (SELECT doc_id, o.n, s, item FROM o JOIN k USING (k) WHERE o.n = k.n),
    p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.winnow import contaminated

    names = F.sort_array(F.col("items").cast("array<string>"))
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op11_divergence",
    r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    o AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
    v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
    gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS t FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
    p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (t + 5 * v) AS p
      FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
    ln AS (SELECT lang, sum(n) AS t FROM c GROUP BY lang),
    lp AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (max(t) + 5 * max(v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.divergence import audited

    return audited(table(spark, sf_dir, "documents"))
