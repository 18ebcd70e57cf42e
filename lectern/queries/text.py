"""Text queries: rules over sentences composed from orders, and over the documents."""

from pyspark.sql import functions as F

from lectern.functions import lexicon as X
from lectern.functions import numbers as N
from lectern.functions import segment as G
from lectern.functions.normalize import RULESETS, default_registry
from lectern.operators.catalog import LANGUAGE_ROUTING
from lectern.queries import sqltext as Q
from lectern.queries.registry import query, table, texts
from lectern.queries.views import sql
from lectern.session import spread
from lectern.sources import model as M

NUMERALS = ["I", "IV", "IX", "XIV", "XIX", "XL", "XLIX", "XC", "CD", "MCMXCIV", "IIX", "CLXVI"]
SUFFIXES = ["st", "nd", "rd", "th"]

_PIECES = f"""SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, {Q.words(NUMERALS)}[o_orderkey % 12 + 1] AS rom,
  {Q.words(SUFFIXES)}[o_orderkey % 4 + 1] AS suffix, o_orderkey % 31 + 1 AS day, (o_orderkey % 1000) // 10 || '.' || o_orderkey % 10 AS pct,
  (o_orderkey % 97) || '.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS weight,
  format('{{:,}}', CAST(round(o_totalprice * 100) AS BIGINT) // 100) AS big, lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS small,
  format('{{:,}}', o_orderkey * 977) AS lot FROM orders"""
_SENTENCES = {
    "en": """'Volume ' || rom || ':  Mr. Smith & “Co” paid $' || big || '.' || small || ' i.e. ' || pct || '% of £' || c || ' on the ' || day || suffix || '… in '
  || y || ', or ' || y || '–' || (y + 1) || '; lot ' || lot || ' of ' || weight || ' NEVER NASA, etc. for €' || weight || '.'""",
    "de": """'Kapitel ' || rom || ':  „Nr. ' || c || '” kostete ' || replace(big, ',', '.') || ',' || small || ' € bzw. $' || big || '.' || small || ' am ' || day || '. Mai '
  || y || ' & ' || y || '-' || (y + 1) || '; ' || replace(pct, '.', ',') || '% von ' || replace(lot, ',', '.') || ' NIEMALS USA, z.B. ' || replace(weight, '.', ',') || ' oder £' || c || '. Usw.'""",
    "pl": """'Rozdział ' || rom || ':  np. ' || replace(big, ',', ' ') || ',' || small || ' zł itd. lub €' || big || '.' || small || ' & $' || c || ' w '
  || y || ' roku, ' || y || '—' || (y + 1) || '; ' || replace(pct, '.', ',') || '% z ' || replace(lot, ',', '.') || ' NIGDY USA, m.in. ' || replace(weight, '.', ',') || ' „tak”. Tj. £' || weight || '.'""",
    "zh": """'第' || k || '章：  价格是$' || big || '.' || small || '，' || c || ' CNY，' || pct || '%，' || y || '年，' || y || '-' || (y + 1) || '，共' || (k * 977) || '人，' || weight || '和¥' || c || '。'""",
}


def sentences_of(spark, sf, language):
    """One sentence per order, full of numbers."""
    o = spread(table(spark, sf, "orders"), "o_orderkey", pieces=8)
    cents = M.cents(F.col("o_totalprice"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = o.select(
        k.alias("k"), c.alias("c"), F.year("o_orderdate").alias("y"),
        F.get(F.lit(NUMERALS), (k % 12).cast("int")).alias("rom"), F.get(F.lit(SUFFIXES), (k % 4).cast("int")).alias("suffix"),
        (k % 31 + 1).alias("day"), F.concat(F.floor(k % 1000 / 10), F.lit("."), k % 10).alias("pct"),
        F.concat(k % 97, F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0")).alias("weight"),
        F.format_number(F.floor(cents / 100), 0).alias("big"), F.lpad((cents % 100).cast("string"), 2, "0").alias("small"),
        F.format_number(k * 977, 0).alias("lot"),
    )
    # The same concatenation in both engines.
    return p.select("k", F.expr(_SENTENCES[language].replace("\n", " ")).alias("t"))


def _source(language):
    return f"SELECT k, {_SENTENCES[language]} AS t FROM pieces"


def _register_rules():
    for language, ruleset in RULESETS.items():
        for name, rule in ruleset.clean + ruleset.spoken:
            steps = Q.normalized(language, _source(language), [name])

            def run(spark, sf, language=language, rule=rule):
                return sentences_of(spark, sf, language).select("k", rule(F.col("t")).alias("t"))

            query(f"text_{language}_{name}", sql(f"SELECT k, t FROM {language}_out", pieces=_PIECES, **steps))(run)

        def whole(spark, sf, language=language, ruleset=ruleset):
            return sentences_of(spark, sf, language).select("k", ruleset.apply(F.col("t")).alias("t"))

        steps = Q.normalized(language, _source(language))
        query(f"normalize_{language}", sql(f"SELECT k, t FROM {language}_out", pieces=_PIECES, **steps))(whole)


_register_rules()


@query(
    "normalize_documents",
    sql(
        "SELECT doc_id, t AS text FROM en_out UNION ALL SELECT doc_id, t FROM de_out",
        **{
            **Q.normalized("en", "SELECT doc_id, text AS t FROM documents WHERE lang = 'en'"),
            **Q.normalized("de", "SELECT doc_id, text AS t FROM documents WHERE lang = 'de'"),
        },
    ),
)
def normalize_documents(spark, sf):
    """The documents are English, German, French and Spanish; the last two have no normalizer."""
    docs = texts(spark, sf, "documents").filter(F.col("lang").isin(list(LANGUAGE_ROUTING)))
    rules = default_registry(["en", "de"])
    return docs.select("doc_id", rules.normalize(F.col("text"), F.col("lang")).alias("text"))


@query(
    "normalizer_dispatch",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'en-1' WHEN 'de' THEN 'de-1' WHEN 'pl' THEN 'pl-1' WHEN 'zh' THEN 'zh-1' END AS version,
  CASE WHEN lang NOT IN ('en','de','pl','zh') THEN 'no normalizer for language ' || lang || ' (known: de, en, pl, zh)' END AS error FROM documents""",
)
def normalizer_dispatch(spark, sf):
    registry = default_registry()
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    rejected = registry.unsupported(docs).select("doc_id", "error")
    return docs.join(rejected, "doc_id", "left").select("doc_id", registry.version(F.col("language")).alias("version"), "error")


# ---------------------------------------------------------------- number words


def _numbers(spark, sf):
    li = spread(table(spark, sf, "orders"), "o_orderkey")
    # As decimals: the product passes the range of a bigint.
    key, customer = F.col("o_orderkey").cast("decimal(20,0)"), F.col("o_custkey").cast("decimal(20,0)")
    big = key * key * customer
    year = F.year("o_orderdate") - F.col("o_custkey") % 800
    return li.select(
        "o_orderkey", big.cast("string").alias("big"), (F.col("o_orderkey") % 10000).cast("string").alias("small"),
        F.rpad((F.col("o_orderkey") % 10000).cast("string"), (4 + F.col("o_custkey") % 12).cast("int"), F.lit("0")).alias("round"),
        year.cast("string").alias("year"), F.concat(F.floor("o_totalprice"), F.lit("."), F.col("o_orderkey") % 1000).alias("amount"),
    )


_NUMBERS = """SELECT o_orderkey, CAST(o_orderkey * o_orderkey * o_custkey AS VARCHAR) AS big, CAST(o_orderkey % 10000 AS VARCHAR) AS small, rpad(CAST(o_orderkey % 10000 AS VARCHAR), CAST(4 + o_custkey % 12 AS INTEGER), '0') AS round,
  CAST(year(o_orderdate) - o_custkey % 800 AS VARCHAR) AS year, CAST(floor(o_totalprice) AS BIGINT) || '.' || o_orderkey % 1000 AS amount, n.* FROM orders, number_tables n"""


def _number_query(language, reader, cardinal, ordinal, year, money, currency):
    codes = {"en": "GBP", "de": "EUR", "pl": "PLN"}

    def run(spark, sf):
        return _numbers(spark, sf).select(
            "o_orderkey", reader.cardinal(F.col("big")).alias("cardinal"), reader.ordinal(F.col("small")).alias("ordinal"),
            reader.ordinal(F.col("big")).alias("big_ordinal"), reader.ordinal(F.col("round")).alias("round_ordinal"),
            reader.year(F.col("year")).alias("year"),
            reader.money(F.col("amount"), F.lit(codes[language]), [codes[language]]).alias("money"),
        )

    text = f"SELECT o_orderkey, {cardinal('big')} AS cardinal, {ordinal('small')} AS ordinal, {ordinal('big')} AS big_ordinal, {ordinal('round')} AS round_ordinal, {year('year')} AS year, {money} AS money FROM numbers"
    query(f"number_words_{language}", sql(text, number_tables=Q.NUMBER_TABLES, numbers=_NUMBERS))(run)


_number_query("en", N.ENGLISH, Q.en_cardinal, Q.en_ordinal, Q.en_year, Q._money("amount", Q.en_cardinal, Q._two_forms("'£'", Q.EN_MONEY), ", "), "£")
_number_query("de", N.GERMAN, Q.de_cardinal, Q.de_ordinal, Q.de_year, Q._money("amount", Q._de_money_cardinal, Q._two_forms("'€'", Q.DE_MONEY), " und "), "€")
_number_query("pl", N.POLISH, Q.pl_cardinal, Q.pl_ordinal, Q.pl_ordinal, Q._money("amount", Q.pl_cardinal, Q._pl_forms("'zł'"), ", "), "zł")


@query(
    "number_words_zh",
    sql(
        f"SELECT o_orderkey, {Q.zh_cardinal('big', N.ZH_MAX_DIGITS)} AS cardinal, {Q.zh_cardinal('amount', N.ZH_MAX_DIGITS)} AS amount, {Q.zh_direct('year')} AS direct FROM numbers",
        # The product of keys passes the range of a bigint.
        number_tables=Q.NUMBER_TABLES, numbers=_NUMBERS.replace("o_orderkey * o_orderkey", "CAST(o_orderkey AS HUGEINT) * o_orderkey"),
    ),
)
def number_words_zh(spark, sf):
    return _numbers(spark, sf).select(
        "o_orderkey", N.zh_cardinal(F.col("big")).alias("cardinal"), N.zh_cardinal(F.col("amount")).alias("amount"),
        N.zh_direct(F.col("year")).alias("direct"),
    )


_TOKENS = [*NUMERALS, "xiv", "ABC", "MMXXIV", "", "iX"]


@query(
    "roman_numerals",
    f"""SELECT l_orderkey, l_partkey, token, CASE WHEN regexp_matches(upper(token), '^[IVXLCDM]+$') THEN CAST({Q.roman('token')} AS BIGINT) END AS value
  FROM (SELECT l_orderkey, l_partkey, {Q.words(_TOKENS)}[l_partkey % 17 + 1] AS token FROM lineitem)""",
)
def roman_numerals(spark, sf):
    token = F.get(F.lit(_TOKENS), (F.col("l_partkey") % 17).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", token.alias("token"))
    return rows.withColumn("value", N.roman_value(F.col("token")).cast("bigint"))


# -------------------------------------------------------- lexicon and sentences


@query(
    "lexicon_applied",
    """SELECT doc_id, CASE WHEN quality = 0 THEN replace(b, '.', ' $.') ELSE b END AS text FROM (
  SELECT doc_id, quality, CASE WHEN toxic = 0 THEN regexp_replace(a, '([aeiou])nt', '\\1mt', 'g') ELSE a END AS b FROM (
    SELECT d.doc_id, quality, toxic, CASE WHEN quality = 1 THEN replace(text, 'the ', 'thee ') ELSE text END AS a
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))""",
)
def lexicon_applied(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), "text")
    ruled = X.with_lexicon(docs, M.lexicon(spark, sf))
    return ruled.select(F.col("book_id").alias("doc_id"), X.apply_lexicon(F.col("text"), F.col("lexicon")).alias("text"))


_SPLIT = f"SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, {Q.sentences('text')} AS a FROM documents)"


@query("sentences", _SPLIT)
def sentences(spark, sf):
    docs = texts(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(G.split_sentences(F.col("text"), F.col("lang"))).alias("pos", "sentence"))


@query(
    "packed_chunks",
    f"""SELECT doc_id, unnest(p) AS chunk, generate_subscripts(p, 1) - 1 AS pos FROM (
  SELECT doc_id, {Q.packed('a', 350)} AS p FROM (SELECT doc_id, {Q.sentences('text')} AS a FROM documents))""",
)
def packed_chunks(spark, sf):
    docs = texts(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(G.segment_text(F.col("text"), F.col("lang"))).alias("pos", "chunk"))
