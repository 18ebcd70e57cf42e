"""SQL text of number words and normalization rules, for the oracle side.

A rule is a CTE over the previous one: the text is cut at the matches of a
pattern and woven together again with each match rewritten.
"""

from __future__ import annotations

from itertools import count

_ids = count()


def bind(value: str, body) -> str:
    """Evaluate ``value`` once under a fresh lambda name."""
    v = f"v{next(_ids)}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(entries: list[str]) -> str:
    return "[" + ", ".join(q(e) for e in entries) + "]"


# Number words.
EN_U = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_T = "- ten twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_S = ["", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion", " sextillion"]
DE_U = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
DE_T = "- zehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
PL_U = "zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście dwanaście trzynaście czternaście piętnaście szesnaście siedemnaście osiemnaście dziewiętnaście".split()
PL_T = "- dziesięć dwadzieścia trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt siedemdziesiąt osiemdziesiąt dziewięćdziesiąt".split()
PL_H = "- sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset".split()
PL_UO = "zerowy pierwszy drugi trzeci czwarty piąty szósty siódmy ósmy dziewiąty dziesiąty jedenasty dwunasty trzynasty czternasty piętnasty szesnasty siedemnasty osiemnasty dziewiętnasty".split()
PL_TO = "- dziesiąty dwudziesty trzydziesty czterdziesty pięćdziesiąty sześćdziesiąty siedemdziesiąty osiemdziesiąty dziewięćdziesiąty".split()
PL_HO = "- setny dwusetny trzysetny czterysetny pięćsetny sześćsetny siedemsetny osiemsetny dziewięćsetny".split()


def _table(two: str, hundred: str, glue: str) -> str:
    return f"""SELECT list(w ORDER BY n) FROM (SELECT n, CASE WHEN n = 0 THEN '' WHEN n < 100 THEN {two} WHEN n % 100 = 0 THEN {hundred}
    ELSE {hundred} || '{glue}' || {two} END AS w FROM range(1000) r(n))"""


def _two(units: list[str], tens: list[str], joined: str) -> str:
    u, t = words(units), words(tens)
    return f"""CASE WHEN n % 100 < 20 THEN {u}[n % 100 + 1] WHEN n % 10 = 0 THEN {t}[n % 100 // 10 + 1]
      ELSE {joined.format(ten=f'{t}[n % 100 // 10 + 1]', unit=f'{u}[n % 10 + 1]')} END"""


_EN_TABLE = _table(_two(EN_U, EN_T, "{ten} || '-' || {unit}"), f"{words(EN_U)}[n // 100 + 1] || ' hundred'", " and ")
_DE_TABLE = _table(
    _two(DE_U, DE_T, "CASE WHEN n % 10 = 1 THEN 'ein' ELSE {unit} END || 'und' || {ten}"),
    f"CASE WHEN n // 100 = 1 THEN 'ein' ELSE {words(DE_U)}[n // 100 + 1] END || 'hundert'", "",
)
_PL_TABLE = _table(_two(PL_U, PL_T, "{ten} || ' ' || {unit}"), f"{words(PL_H)}[n // 100 + 1]", " ")
_PLO_TABLE = f"""SELECT list(w ORDER BY n) FROM (SELECT n, CASE WHEN n = 0 THEN '' WHEN n % 100 = 0 THEN {words(PL_HO)}[n // 100 + 1]
    ELSE CASE WHEN n >= 100 THEN {words(PL_H)}[n // 100 + 1] || ' ' ELSE '' END || {_two(PL_UO, PL_TO, "{ten} || ' ' || {unit}")} END AS w FROM range(1000) r(n))"""

PL_UC = "- jedno dwu trzy cztero pięcio sześcio siedmio ośmio dziewięcio dziesięcio jedenasto dwunasto trzynasto czternasto piętnasto szesnasto siedemnasto osiemnasto dziewiętnasto".split()
PL_TC = "- dziesięcio dwudziesto trzydziesto czterdziesto pięćdziesięcio sześćdziesięcio siedemdziesięcio osiemdziesięcio dziewięćdziesięcio".split()
PL_HC = "- stu dwustu trzystu czterystu pięćset sześćset siedemset osiemset dziewięćset".split()
_PLC_TABLE = _table(f"CASE WHEN n = 1 THEN '' ELSE {_two(PL_UC, PL_TC, '{ten} || {unit}')} END", f"{words(PL_HC)}[n // 100 + 1]", "")

NUMBER_TABLES = f"SELECT ({_EN_TABLE}) AS en, ({_DE_TABLE}) AS de, ({_PL_TABLE}) AS pl, ({_PLO_TABLE}) AS plo, ({_PLC_TABLE}) AS plc"


def _groups(d: str) -> str:
    return f"regexp_extract_all(lpad({d}, CAST(ceil(length({d}) / 3.0) * 3 AS INTEGER), '0'), '[0-9]{{3}}')"


def en_cardinal(x: str) -> str:
    def read(d: str) -> str:
        def joined(g: str) -> str:
            parts = (
                f"list_filter(list_transform({g}, lambda a, i: CASE WHEN a <> '000' THEN en[CAST(a AS INTEGER) + 1] || "
                f"{words(EN_S)}[len({g}) - i + 1] END), lambda z: z IS NOT NULL)"
            )
            return bind(
                f"array_to_string({parts}, ', ')",
                lambda t: f"CASE WHEN len({g}) > 1 AND regexp_matches({g}[len({g})], '^0(0[1-9]|[1-9][0-9])$') "
                f"THEN regexp_replace({t}, ', ([^,]*)$', ' and \\1') ELSE {t} END",
            )

        return f"CASE WHEN {d} = '' THEN 'zero' ELSE {bind(_groups(d), joined)} END"

    return bind(f"ltrim({x}, '0')", read)


def en_ordinal(x: str) -> str:
    special = {
        "one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth",
    }
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in special.items())
    return bind(
        en_cardinal(x),
        lambda w: f"regexp_replace({w}, '[a-z]+$', '') || CASE regexp_extract({w}, '[a-z]+$') {cases} "
        f"ELSE regexp_replace(regexp_extract({w}, '[a-z]+$'), 'y$', 'ie') || 'th' END",
    )


def en_year(x: str) -> str:
    c, r = f"CAST(substr({x}, 1, 2) AS INTEGER)", f"CAST(substr({x}, 3, 2) AS INTEGER)"
    return (
        f"CASE WHEN {c} = 20 THEN 'two thousand' || CASE WHEN {r} = 0 THEN '' ELSE ' ' || en[{r} + 1] END "
        f"WHEN {r} = 0 THEN en[{c} + 1] || ' hundred' WHEN {r} < 10 THEN en[{c} + 1] || ' oh ' || en[{r} + 1] "
        f"ELSE en[{c} + 1] || ' ' || en[{r} + 1] END"
    )


def de_cardinal(x: str) -> str:
    def group(v: str, i: str, n: str) -> str:
        k = f"({n} - {i})"
        return (
            f"CASE WHEN {v} = 0 THEN '' WHEN {k} = 0 THEN de[{v} + 1] WHEN {k} = 1 THEN CASE WHEN {v} = 1 THEN 'ein' ELSE de[{v} + 1] END || 'tausend' "
            f"WHEN {v} = 1 THEN 'eine ' || ['Million','Milliarde','Billion','Billiarde','Trillion'][{k} - 1] || ' ' "
            f"ELSE de[{v} + 1] || ' ' || ['Millionen','Milliarden','Billionen','Billiarden','Trillionen'][{k} - 1] || ' ' END"
        )

    def read(d: str) -> str:
        return f"CASE WHEN {d} = '' THEN 'null' ELSE " + bind(
            _groups(d),
            lambda g: f"rtrim(array_to_string(list_transform({g}, lambda a, i: {group('CAST(a AS INTEGER)', 'i', f'len({g})')}), ''))",
        ) + " END"

    return bind(f"ltrim({x}, '0')", read)


def de_ordinal(x: str) -> str:
    """Joined from the last two digits; a bare scale is rebuilt from its count."""
    irregular = "CASE {n} WHEN 1 THEN 'erste' WHEN 3 THEN 'dritte' WHEN 7 THEN 'siebte' WHEN 8 THEN 'achte' ELSE de[{n} + 1] || 'te' END"
    scales = "['', '', 'million', 'milliard', 'billion', 'billiard', 'trillion']"

    def read(d: str) -> str:
        n = f"CAST(right({d}, 2) AS INTEGER)"
        lead = lambda cut: f"lower({de_cardinal(cut)})"
        zeros = f"(length({d}) - length(rtrim({d}, '0'))) // 3"
        head = f"left({d}, length({d}) - 3 * ({zeros}))"
        count = f"CAST(right({head}, 3) AS INTEGER)"
        above = f"CASE WHEN length({head}) > 3 THEN lower({de_cardinal(f'(left({head}, length({head}) - 3) || repeat(chr(48), 3 + 3 * ({zeros})))')}) || ' ' ELSE '' END"
        first = f"CASE WHEN {count} > 1 THEN de[{count} + 1] WHEN length({head}) > 3 THEN 'ein' ELSE '' END"
        small = f"CASE WHEN length({d}) > 2 THEN {lead(f'(left({d}, length({d}) - 2) || chr(48) || chr(48))')} ELSE '' END"
        gap = f"CASE WHEN length({d}) > 6 AND left(right({d}, 6), 4) = '0000' THEN ' ' ELSE '' END"
        return (
            f"CASE WHEN {d} = '' THEN 'nullte' WHEN {n} BETWEEN 1 AND 19 THEN {small} || {gap} || {irregular.format(n=n)} "
            f"WHEN {zeros} >= 2 THEN {above} || {first} || {scales}[{zeros} + 1] || 'ste' "
            f"WHEN {d} IN ('100', '1000') THEN CASE {d} WHEN '100' THEN 'hundertste' ELSE 'tausendste' END ELSE {lead(d)} || 'ste' END"
        )

    return bind(f"ltrim({x}, '0')", read)


def de_year(x: str) -> str:
    c, r = f"CAST(substr({x}, 1, 2) AS INTEGER)", f"CAST(substr({x}, 3, 2) AS INTEGER)"
    return f"CASE WHEN substr({x}, 2, 1) = '0' THEN {de_cardinal(x)} ELSE de[{c} + 1] || 'hundert' || de[{r} + 1] END"


def _pl_class(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN 1 WHEN {n} % 10 BETWEEN 2 AND 4 AND {n} % 100 NOT BETWEEN 12 AND 14 THEN 2 ELSE 3 END"


def pl_cardinal(x: str) -> str:
    names = "[['tysiąc','tysiące','tysięcy'],['milion','miliony','milionów'],['miliard','miliardy','miliardów'],['bilion','biliony','bilionów'],['biliard','biliardy','biliardów'],['trylion','tryliony','trylionów']]"

    def group(v: str, k: str) -> str:
        return (
            f"CASE WHEN {v} = 0 THEN NULL WHEN {k} = 0 THEN pl[{v} + 1] WHEN {v} = 1 THEN {names}[{k}][1] "
            f"ELSE pl[{v} + 1] || ' ' || {names}[{k}][{_pl_class(v)}] END"
        )

    def read(d: str) -> str:
        return f"CASE WHEN {d} = '' THEN 'zero' ELSE " + bind(
            _groups(d),
            lambda g: f"array_to_string(list_filter(list_transform({g}, lambda a, i: {group('CAST(a AS INTEGER)', f'(len({g}) - i)')}), lambda z: z IS NOT NULL), ' ')",
        ) + " END"

    return bind(f"ltrim({x}, '0')", read)


def pl_ordinal(x: str) -> str:
    """The number less its last group that is not zero, and the word of that group with its scale."""
    scales = "['', 'tysięczny', 'milionowy', 'miliardowy', 'bilionowy', 'biliardowy', 'trylionowy']"

    def read(d: str) -> str:
        zeros = f"(length({d}) - length(rtrim({d}, '0'))) // 3"
        head = f"left({d}, length({d}) - 3 * ({zeros}))"
        last = f"CAST(right({head}, 3) AS INTEGER)"
        lead = pl_cardinal(f"(left({head}, greatest(length({head}) - 3, 0)) || repeat(chr(48), 3 + 3 * ({zeros})))")
        word = f"CASE WHEN {zeros} = 0 THEN plo[{last} + 1] ELSE plc[{last} + 1] || {scales}[{zeros} + 1] END"
        return f"CASE WHEN {d} = '' THEN 'zerowy' WHEN length({head}) > 3 THEN {lead} || ' ' || {word} ELSE {word} END"

    return bind(f"ltrim({x}, '0')", read)


def zh_cardinal(x: str, limit: int | None = None) -> str:
    """Whole part in groups of four, decimals digit by digit; a whole part of more than ``limit`` digits too."""

    def whole(d: str) -> str:
        def digit(i: str) -> str:
            k = f"(length({d}) - {i})"
            c = f"substr({d}, {i}, 1)"
            zero = f"CASE WHEN {i} > 1 AND substr({d}, {i} - 1, 1) = '0' THEN '零' ELSE '' END"
            spoken = f"CASE WHEN {c} <> '0' THEN {zero} || translate({c}, '0123456789', '零一二三四五六七八九') || ['','十','百','千'][{k} % 4 + 1] ELSE '' END"
            four = f"substr({d}, greatest({i} - 3, 1), least({i}, 4))"
            unit = f"CASE WHEN {k} = 8 THEN '亿' WHEN {k} IN (4, 12) AND regexp_matches({four}, '[1-9]') THEN '万' ELSE '' END"
            return f"{spoken} || {unit}"

        body = f"array_to_string(list_transform(range(1, length({d}) + 1), lambda i: {digit('i')}), '')"
        beyond = f"WHEN length({d}) > {limit} THEN {zh_direct(d)} " if limit else ""
        return f"CASE WHEN {d} = '' THEN '零' {beyond}ELSE regexp_replace({body}, '^一十', '十') END"

    integer = bind(f"ltrim(split_part({x}, '.', 1), '0')", whole)
    return f"{integer} || CASE WHEN contains({x}, '.') THEN '点' || translate(split_part({x}, '.', 2), '0123456789', '零一二三四五六七八九') ELSE '' END"


def zh_direct(x: str) -> str:
    return f"translate({x}, '0123456789', '零一二三四五六七八九')"


def _decimals(x: str, units: list[str], point: str, cardinal) -> str:
    """A number with an optional point; trailing zeros of the fraction are not read."""
    fraction = bind(
        f"regexp_replace(split_part({x}, '.', 2), '^(.+?)0+$', '\\1')",
        lambda f: f"array_to_string(list_transform(regexp_extract_all({f}, '[0-9]'), lambda c: {words(units)}[CAST(c AS INTEGER) + 1]), ' ')",
    )
    return f"{cardinal(f'split_part({x}, {q(chr(46))}, 1)')} || CASE WHEN contains({x}, '.') THEN ' {point} ' || {fraction} ELSE '' END"


def _money(number: str, cardinal, form, joiner: str) -> str:
    def read(t: str) -> str:
        w, s = f"split_part({t}, '.', 1)", f"ltrim(split_part({t}, '.', 2), '0')"
        return (
            f"{cardinal(w)} || ' ' || {form(w, 0)} || CASE WHEN {s} = '' THEN '' ELSE '{joiner}' || {cardinal(s)} || ' ' || {form(s, 1)} END"
        )

    return bind(f"CAST(CAST({number} AS DECIMAL(38,2)) AS VARCHAR)", read)


def _two_forms(sign: str, table: dict):
    def form(n: str, level: int) -> str:
        cases = " ".join(f"WHEN '{k}' THEN CASE WHEN {n} = '1' THEN '{v[level][0]}' ELSE '{v[level][1]}' END" for k, v in table.items())
        return f"CASE {sign} {cases} END"

    return form


EN_MONEY = {"$": (("dollar", "dollars"), ("cent", "cents")), "£": (("pound sterling", "pounds sterling"), ("penny", "pence")), "€": (("euro", "euro"), ("cent", "cents"))}
DE_MONEY = {"$": (("Dollar", "Dollar"), ("Cent", "Cent")), "£": (("Pfund", "Pfund"), ("Penny", "Pence")), "€": (("Euro", "Euro"), ("Cent", "Cent"))}
PL_MONEY = {
    "$": (("dolar amerykański", "dolary amerykańskie", "dolarów amerykańskich"), ("cent", "centy", "centów")),
    "£": (("funt szterling", "funty szterlingi", "funtów szterlingów"), ("pens", "pensy", "pensów")),
    "€": (("euro", "euro", "euro"), ("cent", "centy", "centów")),
    "zł": (("złoty", "złote", "złotych"), ("grosz", "grosze", "groszy")),
}


def _pl_forms(sign: str):
    def form(n: str, level: int) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {words(list(v[level]))}" for k, v in PL_MONEY.items())
        return f"(CASE {sign} {cases} END)[{_pl_class(f'CAST({n} AS BIGINT)')}]"

    return form


def _de_money_cardinal(x: str) -> str:
    return f"regexp_replace({de_cardinal(x)}, 'eins$', 'ein')"


def roman(x: str) -> str:
    """Value of a roman numeral by sums and differences of neighbours."""
    v = "list_transform(regexp_extract_all(upper({0}), '.'), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END)".format(x)
    return bind(
        v,
        lambda a: f"CAST(list_sum(list_transform({a}, lambda n, i: CASE WHEN n < coalesce(list_max({a}[i + 1:]), 0) THEN -n ELSE n END)) AS VARCHAR)",
    )


Y = "(?:1[0-9]{3}|2[0-9]{3})"


def rewrite(prev: str, pattern: str, body) -> str:
    p = q(pattern)
    woven = (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array(t, {p}), regexp_extract_all(t, {p})), "
        f"lambda z: z[1] || coalesce({bind('z[2]', body)}, '')), '')"
    )
    return f"SELECT * REPLACE (CASE WHEN regexp_matches(t, {p}) THEN {woven} ELSE t END AS t) FROM {prev}"


def replace(prev: str, expression: str) -> str:
    return f"SELECT * REPLACE ({expression} AS t) FROM {prev}"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def digits(h: str) -> str:
    return f"regexp_replace({h}, '[^0-9]', '', 'g')"


def number(h: str) -> str:
    return f"regexp_replace({h}, '[^0-9.]', '', 'g')"


def comma_number(h: str) -> str:
    return f"replace(regexp_replace({h}, '[^0-9,.]', '', 'g'), ',', '.')"


def _clean(quotes: str, conjunction: str) -> str:
    plain = {"‘": "''", "’": "''", "“": '"', "”": '"', "„": '"'}
    text = f"translate(t, '{quotes}' || chr(160), '{''.join(plain[c] for c in quotes)} ')"
    text = f"replace({text}, '…', '...')"
    pair = "'([\\p{L}\\p{N}_])\\s*&\\s*([\\p{L}\\p{N}_])'"
    for _ in range(2):
        text = f"regexp_replace({text}, {pair}, '\\1 {conjunction} \\2', 'g')"
    return text


def _abbreviate(table: dict, both: bool) -> str:
    pairs = dict(table)
    if both:
        for a, b in table.items():
            pairs.setdefault(a[0].upper() + a[1:], b[0].upper() + b[1:])
    text = "t"
    for a, b in pairs.items():
        text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_]){a.replace('.', '[.]')}', '\\1{b}', 'g')"
    return text


def _calm(letters: str, keep: list[str]):
    kept = ", ".join(q(k) for k in keep)
    return lambda h: (
        f"CASE WHEN regexp_matches({h}, '^[{letters}]{{4,}}$') AND {h} NOT IN ({kept}) THEN substr({h}, 1, 1) || lower(substr({h}, 2)) ELSE {h} END"
    )


def _heading(reading):
    return lambda h: f"regexp_replace({h}, '\\s+[A-Za-z]+$', '') || ' ' || {reading(roman(f'regexp_extract({h}, {q(chr(91) + 'A-Za-z]+$')})'))}"


EN_ABBR = {
    "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miss", "Dr.": "Doctor", "Prof.": "Professor", "Sr.": "Senior", "Jr.": "Junior",
    "St.": "Saint", "vs.": "versus", "etc.": "et cetera", "e.g.": "for example", "i.e.": "that is", "approx.": "approximately",
}
DE_ABBR = {
    "z.B.": "zum Beispiel", "bzw.": "beziehungsweise", "Nr.": "Nummer", "usw.": "und so weiter", "d.h.": "das heißt",
    "u.a.": "unter anderem", "ca.": "circa", "Dr.": "Doktor", "Prof.": "Professor",
}
PL_ABBR = {
    "np.": "na przykład", "itd.": "i tak dalej", "itp.": "i tym podobne", "tzn.": "to znaczy", "tj.": "to jest",
    "m.in.": "między innymi", "ul.": "ulica", "dr.": "doktor", "prof.": "profesor", "godz.": "godzina",
}
WORD = "[\\p{L}\\p{M}\\p{N}_]+"
AMOUNT = "[0-9][0-9,]*(?:[.][0-9]+)?"
DE_ORDINAL_WORDS = "Kapitel|Teil|Band|Akt|Jahrhundert|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _years(joiner: str, reading) -> list:
    return [
        ("year_range", f"\\b{Y}\\s?[-–—]\\s?{Y}\\b", lambda h: f"{reading(f'substr({h}, 1, 4)')} || '{joiner}' || {reading(f'right({h}, 4)')}"),
        ("year", f"\\b{Y}\\b", reading),
    ]


def _comma_tail(cardinal, units, point) -> list:
    return [
        ("decimal", "\\b[0-9]+,[0-9]+\\b", lambda h: bind(comma_number(h), lambda n: _decimals(n, units, point, cardinal))),
        ("integer", "\\b[0-9]{1,3}(?:[ .][0-9]{3})+\\b|\\b[0-9]+\\b", lambda h: cardinal(digits(h))),
    ]


def _en_rules() -> list:
    quantity = lambda h: bind(number(h), lambda n: _decimals(n, EN_U, "point", en_cardinal))
    sign = lambda h: f"substr({h}, 1, 1)"
    return [
        ("symbols", None, _clean("‘’“”", "and")),
        ("capitals", WORD, _calm("A-Z", ["NASA", "FBI", "CIA", "USA", "NATO", "UNESCO", "OK"])),
        ("spaces", None, f"trim(regexp_replace(t, '[ \\t]+', ' ', 'g'), {WS})"),
        ("abbreviations", None, _abbreviate(EN_ABBR, False)),
        ("heading", "\\b(?:Chapter|Part|Book|Volume|Act)\\s+[IVXLCDM]+\\b", _heading(en_cardinal)),
        ("currency", f"[$£€]\\s?{AMOUNT}", lambda h: _money(number(h), en_cardinal, _two_forms(sign(h), EN_MONEY), ", ")),
        ("percent", "[0-9]+(?:[.][0-9]+)?\\s?%", lambda h: f"{quantity(h)} || ' percent'"),
        *_years(" to ", en_year),
        ("ordinal", "(?i)\\b[0-9]{1,3}(?:,[0-9]{3})*(?:st|nd|rd|th)\\b", lambda h: en_ordinal(digits(h))),
        ("decimal", "\\b[0-9]+[.][0-9]+\\b", quantity),
        ("integer", "\\b[0-9]{1,3}(?:,[0-9]{3})+\\b|\\b[0-9]+\\b", lambda h: en_cardinal(digits(h))),
    ]


def _de_rules() -> list:
    sign = lambda h: f"substr({h}, 1, 1)"
    return [
        ("symbols", None, _clean("‘’“”„", "und")),
        ("capitals", WORD, _calm("A-ZÄÖÜ", ["USA", "NATO", "EU", "UNO"])),
        ("spaces", None, f"trim(regexp_replace(t, '[ \\t]+', ' ', 'g'), {WS})"),
        ("abbreviations", None, _abbreviate(DE_ABBR, True)),
        ("heading", "\\b(?:Kapitel|Teil|Band|Akt)\\s+[IVXLCDM]+\\b", _heading(de_cardinal)),
        ("ordinal", f"\\b[0-9]{{1,4}}[.]\\s+(?:{DE_ORDINAL_WORDS})", lambda h: f"{de_ordinal(digits(h))} || ' ' || regexp_extract({h}, '[.]\\s+(.*)$', 1)"),
        ("currency", f"[$£]\\s?{AMOUNT}", lambda h: _money(number(h), _de_money_cardinal, _two_forms(sign(h), DE_MONEY), " und ")),
        ("euro", "[0-9][0-9.\\s]*(?:,[0-9]+)?\\s?(?:€|EUR\\b)", lambda h: _money(f"replace(regexp_replace({h}, '[^0-9,]', '', 'g'), ',', '.')", _de_money_cardinal, _two_forms("'€'", DE_MONEY), " und ")),
        ("percent", "[0-9]+(?:,[0-9]+)?\\s?%", lambda h: f"{bind(comma_number(h), lambda n: _decimals(n, DE_U, 'Komma', de_cardinal))} || ' Prozent'"),
        *_years(" bis ", de_year),
        *_comma_tail(de_cardinal, DE_U, "Komma"),
    ]


def _pl_rules() -> list:
    sign = lambda h: f"substr({h}, 1, 1)"
    return [
        ("symbols", None, _clean("‘’“”„", "i")),
        ("capitals", WORD, _calm("A-ZĄĆĘŁŃÓŚŹŻ", ["USA", "NATO", "ONZ", "UE"])),
        ("spaces", None, f"trim(regexp_replace(t, '[ \\t]+', ' ', 'g'), {WS})"),
        ("abbreviations", None, _abbreviate(PL_ABBR, True)),
        ("heading", "(?i)\\b(?:Rozdział|Część|Tom|Akt)\\s+[IVXLCDM]+\\b", _heading(pl_ordinal)),
        ("currency", f"[$£€]\\s?{AMOUNT}", lambda h: _money(number(h), pl_cardinal, _pl_forms(sign(h)), ", ")),
        ("zloty", "[0-9][0-9\\s]*(?:[.,][0-9]+)?\\s?(?:zł|PLN\\b)", lambda h: _money(comma_number(h), pl_cardinal, _pl_forms("'zł'"), ", ")),
        ("percent", "[0-9]+(?:[.,][0-9]+)?\\s?%", lambda h: f"{bind(comma_number(h), lambda n: _decimals(n, PL_U, 'przecinek', pl_cardinal))} || ' procent'"),
        *_years(" do ", pl_ordinal),
        *_comma_tail(pl_cardinal, PL_U, "przecinek"),
    ]


def _zh_rules() -> list:
    amount = lambda h: bind(number(h), zh_cardinal)
    # RE2 has no lookaround: a digit run is taken whole and judged afterwards.
    year = lambda h: f"CASE WHEN regexp_matches({h}, '^{Y}$') THEN {zh_direct(h)} ELSE {h} END"
    return [
        ("spaces", None, f"trim(regexp_replace(translate(t, chr(160), ' '), '[ \\t]+', ' ', 'g'), {WS})"),
        ("heading", "第\\s*[0-9]+\\s*[章节部卷回幕篇]", lambda h: f"'第' || {amount(h)} || right({h}, 1)"),
        ("currency", f"[$£¥]\\s?{AMOUNT}", lambda h: f"{amount(h)} || CASE substr({h}, 1, 1) WHEN '$' THEN '美元' WHEN '£' THEN '英镑' ELSE '元' END"),
        ("yuan", f"{AMOUNT}\\s?(?:CNY|RMB)\\b", lambda h: f"{amount(h)} || '元'"),
        ("percent", "[0-9]+(?:[.][0-9]+)?\\s?%", lambda h: f"'百分之' || {amount(h)}"),
        ("year_range", f"[0-9]+\\s?[-–—]\\s?[0-9]+", lambda h: f"CASE WHEN regexp_matches({h}, '^{Y}\\s?[-–—]\\s?{Y}$') THEN {zh_direct(f'substr({h}, 1, 4)')} || '到' || {zh_direct(f'right({h}, 4)')} ELSE {h} END"),
        ("year", "[0-9]+", year),
        ("number", "[0-9]+(?:[.][0-9]+)?", zh_cardinal),
    ]


RULES = {"en": _en_rules, "de": _de_rules, "pl": _pl_rules, "zh": _zh_rules}


def normalized(language: str, source: str, only: list[str] | None = None) -> dict[str, str]:
    """CTEs ``<lang>_0`` … ``<lang>_out`` that rewrite column t of ``source`` rule by rule."""
    steps = {f"{language}_0": f"SELECT s.*, n.* FROM ({source}) s, number_tables n"}
    last = f"{language}_0"
    for k, (name, pattern, body) in enumerate(RULES[language](), 1):
        if only is not None and name not in only:
            continue
        step = f"{language}_{k}"
        steps[step] = replace(last, body) if pattern is None else rewrite(last, pattern, body)
        last = step
    steps[f"{language}_out"] = f"SELECT * EXCLUDE (en, de, pl, plo) FROM {last}"
    return {"number_tables": NUMBER_TABLES, **steps}


def sentences(text: str) -> str:
    """The splitter's rule for languages with blanks, as a list."""
    initial = "'(^|[ \\t\\r\\n])([A-Z])[.]([ \\t\\r\\n])'"
    for _ in range(2):
        text = f"regexp_replace({text}, {initial}, '\\1\\2' || chr(29) || '\\3', 'g')"
    closers = "[\"''”’»)\\]」』）]*"
    marked = f"regexp_replace({text}, '([.!?…]+{closers})[ \\t\\r\\n]+', '\\1' || chr(30), 'g')"
    return f"list_filter(list_transform(string_split(translate({marked}, chr(29), '.'), chr(30)), lambda s: trim(s, {WS})), lambda s: s <> '')"


def packed(sentence_list: str, limit: int) -> str:
    """Greedy packing as a fold over text: chr(30) closes a chunk."""
    current = "list_last(string_split(a, chr(30)))"
    fold = f"list_reduce({sentence_list}, lambda a, s: CASE WHEN length({current}) + 1 + length(s) > {limit} THEN a || chr(30) || s ELSE a || ' ' || s END)"
    return f"CASE WHEN len({sentence_list}) = 0 THEN [] ELSE string_split({fold}, chr(30)) END"
