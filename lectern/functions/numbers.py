"""Number words as Column expressions over digit strings.

Every function takes a string column of ASCII digits, so the length of a number
is not bound by any integer type. A number is cut into groups of three from the
right; the words of one group come from a literal array that a rule builds, so
the expression stays small and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.strings import bind

# ---------------------------------------------------------------- fixed values
# Number words of each language.
EN_UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
EN_TENS = "- ten twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_SCALES = (
    "- thousand million billion trillion quadrillion quintillion sextillion septillion "
    "octillion nonillion decillion undecillion duodecillion tredecillion quattuordecillion "
    "quindecillion sexdecillion septendecillion octodecillion novemdecillion vigintillion"
).split()
EN_ORDINALS = {
    "one": "first", "two": "second", "three": "third", "four": "fourth", "five": "fifth",
    "six": "sixth", "seven": "seventh", "eight": "eighth", "nine": "ninth",
    "ten": "tenth", "eleven": "eleventh", "twelve": "twelfth",
}

DE_UNITS = (
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn "
    "vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn"
).split()
DE_TENS = "- zehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
DE_SCALES = "- tausend Million Milliarde Billion Billiarde Trillion Trilliarde Quadrillion Quadrilliarde".split()
DE_IRREGULAR_ORDINALS = {1: "erste", 3: "dritte", 7: "siebte", 8: "achte"}

PL_UNITS = (
    "zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście "
    "dwanaście trzynaście czternaście piętnaście szesnaście siedemnaście osiemnaście "
    "dziewiętnaście"
).split()
PL_TENS = (
    "- dziesięć dwadzieścia trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt "
    "siedemdziesiąt osiemdziesiąt dziewięćdziesiąt"
).split()
PL_HUNDREDS = "- sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset".split()
PL_SCALES = [
    ("", "", ""),
    ("tysiąc", "tysiące", "tysięcy"),
    ("milion", "miliony", "milionów"),
    ("miliard", "miliardy", "miliardów"),
    ("bilion", "biliony", "bilionów"),
    ("biliard", "biliardy", "biliardów"),
    ("trylion", "tryliony", "trylionów"),
    ("tryliard", "tryliardy", "tryliardów"),
    ("kwadrylion", "kwadryliony", "kwadrylionów"),
]
PL_UNIT_ORDINALS = (
    "zerowy pierwszy drugi trzeci czwarty piąty szósty siódmy ósmy dziewiąty dziesiąty "
    "jedenasty dwunasty trzynasty czternasty piętnasty szesnasty siedemnasty osiemnasty "
    "dziewiętnasty"
).split()
PL_TEN_ORDINALS = (
    "- dziesiąty dwudziesty trzydziesty czterdziesty pięćdziesiąty sześćdziesiąty "
    "siedemdziesiąty osiemdziesiąty dziewięćdziesiąty"
).split()
PL_HUNDRED_ORDINALS = (
    "- setny dwusetny trzysetny czterysetny pięćsetny sześćsetny siedemsetny osiemsetny "
    "dziewięćsetny"
).split()
# First parts of compounds with a scale, as in "dwudziestopięciotysięczny".
PL_UNIT_COMPOUNDS = (
    "- jedno dwu trzy cztero pięcio sześcio siedmio ośmio dziewięcio dziesięcio jedenasto dwunasto "
    "trzynasto czternasto piętnasto szesnasto siedemnasto osiemnasto dziewiętnasto"
).split()
PL_TEN_COMPOUNDS = (
    "- dziesięcio dwudziesto trzydziesto czterdziesto pięćdziesięcio sześćdziesięcio siedemdziesięcio "
    "osiemdziesięcio dziewięćdziesięcio"
).split()
PL_HUNDRED_COMPOUNDS = "- stu dwustu trzystu czterystu pięćset sześćset siedemset osiemset dziewięćset".split()

ZH_DIGITS = "零一二三四五六七八九"
ZH_PLACES = ["", "十", "百", "千"]
ZH_MAX_DIGITS = 16

ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# Currency names: (major forms, minor forms) in each language's plural classes.
EN_MONEY = {
    "USD": (("dollar", "dollars"), ("cent", "cents")),
    "GBP": (("pound sterling", "pounds sterling"), ("penny", "pence")),
    "EUR": (("euro", "euro"), ("cent", "cents")),
}
DE_MONEY = {
    "USD": (("Dollar", "Dollar"), ("Cent", "Cent")),
    "GBP": (("Pfund", "Pfund"), ("Penny", "Pence")),
    "EUR": (("Euro", "Euro"), ("Cent", "Cent")),
}
PL_MONEY = {
    "USD": (("dolar amerykański", "dolary amerykańskie", "dolarów amerykańskich"), ("cent", "centy", "centów")),
    "GBP": (("funt szterling", "funty szterlingi", "funtów szterlingów"), ("pens", "pensy", "pensów")),
    "EUR": (("euro", "euro", "euro"), ("cent", "centy", "centów")),
    "PLN": (("złoty", "złote", "złotych"), ("grosz", "grosze", "groszy")),
}
# ------------------------------------------------------------ end fixed values


def _words(entries: list[str]) -> Column:
    """A literal array: one string that constant folding splits once per query."""
    return F.split(F.lit("|".join(entries)), r"\|")


def _pick(entries: list[str], index: Column) -> Column:
    return F.get(_words(entries), index.cast("int"))


def _three_digits(below_hundred: Callable[[int], str], hundred: Callable[[int], str], glue: str) -> list[str]:
    """Words for 0..999; the entry for zero is empty."""
    out = [""]
    for n in range(1, 1000):
        parts = [hundred(n // 100) if n >= 100 else "", below_hundred(n % 100) if n % 100 else ""]
        out.append(glue.join(p for p in parts if p))
    return out


def _two_digits(units: list[str], tens: list[str], joined: Callable[[str, str], str]) -> Callable[[int], str]:
    def words(n: int) -> str:
        if n < 20:
            return units[n]
        return tens[n // 10] if n % 10 == 0 else joined(tens[n // 10], units[n % 10])

    return words


_EN_TWO = _two_digits(EN_UNITS, EN_TENS, lambda ten, unit: f"{ten}-{unit}")
EN_THREE = _three_digits(_EN_TWO, lambda h: f"{EN_UNITS[h]} hundred", " and ")
_DE_TWO = _two_digits(DE_UNITS, DE_TENS, lambda ten, unit: f"{'ein' if unit == 'eins' else unit}und{ten}")
DE_THREE = _three_digits(_DE_TWO, lambda h: f"{'ein' if h == 1 else DE_UNITS[h]}hundert", "")
_PL_TWO = _two_digits(PL_UNITS, PL_TENS, lambda ten, unit: f"{ten} {unit}")
PL_THREE = _three_digits(_PL_TWO, lambda h: PL_HUNDREDS[h], " ")
_PL_TWO_ORDINAL = _two_digits(PL_UNIT_ORDINALS, PL_TEN_ORDINALS, lambda ten, unit: f"{ten} {unit}")
PL_THREE_ORDINAL = _three_digits(_PL_TWO_ORDINAL, lambda h: PL_HUNDREDS[h], " ")
for _h in range(1, 10):
    PL_THREE_ORDINAL[100 * _h] = PL_HUNDRED_ORDINALS[_h]
_PL_TWO_COMPOUND = _two_digits(PL_UNIT_COMPOUNDS, PL_TEN_COMPOUNDS, lambda ten, unit: ten + unit)
#: What stands before a scale's adjective; one thousand, one million and so on have nothing there.
PL_THREE_COMPOUND = ["" if n == 1 else w for n, w in enumerate(_three_digits(_PL_TWO_COMPOUND, lambda h: PL_HUNDRED_COMPOUNDS[h], ""))]
PL_SCALE_ORDINALS = ["", "tysięczny", *(f"{one}owy" for one, _, _ in PL_SCALES[2:])]


def _zh_pair(n: int, places: list[str]) -> str:
    """Two digits with their places; a zero stays a mark."""
    return "".join(ZH_DIGITS[d] + place if d else "0" for d, place in zip(divmod(n, 10), places, strict=True))


ZH_TENS = [_zh_pair(n, [ZH_PLACES[1], ZH_PLACES[0]]) for n in range(100)]
ZH_HUNDREDS = [_zh_pair(n, [ZH_PLACES[3], ZH_PLACES[2]]) for n in range(100)]


def _canonical(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def _read_groups(
    digits: Column, scales: int, body: Callable[[Column, Column], Column], glue: str, units: list[str]
) -> Column:
    """Join ``body(value, scale)`` of the three-digit groups; null groups are skipped.

    Numbers beyond the last scale word are read digit by digit.
    """

    def group(back: Column, scale: Column) -> Column:
        return bind(F.reverse(back).cast("int"), lambda value: body(value, scale))

    def read(text: Column) -> Column:
        number = F.ltrim(text, F.lit("0"))
        groups = F.regexp_extract_all(F.reverse(number), F.lit("[0-9]{1,3}"), F.lit(0))
        return (
            F.when(F.length(number) > 3 * scales, _spell(text, units))
            .when(number == "", units[0])
            .otherwise(F.array_join(F.reverse(F.transform(groups, group)), glue))
        )

    return bind(digits, read)


def _spell(digits: Column, units: list[str]) -> Column:
    each = F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))
    return F.array_join(F.transform(each, lambda d: _pick(units, d)), " ")


# -------------------------------------------------------------------- English


def en_cardinal(digits: Column) -> Column:
    # A last group below one hundred joins with "and"; "&" marks it until then.
    last = ["&" + w if 0 < n < 100 else w for n, w in enumerate(EN_THREE)]
    scales = [f" {name}" for name in EN_SCALES]

    def read(value: Column, scale: Column) -> Column:
        return F.when(value > 0, F.when(scale == 0, _pick(last, value)).otherwise(
            F.concat(_pick(EN_THREE, value), _pick(scales, scale))))

    joined = _read_groups(digits, len(EN_SCALES), read, ", ", EN_UNITS)
    return F.ltrim(F.replace(joined, F.lit(", &"), F.lit(" and ")), F.lit("&"))


def en_ordinal(digits: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EN_ORDINALS.items() for x in pair])

    def turn(words: Column) -> Column:
        last = F.regexp_extract(words, "[a-z]+$", 0)
        regular = F.concat(F.regexp_replace(last, "y$", "ie"), F.lit("th"))
        return F.concat(
            F.regexp_replace(words, "[a-z]+$", ""), F.coalesce(F.try_element_at(names, last), regular)
        )

    return bind(en_cardinal(digits), turn)


def en_year(digits: Column) -> Column:
    """A four-digit year read in two halves."""
    half = [_EN_TWO(n) if n else "hundred" for n in range(100)]
    half = [f"oh {w}" if 0 < n < 10 else w for n, w in enumerate(half)]
    century, rest = F.left(digits, F.lit(2)), F.right(digits, F.lit(2))
    whole = F.rtrim(F.concat(F.lit("two thousand "), _pick(EN_THREE, rest)))
    return F.when(century == "20", whole).otherwise(
        F.concat(_pick(EN_THREE, century), F.lit(" "), _pick(half, rest))
    )


# --------------------------------------------------------------------- German

_DE_COUNT = [w if n != 1 else "ein" for n, w in enumerate(DE_THREE)]


def de_cardinal(digits: Column) -> Column:
    single = [f"eine {name} " for name in DE_SCALES]
    several = [f" {name}{'n' if name.endswith('e') else 'en'} " for name in DE_SCALES]

    def read(value: Column, scale: Column) -> Column:
        return (
            F.when(scale == 0, _pick(DE_THREE, value))
            .when(value == 0, "")
            .when(scale == 1, F.concat(_pick(_DE_COUNT, value), F.lit(DE_SCALES[1])))
            .when(value == 1, _pick(single, scale))
            .otherwise(F.concat(_pick(DE_THREE, value), _pick(several, scale)))
        )

    return F.rtrim(_read_groups(digits, len(DE_SCALES), read, "", DE_UNITS))


_DE_UNIT_ORDINALS = [DE_IRREGULAR_ORDINALS.get(n, f"{unit}te") for n, unit in enumerate(DE_UNITS)]


def de_ordinal(digits: Column) -> Column:
    """Of the last number word: a unit below twenty takes -te (with four irregular ones), any other takes -ste.

    A bare scale is one word with its count and without its plural ending: zweimillionste, dreimilliardste. Only
    *hundertste*, *tausendste*, *millionste* and so on stand without a leading one.
    """
    number = F.ltrim(digits, F.lit("0"))
    spelled = F.length(number) > 3 * len(DE_SCALES)
    last = F.when(spelled, F.right(number, F.lit(1))).otherwise(F.right(number, F.lit(2))).cast("int")
    whole_scale = number.rlike("000000$") & ~spelled

    def turn(words: Column) -> Column:
        unit = F.concat(F.left(words, F.length(words) - F.length(_pick(DE_UNITS, last))), _pick(_DE_UNIT_ORDINALS, last))
        before = F.regexp_extract(words, r"^(.* )?\S+ \S+$", 1)
        count = F.regexp_replace(F.regexp_extract(words, r"(\S+) \S+$", 1), "^eine$", F.when(before == "", "").otherwise("ein"))
        scale = F.regexp_replace(F.regexp_extract(words, r"(\S+)$", 1), "(illi)(on|ard)(?:e|en)?$", "$1$2")
        return (
            F.when(number == "", "nullte")
            .when(spelled | last.between(1, 19), unit)
            .when(whole_scale, F.concat(before, count, scale, F.lit("ste")))
            .otherwise(F.regexp_replace(F.concat(words, F.lit("ste")), "^ein(tausendste|hundertste)$", "$1"))
        )

    return bind(F.lower(de_cardinal(digits)), turn)


def de_year(digits: Column) -> Column:
    """Years are counted in hundreds unless the hundreds digit is zero."""
    in_thousands = F.concat(
        _pick(_DE_COUNT, F.left(digits, F.lit(1))), F.lit("tausend"), _pick(DE_THREE, F.right(digits, F.lit(2)))
    )
    in_hundreds = F.concat(
        _pick(DE_THREE, F.left(digits, F.lit(2))), F.lit("hundert"), _pick(DE_THREE, F.right(digits, F.lit(2)))
    )
    return F.when(F.substring(digits, 2, 1) == "0", in_thousands).otherwise(in_hundreds)


# --------------------------------------------------------------------- Polish


def _pl_form(n: Column, one: Column, few: Column, many: Column) -> Column:
    """Polish plural class of the count ``n``."""
    few_like = (n % 10).between(2, 4) & ~(n % 100).between(10, 20)
    return F.when(n == 1, one).when(few_like, few).otherwise(many)


def pl_cardinal(digits: Column) -> Column:
    one, few, many = ([forms[k] for forms in PL_SCALES] for k in range(3))

    def read(value: Column, scale: Column) -> Column:
        name = _pl_form(value, _pick(one, scale), _pick(few, scale), _pick(many, scale))
        return (
            F.when(value == 0, F.lit(None).cast("string"))
            .when(scale == 0, _pick(PL_THREE, value))
            .when(value == 1, name)
            .otherwise(F.concat(_pick(PL_THREE, value), F.lit(" "), name))
        )

    return _read_groups(digits, len(PL_SCALES), read, " ", PL_UNITS)


def pl_ordinal(digits: Column) -> Column:
    """Leading groups stay cardinal; the last group that is not zero takes ordinal endings.

    If that group counts thousands or a higher scale, it is one word with the scale's adjective:
    dziesięciotysięczny, dwumilionowy. Beyond the last scale word the digits are read, the last as an ordinal.
    """

    def grouped(d: Column, tail: Column) -> Column:
        def parts(head: Column) -> Column:
            low, high = F.right(head, F.lit(3)), F.left(head, F.greatest(F.length(head) - 3, F.lit(0)))
            lead = F.when(F.length(head) > 3, pl_cardinal(F.concat(high, F.lit("000"), tail)))
            ending = F.when(tail == "", _pick(PL_THREE_ORDINAL, low)).otherwise(
                F.concat(_pick(PL_THREE_COMPOUND, low), _pick(PL_SCALE_ORDINALS, F.length(tail) / 3))
            )
            return F.concat_ws(" ", lead, ending)

        return bind(F.left(d, F.length(d) - F.length(tail)), parts)

    def read(d: Column) -> Column:
        spelled = F.concat_ws(" ", _spell(F.left(d, F.length(d) - 1), PL_UNITS), _pick(PL_UNIT_ORDINALS, F.right(d, F.lit(1))))
        return (
            F.when(F.length(d) > 3 * len(PL_SCALES), spelled)
            .when(d == "0", PL_UNIT_ORDINALS[0])
            .otherwise(bind(F.regexp_extract(d, "((?:000)*)$", 1), lambda tail: grouped(d, tail)))
        )

    return bind(_canonical(digits), read)


# -------------------------------------------------------------------- Chinese


def zh_direct(digits: Column) -> Column:
    return F.translate(digits, "0123456789", ZH_DIGITS)


def zh_cardinal(number: Column) -> Column:
    """Numerals with 十百千 and the 万/亿 groups; decimals, and what is beyond these groups, digit by digit."""

    def group(back: Column, scale: Column) -> Column:
        # Four digits, written backwards: groups 1 and 3 close with 万, group 2 with 亿.
        said = bind(F.reverse(back).cast("int"), lambda n: F.concat(_pick(ZH_HUNDREDS, F.floor(n / 100)), _pick(ZH_TENS, n % 100)))
        return F.concat(said, F.when(scale == 2, "亿").when(scale.isin(1, 3), "万").otherwise(""))

    def joined(marked: Column) -> Column:
        # An empty 万 group loses its unit; zeros move behind a group unit and read as one, behind 亿 also those that 万 left.
        spoken = F.regexp_replace(marked, "(?<=亿)0000万", "0")
        return F.regexp_replace(F.regexp_replace(spoken, "0+万", "万0"), "0+亿", "亿0")

    def integer(text: Column) -> Column:
        groups = F.regexp_extract_all(F.reverse(text), F.lit("[0-9]{1,4}"), F.lit(0))
        marked = F.ltrim(F.array_join(F.reverse(F.transform(groups, group)), ""), F.lit("0"))
        said = bind(marked, lambda m: F.when(F.length(text) > 4, joined(m)).otherwise(m))
        spoken = F.regexp_replace(F.rtrim(said, F.lit("0")), "0+", "零")
        return F.when(text == "0", "零").otherwise(F.regexp_replace(spoken, "^一十", "十"))

    def read(text: Column) -> Column:
        fraction = F.when(text.contains("."), F.concat(F.lit("点"), zh_direct(F.substring_index(text, ".", -1))))
        said = lambda whole: F.when(F.length(whole) > ZH_MAX_DIGITS, zh_direct(whole)).otherwise(integer(whole))
        return F.concat(bind(_canonical(F.substring_index(text, ".", 1)), said), F.coalesce(fraction, F.lit("")))

    return bind(number, read)


# ---------------------------------------------------------------------- roman


def roman_value(token: Column) -> Column:
    """Value of a roman numeral in either case; null for any other text."""
    values = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])
    letters = F.regexp_extract_all(F.reverse(F.upper(token)), F.lit("[IVXLCDM]"), F.lit(0))

    def add(state: Column, letter: Column) -> Column:
        value = F.try_element_at(values, letter)
        smaller = value < state["top"]
        return F.struct(
            (state["total"] + F.when(smaller, -value).otherwise(value)).alias("total"),
            F.greatest(state["top"], value).alias("top"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    total = F.aggregate(letters, start, add, lambda s: s["total"])
    return F.when(F.upper(token).rlike("^[IVXLCDM]+$"), total)


# ------------------------------------------------------------- whole readings


def _two_forms(count: Column, forms: tuple[str, ...]) -> Column:
    return F.when(count == "1", forms[0]).otherwise(forms[1])


def _polish_forms(count: Column, forms: tuple[str, ...]) -> Column:
    # The last two digits decide the class, so a count of any length works.
    few_like = count.rlike("(^|[^1])[234]$")
    return F.when(count == "1", forms[0]).when(few_like, forms[1]).otherwise(forms[2])


@dataclass(frozen=True)
class Reader:
    """How one language says numbers."""

    cardinal: Callable[[Column], Column]
    ordinal: Callable[[Column], Column]
    year: Callable[[Column], Column]
    units: list[str]
    point: str
    money_names: dict
    money_form: Callable[[Column, tuple[str, ...]], Column]
    money_joiner: str
    money_cardinal: Callable[[Column], Column]

    def quantity(self, number: Column) -> Column:
        """Whole part; after the point one word per decimal, without trailing zeros."""

        def read(text: Column) -> Column:
            fraction = F.regexp_replace(F.substring_index(text, ".", -1), "(?<=[0-9])0+$", "")
            spelled = F.concat(F.lit(f" {self.point} "), _spell(fraction, self.units))
            return F.concat(
                self.cardinal(F.substring_index(text, ".", 1)),
                F.when(text.contains("."), spelled).otherwise(""),
            )

        return bind(number, read)

    def money(self, number: Column, currency: Column, codes: list[str]) -> Column:
        """Amount in words, rounded to the minor unit; a zero minor unit is not read."""

        def name(count: Column, level: int) -> Column:
            out = F.lit(None).cast("string")
            for code in codes:
                out = F.when(currency == code, self.money_form(count, self.money_names[code][level])).otherwise(out)
            return out

        def read(text: Column) -> Column:
            whole = F.substring_index(text, ".", 1)
            small = F.ltrim(F.substring_index(text, ".", -1), F.lit("0"))
            return bind(F.array(whole, small), lambda both: bind(F.transform(both, self.money_cardinal), lambda said: spoken(both, said)))

        def spoken(both: Column, said: Column) -> Column:
            whole, small = F.get(both, F.lit(0)), F.get(both, F.lit(1))
            head = F.concat_ws(" ", F.get(said, F.lit(0)), name(whole, 0))
            tail = F.concat(F.lit(self.money_joiner), F.get(said, F.lit(1)), F.lit(" "), name(small, 1))
            return F.concat(head, F.when(small == "", "").otherwise(tail))

        return bind(number.try_cast("decimal(38,2)").cast("string"), read)


def _de_money_words(digits: Column) -> Column:
    # A trailing "eins" shortens before a currency name.
    return F.regexp_replace(de_cardinal(digits), "eins$", "ein")


ENGLISH = Reader(
    en_cardinal, en_ordinal, en_year, EN_UNITS, "point", EN_MONEY, _two_forms, ", ", en_cardinal
)
GERMAN = Reader(
    de_cardinal, de_ordinal, de_year, DE_UNITS, "Komma", DE_MONEY, _two_forms, " und ", _de_money_words
)
POLISH = Reader(
    pl_cardinal, pl_ordinal, pl_ordinal, PL_UNITS, "przecinek", PL_MONEY, _polish_forms, ", ", pl_cardinal
)
