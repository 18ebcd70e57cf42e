"""Language-specific text normalization as chains of Column rules.

A language is a ``Ruleset``: an ordered list of named Column → Column rules and
a version string. Rules that read numbers share the builders below; what differs
between languages is data. The number rules are skipped for texts without digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions.strings import bind, digits_of, regex_transform, strip

Rule = Callable[[Column], Column]

# ---------------------------------------------------------------- fixed values
QUOTES_EN = "‘’“”"
QUOTES_DE_PL = "‘’“”„"
PLAIN_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "„": '"'}

CAPS_EN, CAPS_DE, CAPS_PL = "A-Z", "A-ZÄÖÜ", "A-ZĄĆĘŁŃÓŚŹŻ"
KEEP_CAPS_EN = ["NASA", "FBI", "CIA", "USA", "NATO", "UNESCO", "OK"]
KEEP_CAPS_DE = ["USA", "NATO", "EU", "UNO"]
KEEP_CAPS_PL = ["USA", "NATO", "ONZ", "UE"]

ABBREVIATIONS_EN = {
    "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miss", "Dr.": "Doctor", "Prof.": "Professor",
    "Sr.": "Senior", "Jr.": "Junior", "St.": "Saint", "vs.": "versus", "etc.": "et cetera",
    "e.g.": "for example", "i.e.": "that is", "approx.": "approximately",
}
ABBREVIATIONS_DE = {
    "z.B.": "zum Beispiel", "bzw.": "beziehungsweise", "Nr.": "Nummer", "usw.": "und so weiter",
    "d.h.": "das heißt", "u.a.": "unter anderem", "ca.": "circa", "Dr.": "Doktor", "Prof.": "Professor",
}
ABBREVIATIONS_PL = {
    "np.": "na przykład", "itd.": "i tak dalej", "itp.": "i tym podobne", "tzn.": "to znaczy",
    "tj.": "to jest", "m.in.": "między innymi", "ul.": "ulica", "dr.": "doktor",
    "prof.": "profesor", "godz.": "godzina",
}

HEADINGS_EN = "Chapter|Part|Book|Volume|Act"
HEADINGS_DE = "Kapitel|Teil|Band|Akt"
HEADINGS_PL = "Rozdział|Część|Tom|Akt"
ORDINAL_WORDS_DE = (
    "Kapitel|Teil|Band|Akt|Jahrhundert|Januar|Februar|März|April|Mai|Juni|Juli|August|"
    "September|Oktober|November|Dezember"
)
CURRENCY_SIGNS = {"$": "USD", "£": "GBP", "€": "EUR"}
CURRENCY_WORDS_ZH = {"$": "美元", "£": "英镑", "¥": "元"}
VERSIONS = {"en": "en-1", "de": "de-1", "pl": "pl-1", "zh": "zh-1"}

YEAR = "(?:1[0-9]{3}|2[0-9]{3})"
AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
# ------------------------------------------------------------ end fixed values

# Unicode classes for \b, \s and \w, as in the languages' own alphabets.
U = "(?U)"
# A look at the next character before \b: Unicode word boundaries are dear, and are tried where a match can begin alone.
DIGIT = "(?=[0-9])(?<![0-9])"


# ------------------------------------------------------------- symbol clean-up


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[ \t]+", " "))


def plain_symbols(quotes: str, conjunction: str) -> Rule:
    """Typographic quotes, ellipsis, no-break space and the ampersand between words."""
    plain = "".join(PLAIN_QUOTES[q] for q in quotes)

    def rule(text: Column) -> Column:
        text = F.translate(text, quotes + "\xa0", plain + " ")
        text = F.replace(text, F.lit("…"), F.lit("..."))
        joined = U + r"(?=\s*&)(?<=\w)\s*&\s*(?=\w)"
        return bind(
            text,
            lambda t: F.when(t.contains("&"), F.regexp_replace(t, joined, f" {conjunction} ")).otherwise(t),
        )

    return rule


def calm_capitals(letters: str, keep: list[str]) -> Rule:
    """Shouted words of four letters or more become title case; listed acronyms stay."""
    capitals = ascii_uppercase + letters.removeprefix("A-Z")
    some = r"(?=[A-Z\u00c0-\u017f])"

    def rule(text: Column) -> Column:
        return regex_transform(
            text,
            U + rf"{some}(?=[{letters}]{{4}})\b[{letters}]{{4,}}\b",
            lambda w: F.when(w.isin(keep), w).otherwise(
                F.concat(F.substring(w, 1, 1), F.translate(F.substring(w, F.lit(2), F.length(w)), capitals, capitals.lower()))
            ),
            hint=rf"{some}[{letters}]{{4}}",
        )

    return rule


def expand_abbreviations(table: dict[str, str], *, sentence_case: bool) -> Rule:
    """Literal expansion where no letter or digit precedes; capitals carry over if asked."""
    pairs = dict(table)
    if sentence_case:
        for short, full in table.items():
            pairs.setdefault(short[0].upper() + short[1:], full[0].upper() + full[1:])

    def rule(text: Column) -> Column:
        def expand(short: str, full: str) -> Rule:
            literal = short.replace(".", r"\.")
            pattern = U + rf"(?={literal})(?<!\w){literal}"
            return lambda t: F.when(t.contains(short), F.regexp_replace(t, pattern, full)).otherwise(t)

        def fold(t: Column) -> Column:
            for short, full in pairs.items():
                t = bind(t, expand(short, full))
            return t

        return bind(text, lambda t: F.when(t.contains("."), fold(t)).otherwise(t))

    return rule


# ---------------------------------------------------------------- number rules


def heading_roman(words: str, reading: Rule, *, any_case: bool = False) -> Rule:
    first = "".join(sorted({word[0] for word in words.split("|")}))
    start = f"(?=[{first}{first.lower()}])" if any_case else f"(?=[{first}])"
    pattern = f"{start}(?{'iuU' if any_case else 'U'})" + rf"(?={words})\b({words})\s+([IVXLCDM]+)\b"

    def read(hit: Column) -> Column:
        def spoken(value: Column) -> Column:
            said = F.concat(F.regexp_extract(hit, U + r"^(.*?)\s+\S+$", 1), F.lit(" "), reading(value.cast("string")))
            return F.when(value > 0, said).otherwise(hit)

        return bind(bind(F.regexp_extract(hit, "[A-Za-z]+$", 0), N.roman_value), spoken)

    return lambda text: regex_transform(text, pattern, read, hint=f"{start}{'(?iu)' if any_case else ''}(?:{words})")


def prefixed_currency(signs: dict[str, str], reader: N.Reader) -> Rule:
    pattern = "[" + "".join(signs) + "]" + U + r"\s?" + AMOUNT

    def read(hit: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
        code = F.try_element_at(names, F.left(hit, F.lit(1)))
        amount = F.regexp_replace(hit, r"[^0-9.]", "")
        return F.coalesce(reader.money(amount, code, sorted(signs.values())), hit)

    return lambda text: regex_transform(text, pattern, read, hint="[" + "".join(signs) + "]")


def suffixed_currency(pattern: str, code: str, reader: N.Reader, amount: Rule, hint: str) -> Rule:
    return lambda text: regex_transform(
        text, pattern, lambda hit: F.coalesce(reader.money(amount(hit), F.lit(code), [code]), hit), hint
    )


def percent(pattern: str, word: str, reader: N.Reader) -> Rule:
    def read(hit: Column) -> Column:
        number = F.replace(F.regexp_replace(hit, U + r"\s?%$", ""), F.lit(","), F.lit("."))
        return F.concat(reader.quantity(number), F.lit(f" {word}"))

    return lambda text: regex_transform(text, pattern, read, hint="%")


def year_range(pattern: str, joiner: str, reading: Rule) -> Rule:
    def read(hit: Column) -> Column:
        return F.concat(reading(F.left(hit, F.lit(4))), F.lit(joiner), reading(F.right(hit, F.lit(4))))

    return lambda text: regex_transform(text, pattern, read, hint="[0-9].?[-–—].?[12]")


def reread(pattern: str, reading: Rule, hint: str = "[0-9]") -> Rule:
    """Plain case: the whole match is handed to ``reading``."""
    return lambda text: regex_transform(text, pattern, reading, hint)


def _years(joiner: str, reading: Rule) -> list[tuple[str, Rule]]:
    return [
        ("year_range", year_range(U + rf"{DIGIT}\b{YEAR}\s?[-–—]\s?{YEAR}\b", joiner, reading)),
        ("year", reread(U + rf"{DIGIT}\b{YEAR}\b", reading, hint=YEAR)),
    ]


# ------------------------------------------------------------------- rulesets


@dataclass(frozen=True)
class Ruleset:
    version: str
    clean: list[tuple[str, Rule]]
    spoken: list[tuple[str, Rule]]

    def cleaned(self, text: Column) -> Column:
        for _, rule in self.clean:
            text = rule(text)
        return text

    def said(self, text: Column) -> Column:
        """Numbers of a cleaned text in words."""

        def speak(t: Column) -> Column:
            for _, rule in self.spoken:
                t = rule(t)
            return t

        return bind(text, lambda t: F.when(t.rlike("[0-9]"), speak(t)).otherwise(t))

    def apply(self, text: Column) -> Column:
        return self.said(self.cleaned(text))

    def rule(self, name: str) -> Rule:
        return dict(self.clean + self.spoken)[name]


def _english() -> Ruleset:
    r = N.ENGLISH
    return Ruleset(
        VERSIONS["en"],
        [
            ("symbols", plain_symbols(QUOTES_EN, "and")),
            ("capitals", calm_capitals(CAPS_EN, KEEP_CAPS_EN)),
            ("spaces", squeeze),
            ("abbreviations", expand_abbreviations(ABBREVIATIONS_EN, sentence_case=False)),
            ("heading", heading_roman(HEADINGS_EN, r.cardinal)),
        ],
        [
            ("currency", prefixed_currency(CURRENCY_SIGNS, r)),
            ("percent", percent(U + DIGIT + r"[0-9]+(?:\.[0-9]+)?\s?%", "percent", r)),
            *_years(" to ", r.year),
            (
                "ordinal",
                reread(
                    U + rf"(?i){DIGIT}\b[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:st|nd|rd|th)\b",
                    lambda hit: r.ordinal(digits_of(hit)),
                    hint="[0-9](?i:st|nd|rd|th)",
                ),
            ),
            ("decimal", reread(U + rf"{DIGIT}\b[0-9]+\.[0-9]+\b", r.quantity, hint=r"[0-9]\.[0-9]")),
            (
                "integer",
                reread(
                    U + rf"{DIGIT}\b(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)\b",
                    lambda hit: r.cardinal(digits_of(hit)),
                ),
            ),
        ],
    )


def _comma_numbers(reader: N.Reader) -> list[tuple[str, Rule]]:
    """Decimal comma, and groups of three set off by a space or a full stop."""
    return [
        (
            "decimal",
            reread(
                U + rf"{DIGIT}\b[0-9]+,[0-9]+\b",
                lambda hit: reader.quantity(F.replace(hit, F.lit(","), F.lit("."))),
                hint="[0-9],[0-9]",
            ),
        ),
        (
            "integer",
            reread(
                U + rf"{DIGIT}\b(?:[0-9]{{1,3}}(?:[ .][0-9]{{3}})+|[0-9]+)\b",
                lambda hit: reader.cardinal(digits_of(hit)),
            ),
        ),
    ]


def _german() -> Ruleset:
    r = N.GERMAN
    return Ruleset(
        VERSIONS["de"],
        [
            ("symbols", plain_symbols(QUOTES_DE_PL, "und")),
            ("capitals", calm_capitals(CAPS_DE, KEEP_CAPS_DE)),
            ("spaces", squeeze),
            ("abbreviations", expand_abbreviations(ABBREVIATIONS_DE, sentence_case=True)),
            ("heading", heading_roman(HEADINGS_DE, r.cardinal)),
        ],
        [
            (
                "ordinal",
                reread(
                    U + rf"{DIGIT}\b[0-9]{{1,4}}\.\s+(?={ORDINAL_WORDS_DE})",
                    lambda hit: F.concat(r.ordinal(digits_of(hit)), F.lit(" ")),
                    hint=U + r"[0-9]\.\s",
                ),
            ),
            ("currency", prefixed_currency({s: CURRENCY_SIGNS[s] for s in "$£"}, r)),
            (
                "euro",
                suffixed_currency(
                    U + DIGIT + r"[0-9][0-9.\s]*(?:,[0-9]+)?\s?(?:€|EUR\b)",
                    "EUR",
                    r,
                    lambda hit: F.replace(F.regexp_replace(hit, "[^0-9,]", ""), F.lit(","), F.lit(".")),
                    "€|EUR",
                ),
            ),
            ("percent", percent(U + DIGIT + r"[0-9]+(?:,[0-9]+)?\s?%", "Prozent", r)),
            *_years(" bis ", r.year),
            *_comma_numbers(r),
        ],
    )


def _polish() -> Ruleset:
    r = N.POLISH
    return Ruleset(
        VERSIONS["pl"],
        [
            ("symbols", plain_symbols(QUOTES_DE_PL, "i")),
            ("capitals", calm_capitals(CAPS_PL, KEEP_CAPS_PL)),
            ("spaces", squeeze),
            ("abbreviations", expand_abbreviations(ABBREVIATIONS_PL, sentence_case=True)),
            ("heading", heading_roman(HEADINGS_PL, r.ordinal, any_case=True)),
        ],
        [
            ("currency", prefixed_currency(CURRENCY_SIGNS, r)),
            (
                "zloty",
                suffixed_currency(
                    U + DIGIT + r"[0-9][0-9\s]*(?:[.,][0-9]+)?\s?(?:zł|PLN)\b",
                    "PLN",
                    r,
                    lambda hit: F.replace(F.regexp_replace(hit, "[^0-9,.]", ""), F.lit(","), F.lit(".")),
                    "zł|PLN",
                ),
            ),
            ("percent", percent(U + DIGIT + r"[0-9]+(?:[.,][0-9]+)?\s?%", "procent", r)),
            *_years(" do ", r.year),
            *_comma_numbers(r),
        ],
    )


def _zh_amount(hit: Column) -> Column:
    return N.zh_cardinal(F.regexp_replace(hit, "[^0-9.]", ""))


def _zh_prefixed(hit: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CURRENCY_WORDS_ZH.items() for x in kv])
    return F.concat(_zh_amount(hit), F.try_element_at(names, F.left(hit, F.lit(1))))


def _chinese() -> Ruleset:
    alone = r"(?<![0-9])", r"(?![0-9])"
    return Ruleset(
        VERSIONS["zh"],
        [("spaces", lambda text: squeeze(F.translate(text, "\xa0", " ")))],
        [
            (
                "heading",
                reread(
                    U + r"第\s*[0-9]+\s*[章节部卷回幕篇]",
                    lambda hit: F.concat(F.lit("第"), _zh_amount(hit), F.right(hit, F.lit(1))),
                    hint="第",
                ),
            ),
            ("currency", reread(U + r"[$£¥]\s?" + AMOUNT, _zh_prefixed, hint="[$£¥]")),
            (
                "yuan",
                reread(U + DIGIT + AMOUNT + r"\s?(?:元|CNY|RMB)\b", lambda hit: F.concat(_zh_amount(hit), F.lit("元")), hint="元|CNY|RMB"),
            ),
            (
                "percent",
                reread(U + DIGIT + r"[0-9]+(?:\.[0-9]+)?\s?%", lambda hit: F.concat(F.lit("百分之"), _zh_amount(hit)), hint="%"),
            ),
            (
                "year_range",
                year_range(U + rf"{DIGIT}{alone[0]}{YEAR}\s?[-–—]\s?{YEAR}{alone[1]}", "到", N.zh_direct),
            ),
            ("year", reread(rf"{DIGIT}{alone[0]}{YEAR}{alone[1]}", N.zh_direct, hint=YEAR)),
            ("number", reread(r"[0-9]+(?:\.[0-9]+)?", N.zh_cardinal)),
        ],
    )


class NormalizerRegistry:
    """Language code → rule function and version; users may register more."""

    def __init__(self) -> None:
        self._rules: dict[str, tuple[tuple[Rule, ...], str]] = {}

    def register(self, language: str, rule: Rule, version: str, *further: Rule) -> None:
        """``further`` rules go on where the first one ends; a plan may make each a column of its own."""
        self._rules[language] = ((rule, *further), version)

    def languages(self) -> list[str]:
        return sorted(self._rules)

    def steps(self) -> list[Callable[[Column, Column], Column]]:
        """``normalize`` in as many steps as the longest chain has; each takes text and language."""

        def step(at: int) -> Callable[[Column, Column], Column]:
            def run(text: Column, language: Column) -> Column:
                out = F.lit(None).cast("string")
                for code, (rules, _) in self._rules.items():
                    out = F.when(language == code, rules[at](text) if at < len(rules) else text).otherwise(out)
                return out

            return run

        return [step(at) for at in range(max((len(rules) for rules, _ in self._rules.values()), default=1))]

    def normalize(self, text: Column, language: Column) -> Column:
        """Each row meets the chain of its own language; unknown languages give null."""
        out = F.lit(None).cast("string")
        for code, (rules, _) in self._rules.items():
            done = text
            for rule in rules:
                done = rule(done)
            out = F.when(language == code, done).otherwise(out)
        return out

    def version(self, language: Column) -> Column:
        out = F.lit(None).cast("string")
        for code, (_, version) in self._rules.items():
            out = F.when(language == code, F.lit(version)).otherwise(out)
        return out

    def unsupported(self, rows: DataFrame, language: str = "language") -> DataFrame:
        """Rows no registered normalizer can read, with the reason."""
        known = ", ".join(self.languages())
        lang = F.col(language)
        return rows.filter(lang.isNull() | ~lang.isin(self.languages())).withColumn(
            "error",
            F.concat(F.lit("no normalizer for language "), F.coalesce(lang, F.lit("null")), F.lit(f" (known: {known})")),
        )


RULESETS = {"en": _english(), "de": _german(), "pl": _polish(), "zh": _chinese()}


def default_registry(languages: list[str] | None = None) -> NormalizerRegistry:
    """The built-in rules; a job that knows its languages need not carry the others' expressions."""
    registry = NormalizerRegistry()
    for code, ruleset in RULESETS.items():
        if languages is None or code in languages:
            registry.register(code, ruleset.cleaned, ruleset.version, ruleset.said)
    return registry


def normalize(text: Column, language: Column) -> Column:
    return default_registry().normalize(text, language)


def normalizer_version(language: Column) -> Column:
    return default_registry().version(language)
