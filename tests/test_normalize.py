"""Golden strings: each row is (language, input, expected)."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions.normalize import normalize
from lectern.functions.segment import pack_chunks, segment_text, split_sentences

# Short forms whose reading is given.
CONTRACTS = [
    ("en", "$1,234.56", "one thousand, two hundred and thirty-four dollars, fifty-six cents"),
    ("en", "1939-1945", "nineteen thirty-nine to nineteen forty-five"),
    ("en", "3rd", "third"),
    ("de", "1939-1945", "neunzehnhundertneununddreißig bis neunzehnhundertfünfundvierzig"),
    ("pl", "1939-1945", "tysiąc dziewięćset trzydziesty dziewiąty do tysiąc dziewięćset czterdziesty piąty"),
    ("zh", "1939-1945", "一九三九到一九四五"),
]

GOLDEN = CONTRACTS + [
    ("en", "Chapter XII", "Chapter twelve"),
    ("en", "Chapter VI: Low Tide", "Chapter six: Low Tide"),
    ("en", "from 1871–1903 onward", "from eighteen seventy-one to nineteen oh three onward"),
    ("en", "Mrs. Okafor met Dr. Lund.", "Missus Okafor met Doctor Lund."),
    ("en", "A ticket is $7 and a meal £12.", "A ticket is seven dollars and a meal twelve pounds sterling."),
    ("en", "Rain fell on 62% of the days.", "Rain fell on sixty-two percent of the days."),
    ("en", "By 1907 the mill stood empty.", "By nineteen oh seven the mill stood empty."),
    ("en", "Records from 2019 are lost.", "Records from two thousand nineteen are lost."),
    ("en", "the winter of 1700", "the winter of seventeen hundred"),
    ("en", "their 32nd voyage", "their thirty-second voyage"),
    ("en", "48,217 letters arrived", "forty-eight thousand, two hundred and seventeen letters arrived"),
    ("en", "a slope of 2.75 degrees", "a slope of two point seven five degrees"),
    ("en", "salt & pepper", "salt and pepper"),
    ("en", "the fee was €40", "the fee was forty euro"),
    ("en", "“Wait,” he wrote… ‘please.’", "\"Wait,\" he wrote... 'please.'"),
    ("en", "The sign read STAY AWAY near the FBI office.", "The sign read Stay Away near the FBI office."),
    ("en", "3000007 and 4,056,031 and 900", "three million and seven and four million, fifty-six thousand and thirty-one and nine hundred"),
    ("en", "the 300th, 50th and 21,000th", "the three hundredth, fiftieth and twenty-one thousandth"),
    ("en", "8.60 or 9.0 or 004", "eight point six or nine point zero or four"),
    ("en", "$1 and $1.01 and £0.01", "one dollar and one dollar, one cent and zero pounds sterling, one penny"),
    ("en", "  x \t y\xa0z  ", "x y z"),
    ("de", "Kapitel XII", "Kapitel zwölf"),
    ("de", "Seit 1871 gehört das Haus uns.", "Seit achtzehnhunderteinundsiebzig gehört das Haus uns."),
    ("de", "Die Akten von 2019 fehlen.", "Die Akten von zweitausendneunzehn fehlen."),
    ("de", "Ein Brot kostet 3 €.", "Ein Brot kostet drei Euro."),
    ("de", "Der Korb kam auf 18,75 €.", "Der Korb kam auf achtzehn Euro und fünfundsiebzig Cent."),
    ("de", "Nur 62% stimmten zu.", "Nur zweiundsechzig Prozent stimmten zu."),
    ("de", "Haus Nr. 8 brannte.", "Haus Nummer acht brannte."),
    ("de", "48.217 Briefe kamen an.", "achtundvierzigtausendzweihundertsiebzehn Briefe kamen an."),
    ("de", "Obst, z.B. Birnen, usw.", "Obst, zum Beispiel Birnen, und so weiter"),
    ("de", "7. Akt", "siebte Akt"),
    ("de", "„Warte,” schrieb er… 'bitte.'", "\"Warte,\" schrieb er... 'bitte.'"),
    ("de", "Dort stand BETRETEN VERBOTEN für die USA.", "Dort stand Betreten Verboten für die USA."),
    ("de", "1 € und 201 EUR", "ein Euro und zweihundertein Euro"),
    ("de", "4.000.002 Bäume", "vier Millionen zwei Bäume"),
    ("pl", "Rozdział XII", "Rozdział dwunasty"),
    ("pl", "Rozdział VI: Odpływ", "Rozdział szósty: Odpływ"),
    ("pl", "W 1871 roku zbudowano młyn.", "W tysiąc osiemset siedemdziesiąty pierwszy roku zbudowano młyn."),
    ("pl", "Chleb kosztuje 300 zł.", "Chleb kosztuje trzysta złotych."),
    ("pl", "Koszyk był za 18,75 zł.", "Koszyk był za osiemnaście złotych, siedemdziesiąt pięć groszy."),
    ("pl", "Zgodziło się 62% z nich.", "Zgodziło się sześćdziesiąt dwa procent z nich."),
    ("pl", "Przyszło 48.217 listów.", "Przyszło czterdzieści osiem tysięcy dwieście siedemnaście listów."),
    ("pl", "Owoce, np. gruszki, itd. na stole.", "Owoce, na przykład gruszki, i tak dalej na stole."),
    ("pl", "ul. Długa 8", "ulica Długa osiem"),
    ("pl", "Bilet za $7 czeka.", "Bilet za siedem dolarów amerykańskich czeka."),
    ("pl", "Napis ZAKAZ WSTĘPU wisiał w USA.", "Napis Zakaz Wstępu wisiał w USA."),
    ("pl", "rozdział vi", "rozdział szósty"),
    ("zh", "第22章", "第二十二章"),
    ("zh", "第6节", "第六节"),
    ("zh", "磨坊建于1871年。", "磨坊建于一八七一年。"),
    ("zh", "面包卖300元。", "面包卖三百元。"),
    ("zh", "票价$7。", "票价七美元。"),
    ("zh", "有62%的人同意。", "有百分之六十二的人同意。"),
    ("zh", "篮子要18.5元。", "篮子要十八点五元。"),
    ("zh", "来了48217封信。", "来了四万八千二百一十七封信。"),
    ("zh", "共有305020417棵树。", "共有三亿零五百零二万零四百一十七棵树。"),
]


def test_golden(spark):
    rows = spark.createDataFrame(GOLDEN, "lang string, input string, expected string")
    got = rows.repartition(8).select("lang", "input", "expected", normalize(F.col("input"), F.col("lang")).alias("got")).collect()
    bad = [(r.lang, r.input, r.expected, r.got) for r in got if r.got != r.expected]
    assert not bad and len(got) == len(GOLDEN)


NUMBERS = [
    ("zh_cardinal", "100000005", "一亿零五"), ("zh_cardinal", "10002345", "一千万零二千三百四十五"),
    ("zh_cardinal", "105", "一百零五"), ("zh_cardinal", "110000", "十一万"), ("zh_cardinal", "0", "零"),
    ("zh_cardinal", "1000000000000", "一万亿"), ("zh_cardinal", "10500005", "一千零五十万零五"),
    ("pl_ordinal", "2000", "dwutysięczny"), ("pl_ordinal", "1000", "tysięczny"), ("pl_ordinal", "100", "setny"),
    ("pl_cardinal", "2000000", "dwa miliony"), ("pl_cardinal", "1001", "tysiąc jeden"),
    ("de_ordinal", "100", "hundertste"), ("de_ordinal", "21", "einundzwanzigste"), ("de_ordinal", "7", "siebte"),
    ("de_cardinal", "2000000", "zwei Millionen"), ("de_cardinal", "100", "einhundert"),
    ("de_year", "1905", "neunzehnhundertfünf"), ("de_year", "2100", "einundzwanzighundert"),
    ("en_cardinal", "0", "zero"), ("en_cardinal", "1100", "one thousand, one hundred"),
    ("en_cardinal", "4785380592391139", "four quadrillion, seven hundred and eighty-five trillion, three hundred and eighty billion, five hundred and ninety-two million, three hundred and ninety-one thousand, one hundred and thirty-nine"),
    ("en_ordinal", "1012", "one thousand and twelfth"),
    ("pl_ordinal", "10000", "dziesięciotysięczny"), ("pl_ordinal", "25000", "dwudziestopięciotysięczny"), ("pl_ordinal", "100000", "stutysięczny"),
    ("pl_ordinal", "1000000", "milionowy"), ("pl_ordinal", "5000000", "pięciomilionowy"), ("pl_ordinal", "2000000000", "dwumiliardowy"),
    ("pl_ordinal", "1002000", "milion dwutysięczny"), ("pl_ordinal", "12345", "dwanaście tysięcy trzysta czterdziesty piąty"), ("pl_ordinal", "0000", "zerowy"),
    ("de_ordinal", "1000000", "millionste"), ("de_ordinal", "2000000", "zweimillionste"), ("de_ordinal", "3000000000", "dreimilliardste"),
    ("de_ordinal", "1001000000", "eine milliarde einmillionste"), ("de_ordinal", "1000001", "eine million erste"), ("de_ordinal", "2017", "zweitausendsiebzehnte"),
    ("de_ordinal", "117", "einhundertsiebzehnte"), ("de_ordinal", "103", "einhundertdritte"), ("de_ordinal", "1000", "tausendste"), ("de_ordinal", "30", "dreißigste"),
    ("de_ordinal", "0", "nullte"), ("de_ordinal", "80", "achtzigste"), ("de_ordinal", "70000", "siebzigtausendste"),
    ("en_cardinal", "9" * 67, " ".join(["nine"] * 67)), ("en_ordinal", "1" * 67, " ".join(["one"] * 66 + ["first"])),
    ("de_ordinal", "1" * 31, " ".join(["eins"] * 30 + ["erste"])), ("pl_ordinal", "2" * 28, " ".join(["dwa"] * 27 + ["drugi"])),
    ("zh_cardinal", "12345678901234567.5", "一二三四五六七八九零一二三四五六七点五"),
]


def test_number_words(spark):
    for fn in sorted({n[0] for n in NUMBERS}):
        cases = [(a, b) for f, a, b in NUMBERS if f == fn]
        df = spark.createDataFrame(cases, "d string, want string")
        got = df.select("d", "want", getattr(N, fn)(F.col("d")).alias("got")).collect()
        assert [(r.d, r.got) for r in got] == [(r.d, r.want) for r in got], fn


def test_roman(spark):
    df = spark.createDataFrame([("XIV", 14), ("iv", 4), ("MCMXCIV", 1994), ("ABC", None), ("", None)], "t string, want int")
    assert all(r.want == r.got for r in df.select("want", N.roman_value(F.col("t")).alias("got")).collect())


def _split(spark, text, lang="en"):
    df = spark.createDataFrame([(text, lang)], "t string, l string")
    return df.select(split_sentences(F.col("t"), F.col("l")).alias("s")).first().s


def _pack(spark, sentences, max_chars, joiner=" "):
    df = spark.createDataFrame([(sentences,)], "s array<string>")
    return df.select(pack_chunks(F.col("s"), F.lit(joiner), max_chars).alias("c")).first().c


def test_sentences(spark):
    assert _split(spark, "The ferry left at noon. Nobody waved! Had they forgotten?") == [
        "The ferry left at noon.", "Nobody waved!", "Had they forgotten?"]
    assert _split(spark, "") == [] and _split(spark, "   ") == []
    assert _split(spark, "渡船，走了。没有人挥手！他们忘了吗？", "zh") == ["渡船，走了。", "没有人挥手！", "他们忘了吗？"]
    assert _split(spark, "P. T. Moreau sang. We slept.") == ["P. T. Moreau sang.", "We slept."]


def test_pack(spark):
    sentences = ["Ah.", "Row on.", "Steer.", "Halt.", "Mind that!", "Pull hard.", "Turn back.", "Lie still."]
    chunks = _pack(spark, sentences, 30)
    assert all(len(c) <= 30 for c in chunks) and " ".join(chunks) == " ".join(sentences)
    assert chunks == ["Ah. Row on. Steer. Halt.", "Mind that! Pull hard.", "Turn back. Lie still."]
    long = "x" * 120
    assert _pack(spark, [long], 50) == [long]
    assert _pack(spark, ["a.", long, "b."], 50) == ["a.", long, "b."]
    assert _pack(spark, ["上船。", "下船。"], 1000, "") == ["上船。下船。"]
    assert _pack(spark, [], 50) == []


@pytest.mark.parametrize("seed", range(3))
def test_pack_matches_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    sentences = ["w" * rng.randint(1, 60) for _ in range(80)]
    want, cur = [], []
    for s in sentences:
        if cur and len(" ".join(cur + [s])) > 70:
            want.append(" ".join(cur))
            cur = []
        cur.append(s)
    want.append(" ".join(cur))
    assert _pack(spark, sentences, 70) == want


def test_segment(spark):
    df = spark.createDataFrame([("渡船，走了。没有人挥手！", "zh"), ("The ferry left. Nobody waved.", "en")], "t string, l string")
    got = [r.c for r in df.select(segment_text(F.col("t"), F.col("l"), 1000).alias("c")).collect()]
    assert got == [["渡船，走了。没有人挥手！"], ["The ferry left. Nobody waved."]]
