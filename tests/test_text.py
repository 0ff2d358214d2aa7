"""Worked examples of text normalization."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from parlance.functions import numbers as N
from parlance.functions import text as X
from parlance.operators import casing as R


@pytest.fixture(scope="module")
def one(spark):
    def run(column, text, name="text"):
        return spark.createDataFrame([(text,)], f"{name} string").select(column.alias("x")).first().x

    return run


GOLDEN = [
    ("fr", "1,20€ et 3/10/1998", "un euros vingt et trois octobre mille neuf cent quatre-vingt-dix-huit"),
    ("en", "1.20$ and -5", "one dollars twenty and minus five"),
    ("en", "on 3/04, 12/05/1999, 3/4, 1/2/3 and 007",
     "on third april, twelfth may one thousand, nine hundred and ninety-nine, three quarters, one / two / three and zero zero seven"),
    ("fr", "XIV XXe XX I IV 1/2 3/2 5/4 1er 2nde 21e 80e",
     "quatorze vingtième vingt I IV un demi trois demis cinq quarts premier deuxième vingt et unième quatre-vingtième"),
    ("en", "1 234 567 and 12% a&b 1st 22nd 13th 100th 3rd XXI",
     "one million, two hundred and thirty-four thousand, five hundred and sixty-seven and twelve percent a and b "
     "first twenty-second thirteenth one hundredth third twenty-one"),
    ("es", "12 y 3/4, 1/2 y 21 000", "doce y tres cuartos, uno mitad y veintiún mil"),
    ("de", "21 und 101 000, -7, XII", "einundzwanzig und einhunderteintausend, minus sieben, zwölf"),
    ("it", "12 e 3", "12 e 3"),
    ("en", "12345678901 and 1001 5",
     "twelve billion, three hundred and forty-five million, six hundred and seventy-eight thousand, nine hundred and one "
     "and one thousand and one five"),
    ("fr", "1/08 m² 25°C 3+4 5*6", "premier août mètres carrés vingt-cinq degrés Celsius trois plus quatre cinq fois six"),
    ("en", "no digits  here", "no digits here"),
    ("en", "costs 5$ or 7*2", "costs five dollars or seven times two"),
]


def test_normalize_text(spark):
    rows = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(GOLDEN)], "i int, lang string, text string")
    got = {r.i: r.text for r in X.normalize_text(rows).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(GOLDEN)}


def test_cleaning(one):
    t = F.col("text")
    assert one(X.remove_emoji(t), "a😀b🚀c") == "abc"
    assert one(X.remove_punctuation(t), "¡«Hola, €5-C++!»") == "Hola, €5-C++"
    assert one(X.remove_punctuation(t), "...") == ""
    assert one(X.remove_punctuation(t), "ab@gmail.com.") == "ab@gmail.com"
    assert one(X.no_space_word(t)[0], "foo 12") == "foo" and one(X.no_space_word(t)[1], "foo 12") is None
    assert one(X.no_space_word(t)[0], "foo bar") is None and one(X.no_space_word(t)[1], "foo bar").startswith("unexpected")
    assert one(X.transliterate(t), "à ß œ ﬂ") == "a ss oe fl"


def test_transliterate_whole_planes(spark):
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in list(range(0x80, 0x3400, 64)) + list(range(0xF900, 0xFFC0, 64)) + list(range(0x1D400, 0x1D800, 64))]

    def plain(text):
        for char, to in (("œ", "oe"), ("æ", "ae"), ("Œ", "OE"), ("Æ", "AE"), ("ß", "ss")):
            text = text.replace(char, to)
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()

    rows = spark.createDataFrame([(t, plain(t)) for t in texts], "text string, want string")
    assert rows.filter(X.transliterate(F.col("text")) != F.col("want")).count() == 0


def test_currency(one):
    assert one(F.expr(X.reorder_currency("text", "'fr'")), "1,20€") == "1 € 20"
    assert one(F.expr(X.reorder_currency("text", "'en'")), "1.20$") == "1 $ 20"


def test_roman(one):
    assert one(F.expr(X.roman_tokens("text", "'en'")), "XIV XX I IV MXX") == ["XIV", "XX"]
    values = {t: one(F.expr(X.roman_value("text")), t) for t in ("XIV", "XX", "XXXIX", "XL"[:1] + "VIII", "XIe")}
    assert values == {"XIV": 14, "XX": 20, "XXXIX": 39, "XVIII": 18, "XIe": 11}


@pytest.mark.parametrize("n,en,fr,en_th,fr_th", [
    (0, "zero", "zéro", "zeroth", "zéroième"),
    (1, "one", "un", "first", "premier"),
    (71, "seventy-one", "soixante et onze", "seventy-first", "soixante et onzième"),
    (80, "eighty", "quatre-vingts", "eightieth", "quatre-vingtième"),
    (85, "eighty-five", "quatre-vingt-cinq", "eighty-fifth", "quatre-vingt-cinquième"),
    (200, "two hundred", "deux cents", "two hundredth", "deux centième"),
    (209, "two hundred and nine", "deux cent neuf", "two hundred and ninth", "deux cent neuvième"),
    (1000, "one thousand", "mille", "one thousandth", "millième"),
    (80_000, "eighty thousand", "quatre-vingt mille", "eighty thousandth", "quatre-vingt millième"),
    (1_001_012, "one million, one thousand and twelve", "un million mille douze", "one million, one thousand and twelfth", "un million mille douzième"),
    (200_000_000, "two hundred million", "deux cents millions", "two hundred millionth", "deux cents millionsième"),
])
def test_numbers(spark, n, en, fr, en_th, fr_th):
    row = spark.range(1).select(
        *[F.expr(N.with_names(rule(f"'{n}'", lang))).alias(f"{lang}{i}") for i, rule in enumerate((N.cardinal, N.ordinal)) for lang in ("en", "fr")]
    ).first()
    assert (row.en0, row.fr0, row.en1) == (en, fr, en_th)
    if n != 200_000_000:
        assert row.fr1 == fr_th


def test_undigit(spark):
    def words(digits, lang, to="cardinal"):
        return spark.range(1).select(F.expr(N.with_names(X.undigit(f"'{digits}'", f"'{lang}'", to)))).first()[0]

    assert words("007", "en") == "zero zero seven"
    assert words("2", "fr", "denominator") == "demi"
    assert words("4", "en", "denominator") == "quarter"
    assert words("5", "en", "denominator") == "fifth"


def test_labels_to_text(spark):
    tokens = [(1, 0, "[CLS]", 0, 0), (1, 1, "hello", 1, 0), (1, 2, "won", 0, 1), (1, 3, "##der", 2, 1), (1, 4, "l", 0, 0),
              (1, 5, "'", 0, 0), (1, 6, "eau", 0, 0), (1, 7, "[SEP]", 2, 0)]
    rows = spark.createDataFrame(tokens, "doc long, pos int, token string, punc_label int, case_label int")
    plain = F.lit(False)
    assert R.detokenize(rows, ["doc"], plain).first().text == "Hello, WONDER. L'eau."
    marked = rows.replace({"won": "a"}).withColumn("punc_label", F.expr("if(pos = 2, 3, punc_label)"))
    assert R.detokenize(marked, ["doc"], plain, compat=True).first().text == "Hello, A ?DER L'eau.".replace(" L'", " L'")
    french = [(1, 0, "bon", 0, 0), (1, 1, "jour</w>", 4, 0), (1, 2, "toi</w>", 2, 3)]
    rows = spark.createDataFrame(french, "doc long, pos int, token string, punc_label int, case_label int")
    assert R.detokenize(rows, ["doc"], F.lit(True)).first().text == "Bonjour ! Toi."


def test_fillers(spark):
    text = "bonjour euh je veux heu partir"
    row = spark.createDataFrame([(text,)], "text string").select(
        R.find_disfluencies(F.col("text"), "fr").alias("hits"), R.remove_disfluencies(F.col("text"), "fr").alias("clean")
    ).first()
    assert [(h.start, h.hit) for h in row.hits] == [(7, " euh "), (19, " heu ")]
    assert row.clean == "bonjour je veux partir"
    back = spark.createDataFrame([("Bonjour, je veux partir.", [(7, " euh "), (19, " heu ")])], "t string, h array<struct<start:int,hit:string>>")
    assert back.select(R.restore_disfluencies(F.col("t"), F.col("h"))).first()[0] == "Bonjour euh, je veux heu partir."
    assert spark.range(1).select(R.find_disfluencies(F.lit(text), "en")).first()[0] == []


def test_text_fields(one):
    op = R.map_text_field(F.col("text"), lambda c: F.upper(c))
    assert one(op, ' {"a": 1, "text": "hi"} ') == '{"a":1,"text":"HI"}'
    assert one(op, "hi ") == "HI" and one(op, "  ") == ""


def test_wordpieces(spark):
    words = spark.createDataFrame([("unaffable",), ("unaffable",), ("Un",), ("xyz",), ("un" * 60,)], "word string")
    vocab = spark.createDataFrame([("un",), ("##aff",), ("##able",), ("##un",)], "piece string")
    got = {r.word: (r.n, r.pieces, r.known) for r in R.wordpiece_coverage(words, vocab).collect()}
    assert got["unaffable"] == (2, ["un", "##aff", "##able"], True)
    assert got["Un"] == (1, ["Un"], True)
    assert got["xyz"][2] is False and got["un" * 60][2] is False


@pytest.mark.parametrize("n,de,es,de_th,es_th", [
    (0, "null", "cero", "nullte", "cero"),
    (1, "eins", "uno", "erste", "primero"),
    (27, "siebenundzwanzig", "veintisiete", "siebenundzwanzigste", "vigésimo séptimo"),
    (101, "einhunderteins", "ciento uno", "einhunderterste", "centésimo primero"),
    (1100, "eintausendeinhundert", "mil cien", "eintausendeinhundertste", "milésimo centésimo"),
    (31_000, "einunddreißigtausend", "treinta y un mil", "einunddreißigtausendste", "treinta y uno milésimo"),
    (1_000_000, "eine Million", "un millón", None, None),
    (2_021_000_003, "zwei Milliarden einundzwanzig Millionen drei", "dos mil veintiún millones tres", None, None),
])
def test_german_and_spanish_numbers(spark, n, de, es, de_th, es_th):
    row = spark.range(1).select(
        *[F.expr(N.with_names(rule(f"'{n}'", lang))).alias(f"{lang}{i}") for i, rule in enumerate((N.cardinal, N.ordinal)) for lang in ("de", "es")]
    ).first()
    assert (row.de0, row.es0) == (de, es)
    if de_th:
        assert (row.de1, row.es1) == (de_th, es_th)


def test_numbers_of_any_length(spark):
    row = spark.range(1).select(
        F.expr(N.with_names(N.cardinal("'1000000000000000000000000000000000001'", "en"))).alias("long"),
        F.expr(N.with_names(N.cardinal("'999000000000000000000000000000000000'", "en"))).alias("top"),
    ).first()
    assert row.top == "nine hundred and ninety-nine decillion"
    assert row.long == "one " + "zero " * 35 + "one"


def test_normalize_text_stays_in_the_row(spark):
    rows = spark.createDataFrame([(1, "en", "12/05/1999 and 901 045")], "i int, lang string, text string")
    plan = X.normalize_text(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("lang", N.SPELLED)
def test_ordinals_looked_up_follow_the_rule(spark, lang):
    by_rule = F.expr(N.with_names(N.ordinal("d", lang, N.cardinal("d", lang))))
    looked_up = F.expr(N.with_names(N.ordinal("d", lang)))
    assert spark.range(1200).select(F.col("id").cast("string").alias("d")).filter(by_rule != looked_up).count() == 0


def test_word_boundaries_at_repeated_and_overlapping_places(spark):
    other = X.NOT_W.replace(r"\p{L}\p{N}", "a-z0-9")

    def want(text, orig):
        text = re.sub(f"({other}){orig}({other})", r"\1one\2", text)
        text = re.sub(f"{orig}({other})", r" one\1", text)
        return re.sub(orig, " one ", re.sub(f"({other}){orig}", r"\1one ", text))

    pick = random.Random(5)
    rows = [("".join(pick.choices("5 %-/x12", k=pick.randint(1, 14))), orig) for orig in ("5", "55", "-5", "5/5", "5 5", "1%", "12") for _ in range(300)]
    frame = spark.createDataFrame(rows, "text string, orig string")
    got = frame.select("text", "orig", F.expr(X.replace_keeping_word_boundaries("text", "orig", "'one'")).alias("out")).collect()
    assert [(r.text, r.orig, r.out) for r in got if r.out != want(r.text, r.orig)] == []
