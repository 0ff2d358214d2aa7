"""Number words as SQL expressions over digit strings of any length: English, French, German, Spanish.

A number is a string of digits without leading zeros. It is cut into groups of three digits (six in
Spanish), each group takes its name from a list of a thousand, and a scale word by its place. Beyond
the scale words, at 10^36, digits are read one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import count

# The words number names are made of.
EN_UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
            "fifteen sixteen seventeen eighteen nineteen").split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
FR_UNITS = ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze "
            "seize dix-sept dix-huit dix-neuf").split()
FR_TENS = "vingt trente quarante cinquante soixante".split()
DE_UNITS = ("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn "
            "sechzehn siebzehn achtzehn neunzehn").split()
DE_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
ES_UNITS = ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis "
            "diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco "
            "veintiséis veintisiete veintiocho veintinueve").split()
ES_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = ("ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos "
               "novecientos").split()
ES_ORDINALS = (
    "primero segundo tercero cuarto quinto sexto séptimo octavo noveno".split(),
    "décimo vigésimo trigésimo cuadragésimo quincuagésimo sexagésimo septuagésimo octogésimo nonagésimo".split(),
    ("centésimo ducentésimo tricentésimo cuadringentésimo quingentésimo sexcentésimo septingentésimo "
     "octingentésimo noningentésimo").split(),
)
EN_SCALES = ("thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion "
             "decillion").split()
FR_SCALES = ("mille million milliard billion billiard trillion trilliard quadrillion quadrilliard quintillion "
             "quintilliard").split()
DE_SCALES = ("tausend Million Milliarde Billion Billiarde Trillion Trilliarde Quadrillion Quadrilliarde Quintillion "
             "Quintilliarde").split()
#: Endings of a cardinal and what its ordinal has in their place: the first that fits, or (French) one after another.
EN_ORDINAL = [("one", "first"), ("two", "second"), ("three", "third"), ("five", "fifth"),
              ("eight", "eighth"), ("nine", "ninth"), ("twelve", "twelfth"), ("y", "ieth")]
FR_ORDINAL = (("cinq$", "cinqu"), ("neuf$", "neuv"), ("(cent|vingt)s$", "$1"), ("e$", ""))
DE_ORDINAL = [("eins", "erste"), ("drei", "dritte"), ("sieben", "siebte"), ("acht", "achte")]
ES_SCALES = "millón billón trillón cuatrillón quintillón".split()
SPELLED = ("en", "fr", "de", "es")
MINUS = {"en": "minus ", "fr": "moins ", "de": "minus ", "es": "menos "}
DIGITS = 36


def _en_below_1000(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    if rest < 20:
        tail = EN_UNITS[rest]
    else:
        tens, unit = divmod(rest, 10)
        tail = EN_TENS[tens - 2] + (f"-{EN_UNITS[unit]}" if unit else "")
    if not hundreds:
        return tail
    return f"{EN_UNITS[hundreds]} hundred" + (f" and {tail}" if rest else "")


def _fr_below_100(n: int) -> str:
    if n < 20:
        return FR_UNITS[n]
    if n == 80:
        return "quatre-vingts"
    if n > 80:
        return f"quatre-vingt-{FR_UNITS[n - 80]}"
    base = 60 if n >= 60 else n - n % 10
    rest = n - base
    word = FR_TENS[base // 10 - 2]
    if not rest:
        return word
    return f"{word} et {FR_UNITS[rest]}" if rest in (1, 11) else f"{word}-{FR_UNITS[rest]}"


def _fr_below_1000(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    if not hundreds:
        return _fr_below_100(rest)
    head = "cent" if hundreds == 1 else f"{FR_UNITS[hundreds]} cent"
    if not rest:
        return head + ("s" if hundreds > 1 else "")
    return f"{head} {_fr_below_100(rest)}"


def _de_below_1000(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    tens, unit = divmod(rest, 10)
    one = lambda u: "ein" if u == 1 else DE_UNITS[u]
    tail = DE_UNITS[rest] if rest < 20 else (f"{one(unit)}und" if unit else "") + DE_TENS[tens - 2]
    return f"{one(hundreds)}hundert" + (tail if rest else "") if hundreds else tail


def _es_below_1000(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    tens, unit = divmod(rest, 10)
    tail = ES_UNITS[rest] if rest < 30 else ES_TENS[tens - 3] + (f" y {ES_UNITS[unit]}" if unit else "")
    if not hundreds:
        return tail
    return "cien" if n == 100 else ES_HUNDREDS[hundreds - 1] + (f" {tail}" if rest else "")


def _es_ordinal_below_1000(n: int) -> str:
    return " ".join(names[int(d) - 1] for names, d in zip(ES_ORDINALS[::-1], f"{n:03d}", strict=True) if d != "0")


def _replaced_ending(word: str, endings: list[tuple[str, str]], otherwise: str) -> str:
    return next((word[: -len(end)] + new for end, new in endings if word.endswith(end)), word + otherwise)


def _en_ordinal_below_1000(n: int) -> str:
    return _replaced_ending(_en_below_1000(n), EN_ORDINAL, "th")


def _fr_ordinal_below_1000(n: int) -> str:
    stem = _fr_below_1000(n)
    for end, new in FR_ORDINAL:
        stem = re.sub(end, new.replace("$", "\\"), stem)
    return "premier" if n == 1 else f"{stem}ième"


def _de_ordinal_below_1000(n: int) -> str:
    return _replaced_ending(_de_below_1000(n), DE_ORDINAL, "te" if 1 <= n % 100 <= 19 or n == 0 else "ste")


@lru_cache(maxsize=None)
def small_numbers(lang: str) -> list[str]:
    """The names of 0..999; ``en_ordinal`` and so on for ordinals, the first Spanish one empty."""
    rule = {
        "en": _en_below_1000, "fr": _fr_below_1000, "de": _de_below_1000, "es": _es_below_1000, "en_ordinal": _en_ordinal_below_1000,
        "fr_ordinal": _fr_ordinal_below_1000, "de_ordinal": _de_ordinal_below_1000, "es_ordinal": _es_ordinal_below_1000,
    }[lang]
    return [rule(n) for n in range(1000)]


_fresh = count()


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind a SQL expression to a lambda variable, so that ``body`` can use it often at no cost.

    The largest element of one is that element. An index in its place would work out the type of the
    whole body again for each value.
    """
    name = f"v{next(_fresh)}"
    return f"array_max(transform(array({value}), {name} -> {body(name)}))"


def with_names(body: str) -> str:
    """Make the number names visible to ``body``, which uses :func:`cardinal` or :func:`ordinal`.

    Each list is one literal, split once when the plan is folded.
    """
    for lang in (*SPELLED, *(f"{code}_ordinal" for code in SPELLED)):
        if f"names_{lang}," in body:
            body = f"array_max(transform(array(split('{'|'.join(small_numbers(lang))}', '[|]')), names_{lang} -> {body}))"
    return body


def digits_of(n: str) -> str:
    """The digit string of an integer expression's absolute value."""
    return f"replace(cast({n} as string), '-', '')"


def pick(lang: str, v: str) -> str:
    """The name of ``v`` from 0 to 999, inside :func:`with_names`."""
    return f"element_at(names_{lang}, cast({v} as int) + 1)"


def _words(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _groups(d: str, size: int) -> str:
    """Groups of digits that are not zero, first to last: struct(v, s) with s the place from the right."""
    k = f"cast(ceil(length({d}) / {size}) as int)"
    return let(k, lambda k: let(
        f"lpad({d}, {size} * {k}, '0')",
        lambda p: f"filter(transform(sequence(1, {k}), i -> struct(cast(substring({p}, {size} * i - {size - 1}, {size}) as int) as v, {k} - i as s)), g -> g.v > 0)",
    ))


def cardinal(d: str, lang: str, negative: str = "false") -> str:
    """Words of the digit string expression ``d``, which has no leading zeros; up to three digits are looked up."""
    words = let(d, lambda d: f"case when length({d}) < 4 then {pick(lang, d)} when length({d}) > {DIGITS} then {_one_by_one(d, lang)} else {_positive(d, lang)} end")
    return words if negative == "false" else f"concat(if({negative}, '{MINUS[lang]}', ''), {words})"


def _one_by_one(d: str, lang: str) -> str:
    return f"array_join(transform(filter(split({d}, ''), c -> c <> ''), c -> {pick(lang, 'c')}), ' ')"


def _positive(d: str, lang: str) -> str:
    if lang == "en":
        name = f"concat({pick('en', 'g.v')}, ' ', element_at({_words(EN_SCALES)}, g.s))"
        return let(_groups(d, 3), lambda g: let(
            f"coalesce(try_element_at(filter({g}, x -> x.s = 0), 1).v, 0)",
            lambda rest: f"concat_ws(if({rest} < 100, ' and ', ', '), nullif(array_join(transform(filter({g}, x -> x.s > 0), g -> {name}), ', '), ''), "
                         f"if({rest} > 0, {pick('en', rest)}, null))",
        ))
    if lang == "fr":
        many = f"regexp_replace({pick('fr', 'g.v')}, '(cent|vingt)s$', '$1')"
        name = (f"case when g.s = 0 then {pick('fr', 'g.v')} when g.s = 1 then if(g.v = 1, 'mille', concat({many}, ' mille')) "
                f"else concat({pick('fr', 'g.v')}, ' ', element_at({_words(FR_SCALES)}, g.s), if(g.v > 1, 's', '')) end")
        return f"array_join(transform({_groups(d, 3)}, g -> {name}), ' ')"
    if lang == "de":
        # thousands and what follows are one word
        plural = [s + ("n" if s.endswith("e") else "en") for s in DE_SCALES]
        name = (f"case when g.s = 0 then {pick('de', 'g.v')} when g.s = 1 then concat(regexp_replace({pick('de', 'g.v')}, 'eins$', 'ein'), 'tausend') "
                f"when g.v = 1 then concat('eine ', element_at({_words(DE_SCALES)}, g.s), ' ') else concat({pick('de', 'g.v')}, ' ', element_at({_words(plural)}, g.s), ' ') end")
        return f"rtrim(array_join(transform({_groups(d, 3)}, g -> {name}), ''))"
    short = lambda w: f"regexp_replace(regexp_replace({w}, 'veintiuno$', 'veintiún'), 'uno$', 'un')"
    below = (f"concat_ws(' ', case when g.v < 1000 then null when g.v < 2000 then 'mil' else concat({short(pick('es', 'g.v div 1000'))}, ' mil') end, "
             f"if(g.v % 1000 > 0, {pick('es', 'g.v % 1000')}, null))")
    plural = [s.replace("ón", "ones") for s in ES_SCALES]
    name = (f"case when g.s = 0 then {below} when g.v = 1 then concat('un ', element_at({_words(ES_SCALES)}, g.s)) "
            f"else concat({short(below)}, ' ', element_at({_words(plural)}, g.s)) end")
    return f"array_join(transform({_groups(d, 6)}, g -> {name}), ' ')"


def ordinal(d: str, lang: str, words: str | None = None) -> str:
    """Ordinal words of the digit string expression ``d``; ``words`` is its cardinal, if that is there already."""
    if words is None:  # up to three digits are looked up
        return let(d, lambda d: f"if(length({d}) < 4 and {d} <> '0', {pick(f'{lang}_ordinal', d)}, {ordinal(d, lang, cardinal(d, lang))})")
    spoken = words
    if lang == "en":
        return let(
            spoken,
            lambda w: "case "
            + " ".join(f"when endswith({w}, '{end}') then regexp_replace({w}, '{end}$', '{new}')" for end, new in EN_ORDINAL)
            + f" else concat({w}, 'th') end",
        )
    if lang == "fr":
        stem = "w"
        for end, new in FR_ORDINAL:
            stem = f"regexp_replace({stem}, '{end}', '{new}')"
        return let(spoken, lambda w: f"if({d} = '1', 'premier', concat({stem.replace('(w,', f'({w},', 1)}, 'ième'))")
    if lang == "de":
        return let(
            spoken,
            lambda w: "case "
            + " ".join(f"when endswith({w}, '{end}') then regexp_replace({w}, '{end}$', '{new}')" for end, new in DE_ORDINAL)
            + f" when cast(right({d}, 2) as int) between 1 and 19 or {d} = '0' then concat({w}, 'te') else concat({w}, 'ste') end",
        )
    head = f"substring({d}, 1, length({d}) - 3)"
    thousands = f"if({head} = '1', 'milésimo', concat({cardinal(head, 'es')}, ' milésimo'))"
    rest = f"nullif({pick('es_ordinal', f'right({d}, 3)')}, '')"
    return f"if({d} = '0', 'cero', concat_ws(' ', if(length({d}) > 3, {thousands}, null), {rest}))"
