"""Text normalization as column expressions; every step stays inside the row.

``W`` is the set of word characters (letters, digits, underscore in any script). It is spelled out
because ``\\w`` and ``\\b`` are ASCII-only in Java unless told otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.columns import collapse_whitespace
from parlance.functions.fixed import CURRENCIES, DENOMINATORS, MONTHS, SYMBOLS
from parlance.functions.numbers import SPELLED, cardinal, let, ordinal, pick, with_names

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
EDGE_BEFORE, EDGE_AFTER = rf"(?<!{W})", rf"(?!{W})"
BOUNDARY = rf"(?:(?<!{W})(?={W})|(?<={W})(?!{W}))"
_MARK = r"[^\p{L}\p{N}_\p{Sc}'\-%+×#@&]"


def _sql(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- simple cleaning ----------------------------------------------------------------------------


def remove_emoji(text: Column) -> Column:
    return F.regexp_replace(
        text, r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+", ""
    )


def remove_punctuation(text: Column) -> Column:
    """Strip marks (and blanks) from both ends; marks inside stay."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{_MARK}+", ""), rf"{_MARK}+$", "")


def no_space_word(text: Column) -> tuple[Column, Column]:
    """A word without blanks, and an error where letters would be lost by cutting at a blank."""
    bare = remove_punctuation(text)
    has_space = F.contains(bare, F.lit(" "))
    tail = F.regexp_replace(bare, r"^[^ ]* ", "")
    word = F.when(has_space, remove_punctuation(F.regexp_replace(bare, r"(?s) .*$", ""))).otherwise(bare)
    lost = has_space & tail.rlike(r"[\p{L}\p{No}\p{Nl}]")
    error = F.when(lost, F.concat(F.lit("unexpected word containing space: "), text))
    return F.when(~lost, word), error


@lru_cache(maxsize=1)
def _ascii_forms() -> tuple[str, str, dict[str, str]]:
    """By rule: characters whose compatibility decomposition holds ASCII, as one or several characters."""
    single_from, single_to, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1 and code < 0x10000:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            several[char] = plain
    return "".join(single_from), "".join(single_to), several


def _ranges(chars) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for code in sorted(map(ord, chars)):
        if out and out[-1][1] == code - 1:
            out[-1] = (out[-1][0], code)
        else:
            out.append((code, code))
    return out


def transliterate(text: Column) -> Column:
    """Closest ASCII form; what has none is dropped."""
    for char, plain in (("œ", "oe"), ("æ", "ae"), ("Œ", "OE"), ("Æ", "AE"), ("ß", "ss")):
        text = F.replace(text, F.lit(char), F.lit(plain))
    one_from, one_to, several = _ascii_forms()
    text = F.translate(text, one_from, one_to)
    # Characters that become several (ligatures, fractions) are rare: those that a text has are replaced one by one.
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{p}" for c, p in several.items())), F.lit("\x01"), F.lit("\x02"))
    rare = F.lit("[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _ranges(several)) + "]")
    found = F.array_distinct(F.regexp_extract_all(text, rare, F.lit(0)))
    expanded = F.aggregate(found, text, lambda acc, c: F.replace(acc, c, F.try_element_at(table, c)))
    text = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), expanded).otherwise(text)
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


# --- numbers, dates, symbols --------------------------------------------------------------------
# The functions below build SQL text from SQL text, so that they can be used inside lambdas.


def reorder_currency(text: str, lang: str) -> str:
    """``1,20€`` to ``1 € 20``; the decimal mark is a comma in French and a dot elsewhere."""
    signs = "".join(CURRENCIES)

    def rule(mark: str) -> str:
        pattern = rf"{EDGE_BEFORE}([0-9]+){mark}([0-9]+)\s*([{signs}])"
        return f"regexp_replace({text}, {_sql(pattern)}, '$1 $3 $2')"

    return f"if({text} rlike '[{signs}]', if({lang} = 'fr', {rule(',')}, {rule('[.]')}), {text})"


# Roman numerals from 10 to 49 and the ordinal endings behind them.
_ROMAN = r"(?=[XVI])XX{0,3}(?:I[XV]|V?I{0,3})"
_ROMAN_SUFFIX = {"en": "(?:º|st|nd|rd|th)?", "fr": "(?:º|ème|eme|e|er|ère)?"}


def roman_tokens(text: str, lang: str) -> str:
    """Roman numerals from 10 to 49 with their ordinal suffix, longest first."""

    def found(suffix: str) -> str:
        return f"regexp_extract_all({text}, {_sql(EDGE_BEFORE + '(' + _ROMAN + suffix + ')' + EDGE_AFTER)}, 1)"

    return longest_first(
        f"case {lang} when 'en' then {found(_ROMAN_SUFFIX['en'])} "
        f"when 'fr' then {found(_ROMAN_SUFFIX['fr'])} else {found('')} end"
    )


def roman_letters(token: str) -> str:
    return f"regexp_replace({token}, '[a-zèº]', '')"


def roman_value(token: str) -> str:
    """10..49: the leading Xs are tens, the rest a unit."""
    tens = f"length(regexp_extract({roman_letters(token)}, '^X+', 0))"
    unit = f"array_position(array('I','II','III','IV','V','VI','VII','VIII','IX'), substr({roman_letters(token)}, {tens} + 1))"
    return f"cast(10 * {tens} + {unit} as bigint)"


def replace_roman(text: str, lang: str) -> str:
    is_ordinal = f"({roman_letters('t')} <> t)"
    word = let(roman_value("t"), lambda v: f"if({is_ordinal}, {short_name(v, lang, 'ordinal')}, {short_name(v, lang)})")
    edge = f"regexp_replace(acc, concat({_sql(EDGE_BEFORE)}, t, {_sql(EDGE_AFTER)}), {word})"
    folded = f"aggregate({roman_tokens(text, lang)}, {text}, (acc, t) -> {edge})"
    return with_names(f"if(contains({text}, 'X') and {_spellable(lang)}, {folded}, {text})")


def _spellable(lang: str) -> str:
    return f"coalesce({lang} in ({', '.join(_sql(s) for s in SPELLED)}), false)"


# What counts as an ordinal in digits; French tries ``nde`` before ``nd``.
_ORDINALS = {
    "en": rf"{EDGE_BEFORE}[0-9]*1st|[0-9]*2nd|[0-9]*3rd|[0-9]+(?:º|th){EDGE_AFTER}",
    "fr": rf"{EDGE_BEFORE}1(?:ère|ere|er|re|r)|2(?:nde|nd)|[0-9]+(?:º|ème|eme|e){EDGE_AFTER}",
}


def longest_first(tokens: str) -> str:
    """Distinct tokens by falling length, then by falling text."""
    return (
        f"transform(sort_array(transform(array_distinct({tokens}), "
        "t -> struct(length(t) as n, t as t)), false), s -> s.t)"
    )


def ordinal_tokens(text: str, lang: str) -> str:
    found = " ".join(
        f"when {_sql(code)} then regexp_extract_all({text}, {_sql(pattern)}, 0)" for code, pattern in _ORDINALS.items()
    )
    return longest_first(f"case {lang} {found} else cast(array() as array<string>) end")


def replace_ordinals(text: str, lang: str) -> str:
    word = undigit("regexp_extract(t, '[0-9]+', 0)", lang, "ordinal")
    edge = f"regexp_replace(acc, concat({_sql(EDGE_BEFORE)}, t, {_sql(EDGE_AFTER)}), {word})"
    folded = f"translate(aggregate({ordinal_tokens(text, lang)}, {text}, (acc, t) -> {edge}), {_SHOW})"
    return with_names(f"if({text} rlike '[0-9]', {folded}, {text})")


# Digit strings with blanks between thousands, or with slashes.
_CARDINAL = rf"-?{BOUNDARY}[0-9/]*[0-9]+(?: [0-9]{{3}})+{EDGE_AFTER}|-?[0-9][/0-9]*"


def cardinal_tokens(text: str) -> str:
    """Digit strings, with their parts at blanks and slashes, longest first."""
    found = f"transform(regexp_extract_all({text}, {_sql(_CARDINAL)}, 0), t -> regexp_replace(t, '^[/ ]+|[/ ]+$', ''))"

    def with_parts(tokens: str, mark: str) -> str:
        return f"concat({tokens}, flatten(transform(filter({tokens}, t -> contains(t, '{mark}')), t -> split(t, '{mark}+'))))"

    everything = let(found, lambda a: let(with_parts(a, " "), lambda b: with_parts(b, "/")))
    return longest_first(f"filter({everything}, t -> t <> '')")


# Digits of numbers without words travel as private characters, so that later, shorter tokens
# cannot cut them.
_HIDDEN = "".join(chr(0xE000 + i) for i in range(10))
_HIDE = f"'0123456789', '{_HIDDEN}'"
_SHOW = f"'{_HIDDEN}', '0123456789'"


def shown(text: str) -> str:
    """Bring the digits back that :func:`number_words` and :func:`undigit` left unspelled."""
    return f"translate({text}, {_SHOW})"


def spell(d: str, lang: str, is_ordinal: str = "false", negative: str = "false") -> str:
    """Words of the digit string ``d`` (null-safe choice by language and kind)."""
    branches = " ".join(
        f"when {_sql(code)} then if({is_ordinal}, {ordinal(d, code)}, {cardinal(d, code, negative)})"
        if is_ordinal != "false"
        else f"when {_sql(code)} then {cardinal(d, code, negative)}"
        for code in SPELLED
    )
    return f"case {lang} {branches} end"


def short_name(v: str, lang: str, to: str = "cardinal") -> str:
    """The name of a number from 0 to 999 (Spanish ordinals: from 1), looked up, inside :func:`with_names`."""
    kind = "" if to == "cardinal" else "_ordinal"
    return f"case {lang} " + " ".join(f"when {_sql(code)} then {pick(code + kind, v)}" for code in SPELLED) + " end"


def undigit(digits: str, lang: str, to: str = "cardinal") -> str:
    """A digit string to words: leading zeros one by one, some denominators by name."""
    return let(
        f"replace({digits}, ' ', '')",
        lambda bare: let(
            f"if({bare} rlike '^-?[0-9]+$', regexp_replace({bare}, '^-?0*([0-9])', '$1'), null)",
            lambda number: _undigit(bare, number, lang, to),
        ),
    )


def _undigit(bare: str, number: str, lang: str, to: str) -> str:
    """``number`` is the digit string of ``bare`` without sign and leading zeros, null if it is none."""
    hidden = f"translate({bare}, {_HIDE})"
    if to == "cardinal":
        zeros = f"length(regexp_extract({bare}, '^0+', 0))"
        zero_word = f"case {lang} when 'fr' then 'zéro ' when 'de' then 'null ' when 'es' then 'cero ' else 'zero ' end"
        spoken = spell(number, lang, negative=f"({bare} like '-%')")
        words = f"concat(if({zeros} < length({bare}), repeat({zero_word}, {zeros}), ''), {spoken})"
    else:
        words = spell(number, lang, "true")
    spelled = f"coalesce({words}, {hidden})"
    return spelled if to != "denominator" else _named_denominator(bare, spelled, lang)


def _named_denominator(bare: str, spelled: str, lang: str) -> str:
    named = " ".join(
        f"when {lang} = {_sql(code)} and {bare} = {_sql(d)} then {_sql(w)}"
        for code, names in DENOMINATORS.items()
        for d, w in names.items()
    )
    return f"case {named} else {spelled} end"


def _month(number: str, lang: str, otherwise: str) -> str:
    names = " ".join(
        f"when {_sql(code)} then element_at(array({', '.join(_sql(m) for m in months)}), {number})"
        for code, months in MONTHS.items()
    )
    return f"coalesce(case {lang} {names} end, translate({otherwise}, {_HIDE}))"


def number_words(token: str, lang: str) -> str:
    """Words for one numeric token: integer, fraction, date or a chain joined by slashes.

    Most tokens are short integers, which are looked up; only those with a slash are split.
    """
    parted = let(f"split({token}, '/+')", lambda p: _words_of_parts(p, lang))
    return (
        f"case when contains({token}, '/') then {parted} "
        f"when {token} rlike '^(?:0|[1-9][0-9]{{0,2}})$' and {_spellable(lang)} then {short_name(token, lang)} "
        f"else {undigit(token, lang)} end"
    )


def _words_of_parts(p: str, lang: str) -> str:
    """Words of the parts ``p`` between slashes, of which there are two or more.

    Each rule for digit strings stands once in the expression and is followed only for the parts that the
    kind of token (date, fraction, chain) needs; numbers below a thousand are looked up.
    """

    def whole(i: int) -> str:
        return f"if({p}[{i}] rlike '^[0-9]{{1,9}}$', cast({p}[{i}] as int), null)"

    def each(parts: str, least: str, to: str) -> str:
        rule = f"if(q rlike '^(?:{least}[1-9][0-9]{{0,2}})$' and {_spellable(lang)}, {short_name('q', lang, to)}, {undigit('q', lang, to)})"
        return f"transform({parts}, q -> {rule})"

    none = "cast(array() as array<string>)"
    day_month = f"coalesce({whole(0)} between 1 and 31 and {whole(1)} between 1 and 12 and length({p}[1]) = 2, false)"
    is_date = (
        f"case when size({p}) > 3 or not {day_month} then false when size({p}) = 2 then true "
        f"else length({p}[2]) = 4 and coalesce({whole(2)} > 1000, false) end"
    )
    as_ordinal = lambda day: f"if({lang} = 'fr', {day} = '1', right({day}, 1) in ('1', '2', '3'))"
    day = let(is_date, lambda d: f"if({d}, regexp_replace({p}[0], '^0+', ''), null)")  # null: no date

    def kinds(day: str) -> tuple[str, str]:
        cardinals = f"case when {day} is not null then concat(if({as_ordinal(day)}, {none}, array({day})), slice({p}, 3, 1)) when size({p}) = 2 then slice({p}, 1, 1) else {p} end"
        ordinals = f"case when {day} is not null then if({as_ordinal(day)}, array({day}), {none}) when size({p}) = 2 then slice({p}, 2, 1) else {none} end"
        return each(cardinals, "0|", "cardinal"), each(ordinals, "", "ordinal")

    def composed(day: str, cardinals: str, ordinals: str) -> str:
        month = _month(f"greatest(least({whole(1)}, 12), 1)", lang, f"{p}[1]")
        date = f"concat(if({as_ordinal(day)}, {ordinals}, {cardinals})[0], ' ', {month})"
        more_than_two = f"coalesce(try_cast(replace({p}[0], ' ', '') as bigint) > 2, false)"
        below = let(
            _named_denominator(f"replace({p}[1], ' ', '')", f"{ordinals}[0]", lang),
            lambda b: f"if({more_than_two} and right({b}, 1) <> 's', concat({b}, 's'), {b})",
        )
        return (
            f"case when {day} is not null then if(size({p}) = 2, {date}, concat({date}, ' ', element_at({cardinals}, -1))) "
            f"when size({p}) = 2 then concat({cardinals}[0], ' ', {below}) else array_join({cardinals}, ' / ') end"
        )

    return let(day, lambda day: let(
        kinds(day)[0], lambda c: let(kinds(day)[1], lambda o: composed(day, c, o)),
    ))


def replace_keeping_word_boundaries(text: str, orig: str, dest: str, pattern: str | None = None) -> str:
    """Put ``dest`` for ``orig`` and add blanks where it would touch a word.

    All arguments are SQL expressions; ``pattern`` is ``orig`` as a regular expression.
    """
    find, other = pattern or orig, _sql(f"({NOT_W})")

    def by_patterns(word: str) -> str:
        step = f"regexp_replace({text}, concat({other}, {find}, {other}), concat('$1', {word}, '$2'))"
        step = f"regexp_replace({step}, concat({find}, {other}), concat(' ', {word}, '$1'))"
        step = f"regexp_replace({step}, concat({other}, {find}), concat('$1', {word}, ' '))"
        return f"regexp_replace({step}, {find}, concat(' ', {word}, ' '))"

    def by_parts(parts: str, word: str) -> str:
        gap = lambda char: f"if({char} rlike {other}, '', ' ')"
        step = f"concat(before, {gap('right(before, 1)')}, {word}, {gap('left(after, 1)')}, after)"
        return f"aggregate(slice({parts}, 2, size({parts}) - 1), {parts}[0], (before, after) -> {step})"

    # The patterns take one blank or mark for one place only. Where places share none and cannot overlap,
    # each depends on its two neighbours alone, and the text is put together from its parts.
    once = f"locate({orig}, {text}, locate({orig}, {text}) + 1) = 0"
    apart = f"(locate(left({orig}, 1), {orig}, 2) = 0 and forall(slice({{p}}, 2, size({{p}}) - 2), x -> length(x) > 1))"
    replaced = let(dest, lambda word: let(
        f"split({text}, {find}, -1)",
        lambda p: f"if({once} or {apart.format(p=p)}, {by_parts(p, word)}, {by_patterns(word)})",
    ))
    return f"if(contains({text}, {orig}), {replaced}, {text})"


def spelled_tokens(tokens: DataFrame, token: str = "token", lang: str = "lang") -> DataFrame:
    """``tokens`` with the ``words`` of every numeric token; each distinct one is spelled once.

    Tokens are put together before the shuffle. The words are joined back by (language, token): a
    dictionary that is small by its measured size is broadcast, and adaptive execution splits a
    token that holds a large share of the rows.
    """
    distinct = tokens.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("__lang"), F.col(token).alias("__token")).distinct()
    # fresh column names inside the rule, whose lambda variables must not meet them
    words = distinct.withColumn("words", F.expr(with_names(number_words("__token", "__lang"))))
    return tokens.join(words, (tokens[lang] == words["__lang"]) & (tokens[token] == words["__token"]), "left").drop("__lang", "__token")


def replace_cardinals(text: str, lang: str) -> str:
    """Digits in ``text`` to words, longest token first; texts without digits are left alone.

    The list of tokens of a row is bounded by its own text. A part of a longer token is gone once that
    token has its words, so only tokens that are still there are spelled.
    """
    replaced = replace_keeping_word_boundaries("acc", "token", number_words("token", lang))
    folded = f"translate(aggregate({cardinal_tokens(text)}, {text}, (acc, token) -> {replaced}), {_SHOW})"
    return with_names(f"if({text} rlike '[0-9]' and {_spellable(lang)}, {folded}, {text})")


def symbols_to_words(text: str, lang: str) -> str:
    """Replace the symbols of the text's language, in table order; texts without any are left alone."""
    step = replace_keeping_word_boundaries("acc", "s.symbol", "s.word", "s.find")
    branches = []
    for code, table in SYMBOLS.items():
        rows = ", ".join(
            f"struct({_sql(symbol)} as symbol, {_sql(word)} as word, {_sql(chr(92) + 'Q' + symbol + chr(92) + 'E')} as find)"
            for symbol, word in table
        )
        firsts = "".join(dict.fromkeys(symbol[0] for symbol, _ in table if symbol[0] != "m"))
        branches.append(
            f"when {lang} = {_sql(code)} and {text} rlike {_sql('[' + firsts + ']')} "
            f"then aggregate(array({rows}), {text}, (acc, s) -> {step})"
        )
    return f"case {' '.join(branches)} else {text} end"


def normalize_text(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Currency order, Roman, ordinal and cardinal numbers, symbols, blanks.

    All steps stay inside the row. Rows are dealt by their values first, as a table may come in few parts.
    """
    out = df.repartition(*(name for name, kind in df.dtypes if "map<" not in kind))
    for step in (reorder_currency, replace_roman, replace_ordinals, replace_cardinals):
        out = out.withColumn(text, F.expr(step(text, lang)))
    return out.withColumn(text, collapse_whitespace(F.expr(symbols_to_words(text, lang))))
