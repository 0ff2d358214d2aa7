"""Text normalization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns
from parlance.functions import numbers as N
from parlance.functions import text as X
from parlance.functions.fixed import DENOMINATORS, MONTHS, SYMBOLS
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T

# --- SQL pieces for the twins -------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


NAMES = "names AS (SELECT " + ", ".join(f"{_list(N.small_numbers(lang))} AS {lang}" for lang in (*N.SPELLED, "es_ordinal")) + ")"


def _parts(n: str, size: int, top: int) -> list[tuple[str, int]]:
    return [(f"(abs({n}) // {1000 ** (size * i)} % {1000 ** size})", i) for i in range(top, -1, -1)]


def card(n: str, lang: str) -> str:
    """Cardinal words of an SQL integer below 10^18; needs ``names`` in scope."""
    a = f"abs({n})"
    pick = lambda v: f"{lang}[{v} + 1]"
    out = []
    if lang == "es":
        short = lambda w: f"regexp_replace(regexp_replace({w}, 'veintiuno$', 'veintiún'), 'uno$', 'un')"
        for v, i in _parts(n, 2, 2):
            below = (f"concat_ws(' ', CASE WHEN {v} >= 2000 THEN {short(pick(f'({v} // 1000)'))} || ' mil' WHEN {v} >= 1000 THEN 'mil' END, "
                     f"CASE WHEN {v} % 1000 > 0 THEN {pick(f'({v} % 1000)')} END)")
            if i:
                scale = N.ES_SCALES[i - 1]
                below = f"CASE WHEN {v} = 1 THEN 'un {scale}' WHEN {v} > 1 THEN {short(below)} || ' {scale.replace('ón', 'ones')}' END"
            out.append(f"nullif({below}, '')")
        words = f"concat_ws(' ', {', '.join(out)})"
    elif lang == "en":
        for v, i in _parts(n, 1, 5)[:-1]:
            out.append(f"CASE WHEN {v} > 0 THEN {pick(v)} || ' {N.EN_SCALES[i - 1]}' END")
        rest = f"({a} % 1000)"
        words = f"concat_ws(CASE WHEN {rest} < 100 THEN ' and ' ELSE ', ' END, nullif(concat_ws(', ', {', '.join(out)}), ''), CASE WHEN {rest} > 0 THEN {pick(rest)} END)"
    elif lang == "fr":
        for v, i in _parts(n, 1, 5):
            name = pick(v) if not i else f"{pick(v)} || ' {N.FR_SCALES[i - 1]}' || CASE WHEN {v} > 1 THEN 's' ELSE '' END"
            if i == 1:
                name = f"CASE WHEN {v} = 1 THEN 'mille' ELSE regexp_replace({pick(v)}, '(cent|vingt)s$', '\\1') || ' mille' END"
            out.append(f"CASE WHEN {v} > 0 THEN {name} END")
        words = f"concat_ws(' ', {', '.join(out)})"
    else:
        for v, i in _parts(n, 1, 5):
            if i > 1:
                scale = N.DE_SCALES[i - 1]
                name = f"CASE WHEN {v} = 1 THEN 'eine {scale} ' ELSE {pick(v)} || ' {scale}{'n' if scale.endswith('e') else 'en'} ' END"
            else:
                name = pick(v) if not i else f"regexp_replace({pick(v)}, 'eins$', 'ein') || 'tausend'"
            out.append(f"CASE WHEN {v} > 0 THEN {name} ELSE '' END")
        words = f"rtrim({' || '.join(out)})"
    return f"(CASE WHEN {n} < 0 THEN '{N.MINUS[lang]}' ELSE '' END || CASE WHEN {a} = 0 THEN {pick('0')} ELSE {words} END)"


def ordi(n: str, lang: str) -> str:
    if lang == "es":
        t = f"({n} // 1000)"
        return (f"CASE WHEN {n} = 0 THEN 'cero' ELSE concat_ws(' ', CASE WHEN {t} = 1 THEN 'milésimo' WHEN {t} > 1 THEN {card(t, 'es')} || ' milésimo' END, "
                f"nullif(es_ordinal[{n} % 1000 + 1], '')) END")
    word = card(n, lang)
    if lang == "fr":
        for end, new in (("cinq$", "cinqu"), ("neuf$", "neuv"), ("(cent|vingt)s$", "\\1"), ("e$", "")):
            word = f"regexp_replace({word}, '{end}', '{new}')"
        return f"CASE WHEN {n} = 1 THEN 'premier' ELSE {word} || 'ième' END"
    if lang == "de":
        for end, new in (("eins", "ers§"), ("drei", "drit§"), ("sieben", "sieb§"), ("acht", "ach§")):
            word = f"regexp_replace({word}, '{end}$', '{new}')"
        tail = f"CASE WHEN {n} % 100 BETWEEN 1 AND 19 OR {n} = 0 THEN 'te' ELSE 'ste' END"
        return f"(SELECT CASE WHEN w LIKE '%§' THEN replace(w, '§', 'te') ELSE w || {tail} END FROM (SELECT {word} AS w))"
    for end, new in (("one", "fir§"), ("two", "seco§"), ("three", "thi§"), ("five", "fif§"), ("eight", "eigh§"),
                     ("nine", "nin§"), ("twelve", "twelf§"), ("y", "ie§")):
        word = f"regexp_replace({word}, '{end}$', '{new}')"
    marked = f"CASE WHEN {word} LIKE '%§' THEN {word} ELSE {word} || '§' END"
    return (f"replace(regexp_replace(regexp_replace(regexp_replace({marked}, 'fir§$', 'first'), 'seco§$', 'second'), 'thi§$', 'third'), '§', 'th')")


def by_lang(n: str, rule, otherwise: str = "NULL") -> str:
    return f"CASE lang WHEN 'en' THEN {rule(n, 'en')} WHEN 'fr' THEN {rule(n, 'fr')} WHEN 'es' THEN {rule(n, 'es')} ELSE {otherwise} END"


_LANG = "['en', 'fr', 'en', 'fr', 'es'][o_orderkey % 5 + 1]"
NUMERIC = f"""numeric_lines AS (
  SELECT o_orderkey AS order_id, {_LANG} AS lang, concat_ws(' ',
    CASE WHEN {_LANG} = 'fr' THEN 'le' ELSE 'on' END,
    day(o_orderdate) || '/' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 4 = 0 THEN '/' || year(o_orderdate) ELSE '' END,
    floor(o_totalprice / 100)::BIGINT || CASE WHEN {_LANG} = 'fr' THEN ',' ELSE '.' END || lpad((o_custkey % 100)::VARCHAR, 2, '0') || ['€', '$', '£', '¥'][o_orderkey % 4 + 1],
    (o_custkey % 9 + 1) || '/' || (o_orderkey % 7 + 2),
    (o_orderkey % 3) || '/' || (o_custkey % 5) || '/' || (o_orderkey % 11),
    ['X', 'XI', 'XIV', 'XIX', 'XX', 'XXVII', 'XXXVIII', 'IV', 'I', 'XXIII'][o_custkey % 10 + 1] ||
      CASE WHEN {_LANG} = 'fr' AND o_orderkey % 2 = 1 THEN 'e' WHEN {_LANG} = 'en' AND o_orderkey % 6 = 0 THEN 'th' ELSE '' END,
    (o_orderkey % 60 + 1) || CASE WHEN {_LANG} = 'fr' THEN 'e' ELSE 'th' END,
    lpad((o_custkey % 50)::VARCHAR, 3, '0'),
    (o_orderkey % 900 + 1) || ' ' || lpad((o_custkey % 1000)::VARCHAR, 3, '0'),
    (o_custkey % 100) || '%', CASE WHEN o_orderkey % 2 = 0 THEN 'a&b' ELSE 'c + d' END, '-' || (o_orderkey % 20)) AS text
  FROM orders)"""
_MARKS = r"[^\p{L}\p{N}_\p{Sc}''\-%+×#@&]"
_NW = r"[^\p{L}\p{N}_]"


def keep_edges(text: str, orig: str, dest: str, find: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '({_NW}){find}({_NW})', '\\1{dest}\\2', 'g'), "
            f"'{find}({_NW})', ' {dest}\\1', 'g'), '({_NW}){find}', '\\1{dest} ', 'g'), '{find}', ' {dest} ', 'g')")


# --- cleaning -----------------------------------------------------------------------------------


def _line_query(name: str, sql_expr: str, column):
    @register(name, C.ctes(C.LINES) + f"SELECT doc_id, line_no, {sql_expr} AS text FROM lines")
    def query(spark, d):
        return T.lines(spark, d).select("doc_id", "line_no", column(F.col("line")).alias("text"))

    return query


_line_query("remove_emoji", r"regexp_replace(line, '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+', '', 'g')",
            X.remove_emoji)
_line_query("remove_punctuation", f"regexp_replace(regexp_replace(line, '^{_MARKS}+', ''), '{_MARKS}+$', '')", X.remove_punctuation)
_line_query("collapse_whitespace", r"trim(regexp_replace(line, '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))",
            columns.collapse_whitespace)
_line_query("transliterate",
            r"regexp_replace(strip_accents(replace(replace(replace(replace(replace(line, 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'OE'), 'Æ', 'AE'), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g')",
            X.transliterate)


@register("no_space_words", C.ctes(C.LINES, f"""
pieces AS (SELECT doc_id, line_no, n, regexp_replace(regexp_replace(piece, '^{_MARKS}+', ''), '{_MARKS}+$', '') AS bare, piece FROM (
  SELECT doc_id, line_no, unnest(string_split(line, ',')) AS piece, unnest(range(len(string_split(line, ',')))) AS n FROM lines)),
cut AS (SELECT *, contains(bare, ' ') AS sp, regexp_replace(bare, '^[^ ]* ', '') AS tail, string_split(bare, ' ')[1] AS head FROM pieces)""") + f"""
SELECT doc_id, line_no, n, CASE WHEN sp AND regexp_matches(tail, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]') THEN NULL WHEN sp THEN
    regexp_replace(regexp_replace(head, '^{_MARKS}+', ''), '{_MARKS}+$', '') ELSE bare END AS word,
  CASE WHEN sp AND regexp_matches(tail, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]') THEN 'unexpected word containing space: ' || piece END AS error
FROM cut""")
def no_space_words(spark, d):
    word, error = X.no_space_word(F.col("piece"))
    return T.lines(spark, d).select(
        "doc_id", "line_no", F.posexplode_outer(F.split("line", ",", -1)).alias("n", "piece")
    ).select("doc_id", "line_no", F.col("n").cast("long").alias("n"), word.alias("word"), error.alias("error"))


# --- numbers ------------------------------------------------------------------------------------


@register("reorder_currency", C.ctes(NUMERIC) + r"""
SELECT order_id, CASE WHEN lang = 'fr' THEN regexp_replace(text, '\b([0-9]+),([0-9]+)\s*([€$£¥])', '\1 \3 \2', 'g')
  ELSE regexp_replace(text, '\b([0-9]+)[.]([0-9]+)\s*([€$£¥])', '\1 \3 \2', 'g') END AS text FROM numeric_lines""")
def reorder_currency(spark, d):
    return T.numeric_lines(spark, d).select("order_id", F.expr(X.reorder_currency("text", "lang")).alias("text"))


@register("roman_numerals", C.ctes(NUMERIC, NAMES, r"""
found AS (SELECT DISTINCT order_id, lang, unnest(regexp_extract_all(text, CASE lang
    WHEN 'en' THEN '\b(XX{0,3}(?:I[XV]|V?I{0,3})(?:st|nd|rd|th)?)\b' WHEN 'fr' THEN '\b(XX{0,3}(?:I[XV]|V?I{0,3})(?:eme|er|e)?)\b'
    ELSE '\b(XX{0,3}(?:I[XV]|V?I{0,3}))\b' END)) AS token FROM numeric_lines),
valued AS (SELECT *, regexp_replace(token, '[a-z]', '', 'g') AS r FROM found),
counted AS (SELECT *, r <> token AS ordinal,
    (len(r) - len(replace(r, 'X', ''))) * 10 + (len(r) - len(replace(r, 'V', ''))) * 5 + (len(r) - len(replace(r, 'I', '')))
    - CASE WHEN r LIKE '%IX' OR r LIKE '%IV' THEN 2 ELSE 0 END AS value FROM valued)""") + f"""
SELECT order_id, token, value, CASE WHEN ordinal THEN {by_lang('value', ordi)} ELSE {by_lang('value', card)} END AS words
FROM counted, names""")
def roman_numerals(spark, d):
    words = X.spell(f"cast({X.roman_value('token')} as string)", "lang", f"({X.roman_letters('token')} <> token)")
    return (
        T.numeric_lines(spark, d)
        .select("order_id", "lang", F.explode_outer(F.expr(X.roman_tokens("text", "lang"))).alias("token"))
        .filter("token is not null")
        .select("order_id", "token", F.expr(X.roman_value("token")).alias("value"), F.expr(N.with_names(words)).alias("words"))
    )


@register("ordinals", C.ctes(NUMERIC, NAMES, r"""
found AS (SELECT DISTINCT order_id, lang, unnest(CASE lang
    WHEN 'en' THEN regexp_extract_all(text, '\b[0-9]*1st|[0-9]*2nd|[0-9]*3rd|[0-9]+th\b')
    WHEN 'fr' THEN regexp_extract_all(text, '\b1(?:ere|er|re|r)|2(?:nde|nd)|[0-9]+(?:eme|e)\b') ELSE [] END) AS token FROM numeric_lines)""") + f"""
SELECT order_id, token, {by_lang("regexp_extract(token, '[0-9]+')::BIGINT", ordi)} AS words FROM found, names""")
def ordinals(spark, d):
    words = N.with_names(X.undigit("regexp_extract(token, '[0-9]+', 0)", "lang", "ordinal"))
    return (
        T.numeric_lines(spark, d)
        .select("order_id", "lang", F.explode_outer(F.expr(X.ordinal_tokens("text", "lang"))).alias("token"))
        .filter("token is not null")
        .select("order_id", "token", F.expr(words).alias("words"))
    )


_TOKENS = C.ctes(NUMERIC, NAMES, r"""
raw AS (SELECT order_id, lang, list_transform(regexp_extract_all(text, '-?\b[0-9/]*[0-9]+(?: [0-9]{3})+\b|-?[0-9][/0-9]*'),
          lambda t: regexp_replace(t, '^[/ ]+|[/ ]+$', '', 'g')) AS a FROM numeric_lines),
spaced AS (SELECT order_id, lang, list_concat(a, flatten(list_transform(list_filter(a, lambda t: contains(t, ' ')), lambda t: string_split(t, ' ')))) AS a FROM raw),
parted AS (SELECT order_id, lang, list_concat(a, flatten(list_transform(list_filter(a, lambda t: contains(t, '/')), lambda t: string_split(t, '/')))) AS a FROM spaced),
tok AS (SELECT order_id, lang, token, row_number() OVER (PARTITION BY order_id ORDER BY len(token) DESC, token DESC) - 1 AS idx
  FROM (SELECT DISTINCT order_id, lang, unnest(a) AS token FROM parted) WHERE token <> '')""")


@register("cardinals", _TOKENS + "SELECT order_id, idx, token FROM tok")
def cardinals(spark, d):
    return T.numeric_lines(spark, d).select(
        "order_id", F.posexplode_outer(F.expr(X.cardinal_tokens("text"))).alias("idx", "token")
    ).filter("idx is not null").withColumn("idx", F.col("idx").cast("long"))


def _denominator(d: str) -> str:
    named = " ".join(
        f"WHEN lang = '{code}' AND {d} = {n} THEN '{w}'" for code, names in DENOMINATORS.items() for n, w in names.items()
    )
    return f"CASE {named} ELSE {by_lang(d, ordi)} END"


_DAY = (f"CASE WHEN (lang = 'fr' AND c[1] = 1) OR (lang <> 'fr' AND right(p[1], 1) IN ('1', '2', '3')) "
        f"THEN {by_lang('c[1]', ordi)} ELSE {by_lang('c[1]', card)} END")
_MONTH_SQL = f"CASE lang WHEN 'en' THEN {_list(MONTHS['en'])}[c[2]] WHEN 'fr' THEN {_list(MONTHS['fr'])}[c[2]] ELSE p[2] END"
_IS_DAY = "TRY_CAST(p[1] AS BIGINT) BETWEEN 1 AND 31 AND TRY_CAST(p[2] AS BIGINT) BETWEEN 1 AND 12 AND len(p[2]) = 2"


def _with_zeros(i: int) -> str:
    bare = f"replace(p[{i}], ' ', '')"
    zeros = f"CASE WHEN ltrim({bare}, '0') = '' THEN 0 ELSE len({bare}) - len(ltrim({bare}, '0')) END"
    return f"repeat(CASE lang WHEN 'fr' THEN 'zéro ' WHEN 'es' THEN 'cero ' ELSE 'zero ' END, {zeros}) || {by_lang(f'c[{i}]', card)}"


_CHAIN = " || ' / ' || ".join(_with_zeros(i) for i in (1, 2, 3))


@register("fractions_dates", _TOKENS + f"""
SELECT order_id, token, CASE
  WHEN len(p) = 2 AND {_IS_DAY} THEN {_DAY} || ' ' || {_MONTH_SQL}
  WHEN len(p) = 2 THEN {by_lang('c[1]', card)} || ' ' || below || CASE WHEN c[1] > 2 AND right(below, 1) <> 's' THEN 's' ELSE '' END
  WHEN {_IS_DAY} AND TRY_CAST(p[3] AS BIGINT) > 1000 AND len(p[3]) = 4 THEN {_DAY} || ' ' || {_MONTH_SQL} || ' ' || {by_lang('c[3]', card)}
  ELSE {_CHAIN} END AS words
FROM (SELECT *, CASE WHEN len(p) = 2 THEN {_denominator('c[2]')} END AS below
      FROM (SELECT order_id, lang, token, string_split(token, '/') AS p,
              list_transform(string_split(token, '/'), lambda x: CAST(replace(x, ' ', '') AS BIGINT)) AS c FROM tok WHERE contains(token, '/')), names)""")
def fractions_dates(spark, d):
    tokens = (
        T.numeric_lines(spark, d)
        .select("order_id", "lang", F.explode_outer(F.expr(X.cardinal_tokens("text"))).alias("token"))
        .filter("token is not null")
        .filter(F.contains("token", F.lit("/")))
    )
    return X.spelled_tokens(tokens).select("order_id", "token", F.expr(X.shown("words")).alias("words"))


def _all_symbols(text: str) -> str:
    branches = []
    for code, table in SYMBOLS.items():
        folded = text
        for symbol, word in table:
            folded = keep_edges(folded, symbol, word, "\\" + symbol if symbol in "*+$" else symbol)
        branches.append(f"WHEN '{code}' THEN {folded}")
    return f"CASE lang {' '.join(branches)} ELSE {text} END"


@register("symbols_to_words", C.ctes(NUMERIC) + f"SELECT order_id, {_all_symbols('text')} AS text FROM numeric_lines")
def symbols_to_words(spark, d):
    return T.numeric_lines(spark, d).select("order_id", F.expr(X.symbols_to_words("text", "lang")).alias("text"))


@register("replace_word_boundaries", C.ctes(C.LINES) + f"""
SELECT doc_id, line_no, {keep_edges('line', 'the', 'THE', 'the')} AS text FROM lines""")
def replace_word_boundaries(spark, d):
    return T.lines(spark, d).select(
        "doc_id", "line_no", F.expr(X.replace_keeping_word_boundaries("line", "'the'", "'THE'")).alias("text")
    )


@register("undigit", C.ctes(NAMES, f"""
src AS (SELECT o_orderkey AS order_id, {_LANG} AS lang, lpad((o_custkey % 100)::VARCHAR, 3, '0') AS digits, (o_custkey % 100)::BIGINT AS n,
          (o_orderkey % 7 + 2)::BIGINT AS below FROM orders)""") + f"""
SELECT order_id, digits, repeat(CASE lang WHEN 'fr' THEN 'zéro ' WHEN 'es' THEN 'cero ' ELSE 'zero ' END, CASE WHEN n = 0 THEN 0 WHEN n < 10 THEN 2 ELSE 1 END) ||
  {by_lang('n', card)} AS words, {_denominator('below')} AS denominator
FROM src, names""")
def undigit(spark, d):
    src = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.expr(T.NUMERIC_LANG).alias("lang"),
        F.expr("lpad(cast(o_custkey % 100 as string), 3, '0')").alias("digits"),
        F.expr("cast(o_orderkey % 7 + 2 as string)").alias("below"),
    )
    return src.select(
        "order_id",
        "digits",
        F.expr(N.with_names(X.undigit("digits", "lang"))).alias("words"),
        F.expr(N.with_names(X.undigit("below", "lang", "denominator"))).alias("denominator"),
    )


_LARGE = "(o_orderkey * 7919 % 999983) * (o_custkey % 1000) * (o_orderkey % 4 * 333333 + 1) - 5"
_SPOKEN = [(rule, lang) for rule in ("cardinal", "ordinal") for lang in N.SPELLED]


@register("spell_numbers", C.ctes(NAMES, f"n AS (SELECT DISTINCT {_LARGE} AS n FROM orders)") + "SELECT n, " + ", ".join(
    f"{card('n', lang)} AS {lang}" if rule == "cardinal" else f"{ordi('abs(n)', lang)} AS {lang}_ordinal" for rule, lang in _SPOKEN
) + " FROM n, names")
def spell_numbers(spark, d):
    distinct = T.table(spark, d, "orders").select(F.expr(_LARGE).alias("n")).distinct()
    digits = N.digits_of("n")
    # cardinals without a sign first: ordinals are made of their words
    spoken = distinct.select("n", F.expr(digits).alias("digits"), *(F.expr(N.with_names(N.cardinal(digits, lang))).alias(f"{lang}_words") for lang in N.SPELLED))
    words = [
        F.expr(f"concat(if(n < 0, '{N.MINUS[lang]}', ''), {lang}_words)").alias(lang) if rule == "cardinal"
        else F.expr(N.with_names(N.ordinal("digits", lang, f"{lang}_words"))).alias(f"{lang}_ordinal")
        for rule, lang in _SPOKEN
    ]
    return spoken.select("n", *words)


@register("normalize_text")
def normalize_text(spark, d):
    numeric = T.numeric_lines(spark, d).selectExpr("order_id as id", "0L as line_no", "lang", "text")
    prose = T.lines(spark, d).selectExpr("doc_id as id", "line_no + 1 as line_no", "lang", "line as text")
    return X.normalize_text(numeric.unionByName(prose))
