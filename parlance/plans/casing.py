"""Punctuation, case, filler-word and sub-word queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.columns import collapse_whitespace
from parlance.functions.fixed import MAPPED_PUNCTUATION
from parlance.operators import assemble as A
from parlance.operators import casing as R
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T

_PUNCT = MAPPED_PUNCTUATION.replace("'", "''")


@register("drop_mapped_punct", C.ctes(C.LINES) + f"SELECT doc_id, line_no, translate(line, '{_PUNCT}', '') AS text FROM lines")
def drop_mapped_punct(spark, d):
    return T.lines(spark, d).select("doc_id", "line_no", R.drop_mapped_punct(F.col("line")).alias("text"))


def _recased(token: str, label: str) -> str:
    return (f"CASE {label} WHEN 0 THEN lower({token}) WHEN 1 THEN upper({token}) "
            f"WHEN 2 THEN upper(substr({token}, 1, 1)) || lower(substr({token}, 2)) ELSE {token} END")


@register("recase", C.ctes(C.LABELLED) + f"SELECT doc_id, line_no, pos, {_recased('token', 'case_label')} AS text FROM labelled")
def recase(spark, d):
    return T.labelled_tokens(spark, d).select(
        "doc_id", "line_no", "pos", R.recase(F.col("token"), F.col("case_label")).alias("text")
    )


_EFFECTIVE = C.ctes(C.LABELLED, """
eff AS (SELECT *, CASE WHEN coalesce(lag(punc_label) OVER al, 2) > 1 AND case_label IN (0, 3) THEN 2 ELSE case_label END AS case_eff
        FROM labelled WINDOW al AS (PARTITION BY doc_id, line_no ORDER BY pos))""")


@register("sentence_capitalize", _EFFECTIVE + "SELECT doc_id, line_no, pos, token, case_eff FROM eff")
def sentence_capitalize(spark, d):
    return R.sentence_case(T.labelled_tokens(spark, d, together=True), ["doc_id", "line_no"]).select(
        "doc_id", "line_no", "pos", "token", "case_eff"
    )


@register("detokenize", _EFFECTIVE + f""",
pc AS (SELECT *, CASE WHEN lang = 'fr' THEN coalesce(lag(token) OVER al LIKE '%</w>', true) ELSE token NOT LIKE '##%' END AS starts,
         CASE WHEN lang = 'fr' THEN token LIKE '%</w>' ELSE coalesce(lead(token) OVER al NOT LIKE '##%', true) END AS ends,
         CASE WHEN lang = 'fr' THEN regexp_replace(token, '</w>$', '') ELSE regexp_replace(token, '^##', '') END AS bare,
         row_number() OVER al AS rn
       FROM eff WINDOW al AS (PARTITION BY doc_id, line_no ORDER BY pos)),
tx AS (SELECT doc_id, line_no, string_agg(CASE WHEN starts AND rn > 1 THEN ' ' ELSE '' END || {_recased('bare', 'case_eff')} ||
         CASE WHEN ends THEN ['', ',', '.', ' ?', ' !'][punc_label + 1] ELSE '' END, '' ORDER BY pos) AS t, arg_max(punc_label, pos) AS l
       FROM pc GROUP BY 1, 2)""" + r"""
SELECT doc_id, line_no, regexp_replace(t || CASE WHEN l = 0 THEN '.' ELSE '' END,
  '([\p{L}\p{N}_]) *'' *([\p{L}\p{N}_])', '\1''\2', 'g') AS text FROM tx""")
def detokenize(spark, d):
    return R.detokenize(T.labelled_tokens(spark, d, together=True), ["doc_id", "line_no"], F.col("lang") == "fr").select(
        "doc_id", "line_no", "text"
    )


def _filler_lines(spark, d):
    """All lines; French ones get filler words in place of some of their own."""
    noisy = "if(lang = 'fr', replace(replace(line, ' la ', ' euh '), ' le ', ' heu '), line)"
    return T.lines(spark, d).select("doc_id", "line_no", "lang", F.expr(noisy).alias("line"))


_FILLERS = C.ctes(C.LINES, r"""
f AS (SELECT doc_id, line_no, lang, CASE WHEN lang = 'fr' THEN replace(replace(line, ' la ', ' euh '), ' le ', ' heu ') ELSE line END AS line FROM lines)""")


def _hits(word: str) -> str:
    pattern = rf"' *\b{word}\b *'"
    return f"""SELECT doc_id, line_no, h[i] AS hit,
      list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT doc_id, line_no, regexp_extract_all(line, {pattern}) AS h, string_split_regex(line, {pattern}) AS p FROM f WHERE lang = 'fr'))"""


@register("find_disfluencies", _FILLERS + f"SELECT doc_id, line_no, start::BIGINT AS start, hit FROM ({_hits('euh')} UNION ALL {_hits('heu')})")
def find_disfluencies(spark, d):
    return _filler_lines(spark, d).select(
        "doc_id", "line_no", F.explode_outer(R.find_disfluencies(F.col("line"), F.col("lang"))).alias("h")
    ).filter("h is not null").select("doc_id", "line_no", F.col("h.start").cast("long").alias("start"), "h.hit")


@register("remove_disfluencies", _FILLERS + r"""
SELECT doc_id, line_no, CASE WHEN lang = 'fr' THEN regexp_replace(regexp_replace(line, ' *\beuh\b *', ' ', 'g'), ' *\bheu\b *', ' ', 'g') ELSE line END AS text FROM f""")
def remove_disfluencies(spark, d):
    return _filler_lines(spark, d).select("doc_id", "line_no", R.remove_disfluencies(F.col("line"), F.col("lang")).alias("text"))


_BARE = rf"trim(regexp_replace(translate(line, '{_PUNCT}', ''), '\\s+', ' ', 'g'))"
_RESTORED = _FILLERS.rstrip() + rf""",
b AS (SELECT doc_id, line_no, lang, regexp_replace({_BARE}, '([\p{{L}}\p{{N}}_]) *'' *([\p{{L}}\p{{N}}_])', '\1''\2', 'g') AS line FROM f),
h AS (SELECT doc_id, line_no, list(start::VARCHAR || '|' || hit ORDER BY start, hit) AS hits FROM (@hits) GROUP BY 1, 2),
c AS (SELECT b.*, hits, trim(regexp_replace(CASE WHEN lang = 'fr' THEN regexp_replace(regexp_replace(line, ' *\beuh\b *', ' ', 'g'), ' *\bheu\b *', ' ', 'g')
        ELSE line END, '\s+', ' ', 'g')) || '.' AS clean FROM b LEFT JOIN h USING (doc_id, line_no))
SELECT doc_id, line_no, CASE WHEN hits IS NULL THEN clean ELSE list_reduce(list_concat([clean], hits), lambda acc, x:
    acc[1 : string_split(x, '|')[1]::BIGINT + length(clean[1 : string_split(x, '|')[1]::BIGINT]) - length(translate(clean[1 : string_split(x, '|')[1]::BIGINT], '{_PUNCT}', ''))]
    || rtrim(substring(x, position('|' in x) + 1)) ||
    substring(acc, string_split(x, '|')[1]::BIGINT + length(clean[1 : string_split(x, '|')[1]::BIGINT]) - length(translate(clean[1 : string_split(x, '|')[1]::BIGINT], '{_PUNCT}', '')) + 1)) END AS text
FROM c"""


@register("restore_disfluencies", _RESTORED.replace("@hits", " UNION ALL ".join(_hits(w).replace("FROM f WHERE", "FROM b WHERE") for w in ("euh", "heu"))))
def restore_disfluencies(spark, d):
    bare = A.glue_apostrophes(collapse_whitespace(R.drop_mapped_punct(F.col("line"))))
    return (
        _filler_lines(spark, d)
        .select("doc_id", "line_no", "lang", bare.alias("line"))
        .withColumn("hits", R.find_disfluencies(F.col("line"), F.col("lang")))
        .withColumn("clean", F.concat(collapse_whitespace(R.remove_disfluencies(F.col("line"), F.col("lang"))), F.lit(".")))
        .select("doc_id", "line_no", R.restore_disfluencies(F.col("clean"), F.col("hits")).alias("text"))
    )


@register("map_text_field", C.ctes(C.LINES) + f"""
SELECT doc_id, line_no, CASE (doc_id + line_no) % 3 WHEN 0 THEN translate(trim(line), '{_PUNCT}', '')
  WHEN 1 THEN to_json({{'id': doc_id, 'text': translate(trim(line), '{_PUNCT}', '')}})::VARCHAR ELSE '' END AS text FROM lines""")
def map_text_field(spark, d):
    mixed = F.expr(
        "case (doc_id + line_no) % 3 when 0 then line "
        "when 1 then to_json(named_struct('id', doc_id, 'text', trim(line))) else '  ' end"
    )
    return T.lines(spark, d).select(
        "doc_id", "line_no", R.map_text_field(mixed, R.drop_mapped_punct).alias("text")
    )


_PIECES = C.ctes(C.WORDS, r"""
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '[\p{L}\p{N}_]+')) AS word FROM words) GROUP BY 1),
given AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS g FROM benchmark),
bare AS (SELECT DISTINCT g FROM given UNION SELECT unnest(string_split(lower(g), '')) FROM given),
vocab AS (SELECT DISTINCT g AS piece FROM bare WHERE g <> '' UNION SELECT '##' || g FROM bare WHERE g <> ''),
spans AS (SELECT word, a AS place, unnest(range(1, length(word) - a + 2)) AS size FROM (SELECT word, unnest(range(1, length(word) + 1)) AS a FROM w WHERE length(word) <= 100)),
own AS (SELECT *, CASE WHEN place > 1 THEN '##' ELSE '' END || substring(word, place, size) AS own FROM spans),
longest AS (SELECT word, place, max(size) AS size FROM own WHERE own IN (SELECT piece FROM vocab) OR lower(own) IN (SELECT piece FROM vocab) GROUP BY 1, 2),
walk AS (
  SELECT word, 1::BIGINT AS place, '' AS pieces FROM w WHERE length(word) > 0
  UNION ALL
  SELECT k.word, k.place + l.size, k.pieces || CASE WHEN k.place > 1 THEN ' ##' ELSE '' END || substring(k.word, k.place, l.size)
  FROM walk k JOIN longest l ON l.word = k.word AND l.place = k.place)""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("wordpiece_vocab_coverage", _PIECES + """
SELECT w.word, n, coalesce(k.pieces, '') AS pieces, k.pieces IS NOT NULL AS known FROM w LEFT JOIN walk k ON k.word = w.word AND k.place = length(w.word) + 1""")
def wordpiece_vocab_coverage(spark, d):
    """Words of conversations in pieces of a vocabulary made of the words and letters of ``benchmark``."""
    found = lambda column: F.explode(F.regexp_extract_all(column, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    words = T.words(spark, d).select(found("word").alias("word"))
    given = T.table(spark, d, "benchmark").select(found("text").alias("g"))
    bare = given.distinct().union(given.select(F.explode(F.split(F.lower("g"), "")))).filter("g <> ''").distinct()
    vocab = bare.selectExpr("g as piece").unionByName(bare.selectExpr("concat('##', g) as piece"))
    return R.wordpiece_coverage(words, vocab).select(
        "word", "n", F.array_join("pieces", " ").alias("pieces"), "known"
    )
