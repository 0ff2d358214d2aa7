"""Alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.lineage import cut
from parlance.operators import align
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T


def _labels(spark):
    return spark.createDataFrame([(0, " "), (1, "a"), (2, "b"), (3, "c")], "token_idx long, label string")


@register("log_softmax", C.ctes(C.PATHS) + """
SELECT seg_id, time_idx, i - 1 AS i, round(logits[i] - (m + ln(exp(logits[1] - m) + exp(logits[2] - m) + exp(logits[3] - m) + exp(logits[4] - m))), 9) AS lp
FROM (SELECT *, list_max(logits) AS m, unnest(range(1, 5)) AS i FROM paths)""")
def log_softmax(spark, d):
    return T.paths(spark, d).select(
        "seg_id", "time_idx", F.posexplode(align.log_softmax(F.col("logits"))).alias("i", "lp")
    ).select("seg_id", "time_idx", F.col("i").cast("long").alias("i"), F.round("lp", 9).alias("lp"))


_CHARS = C.ctes(r"""
chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents)""", """
vocab AS (SELECT row_number() OVER (ORDER BY label) - 1 AS token_idx, label FROM (
  SELECT DISTINCT CASE WHEN char = ' ' THEN '|' WHEN char = '.' THEN '<pad>' ELSE char END AS label FROM chars WHERE regexp_matches(char, '^[a-z .'']$')))""")


def _chars(spark, d):
    """Distinct characters; each text sends every character once."""
    texts = T.table(spark, d, "documents").select("text")
    return (
        texts.select(F.explode_outer(F.array_distinct(F.split("text", ""))).alias("char")).filter("char <> ''").distinct()
    )


def _vocab(spark, d):
    """Labels of an alignment model: its alphabet, at most 30 rows."""
    from pyspark.sql.window import Window

    labels = _chars(spark, d).filter("char rlike \"^[a-z .']$\"").select(
        F.expr("case char when ' ' then '|' when '.' then '<pad>' else char end").alias("label")
    ).distinct()
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("token_idx"), "label")


@register("norm_labels", _CHARS + "SELECT token_idx, CASE label WHEN '<pad>' THEN '' WHEN '|' THEN ' ' ELSE label END AS label FROM vocab")
def norm_labels(spark, d):
    return align.norm_labels(_vocab(spark, d))


def _ascii(expr: str) -> str:
    return (f"regexp_replace(strip_accents(replace(replace(replace(replace(replace({expr}, 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'OE'), 'Æ', 'AE'), 'ß', 'ss')), "
            r"'[^\x00-\x7F]', '', 'g')")


@register("char_lookup", _CHARS.rstrip() + f""",
c AS (SELECT char, [char, lower(char), upper(char), {_ascii('char')}, lower({_ascii('char')}), upper({_ascii('char')})] AS cands FROM chars WHERE char <> ''),
l AS (SELECT char, unnest(range(6)) AS rank, unnest(cands) AS cand FROM c),
whole AS (SELECT char, arg_min(token_idx, rank)::VARCHAR AS ids FROM l JOIN vocab ON cand = label GROUP BY char),
sp AS (SELECT char, rank, string_agg(token_idx::VARCHAR, ',' ORDER BY i) AS ids, count(*) AS n FROM (
    SELECT char, rank, unnest(string_split(cand, '')) AS letter, unnest(range(len(cand))) AS i FROM l WHERE rank > 0 AND len(cand) > 1) JOIN vocab ON letter = label
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY char ORDER BY n DESC, rank) = 1)
SELECT c.char, coalesce(whole.ids, sp.ids, '') AS ids FROM c LEFT JOIN whole ON c.char = whole.char LEFT JOIN sp ON c.char = sp.char""")
def char_lookup(spark, d):
    return align.char_lookup(_chars(spark, d), _vocab(spark, d)).select("char", F.array_join("ids", ",").alias("ids"))


@register("count_repetitions", C.ctes(C.PATHS, """
t AS (SELECT seg_id, time_idx, row_number() OVER al AS n, CASE WHEN token_idx = lag(token_idx) OVER al THEN 1 ELSE 0 END AS same
      FROM paths WINDOW al AS (PARTITION BY seg_id ORDER BY time_idx)),
r AS (SELECT *, sum(same) OVER (PARTITION BY seg_id ORDER BY time_idx) AS reps FROM t)""") + """
SELECT seg_id, count(*) AS n_tokens, sum(same)::BIGINT AS repetitions, count(*) FILTER (n + reps <= frames) AS kept
FROM r JOIN (SELECT seg_id, count(*) * (90 + seg_id * 5) // 100 AS frames FROM paths GROUP BY 1) USING (seg_id) GROUP BY seg_id""")
def count_repetitions(spark, d):
    tokens = T.paths(spark, d).select("seg_id", F.col("time_idx").alias("pos"), "token_idx")
    budget = tokens.groupBy("seg_id").agg(F.count("*").alias("n")).selectExpr("seg_id", "n * (90 + seg_id * 5) div 100 as frames")
    return align.shrink_tokens(tokens, budget)


@register("merge_repeats", C.ctes(C.CHAR_SEGMENTS) + """
SELECT seg_id, token_idx, start, "end", round(score, 9) AS score FROM csegs""")
def merge_repeats(spark, d):
    return align.merge_repeats(T.scored_paths(spark, d)).withColumn("score", F.round("score", 9))


@register("merge_words", C.ctes(C.CHAR_WORDS) + """
SELECT seg_id, word, start, "end", round(score, 9) AS score FROM cwords JOIN cparts USING (seg_id, g)""")
def merge_words(spark, d):
    segments = cut(align.merge_repeats(T.scored_paths(spark, d)))
    return align.merge_words(segments, _labels(spark)).select(
        "seg_id", "word", "start", "end", F.round("score", 9).alias("score")
    )


@register("frames_to_seconds", C.ctes(C.CHAR_WORDS, """
n AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY start) - 1 AS word_idx FROM cwords),
s AS (SELECT seg_id, (max(time_idx) + 1) * 320 AS samples, max(time_idx) + 1 AS frames, seg_id * 1.5::DOUBLE AS off FROM paths GROUP BY 1)""") + """
SELECT seg_id, word_idx, CASE WHEN seg_id % 2 = 1 THEN word ELSE 'w' || word_idx END AS word,
       round(start * (samples / ((frames + 1) * 16000)) + off, 6) AS start_s, round("end" * (samples / ((frames + 1) * 16000)) + off, 6) AS end_s,
       seg_id % 2 = 1 AS mismatch
FROM n JOIN s USING (seg_id) JOIN cparts USING (seg_id, g)""")
def frames_to_seconds(spark, d):
    path = T.scored_paths(spark, d)
    words = cut(align.merge_words(cut(align.merge_repeats(path)), _labels(spark)))
    segments = path.groupBy("seg_id").agg((F.max("time_idx") + 1).alias("frames")).selectExpr(
        "seg_id", "frames * 320 as samples", "frames", "seg_id * 1.5D as offset"
    )
    # Transcript words for every aligned one, and one too many in odd segments.
    per_segment = words.groupBy("seg_id").agg(F.count("*").alias("n"))
    originals = per_segment.select(
        "seg_id", F.expr("explode(sequence(0L, n - 1 + seg_id % 2))").alias("word_idx")
    ).withColumn("original", F.concat(F.lit("w"), "word_idx"))
    return align.frames_to_seconds(words, segments, originals).select(
        "seg_id", "word_idx", "word", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "mismatch"
    )
