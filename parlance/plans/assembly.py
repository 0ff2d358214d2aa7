"""Transcript assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns
from parlance.functions.text import remove_punctuation
from parlance.lineage import cut
from parlance.operators import assemble as A
from parlance.operators import voice
from parlance.operators.ordered import dealt
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T

PART = A.SEGMENTS_PER_PART
TOKENS_A_TASK = 500_000


def _session_words(spark, d):
    return T.words(spark, d).selectExpr(
        "conv_id as session", "turn as seg_idx", "cast(pos as bigint) as pos",
        "if(conf_pct % 10 = 3, '<unk>', word) as word", "conf_pct",
    )


_UNK = C.ctes(C.WORDS, """
w AS (SELECT conv_id AS session, turn AS seg_idx, pos, CASE WHEN conf_pct % 10 = 3 THEN '<unk>' ELSE word END AS word, conf_pct FROM words)""")


@register("contains_alphanum", C.ctes(C.TOKENS) + r"""
SELECT session, seg_idx, pos, token, regexp_matches(token, '[\p{L}\p{N}]') AS has FROM tokens""")
def contains_alphanum(spark, d):
    return T.tokens(spark, d).select(
        "session", "seg_idx", "pos", "token", columns.contains_alphanum(F.col("token")).alias("has")
    )


@register("drop_unk_words", _UNK + "SELECT session, seg_idx, pos, word FROM w WHERE word <> '<unk>'")
def drop_unk_words(spark, d):
    return A.drop_unk_words(_session_words(spark, d)).select("session", "seg_idx", "pos", "word")


@register("strip_unk_text", C.ctes(C.TURNS) + r"""
SELECT conv_id, turn, regexp_replace(replace(t, '<unk>', ''), '([\p{L}\p{N}_]) *'' *([\p{L}\p{N}_])', '\1''\2', 'g') AS text
FROM (SELECT conv_id, turn, replace(replace(text, 'le ', 'l '' '), 'an ', '<unk> ') AS t FROM turns)""")
def strip_unk_text(spark, d):
    noisy = F.expr("replace(replace(text, 'le ', \"l ' \"), 'an ', '<unk> ')")
    return T.turns(spark, d).select("conv_id", "turn", A.strip_unk_text(noisy).alias("text"))


@register("validate_segments", C.ctes(C.TURNS) + """
SELECT conv_id AS session, turn AS seg_idx,
  CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN ''
       ELSE concat_ws(',', CASE WHEN turn % 4 = 1 THEN 'start' END, CASE WHEN turn % 4 = 2 THEN 'end' END,
                      CASE WHEN turn % 3 = 2 THEN 'words' END, CASE WHEN turn % 5 = 3 THEN 'avg_logprob' END) END AS missing
FROM turns""")
def validate_segments(spark, d):
    segs = T.segments(spark, d).selectExpr(
        "session", "seg_idx", "if(seg_idx % 4 = 1, null, 0) as start", "if(seg_idx % 4 = 2, null, 1) as end",
        "if(seg_idx % 3 = 2, null, items) as words", "if(seg_idx % 5 = 3, null, avg_logprob) as avg_logprob",
    )
    return A.validate_segments(segs).select("session", "seg_idx", F.array_join("missing_keys", ",").alias("missing"))


@register("timestamp_warnings", C.ctes(C.SESSION_WORDS, """
w AS (SELECT conv_id AS session, pos, start_ms, CASE WHEN pos % 17 = 3 THEN start_ms - 10 WHEN pos % 17 = 4 THEN start_ms ELSE end_ms END AS end_ms FROM timed),
dur AS (SELECT session, max(end_ms) - 3000 AS duration FROM w GROUP BY session)""") + """
SELECT session, count(*) FILTER (start_ms > duration) AS late_starts, count(*) FILTER (end_ms > duration) AS late_ends,
       count(*) FILTER (end_ms < start_ms) AS reversed
FROM w JOIN dur USING (session) GROUP BY session""")
def timestamp_warnings(spark, d):
    rows = cut(T.session_words(spark, d).selectExpr(
        "conv_id as session", "turn", "pos", "start_ms",
        "case when pos % 17 = 3 then start_ms - 10 when pos % 17 = 4 then start_ms else end_ms end as end_ms",
    ))
    durations = rows.groupBy("session").agg((F.max("end_ms") - 3000).alias("duration"))
    return A.timestamp_warnings(rows, durations).groupBy("session").agg(
        F.count_if("late_start").alias("late_starts"),
        F.count_if("late_end").alias("late_ends"),
        F.count_if("reversed").alias("reversed"),
    )


@register("with_metadata_projection", C.ctes(C.TURNS) + """
SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN array_to_string(items, '|') ELSE '' END AS words,
       CASE WHEN turn % 2 = 0 THEN len(items) ELSE 0 END AS n FROM turns""")
def with_metadata_projection(spark, d):
    kept = A.with_metadata(F.col("items"), F.col("turn") % 2 == 0)
    return T.turns(spark, d).withColumn("kept", kept).select(
        "conv_id", "turn", "text", F.array_join("kept", "|").alias("words"), F.size("kept").cast("long").alias("n")
    )


@register("glue_punctuation", "WITH " + C.GLUED + "SELECT session, seg_idx, word_idx::BIGINT AS word_idx, word, start_ms, end_ms, n_tokens FROM glued")
def glue_punctuation(spark, d):
    return A.glue_punctuation(T.tokens(spark, d)).select(
        "session", "seg_idx", "word_idx", "word", "start_ms", "end_ms", "n_tokens"
    )


@register("word_confidence", "WITH " + C.GLUED + "SELECT session, seg_idx, word_idx::BIGINT AS word_idx, conf FROM glued")
def word_confidence(spark, d):
    return A.glue_punctuation(T.tokens(spark, d)).select(
        "session", "seg_idx", "word_idx", A.word_confidence().alias("conf")
    )


@register("assemble_text", C.ctes(C.TURNS) + f"""
SELECT conv_id AS session, turn // {PART} AS part, string_agg(text, ' ' ORDER BY turn) AS text FROM turns GROUP BY 1, 2""")
def assemble_text(spark, d):
    return A.assemble_text(T.segments(spark, d))


@register("confidence_whisper", C.ctes(C.TURNS) + """
SELECT conv_id AS session, round_even(avg(exp(logprob_milli / 1000)) * 100, 0) / 100 AS confidence FROM turns GROUP BY 1""")
def confidence_whisper(spark, d):
    return A.confidence_from_logprobs(T.segments(spark, d))


@register("confidence_kaldi", _UNK + """
SELECT session, sum(conf_pct)::BIGINT / count(*) / 100 AS confidence FROM w WHERE word <> '<unk>' GROUP BY 1""")
def confidence_kaldi(spark, d):
    return A.confidence_without_unk(_session_words(spark, d))


@register("confidence_nemo", _UNK + """
SELECT session, round_even(sum(c)::BIGINT / count(c) / 100 * 100, 0) / 100 AS confidence
FROM (SELECT session, CASE WHEN session % 7 <> 0 THEN conf_pct END AS c FROM w) GROUP BY 1""")
def confidence_nemo(spark, d):
    return A.confidence_mean(_session_words(spark, d).withColumn("conf_pct", F.expr("if(session % 7 <> 0, conf_pct, null)")))


@register("round_word_times", C.ctes(C.TIMED_WORDS) + """
SELECT conv_id, turn, pos, round_even((start_ms * 7 / 1000) * 100, 0) / 100 AS start,
       round_even((end_ms * 7 / 1000) * 100, 0) / 100 AS "end" FROM timed""")
def round_word_times(spark, d):
    return T.timed_words(spark, d).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"),
        columns.round2(F.col("start_ms") * 7 / 1000).alias("start"),
        columns.round2(F.col("end_ms") * 7 / 1000).alias("end"),
    )


_MONO = "WITH " + C.TURNS.replace("turns AS", "RECURSIVE turns AS", 1) + """,
s AS (SELECT conv_id AS session, turn AS seg_idx, 1500 * turn + (turn * 7919 + conv_id * 104729) % 3000 AS a,
             1500 * turn + (turn * 15485863 + conv_id * 611953) % 4000 AS b FROM turns),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seg_idx) AS n FROM s),
walk AS (
  SELECT session, seg_idx, n, a AS start_ms, CASE WHEN b > a THEN b ELSE a + 1000 END AS end_ms FROM n WHERE n = 1
  UNION ALL
  SELECT n.session, n.seg_idx, n.n, greatest(a, end_ms), CASE WHEN b > greatest(a, end_ms) THEN b ELSE greatest(a, end_ms) + 1000 END
  FROM walk w JOIN n ON n.session = w.session AND n.n = w.n + 1)
"""


@register("monotonic_segments", _MONO + "SELECT session, seg_idx, start_ms, end_ms FROM walk")
def monotonic_segments(spark, d):
    segs = T.segments(spark, d).selectExpr(
        "session", "seg_idx",
        "1500 * seg_idx + (seg_idx * 7919 + session * 104729) % 3000 as start_ms",
        "1500 * seg_idx + (seg_idx * 15485863 + session * 611953) % 4000 as end_ms",
    )
    return A.monotonic_segments(segs)


@register("glue_word_times", C.ctes(C.TIMED_WORDS, """
w AS (SELECT *, start_ms + 20 AS s, end_ms - 10 AS e, min(start_ms) OVER sg AS a, max(end_ms) OVER sg AS b
      FROM timed WINDOW sg AS (PARTITION BY conv_id, turn)),
g AS (SELECT *, coalesce((lead(s) OVER al + e) / 2, b)::DOUBLE AS glued_end FROM w WINDOW al AS (PARTITION BY conv_id, turn ORDER BY pos))""") + """
SELECT conv_id AS session, turn AS seg_idx, pos, coalesce(lag(glued_end) OVER al, a)::DOUBLE AS glued_start, glued_end
FROM g WINDOW al AS (PARTITION BY conv_id, turn ORDER BY pos)""")
def glue_word_times(spark, d):
    rows = T.timed_words(spark, d).selectExpr(
        "conv_id as session", "turn as seg_idx", "cast(pos as bigint) as pos", "start_ms + 20 as start_ms", "end_ms - 10 as end_ms",
        "min(start_ms) over (partition by conv_id, turn) as seg_start", "max(end_ms) over (partition by conv_id, turn) as seg_end",
    )
    return A.glue_word_times(rows).select("session", "seg_idx", "pos", "glued_start", "glued_end")


@register("strip_word_punct", C.ctes(C.WORDS) + r"""
SELECT conv_id, turn, pos, regexp_replace(regexp_replace(word, '^[^\p{L}\p{N}_\p{Sc}''\-%+×#@&]+', ''),
  '[^\p{L}\p{N}_\p{Sc}''\-%+×#@&]+$', '') AS word FROM words""")
def strip_word_punct(spark, d):
    return T.words(spark, d).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), remove_punctuation(F.col("word")).alias("word")
    )


@register("words_from_text", C.ctes(C.WORDS) + "SELECT conv_id, turn, pos, word FROM words")
def words_from_text(spark, d):
    return T.table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(columns.split_words(F.col("text"))).alias("pos", "word")
    ).withColumn("pos", F.col("pos").cast("long"))


@register("flatten_words", C.ctes(C.WORDS) + """
SELECT conv_id AS session, turn AS seg_idx, pos, word, length(word) AS n FROM words""")
def flatten_words(spark, d):
    nested = T.segments(spark, d).withColumn(
        "words", F.transform("items", lambda w: F.struct(w.alias("word"), F.length(w).cast("long").alias("n")))
    )
    return A.flatten_words(nested).withColumn("pos", F.col("pos").cast("long"))


@register("transcript", "WITH " + C.GLUED + f""",
lp AS (SELECT conv_id AS session, turn AS seg_idx, exp(logprob_milli / 1000) AS p FROM turns),
segs AS (SELECT session, seg_idx, string_agg(word, ' ' ORDER BY word_idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
                sum(round_even(conf * 100, 0)::BIGINT) AS conf, count(*) AS n FROM glued GROUP BY 1, 2),
every AS (SELECT * FROM lp LEFT JOIN segs USING (session, seg_idx)),
scores AS (SELECT session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, coalesce(sum(n), 0)::BIGINT AS n_words, round_even(avg(p) * 100, 0) / 100 AS confidence,
                  round_even(sum(conf)::BIGINT / sum(n)::BIGINT / 100 * 100, 0) / 100 AS mean_word_conf FROM every GROUP BY 1)
SELECT session, part, text, start_ms, end_ms, n_words, confidence, mean_word_conf
FROM (SELECT session, seg_idx // {PART} AS part, coalesce(string_agg(text, ' ' ORDER BY seg_idx), '') AS text FROM every GROUP BY 1, 2) JOIN scores USING (session)""")
def transcript(spark, d):
    return A.transcript(T.tokens(spark, d), T.segments(spark, d).select("session", "seg_idx", "avg_logprob")).select(
        "session", "part", "text", "start_ms", "end_ms", "n_words", "confidence", "mean_word_conf"
    )


@register("transcript_original_timeline", "WITH " + C.GLUED.replace("RECURSIVE turns AS", "RECURSIVE " + C.SPEECH_MAP.lstrip() + ",\nturns AS", 1) + """,
ms AS (SELECT session, seg_idx AS sid, start_f * 1000 AS a, end_f * 1000 AS b, obeg * 1000 AS obeg, oend * 1000 AS oend, ioffset * 1000 AS ioffset FROM smap),
cand AS (SELECT t.session, t.seg_idx, t.pos, sid, t.start_ms AS t0, t.end_ms AS t2, least(greatest(ioffset + t.start_ms, a), b) AS x0, least(greatest(ioffset + t.end_ms, a), b) AS x1
  FROM tokens t JOIN ms ON t.session = ms.session AND least(t.start_ms, t.end_ms) <= oend AND (sid = 0 OR obeg < greatest(t.start_ms, t.end_ms))),
tails AS (SELECT session, max(oend) AS total, arg_max(ioffset, sid) AS off FROM ms GROUP BY session),
placed AS (
  SELECT session, seg_idx, pos, x0 AS s, x1 AS e FROM cand
  QUALIFY row_number() OVER (PARTITION BY session, seg_idx, pos ORDER BY abs(abs(t2 - t0) - abs(x1 - x0)), sid) = 1
  UNION ALL SELECT t.session, seg_idx, pos, coalesce(off, 0) + start_ms, coalesce(off, 0) + end_ms FROM tokens t LEFT JOIN tails USING (session) WHERE total IS NULL OR least(start_ms, end_ms) > total)
SELECT session, seg_idx, word_idx::BIGINT AS word_idx, min(s) AS start_ms, max(e) AS end_ms
FROM walk JOIN seq USING (session, seg_idx, n) JOIN placed USING (session, seg_idx, pos) GROUP BY 1, 2, 3""")
def transcript_original_timeline(spark, d):
    """Words glued from tokens whose times were moved from the cut audio back to the recording."""
    segments = cut(voice.vad_segments(T.frames(spark, d), 50, 12, 2))
    scaled = [(F.col(c) * 1000).alias(c) for c in ("start_f", "end_f", "obeg", "oend", "ioffset")]
    mapped = cut(voice.speech_map(segments).select("session", "seg_idx", *scaled))
    tokens = cut(A.on_timeline(cut(T.tokens(spark, d)), mapped))
    whole = dealt(tokens, tokens.count(), TOKENS_A_TASK, "session", "seg_idx")
    return A.glue_punctuation(whole).select("session", "seg_idx", "word_idx", "start_ms", "end_ms")
