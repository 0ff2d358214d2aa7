"""Signal, voice-activity, time-map and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.lineage import cut
from parlance.operators import chunks, voice
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T

MAX_GAP, MIN_LEN = 12, 2
MS = 1000


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments feed several branches, so they are written once."""
    return cut(voice.vad_segments(T.frames(spark, d), 50, MAX_GAP, MIN_LEN))


def _map_ms(spark: SparkSession, d: str) -> DataFrame:
    """The speech map with one frame standing for a second."""
    mapped = voice.speech_map(_segments(spark, d))
    scaled = ["start_f", "end_f", "obeg", "oend", "ioffset"]
    return cut(mapped.select("session", "seg_idx", *[(F.col(c) * MS).alias(c) for c in scaled]))


@register("pcm_to_float", C.ctes(C.SAMPLES) + """
SELECT clip, idx, (sample / 32768.0)::FLOAT::DOUBLE AS value FROM samples""")
def pcm_to_float(spark, d):
    return T.samples(spark, d).select(
        "clip", "idx", voice.pcm_to_float(F.array("sample"))[0].cast("double").alias("value")
    )


@register("downmix_mono", C.ctes(C.SAMPLES) + """
SELECT clip, idx, (sample + (CASE WHEN idx % 2 = 0 THEN -sample ELSE 3 * sample END)) / 2.0 AS mono FROM samples""")
def downmix_mono(spark, d):
    second = F.expr("if(idx % 2 = 0, -sample, 3 * sample)")
    left, right = F.col("sample").cast("float"), second.cast("float")
    stereo = F.array(F.array(left), F.array(right))
    return T.samples(spark, d).select("clip", "idx", voice.downmix(stereo)[0].alias("mono"))


@register("require_sample_rate", C.ctes(C.SAMPLES) + """
SELECT clip, CASE WHEN clip % 3 = 0 THEN 8000 ELSE 16000 END AS rate, count(*) AS n,
       CASE WHEN clip % 3 = 0 THEN 'sample rate is not 16000: 8000' END AS error
FROM samples GROUP BY clip""")
def require_sample_rate(spark, d):
    clips = T.samples(spark, d).groupBy("clip").agg(F.count("*").alias("n")).withColumn(
        "rate", F.expr("if(clip % 3 = 0, 8000, 16000)")
    )
    good, bad = voice.split_by_rate(clips)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("clip", "rate", "n", "error")


@register("peak_normalize", C.ctes(C.SAMPLES) + """
SELECT clip, idx, sample / greatest(max(abs(sample)) OVER (PARTITION BY clip), 0.1::DOUBLE) AS normalized FROM samples""")
def peak_normalize(spark, d):
    return voice.peak_normalize(T.samples(spark, d)).select("clip", "idx", "normalized")


@register("frame_energy", C.ctes(C.SAMPLES) + """
SELECT clip, idx // 800 AS f, count(*) AS n,
       round(20 * log10(greatest(sqrt(sum(sample * sample)::DOUBLE / count(*)), 1e-10)), 6) AS db
FROM samples GROUP BY 1, 2""")
def frame_energy(spark, d):
    return voice.frame_energy(T.samples(spark, d)).select("clip", "f", "n", F.round("db", 6).alias("db"))


@register("vad_segments", C.ctes(C.SEGMENTS) + "SELECT session, start_f, end_f FROM segments")
def vad_segments(spark, d):
    return voice.vad_segments(T.frames(spark, d), 50, MAX_GAP, MIN_LEN)


@register("explicit_segments", r"""
SELECT event_id, CASE WHEN n = 2 THEN round_even(value * 16000, 0)::BIGINT END AS start,
       CASE WHEN n = 2 THEN round_even((value + 1.5) * 16000, 0)::BIGINT END AS "end",
       CASE WHEN n <> 2 THEN 'segment needs a start and an end' END AS error
FROM (SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 = 1 THEN 3 ELSE 2 END AS n FROM events)""")
def explicit_segments(spark, d):
    pairs = T.table(spark, d, "events").selectExpr(
        "event_id",
        "case when event_id % 10 = 0 then array(value) when event_id % 10 = 1 then array(value, value, value) "
        "else array(value, value + 1.5D) end as pair",
    )
    return voice.explicit_segments(pairs, 16000).select("event_id", "start", "end", "error")


@register("dilate_merge", C.ctes(C.SEGMENTS, """
lengths AS (SELECT session, max(f) + 1 AS length FROM frames GROUP BY session),
wide AS (SELECT session, start_f AS p0, greatest(start_f - 10, 0) AS s, least(end_f + 10, length) AS e FROM segments JOIN lengths USING (session)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY p0) AS run FROM (
  SELECT *, CASE WHEN lag(e) OVER (PARTITION BY session ORDER BY p0) >= s THEN 0 ELSE 1 END AS brk FROM wide))""") + """
SELECT session, arg_min(s, p0) AS start_f, arg_max(e, p0) AS end_f FROM runs GROUP BY session, run""")
def dilate_merge(spark, d):
    frames = T.frames(spark, d)
    lengths = frames.groupBy("session").agg((F.max("f") + 1).alias("length"))
    return voice.dilate_merge(_segments(spark, d), lengths, 10)


@register("speech_map", C.ctes(C.SPEECH_MAP) + "SELECT session, seg_idx, obeg, oend, ioffset FROM smap")
def speech_map(spark, d):
    return voice.speech_map(_segments(spark, d)).select("session", "seg_idx", "obeg", "oend", "ioffset")


@register("speech_only", C.ctes(C.SPEECH_MAP) + """
SELECT f.session, f.f, f.f - m.ioffset AS g, f.value FROM frames f JOIN smap m
ON f.session = m.session AND f.f >= m.start_f AND f.f < m.end_f""")
def speech_only(spark, d):
    return voice.speech_only(T.frames(spark, d), _segments(spark, d))


_REMAP = C.ctes(C.SPEECH_MAP, C.SESSION_WORDS, """
ms AS (SELECT session, seg_idx, start_f * 1000 AS a, end_f * 1000 AS b, obeg * 1000 AS obeg, oend * 1000 AS oend, ioffset * 1000 AS ioffset FROM smap),
w AS (SELECT conv_id AS session, turn, pos, start_ms AS t, end_ms AS t2 FROM timed),
cand AS (
  SELECT w.*, seg_idx, least(greatest(ioffset + t, a), b) AS x0, least(greatest(ioffset + t2, a), b) AS x1
  FROM w JOIN ms ON w.session = ms.session AND least(t, t2) <= oend AND (seg_idx = 0 OR obeg < greatest(t, t2))),
best AS (SELECT session, turn, pos, x0 AS start_ms, x1 AS end_ms FROM cand
  QUALIFY row_number() OVER (PARTITION BY session, turn, pos ORDER BY abs(abs(t2 - t) - abs(x1 - x0)), seg_idx) = 1),
tails AS (SELECT session, max(oend) AS total, arg_max(ioffset, seg_idx) AS off FROM ms GROUP BY session)""")


@register("remap_timestamps", _REMAP + """
SELECT * FROM best UNION ALL
SELECT w.session, turn, pos, coalesce(off, 0) + t, coalesce(off, 0) + t2 FROM w LEFT JOIN tails USING (session) WHERE total IS NULL OR least(t, t2) > total""")
def remap_timestamps(spark, d):
    words = cut(T.session_words(spark, d).select(
        F.col("conv_id").alias("session"), "turn", F.col("pos").cast("long").alias("pos"),
        F.col("start_ms").alias("t"), F.col("end_ms").alias("t2"),
    ))
    return voice.remap_timestamps(words, _map_ms(spark, d)).select("session", "turn", "pos", "start_ms", "end_ms")


@register("remap_point", _REMAP + """
SELECT session, turn, pos, least(greatest(ioffset + t, a), b) AS original FROM (
  SELECT w.*, a, b, ioffset, seg_idx FROM w JOIN ms ON w.session = ms.session AND t <= oend
  QUALIFY row_number() OVER (PARTITION BY w.session, turn, pos ORDER BY seg_idx) = 1)
UNION ALL
SELECT w.session, turn, pos, coalesce(off, 0) + t FROM w LEFT JOIN tails USING (session) WHERE total IS NULL OR t > total""")
def remap_point(spark, d):
    points = cut(T.session_words(spark, d).select(
        F.col("conv_id").alias("session"), "turn", F.col("pos").cast("long").alias("pos"), F.col("start_ms").alias("t")
    ))
    return voice.remap_points(points, _map_ms(spark, d)).select("session", "turn", "pos", "original")


@register("skip_silent_chunks", C.ctes(C.FRAMES) + """
SELECT session, f, chunk, value FROM (
  SELECT session, f, f // 24 AS chunk, value, max(value) OVER (PARTITION BY session, f // 24) AS top FROM frames)
WHERE top >= 50""")
def skip_silent_chunks(spark, d):
    return voice.skip_silent_chunks(T.frames(spark, d), 24).select("session", "f", "chunk", "value")


@register("vad_toggle", C.ctes(C.SEGMENTS) + """
SELECT 'on' AS mode, session, start_f, end_f FROM segments
UNION ALL SELECT 'off', session, 0, max(f) + 1 FROM frames GROUP BY session""")
def vad_toggle(spark, d):
    frames = T.frames(spark, d)
    on = voice.segments_for(frames, "true", max_silence=MAX_GAP, min_len=MIN_LEN)
    off = voice.segments_for(frames, "false")
    return on.select(F.lit("on").alias("mode"), "*").unionByName(off.select(F.lit("off").alias("mode"), "*"))


CHUNK, CONTEXT, THRESHOLD = 6000, 500, 9000


def _lengths(spark, d):
    # the last word ends 400 ms a turn after all words said one after the other
    spoken = F.expr("aggregate(items, 0L, (total, w) -> total + 40 + 60 * length(w))")
    return T.turns(spark, d).filter(F.size("items") > 0).groupBy(F.col("conv_id").alias("session")).agg(
        (F.sum(spoken) + 400 * F.max("turn")).cast("long").alias("length")
    )


@register("chunk_plan", C.ctes(C.SESSION_WORDS, f"""
rec AS (SELECT conv_id AS session, max(end_ms) AS length FROM timed GROUP BY 1),
n AS (SELECT *, CASE WHEN length > {THRESHOLD} THEN CAST(ceil(length / {CHUNK}) AS BIGINT) ELSE 1 END AS n FROM rec)""") + f"""
SELECT session, i AS chunk_idx, CASE WHEN n = 1 THEN 0 ELSE greatest(i * {CHUNK} - {CONTEXT}, 0) END AS start,
       CASE WHEN n = 1 THEN length ELSE least((i + 1) * {CHUNK} + {CONTEXT}, length) END AS "end"
FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def chunk_plan(spark, d):
    return chunks.chunk_plan(_lengths(spark, d), CHUNK, CONTEXT, THRESHOLD)


@register("merge_chunk_words", C.ctes(C.SESSION_WORDS, f"""
w AS (SELECT conv_id AS session, turn, pos, word, start_ms, end_ms,
        CAST(ceil(max(end_ms) OVER (PARTITION BY conv_id) / {CHUNK}) AS BIGINT) - 1 AS last_chunk FROM timed),
c AS (SELECT w.*, i, CASE WHEN i = 0 THEN 0 ELSE i * {CHUNK} - {CONTEXT} END AS off
      FROM (SELECT w.*, unnest(range(start_ms // {CHUNK} - 1, end_ms // {CHUNK} + 2)) AS i FROM w) w
      WHERE i BETWEEN 0 AND last_chunk AND start_ms >= i * {CHUNK} - {CONTEXT} AND end_ms <= (i + 1) * {CHUNK} + {CONTEXT}),
r AS (SELECT *, start_ms - off AS s, end_ms - off AS e, 15 * length(word) AS a FROM c)""") + f"""
SELECT session, turn, pos, i AS chunk_idx, s + off AS start_ms, e + off AS end_ms FROM r
WHERE CASE WHEN last_chunk = 0 THEN true WHEN i = 0 THEN e - a < {CHUNK}
           WHEN i = last_chunk THEN s + a > {CONTEXT} ELSE s + a > {CONTEXT} AND e - a < {CHUNK + CONTEXT} END""")
def merge_chunk_words(spark, d):
    words = cut(T.session_words(spark, d).selectExpr("conv_id as session", "turn", "pos", "word", "start_ms", "end_ms"))
    lengths = words.groupBy("session").agg(F.max("end_ms").alias("length"))
    listed = chunks.words_per_chunk(words, lengths, CHUNK, CONTEXT)
    return chunks.merge_chunk_words(listed, CHUNK, CONTEXT).selectExpr(
        "session", "turn", "cast(pos as bigint) as pos", "chunk_idx", "start_ms", "end_ms"
    )


@register("token_windows", C.ctes(C.WORDS) + """
SELECT conv_id, turn, pos // 32 AS win, count(*) AS n,
       string_agg(word, ' ' ORDER BY pos) || repeat(' [PAD]', 32 - count(*)::INT) AS tokens
FROM words GROUP BY 1, 2, 3""")
def token_windows(spark, d):
    words = T.words(spark, d).withColumn("pos", F.col("pos").cast("long"))
    return chunks.token_windows(words, ["conv_id", "turn"], "pos", "word", 32).select(
        "conv_id", "turn", F.col("window").alias("win"), F.col("n").cast("long").alias("n"),
        F.array_join("tokens", " ").alias("tokens"),
    )
