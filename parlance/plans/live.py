"""Live transcription queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.columns import normalize_compare
from parlance.functions.fixed import ASCII_PUNCTUATION, MAX_WORDS_IN_BUFFER, PARTIALS_PER_SECOND
from parlance.lineage import cut
from parlance.operators import assemble as A
from parlance.operators import live as L
from parlance.operators import metrics
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import tables as T
from parlance.streaming import agreement, run

_NORM_PUNCT = ASCII_PUNCTUATION.replace("'", "''")


def _norm(word: str) -> str:
    return f"translate(lower({word}), '{_NORM_PUNCT}', '')"


def _hyps(spark, d):
    return T.hypotheses(T.turns(spark, d)).filter("not eof")


def _text(words):
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


# Words heard before this iteration are committed, the last four before it are the buffer.
_COMMITTED = "slice(ws, greatest(4 * iter - 13, 0) + 1, greatest(0, 4 * (cast(iter as int) - 1) - greatest(4 * cast(iter as int) - 13, 0)))"
_DONE = C.ctes(C.HYPS, """
h AS (SELECT *, ws[greatest(4 * iter - 13, 0) + 1 : 4 * (iter - 1)] AS committed FROM hyps),
c AS (SELECT *, coalesce(committed[-1].end, 0) AS last FROM h)""")


def _committed(spark, d):
    return _hyps(spark, d).withColumn("committed", F.expr(_COMMITTED)).withColumn(
        "last", F.expr("coalesce(try_element_at(committed, -1).end, 0D)")
    )


@register("dedup_overlap", _DONE.rstrip() + """,
n AS (SELECT *, list_filter(list_transform(words, lambda w: {'start': w.start + off, 'end': w.end + off, 'word': w.word}), lambda w: w.start > last - 0.1::DOUBLE) AS fresh
      FROM (SELECT *, CASE WHEN iter % 2 = 0 THEN 0.55::DOUBLE ELSE 0::DOUBLE END AS off FROM c)),
r AS (SELECT *, CASE WHEN abs(fresh[1].start - last) < 1 THEN coalesce(list_filter(range(1, 6), lambda i: i <= least(len(committed), len(fresh)) AND
        list_transform(committed[len(committed) - i + 1 : len(committed)], lambda w: w.word) = list_transform(fresh[1:i], lambda w: w.word))[1], 0) ELSE 0 END AS drop FROM n)
SELECT session, iter, array_to_string(list_transform(fresh[drop + 1 : len(fresh)], lambda w: w.word), ' ') AS text FROM r""")
def dedup_overlap(spark, d):
    rows = _committed(spark, d)
    offset = F.when(F.col("iter") % 2 == 0, F.lit(0.55)).otherwise(F.lit(0.0))
    kept = L.dedup_overlap(F.col("words"), F.col("committed"), F.col("last"), offset)
    return rows.select("session", "iter", _text(kept).alias("text"))


_PAIRS = C.ctes(C.HYPS, """
p AS (SELECT *, lag(words) OVER (PARTITION BY session ORDER BY iter) AS prev FROM hyps),
b AS (SELECT session, iter, list_filter(coalesce(prev, []), lambda x: x.start >= from_s) AS b, list_filter(words, lambda x: x.start >= from_s) AS n
      FROM (SELECT *, ws[greatest(4 * (iter - 2), 0) + 1].start AS from_s FROM p)),
z AS (SELECT *, list_filter(range(least(len(b), len(n))), lambda j: """ + _norm("b[j + 1].word") + " <> " + _norm("n[j + 1].word") + """) AS diffs FROM b)""")


def _pairs(spark, d):
    """Each hypothesis with the one before it, both from the last committed word on."""
    along = Window.partitionBy("session").orderBy("iter")
    start = F.get("ws", F.expr("cast(greatest(4 * (iter - 2), 0) as int)"))["start"]
    previous = F.coalesce(F.lag("words").over(along), F.array().cast(f"array<{L.WORD}>"))
    return (
        _hyps(spark, d)
        .withColumn("from_s", start)
        .withColumn("prev", previous)
        .select(
            "session",
            "iter",
            F.expr("filter(prev, x -> x.start >= from_s)").alias("b"),
            F.expr("filter(words, x -> x.start >= from_s)").alias("n"),
        )
    )


@register("agree_prefix", _PAIRS + "SELECT session, iter, coalesce(list_min(diffs), least(len(b), len(n))) AS agreed FROM z")
def agree_prefix(spark, d):
    return _pairs(spark, d).select(
        "session", "iter", L.agreed_count(F.col("b"), F.col("n")).cast("long").alias("agreed")
    )


@register("agree_prefix_capped", _PAIRS + """
SELECT session, iter, coalesce(list_min(list_filter(diffs, lambda j: NOT (len(b) - j > 2))), least(len(b), len(n))) AS agreed
FROM (SELECT session, iter, b, n, list_filter(range(least(len(b), len(n))), lambda j: (b[j + 1].word <> n[j + 1].word) OR j % 3 = 1) AS diffs FROM z)""")
def agree_prefix_capped(spark, d):
    # Every third word of the buffer is made to differ, so that the cap decides.
    noisy = F.transform(
        "b",
        lambda w, j: F.struct(w["start"].alias("start"), w["end"].alias("end"),
                              F.when((j % 3 == 1) | (w["word"] != F.get("n", j)["word"]), F.lit("~~x")).otherwise(w["word"]).alias("word")),
    )
    return _pairs(spark, d).withColumn("b", noisy).select(
        "session", "iter", L.agreed_count(F.col("b"), F.col("n"), 2).cast("long").alias("agreed")
    )


@register("drop_edge_word", C.ctes(C.HYPS) + """
SELECT session, iter, array_to_string(list_transform(CASE WHEN buffer_end - words[-1].end < 0.05::DOUBLE THEN words[1 : len(words) - 1] ELSE words END,
  lambda w: w.word), ' ') AS text FROM hyps""")
def drop_edge_word(spark, d):
    return _hyps(spark, d).select(
        "session", "iter", _text(L.drop_edge_word(F.col("words"), F.col("buffer_end"))).alias("text")
    )


_BUFFERED = _DONE.rstrip() + """,
q AS (SELECT *, CASE WHEN iter % 5 = 0 THEN [] ELSE ws[4 * (iter - 1) + 1 : least(4 * (iter - 1) + 1 + iter % 4, len(ws))] END AS buf FROM c),
e AS (SELECT *, CASE WHEN len(buf) = 0 THEN buffer_end WHEN len(buf) <= 3 THEN buf[1].end END AS evidence FROM q)
"""


def _buffered(spark, d):
    return _committed(spark, d).withColumn(
        "buf",
        F.expr(f"if(iter % 5 = 0, cast(array() as array<{L.WORD}>), "
               "slice(ws, 4 * (cast(iter as int) - 1) + 1, least(cast(iter % 4 as int) + 1, size(ws) - 4 * (cast(iter as int) - 1))))"),
    )


@register("emit_final", _BUFFERED + """
SELECT session, iter, coalesce(regexp_matches(committed[-1].word, '[!-/:-@\\[-`{-~]$') AND last <> 0 AND evidence <> 0 AND last + 2::DOUBLE < evidence, false) AS by_mark,
       coalesce(len(committed) > 2 AND last <> 0 AND evidence <> 0 AND last + 1.2::DOUBLE < evidence, false) AS by_count FROM e""")
def emit_final(spark, d):
    done, buf, end = F.col("committed"), F.col("buf"), F.col("buffer_end")
    return _buffered(spark, d).select(
        "session",
        "iter",
        L.emit_final(done, buf, end, 2.0).alias("by_mark"),
        L.emit_final(done, buf, end, 1.2, 2).alias("by_count"),
    )


@register("emit_partial", _BUFFERED + """
SELECT session, iter, array_to_string(list_transform(list_concat(committed, buf), lambda w: w.word), ' ') AS text FROM e""")
def emit_partial(spark, d):
    return _buffered(spark, d).select("session", "iter", L.partial_text(F.col("committed"), F.col("buf")).alias("text"))


@register("trim_buffer", _DONE + """
SELECT session, iter, list_max(list_filter(ends[1 : len(ends) - 1], lambda e: e <= last)) AS cut
FROM (SELECT *, list_transform(list_filter(words, lambda w, j: j % 3 = 0), lambda w: w.end) AS ends FROM c)""")
def trim_buffer(spark, d):
    ends = F.expr("transform(filter(words, (w, j) -> (j + 1) % 3 = 0), w -> w.end)")
    return _committed(spark, d).select("session", "iter", L.trim_point(ends, F.col("last")).alias("cut"))


@register("normalize_compare", C.ctes(C.WORDS) + f"SELECT conv_id, turn, pos, {_norm('word')} AS form FROM words")
def normalize_compare_words(spark, d):
    return T.words(spark, d).select(
        "conv_id", "turn", F.col("pos").cast("long").alias("pos"), normalize_compare(F.col("word")).alias("form")
    )


@register("fill_silence", C.ctes(C.PACKETS, """
g AS (SELECT session, at_s, lag(at_s) OVER (PARTITION BY session ORDER BY at_s, event_id) AS prev FROM packets)""") + """
SELECT session, event_id, at_s FROM packets
UNION ALL SELECT session, NULL, unnest(range(prev + 5400, at_s, 5400)) FROM g WHERE at_s - prev > 5400""")
def fill_silence(spark, d):
    return L.fill_silence(T.packets(spark, d), 3600, 1.5)


@register("min_chunk_gate", C.ctes(C.PACKETS) + """
SELECT session, event_id, n * 0.2::DOUBLE AS buffered, CASE WHEN n >= 3 THEN n - 3 END AS trigger_id
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_s, event_id) AS n FROM packets)""")
def min_chunk_gate(spark, d):
    return L.min_chunk_gate(T.packets(spark, d), 0.2, 0.5).select("session", "event_id", "buffered", "trigger_id")


@register("throttle_partials", "WITH RECURSIVE " + C.PACKETS + """,
e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'final' ELSE 'partial' END AS kind, event_id % 7 AS pending,
        row_number() OVER (PARTITION BY session ORDER BY at_s, event_id) AS n FROM packets),
walk AS (
  SELECT session, event_id, at_s, kind, n, true AS passed, CASE WHEN kind = 'partial' THEN at_s END AS sent FROM e WHERE n = 1
  UNION ALL
  SELECT e.session, e.event_id, e.at_s, e.kind, e.n,
    e.kind = 'final' OR e.pending = 0 OR sent IS NULL OR e.at_s - sent > 36000,
    CASE WHEN e.kind = 'final' THEN NULL WHEN e.pending = 0 OR sent IS NULL OR e.at_s - sent > 36000 THEN e.at_s ELSE sent END
  FROM walk w JOIN e ON e.session = w.session AND e.n = w.n + 1)
SELECT session, event_id, at_s, kind FROM walk WHERE passed""")
def throttle_partials(spark, d):
    emissions = T.packets(spark, d).withColumn(
        "kind", F.when(F.col("event_type") == "purchase", F.lit("final")).otherwise(F.lit("partial"))
    ).withColumn("pending", F.col("event_id") % 7)
    return L.throttle_partials(emissions, 36_000)


@register("prompt_suffix", C.ctes(C.SESSION_WORDS, """
w AS (SELECT *, conv_id AS session, max(end_ms) OVER (PARTITION BY conv_id) // 2 AS cut,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, pos DESC) AS newest FROM timed),
k AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY session ORDER BY turn DESC, pos DESC) - length(word) - 1 AS used FROM w WHERE end_ms <= cut AND newest > 1)""") + """
SELECT session, string_agg(word, ' ' ORDER BY turn, pos) AS prompt FROM k WHERE used < 200 GROUP BY session""")
def prompt_suffix(spark, d):
    words = cut(T.session_words(spark, d).selectExpr("conv_id as session", "turn as seg_idx", "pos", "word", "end_ms"))
    cuts = words.groupBy("session").agg(F.expr("max(end_ms) div 2").alias("cut"))
    return L.prompt_suffix(words, cuts)


@register("words_to_sentences", C.ctes(C.TIMED_WORDS, """
s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!]$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM timed)""") + """
SELECT conv_id AS session, turn AS seg_idx, sentence, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text
FROM s GROUP BY 1, 2, 3""")
def words_to_sentences(spark, d):
    words = T.timed_words(spark, d).selectExpr(
        "conv_id as session", "turn as seg_idx", "pos", "word", "start_ms", "end_ms"
    )
    return L.words_to_sentences(words)


@register("expire_idle_sessions", C.ctes(C.PACKETS, """
b AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY session ORDER BY at_s, event_id) < 86400 THEN 0 ELSE 1 END AS brk FROM packets),
r AS (SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY at_s, event_id) AS run FROM b)""") + """
SELECT session, min(at_s) AS start_s, max(at_s) + 86400 AS end_s, count(*) AS n FROM r GROUP BY session, run""")
def expire_idle_sessions(spark, d):
    return L.idle_sessions(T.packets(spark, d), 86_400)


@register("session_text", C.ctes(C.TURNS) + f"""
SELECT conv_id AS session, turn // {A.SEGMENTS_PER_PART} AS part, string_agg(text, chr(10) ORDER BY turn) AS text
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS text FROM turns) WHERE text <> '' GROUP BY 1, 2""")
def session_text(spark, d):
    finals = T.turns(spark, d).selectExpr("conv_id as session", "turn as iter", "if(turn % 3 = 1, ' ', text) as text")
    return L.session_text(finals, A.part_of("iter"))


_RULES = agreement.Settings()
_CAPPED = agreement.Settings(pause=1.2, trimming=10.0, max_words=MAX_WORDS_IN_BUFFER, final_min_words=2, partials_per_second=PARTIALS_PER_SECOND)


def _agree(rules: agreement.Settings) -> str:
    return C.ctes(C.agreement(
        rules.pause, rules.trimming, rules.edge, ASCII_PUNCTUATION, rules.max_words, rules.final_min_words, rules.partials_per_second
    ))


@register("stream_agreement", _agree(_RULES) + "SELECT * FROM agree")
def stream_agreement(spark, d):
    return agreement.agree_batch(T.hypotheses(T.turns(spark, d)))


@register("stream_agreement_capped", _agree(_CAPPED) + "SELECT * FROM agree")
def stream_agreement_capped(spark, d):
    hyps = T.hypotheses(T.turns(spark, d)).withColumn("at", F.col("buffer_end"))
    return agreement.agree_batch(hyps, _CAPPED)


def _live_emissions(spark, d):
    turns = T.turns_of(run.table_stream(spark, d, "conversations"))
    return agreement.agree_stream(T.hypotheses(turns))


@register("stream_agreement_live", _agree(_RULES) + "SELECT * FROM agree")
def stream_agreement_live(spark, d):
    return run.collected(_live_emissions(spark, d))


def _finished(hyps):
    finals = agreement.agree_batch(hyps).filter("kind = 'final'")
    texts = finals.groupBy("session").agg(
        F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iter", "text"))), lambda x: x["text"]), ""), F.lit("#")).alias("text")
    )
    return texts.select("session", F.replace("text", F.lit(" "), F.lit("")).alias("text"))


# All finals of a session, the flush at its end included, one after the other.
_FINISHED = _agree(_RULES) + """
SELECT session, replace(replace(string_agg(text, '' ORDER BY iter), '#', ''), ' ', '') AS text FROM agree WHERE kind = 'final' GROUP BY session"""


@register("finish_every_session", _FINISHED)
@register("finish_session", _FINISHED)
def finish_session(spark, d):
    return _finished(T.hypotheses(T.turns(spark, d)))


@register("partial_revision_rate", _PAIRS + """,
r AS (SELECT session, sum(len(list_filter(range(least(len(b), len(n))), lambda j: b[j + 1].word <> n[j + 1].word)))::BIGINT AS changed,
       sum(least(len(b), len(n)))::BIGINT AS shown FROM z GROUP BY session)
SELECT *, CASE WHEN shown > 0 THEN changed / shown END AS rate FROM r""")
def partial_revision_rate(spark, d):
    return metrics.revision_rate(_pairs(spark, d), "session")


@register("message_stream", C.ctes(C.PACKETS) + """
SELECT session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'eof' WHEN 'view' THEN 'config' WHEN 'error' THEN 'error' ELSE 'audio' END AS kind FROM packets""")
def message_stream(spark, d):
    events = run.table_stream(spark, d, "events")
    doubled = T.messages_of(events).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run.collected(run.ordered_messages(doubled)).select("session", "seq", "kind")


@register("emissions_sink", _agree(_RULES) + """
SELECT CASE WHEN kind = 'partial' THEN to_json({'partial': text}) ELSE to_json({'text': text}) END AS value FROM agree""")
def emissions_sink(spark, d):
    lines = _live_emissions(spark, d).select(run.emission_json(F.col("kind"), F.col("text")).alias("value"))
    return spark.read.text(run.run_available(lines, "text"))
