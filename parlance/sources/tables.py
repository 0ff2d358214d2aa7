"""The given tables seen as transcripts, frames, paths and request logs.

Each adapter is a plain projection or aggregate, so filters and column pruning reach the scan.
Computed arrays are unnested with the ``_outer`` forms: for the plain ones Spark infers a filter on
the array's size below the unnesting, which works out the whole array a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.columns import collapse_whitespace, split_words
from parlance.operators.ordered import Layout, dealt, prefix

ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"
#: Turns of conversations that a task splits into words.
TURNS_A_TASK = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation turn: a recognizer segment with its words."""
    src = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turns_of(src)


def turns_of(conversations: DataFrame) -> DataFrame:
    """The same from a batch or a stream of conversations."""
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        collapse_whitespace(F.col("text")).alias("text"),
        split_words(F.col("text")).alias("items"),
        (-100 * (1 + F.col("turn") % 5)).alias("logprob_milli"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without times: (conv_id, turn, pos, word, conf_pct, logprob_milli)."""
    return _words_of(turns(spark, sf_dir))


def _words_of(turn_rows: DataFrame) -> DataFrame:
    return turn_rows.select(
        "conv_id", "turn", "logprob_milli", F.posexplode_outer("items").alias("pos", "word")
    ).filter("pos is not null").withColumn("conf_pct", 50 + (F.length("word") * 7) % 50)


def word_ms(base: int) -> str:
    return f"cast({base} + 60 * length(word) as bigint)"


def timed_words(spark: SparkSession, sf_dir: str, base: int = 40) -> DataFrame:
    """Words with times inside their turn. A turn comes from one row, so its window is bounded.

    Whole turns are dealt, not their words, in as many parts as their number asks for.
    """
    along = Window.partitionBy("conv_id", "turn").orderBy("pos")
    whole = dealt(turns(spark, sf_dir), table(spark, sf_dir, "conversations").count(), TURNS_A_TASK, "conv_id", "turn")
    return (
        _words_of(whole)
        .withColumn("end_ms", F.sum(F.expr(word_ms(base))).over(along))
        .withColumn("start_ms", F.expr(f"end_ms - {word_ms(base)}"))
    )


def session_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with times inside the whole conversation: turns follow each other, 400 ms apart."""
    spans = turns(spark, sf_dir).withColumn(
        "span", F.expr("400L + aggregate(items, 0L, (acc, w) -> acc + 40 + 60 * length(w))")
    )
    placed = prefix(
        spans, Layout(("conv_id",), ("turn",), "turn div 1024"), turn_start=("sum", "span")
    ).withColumn("turn_block", F.expr("turn div 1024"))
    along = Window.partitionBy("conv_id", "turn").orderBy("pos")
    return (
        placed.select(
            "conv_id", "turn", "logprob_milli", "turn_start", F.posexplode_outer("items").alias("pos", "word")
        )
        .filter("pos is not null")
        .withColumn("end_ms", F.col("turn_start") + F.sum(F.expr(word_ms(40))).over(along))
        .withColumn("start_ms", F.expr(f"end_ms - {word_ms(40)}"))
        .withColumn("conf_pct", 50 + (F.length("word") * 7) % 50)
        .drop("turn_start")
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy per hour-long analysis frame: (session, f, value); frames without events are absent."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("session"),
            F.expr(f"timestampdiff(HOUR, {ORIGIN}, cast(ts as timestamp_ntz))").cast("long").alias("f"),
            "value",
        )
        .groupBy("session", "f")
        .agg(F.max("value").alias("value"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed 16-bit samples: (clip, idx, sample)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip"),
        F.col("event_id").alias("idx"),
        (F.floor(F.col("value") * 100) % 32768).cast("long").alias("sample"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival log: (session, event_id, at_s, event_type); at_s is seconds from the origin."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        "event_id",
        F.expr(f"timestampdiff(SECOND, {ORIGIN}, cast(ts as timestamp_ntz))").cast("long").alias("at_s"),
        "event_type",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: (doc_id, line_no, lang, line)."""
    src = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return src.select(
        "doc_id", "lang", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")
    ).filter("line_no is not null").withColumn("line_no", F.col("line_no").cast("long"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment path: (seg_id, time_idx, token_idx, logits); the token is the largest of four logits."""
    logits = F.slice("embedding", 1, 4)
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("seg_id"),
        F.col("vec_id").alias("time_idx"),
        (F.array_position(logits, F.array_max(logits)) - 1).alias("token_idx"),
        F.transform(logits, lambda x: x.cast("double")).alias("logits"),
    )


# Amounts, dates, fractions, counts and Roman numerals written out per order.
NUMERIC_TEXT = """
concat_ws(' ',
  if({lang} = 'fr', 'le', 'on'),
  concat(day(o_orderdate), '/', lpad(cast(month(o_orderdate) as string), 2, '0'),
         if(o_orderkey % 4 = 0, concat('/', year(o_orderdate)), '')),
  concat(cast(floor(o_totalprice / 100) as string), if({lang} = 'fr', ',', '.'),
         lpad(cast(o_custkey % 100 as string), 2, '0'), element_at(array('€', '$', '£', '¥'), cast(o_orderkey % 4 + 1 as int))),
  concat(o_custkey % 9 + 1, '/', o_orderkey % 7 + 2),
  concat(o_orderkey % 3, '/', o_custkey % 5, '/', o_orderkey % 11),
  concat(element_at(array('X', 'XI', 'XIV', 'XIX', 'XX', 'XXVII', 'XXXVIII', 'IV', 'I', 'XXIII'), cast(o_custkey % 10 + 1 as int)),
         if({lang} = 'fr' and o_orderkey % 2 = 1, 'e', if({lang} = 'en' and o_orderkey % 6 = 0, 'th', ''))),
  concat(o_orderkey % 60 + 1, if({lang} = 'fr', 'e', 'th')),
  lpad(cast(o_custkey % 50 as string), 3, '0'),
  concat(o_orderkey % 900 + 1, ' ', lpad(cast(o_custkey % 1000 as string), 3, '0')),
  concat(o_custkey % 100, '%'), if(o_orderkey % 2 = 0, 'a&b', 'c + d'), concat('-', o_orderkey % 20))
"""
NUMERIC_LANG = "element_at(array('en', 'fr', 'en', 'fr', 'es'), cast(o_orderkey % 5 + 1 as int))"


def numeric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spoken-language text with digits: (order_id, lang, text)."""
    src = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return src.select(
        F.col("o_orderkey").alias("order_id"),
        F.expr(NUMERIC_LANG).alias("lang"),
        F.expr(NUMERIC_TEXT.format(lang=NUMERIC_LANG)).alias("text"),
    )


# A word becomes sub-word tokens: long words are cut, closing marks stand apart, and now and then a
# token follows that joins only because of what is before it.
TOKEN_PIECES = r"""
filter(array(
  concat(' ', if(length(core) > 6, substr(core, 1, 4), core)),
  if(length(core) > 6, concat('-', substr(core, 5)), null),
  case when mark = '' then null when turn % 3 = 0 then concat(mark, mark)
       when turn % 3 = 1 then concat(' ', mark, mark) else mark end,
  if(pos % 11 = 5, " 'x", null),
  if(pos % 13 = 6, ' #', null),
  if(pos % 13 = 6, ' -b', null)), x -> x is not null)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer tokens (session, seg_idx, pos, token, start_ms, end_ms, conf_pct)."""
    return (
        timed_words(spark, sf_dir)
        .withColumn("core", F.regexp_replace("word", "[.,!?]+$", ""))
        .withColumn("mark", F.expr("substr(word, length(core) + 1)"))
        .select("*", F.posexplode_outer(F.expr(TOKEN_PIECES)).alias("piece", "token"))
        .selectExpr(
            "conv_id as session",
            "turn as seg_idx",
            "cast(pos * 8 + piece as bigint) as pos",
            "token",
            "start_ms + 10 * piece as start_ms",
            "end_ms",
            "conf_pct - piece as conf_pct",
        )
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer segments: (session, seg_idx, role, text, items, avg_logprob)."""
    return turns(spark, sf_dir).select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("seg_idx"),
        "role",
        "text",
        "items",
        (F.col("logprob_milli") / 1000).alias("avg_logprob"),
    )


def labelled_tokens(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Document lines as sub-word tokens with the labels that give the line back:
    (doc_id, line_no, lang, pos, token, punc_label, case_label).

    With ``together`` lines are dealt by their key before they are split, so that windows along a
    line need no shuffle of its tokens.
    """
    rows = lines(spark, sf_dir)
    worded = (rows.repartition("doc_id", "line_no") if together else rows).select(
        "doc_id", "line_no", "lang", F.posexplode_outer(split_words(F.col("line"))).alias("n", "w")
    ).filter("n is not null")
    return (
        worded.withColumn("core", F.regexp_replace("w", "[,.!?]$", ""))
        .filter("core <> ''")
        .withColumn("label", F.expr(
            "case right(w, 1) when ',' then 1 when '.' then 2 when '?' then 3 when '!' then 4 else 0 end"))
        .withColumn("shape", F.expr(
            "case when core = lower(core) then 0 when core = upper(core) and length(core) > 1 then 1 "
            "when core = concat(upper(substr(core, 1, 1)), lower(substr(core, 2))) then 2 else 3 end"))
        .withColumn("base", F.expr("if(shape = 3, core, lower(core))"))
        .withColumn("pieces", F.expr("""
            if(lang = 'fr',
               if(length(base) > 8, array(substr(base, 1, 6), concat(substr(base, 7), '</w>')), array(concat(base, '</w>'))),
               if(length(base) > 8, array(substr(base, 1, 6), concat('##', substr(base, 7))), array(base)))"""))
        .select("*", F.posexplode_outer("pieces").alias("i", "token"))
        .selectExpr(
            "doc_id", "line_no", "lang", "cast(n * 2 + i as bigint) as pos", "token",
            "if(i = size(pieces) - 1, label, 0) as punc_label",
            "if(i = 0 or shape in (1, 3), shape, 0) as case_label",
        )
    )


def scored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path points with the probability of their token: (seg_id, time_idx, token_idx, score)."""
    return paths(spark, sf_dir).selectExpr(
        "seg_id", "time_idx", "token_idx",
        "exp(logits[cast(token_idx as int)]) / aggregate(logits, 0D, (acc, x) -> acc + exp(x)) as score",
    )


# Word i of a turn starts at 0.6 s steps with a pause of 3 s after every 16 words.
HYP_WORDS = """
transform(items, (w, i) -> struct(
  (600 * i + 3000 * (i div 16)) / 1000D as start,
  (600 * i + 3000 * (i div 16) + 500) / 1000D as end,
  if(i % 16 = 15, concat(w, '.'), w) as word))
"""
HYP_SHOWN = """
transform(slice(ws, greatest(4 * iter - 12, 0) + 1, 12), (w, j) ->
  if(greatest(4 * iter - 12, 0) + j + 1 = 4 * iter and 4 * iter < size(ws),
     struct(w.start as start, w.end as end, concat(w.word, '#') as word), w))
"""


def hypotheses(turn_rows: DataFrame) -> DataFrame:
    """What a live recognizer shows of each turn: (session, iter, words, buffer_end, eof).

    Every iteration hears four more words and shows the last twelve, the newest one still unsure
    (``#``); the end of the session repeats the last one. All columns come from the turn's own row, so this works on streams as well.
    """
    worded = turn_rows.select(
        F.concat_ws(":", "conv_id", "turn").alias("session"), F.expr(HYP_WORDS).alias("ws")
    ).filter("size(ws) > 0")
    steps = worded.withColumn("iter", F.explode_outer(F.expr("sequence(1, cast(ceil(size(ws) / 4) as int) + 1)")))
    shown = (
        steps.withColumn("eof", F.expr("4 * (iter - 1) >= size(ws)"))
        .withColumn("heard", F.expr("least(4 * iter, size(ws))"))
        .withColumn("iter", F.expr("least(iter, cast(ceil(size(ws) / 4) as int))"))
        .withColumn("words", F.expr(f"slice({HYP_SHOWN}, 1, heard - greatest(4 * iter - 12, 0))"))
        .withColumn("buffer_end", F.expr("ws[heard - 1].end + if(eof, 0.5D, if(iter % 3 = 0, 0.02D, 0.1D))"))
    )
    # the recognizer cuts its own segments after every eighth word; the newest one is still open
    ends = "transform(filter(transform(words, (w, j) -> struct(w.end as t, greatest(4 * iter - 12, 0) + j + 1 as n)), x -> x.n % 8 = 0 or x.n = heard), x -> x.t)"
    return shown.select(
        "session", F.expr("cast(iter + int(eof) as bigint)").alias("iter"), "words", "buffer_end", "eof", "ws", F.expr(ends).alias("segment_ends")
    )


# Every event as the message a live client would send.
PAYLOAD = """
case event_type when 'purchase' then '{"eof" : 1}'
  when 'view' then concat('{"config": {"sample_rate": ', if(user_id % 3 = 0, 8000, 16000), ', "language": "en"}}')
  when 'error' then concat('{"config": {"language": "', user_id, '"}}')
  else concat('pcm ', value) end
"""


def messages_of(events: DataFrame) -> DataFrame:
    """Messages (session, seq, ts, payload, kind, sample_rate) from a batch or stream of events."""
    from parlance.sources.messages import parse_messages

    return parse_messages(
        events.select(
            F.col("user_id").alias("session"),
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.expr(PAYLOAD).alias("payload"),
        )
    )
