"""Stream queries over many micro-batches, each beside the SQL over the table that the stream carries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.functions.fixed import MIN_CHUNK_S
from parlance.lineage import cut, shared_dir
from parlance.operators import live as L
from parlance.plans import ctes as C
from parlance.plans.registry import register
from parlance.sources import audio, wav_ranges
from parlance.sources import tables as T
from parlance.streaming import arrivals, run, sinks

_FILES = 6
_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


@register("scan_audio_ranges", C.ctes(C.SAMPLES, """
clips AS (SELECT clip, idx // 4096 AS block, count(*) AS n, sum(sample)::BIGINT AS total FROM samples WHERE clip % 3 <> 0 GROUP BY 1, 2)""") + """
SELECT clip, block, 16000 AS rate, n AS frames, (42 + 2 * n) // 2048 + 1 AS ranges, total FROM clips""")
def scan_audio_ranges(spark, d):
    """Wav files of two rates, read by ranges of 2 KiB; the rate is decided by the header."""
    clips = T.samples(spark, d).groupBy("clip", F.expr("idx div 4096").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "sample"))), lambda x: x["sample"]).alias("s")
    )
    content = F.when(F.col("clip") % 3 == 0, audio.wav_content(F.col("s"), 8000)).otherwise(audio.wav_content(F.col("s")))
    folder = f"{shared_dir(spark)}/wav-{uuid.uuid4().hex}"
    audio.write_files(clips.select("clip", "block", content.alias("content")), folder, ["clip", "block"])
    named = [F.regexp_extract("path", f"{key}=([0-9]+)", 1).cast("long").alias(key) for key in ("clip", "block")]
    rows = wav_ranges.scan_ranges(spark, folder, range_bytes=2048).filter("rate = 16000")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("rate", "frames", *named, total.alias("total")).groupBy("clip", "block", "rate", "frames").agg(
        F.count("*").alias("ranges"), F.sum("total").alias("total")
    )


def _arriving(spark, rows, *order):
    """``rows`` as a stream of several files, one in each micro-batch, dealt by a hash of ``order``."""
    folder = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    rows.repartition(_FILES, *order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@register("message_stream_in_order", """
SELECT CAST(conv_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn AS seq, text AS payload FROM conversations""")
def message_stream_in_order(spark, d):
    """Every turn twice and in no order over several micro-batches; each leaves once and in order."""
    rows = T.table(spark, d, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr(f"timestampadd(SECOND, turn, {_EPOCH})").alias("ts"), F.col("text").alias("payload"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    )
    stream = _arriving(spark, rows, "session", "seq", "copy").drop("copy")
    return run.collected(arrivals.in_order(stream, "2 days")).select("session", "place", "seq", "payload")


_SEQ = "row_number() OVER (PARTITION BY session ORDER BY at_s, event_id)"


def _packets(spark, d, files=_FILES):
    """Arrivals by ranges of time, one range in each micro-batch; the last row of a session ends it."""
    rows = T.packets(spark, d)
    ends = rows.groupBy("session").agg(F.max(F.struct("at_s", "event_id")).alias("last"))
    # written before it is dealt: the one task of a file then only copies rows, the join stays in many
    marked = cut(rows.join(ends, "session").select(
        "session", "event_id", "at_s", (F.struct("at_s", "event_id") == F.col("last")).alias("eof"),
        F.expr(f"timestampadd(SECOND, at_s, {_EPOCH})").alias("ts"),
    ))
    folder = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for number, share in enumerate(_times(marked, files)):  # one file after the other, as files are taken by age
        share.coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")
    return spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _times(rows, files):
    low, high = rows.agg(F.min("at_s"), F.max("at_s")).first()
    span = ((high or 0) - (low or 0)) // files + 1
    return [rows.filter(F.expr(f"(at_s - {low or 0}) div {span} = {number}")) for number in range(files)]


@register("fill_silence_stream", C.ctes(C.PACKETS, """
g AS (SELECT session, at_s, lag(at_s) OVER (PARTITION BY session ORDER BY at_s, event_id) AS prev FROM packets)""") + """
SELECT CAST(session AS VARCHAR) AS session, event_id, CAST(at_s AS DOUBLE) AS at_s FROM packets
UNION ALL SELECT CAST(session AS VARCHAR), NULL, CAST(unnest(range(prev + 5400, at_s, 5400)) AS DOUBLE) FROM g WHERE at_s - prev > 5400""")
def fill_silence_stream(spark, d):
    return run.collected(arrivals.silence_filled(_packets(spark, d), 3600, 1.5, lateness="1 second"))


@register("min_chunk_stream", C.ctes(C.PACKETS, f"""
n AS (SELECT *, {_SEQ} AS n, count(*) OVER (PARTITION BY session) AS many FROM packets)""") + """
SELECT CAST(session AS VARCHAR) AS session, (n - 1) // 3 AS chunk, arg_min(event_id, n) AS first_id, arg_max(event_id, n) AS last_id, count(*) AS packets,
       CAST(count(*) AS DOUBLE) / 4 AS seconds
FROM n GROUP BY session, (n - 1) // 3""")
def min_chunk_stream(spark, d):
    """Packets of a quarter of a second, sent on by three."""
    seconds = F.lit(0.25)
    packets = _packets(spark, d).select("session", F.expr("at_s * 1000000000L + event_id").alias("seq"), "event_id", seconds.alias("seconds"), "eof")
    return run.collected(arrivals.gathered(packets, MIN_CHUNK_S + 0.25))


@register("expire_idle_stream", C.ctes(C.PACKETS, """
b AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY session ORDER BY at_s, event_id) < 86400 THEN 0 ELSE 1 END AS brk FROM packets),
r AS (SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY at_s, event_id) AS run FROM b),
s AS (SELECT session, min(at_s) AS start_s, max(at_s) + 86400 AS end_s, count(*) AS n FROM r GROUP BY session, run)""") + """
SELECT * FROM s WHERE end_s <= (SELECT max(at_s) FROM packets) - 1""")
def expire_idle_stream(spark, d):
    """Stretches of activity that the watermark has closed when the stream ends."""
    stream = _packets(spark, d).select("session", "ts")
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, {_EPOCH}, {c})").cast("long").alias(f"{c}_s")
    return run.collected(L.idle_sessions_stream(stream, "86400 seconds", "1 second")).select("session", seconds("start"), seconds("end"), "n")


@register("emissions_sink_once", """
SELECT CASE WHEN turn % 2 = 1 THEN to_json({'partial': text || text}) ELSE to_json({'text': text || text}) END AS value FROM conversations""")
def emissions_sink_once(spark, d):
    """Every batch is written twice, as after a failure; the lines are there once."""
    rows = T.table(spark, d, "conversations").select("conv_id", "turn", "text")
    kind = F.when(F.col("turn") % 2 == 1, F.lit("partial")).otherwise(F.lit("final"))
    lines = _arriving(spark, rows, "conv_id", "turn").select(sinks.wire_line(kind, F.array("text", "text")).alias("value"))
    base = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    sink = sinks.OnceSink(f"{base}/out")

    def replayed(batch, number):
        sink.write(batch, number)  # an attempt that ended before it was published
        sink(batch, number)
        sink(batch, number)

    query = lines.writeStream.foreachBatch(replayed).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read(spark, lines.schema).select("value")
