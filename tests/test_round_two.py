"""Whole sessions, unmapped times, long bursts, folder streams, fillers and fields of several languages."""

import glob
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from parlance.operators import assemble, casing, live, voice
from parlance.streaming import run


def test_scores_of_a_long_session(spark):
    n = 3000
    segments = spark.range(n).select(F.lit(1).alias("session"), F.col("id").alias("seg_idx"), (-0.1 - F.col("id") / 1000).alias("avg_logprob"))
    tokens = spark.range(n).filter("id % 10 <> 3").select(
        F.lit(1).alias("session"), F.col("id").alias("seg_idx"), F.lit(0).alias("pos"), F.concat(F.lit(" w"), F.col("id")).alias("token"),
        (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 5).alias("end_ms"), F.lit(80).alias("conf_pct"),
    )
    rows = sorted(assemble.transcript(tokens, segments).collect(), key=lambda r: r.part)
    import math

    mean = sum(math.exp(-0.1 - i / 1000) for i in range(n)) / n
    assert [r.part for r in rows] == [0, 1, 2]
    assert {r.confidence for r in rows} == {round(mean, 2)} and {r.n_words for r in rows} == {2700}
    assert {(r.start_ms, r.end_ms) for r in rows} == {(0, 29995)}
    assert " ".join(r.text for r in rows) == " ".join(f"w{i}" for i in range(n) if i % 10 != 3)


def test_sessions_and_segments_without_words(spark):
    segments = spark.createDataFrame([(1, 0, -0.1), (1, 1, -3.0), (2, 0, -0.5)], "session long, seg_idx long, avg_logprob double")
    tokens = spark.createDataFrame([(1, 0, 0, " hi", 0, 10, 90)], "session long, seg_idx long, pos int, token string, start_ms long, end_ms long, conf_pct int")
    rows = {r.session: r for r in assemble.transcript(tokens, segments).collect()}
    assert rows[1].confidence == 0.48 and rows[1].text == "hi" and rows[1].n_words == 1
    assert rows[2].confidence == 0.61 and rows[2].text == "" and rows[2].n_words == 0 and rows[2].start_ms is None and rows[2].mean_word_conf is None


def test_times_without_a_map_stay(spark):
    mapped = spark.createDataFrame([(1, 5000, 9000, 0, 4000, 5000, 0)], "session long, start_f long, end_f long, obeg long, oend long, ioffset long, seg_idx long")
    words = spark.createDataFrame([(1, 0, 100, 200), (2, 0, 100, 200)], "session long, word_id long, t long, t2 long")
    got = {r.session: (r.start_ms, r.end_ms) for r in voice.remap_timestamps(words, mapped).collect()}
    assert got == {1: (5100, 5200), 2: (100, 200)}
    points = words.select("session", "t")
    assert {r.session: r.original for r in voice.remap_points(points, mapped).collect()} == {1: 5100, 2: 100}


def test_silence_cap_empty_sessions_and_channels(spark):
    frames = spark.createDataFrame([(s, f, 60.0 if f in (0, 1, 9, 10) else 1.0) for s in (1, 2) for f in range(11)] + [(3, f, 1.0) for f in range(4)], "session long, f long, value double")
    lengths = spark.createDataFrame([(1, 11), (2, 7)], "session long, length long")
    got = sorted((r.session, r.start_f, r.end_f) for r in voice.vad_segments(frames, 50, 8, 1, lengths=lengths).collect())
    assert got == [(1, 0, 11), (2, 0, 2), (2, 9, 11)]
    segments = voice.vad_segments(frames, 50, 2, 1)
    assert {r.session for r in voice.speech_only(frames, segments).collect()} == {1, 2}
    kept = voice.speech_only(frames, segments, avoid_empty=True).collect()
    assert sorted((r.f, r.g) for r in kept if r.session == 3) == [(i, i) for i in range(4)]
    audio = spark.createDataFrame([("a", 1), ("b", 2), ("c", 6), ("d", None)], "clip string, channels int")
    good, bad = voice.split_by_channels(audio)
    assert {r.clip for r in good.collect()} == {"a", "b"} and {r.clip for r in bad.collect()} == {"c", "d"}


def test_a_long_burst_takes_linear_time(spark):
    n = 100_000
    burst = spark.range(n).select(
        F.lit(1).cast("long").alias("session"), F.col("id").alias("event_id"), (F.col("id") * 0.01).alias("at_s"), F.lit("partial").alias("kind"), F.lit(1).alias("pending")
    )
    start = time.time()
    sent = [r.at_s for r in live.throttle_partials(burst, 0.2).orderBy("at_s").collect()]
    assert time.time() - start < 60
    want, last = [], None
    for i in range(n):
        if last is None or i * 0.01 - last > 0.2:
            last = i * 0.01
            want.append(last)
    assert sent == want


def test_fractions_of_a_second(spark):
    packets = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (1, 3, 2.9)], "session long, event_id long, at_s double")
    times = sorted(r.at_s for r in live.fill_silence(packets, 0.5).collect() if r.event_id is None)
    assert times == [1.25, 2.0, 2.75]
    whole = packets.withColumn("at_s", F.col("at_s").cast("long"))
    assert sorted(r.at_s for r in live.fill_silence(whole, 1).collect() if r.event_id is None) == [1.5]


def test_monotonic_without_any_anchor(spark):
    n = 20_000
    segments = spark.range(n).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("seg_idx"), F.lit(5).cast("long").alias("start_ms"), F.lit(3).cast("long").alias("end_ms"))
    rows = assemble.monotonic_segments(segments).orderBy("seg_idx").collect()
    assert [(r.start_ms, r.end_ms) for r in rows[:2]] == [(5, 1005), (1005, 2005)] and rows[-1].end_ms == 5 + 1000 * n


def test_fillers_of_mixed_languages(spark):
    rows = spark.createDataFrame([("fr", "bonjour euh toi"), ("en", "bonjour euh toi"), (None, "euh"), ("fr-FR", "heu oui")], "lang string, line string")
    got = rows.select(casing.remove_disfluencies(F.col("line"), F.col("lang")).alias("t"), F.size(casing.find_disfluencies(F.col("line"), F.col("lang"))).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("bonjour toi", 1), ("bonjour euh toi", 0), ("euh", 0), (" oui", 1)]


def test_text_fields_of_all_shapes(spark):
    lines = ["{not json, hello}", '{"text": 5}', '{"text": "hi", "n": 1}', '{"n": 1}', " hi ", "", "{}"]
    upper = lambda c: F.upper(c)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i")
    got = rows.select("i", casing.map_text_field(F.col("line"), upper).alias("t"), casing.text_field_error(F.col("line")).alias("e")).collect()
    assert [r.t for r in sorted(got)] == ["{not json, hello}", '{"text":5}', '{"text":"HI","n":1}', '{"n":1}', "HI", "", "{}"]
    assert [r.e for r in sorted(got)] == ["not a JSON object: {not json, hello}", None, None, None, None, None, None]
    listed = spark.createDataFrame([(["a", '{"text": "b"}'],)], "lines array<string>")
    assert listed.select(casing.map_text_fields(F.col("lines"), upper)).first()[0] == ["A", '{"text":"B"}']


def test_pieces(spark):
    words = spark.createDataFrame([("unhappy",), ("unhappy",), ("Un",), ("xyz",), ("a" * 101,)], "word string")
    vocab = spark.createDataFrame([("un",), ("u",), ("##happy",), ("##hap",), ("##p",), ("##y",)], "piece string")
    got = {r.word: (r.n, r.pieces, r.known) for r in casing.wordpiece_coverage(words, vocab).collect()}
    assert got == {"unhappy": (2, ["un", "##happy"], True), "Un": (1, ["Un"], True), "xyz": (1, [], False), "a" * 101: (1, [], False)}


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_over_folders_and_files(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = f"file://{tmp_path}/data"
    events.repartition(parts).write.parquet(f"{folder}/events.parquet")
    stream = run.table_stream(spark, folder, "events").withColumn("session", F.col("user_id")).withColumn("seq", F.col("event_id"))
    stream = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert run.collected(run.ordered_messages(stream).select("session", "seq")).count() == events.count()


def test_workers_import_the_package_from_anywhere(tmp_path):
    code = """
import os, sys, importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", "/root/repo/__spark_entry__.py".replace("/root/repo", ROOT))
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + os.getcwd() + "/shared").getOrCreate())
print("ROWS", entry.queries()["stream_agreement"](spark, "/root/testdata/sf0.001").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", f"ROOT = {root!r}\n{code}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1737" in done.stdout, done.stderr[-2000:]


def test_idle_sessions_end_by_a_timer(spark, tmp_path):
    """Two sessions without eof: their words come out once the idle time is over."""
    from parlance.streaming import agreement

    schema = "session string, iter long, words array<struct<start:double,end:double,word:string>>, buffer_end double, eof boolean"

    def put(name, session, it):
        words = [(i * 0.6, i * 0.6 + 0.5, f"w{i}") for i in range(3 * it)]
        spark.createDataFrame([(session, it, words, words[-1][1] + 0.3, False)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", run.ROCKSDB)
    try:
        put("a", "a", 1)
        put("b", "b", 1)
        stream = agreement.agree_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), agreement.Settings(idle=1.0))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query = query.outputMode("append").trigger(processingTime="500 milliseconds").start()
        until = time.time() + 40
        while time.time() < until and query.isActive:
            time.sleep(1)
            done = glob.glob(f"{tmp_path}/out/*.parquet")
            if done and {r.session for r in spark.read.schema(agreement.EMISSION_SCHEMA).parquet(f"{tmp_path}/out").filter("kind = 'final'").collect()} == {"a", "b"}:
                break
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = spark.read.schema(agreement.EMISSION_SCHEMA).parquet(f"{tmp_path}/out").filter("kind = 'final'").collect()
    assert {(r.session, r.text) for r in rows} == {("a", "w0 w1 w2"), ("b", "w0 w1 w2")}
