"""Stateful streams over few and many micro-batches against direct rules."""

import json
import math
import os
import random

import pandas as pd
import pytest

from parlance.streaming import arrivals, run, sinks

START = pd.Timestamp("2024-01-01")


def arriving(spark, folder, batches, schema, per_trigger=1):
    """One file for each batch, taken by age."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        path = f"{folder}/part-{i:03}.json"
        with open(path, "w") as out:
            out.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))


def at(second):
    return str(START + pd.Timedelta(seconds=second))


MESSAGES = "session string, seq long, ts timestamp, payload string"


def message(session, seq, second):
    return {"session": session, "seq": seq, "ts": at(second), "payload": f"{session}{seq}"}


def test_gaps_wait_for_the_watermark(spark, tmp_path):
    batches = [
        [message("a", 0, 1), message("a", 2, 3), message("a", 3, 4), message("b", 2, 3), message("b", 0, 1), message("c", 5, 2)],
        [message("a", 1, 2), message("a", 2, 3), message("b", 0, 1)],  # what a waited for, and repeats
        [message("z", 0, 1000)],  # moves the watermark past the gaps of b and c
        [message("z", 1, 1000)],  # the batch in which their timers run
        [message("b", 3, 1001), message("b", 1, 1002), message("c", 6, 1001)],  # b1 comes after its gap was given up
        [message("z", 2, 5000)],
    ]
    got = run.collected(arrivals.in_order(arriving(spark, tmp_path / "in", batches, MESSAGES), "100 seconds")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.session, r.place)):
        assert r.payload == f"{r.session}{r.seq}" and r.place == len(found.setdefault(r.session, []))
        found[r.session].append(r.seq)
    assert found == {"a": [0, 1, 2, 3], "b": [0, 2, 3], "c": [5, 6], "z": [0, 1, 2]}


@pytest.mark.parametrize("files", [1, 9])
def test_any_order_leaves_in_order(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [message(f"s{s}", i, i) for s in range(4) for i in range(rng.randint(1, 40))]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    batches = [rows[i::files] for i in range(files)]
    got = run.collected(arrivals.in_order(arriving(spark, tmp_path / "in", batches, MESSAGES), "1 hour")).collect()
    assert sorted((r.session, r.place, r.seq) for r in got) == sorted({(r["session"], r["seq"], r["seq"]) for r in rows})


PACKETS = "session string, event_id long, seq long, at_s double, ts timestamp, seconds double, eof boolean"


def packets(seed, sessions=4, most=30):
    rng, rows, n = random.Random(seed), [], 0
    for s in range(sessions):
        now, many = rng.random(), rng.randint(1, most)
        for i in range(many):
            now += rng.choice([0.0, 0.5, 1.0, 2.5, 10.0, 40.25])
            n += 1
            rows.append({"session": f"s{s}", "event_id": n, "seq": n, "at_s": now, "ts": at(now), "seconds": rng.choice([0.1, 0.25, 0.6]), "eof": i == many - 1})
    return sorted(rows, key=lambda r: (r["at_s"], r["event_id"]))


@pytest.mark.parametrize("files", [1, 7])
def test_silence_of_any_number_of_batches(spark, tmp_path, files):
    rows = packets(files)
    size = -(-len(rows) // files)
    stream = arriving(spark, tmp_path / "in", [rows[i : i + size] for i in range(0, len(rows), size)], PACKETS)
    got = run.collected(arrivals.silence_filled(stream, 2, 1.5, lateness="0 seconds")).collect()
    want = [(r["session"], r["event_id"], r["at_s"]) for r in rows]
    for name in {r["session"] for r in rows}:
        times = [r["at_s"] for r in rows if r["session"] == name]
        for a, b in zip(times, times[1:]):
            want += [(name, None, a + i * 3.0) for i in range(1, math.ceil((b - a) / 3.0))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_silence_goes_on_until_the_end_is_told(spark, tmp_path):
    """A session that stays silent gets silence as time goes on; the next row of another one moves time."""
    row = lambda session, second, eof=False: {"session": session, "event_id": second, "seq": second, "at_s": second, "ts": at(second), "seconds": 1.0, "eof": eof}
    batches = [[row("a", 0), row("b", 1, True)], [row("c", 7)], [row("c", 20)], [row("c", 21, True)]]
    got = run.collected(arrivals.silence_filled(arriving(spark, tmp_path / "in", batches, PACKETS), 2, 1.5, lateness="0 seconds")).collect()
    assert sorted(r.at_s for r in got if r.session == "a") == [0.0, 3.0, 6.0, 9.0, 12.0, 15.0, 18.0]
    assert [r.at_s for r in got if r.session == "b"] == [1.0]
    assert sorted(r.at_s for r in got if r.session == "c") == [7.0, 10.0, 13.0, 16.0, 19.0, 20.0, 21.0]


def test_silence_by_the_clock(spark, tmp_path):
    """Without event time the clock sends silence; a batch that comes later sees what is due."""
    import time

    folder = tmp_path / "in"
    row = lambda session: {"session": session, "event_id": 1, "seq": 1, "at_s": 0.0, "ts": at(0), "seconds": 1.0, "eof": False}
    stream = arrivals.silence_filled(arriving(spark, folder, [[row("a")]], PACKETS), 0.2, 1.0)
    before = spark.conf.get(run._PROVIDER, None)
    spark.conf.set(run._PROVIDER, run.ROCKSDB)
    query = stream.writeStream.format("memory").queryName("silence_by_the_clock").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("silence_by_the_clock").count() >= 4:
                break
    finally:
        query.stop()
        spark.conf.unset(run._PROVIDER) if before is None else spark.conf.set(run._PROVIDER, before)
    times = sorted(r.at_s for r in spark.table("silence_by_the_clock").collect())
    assert len(times) >= 4 and times == pytest.approx([0.2 * i for i in range(len(times))])


@pytest.mark.parametrize("files", [1, 8])
def test_chunks_of_any_number_of_batches(spark, tmp_path, files):
    rows = packets(20 + files)
    size = -(-len(rows) // files)
    stream = arriving(spark, tmp_path / "in", [rows[i : i + size] for i in range(0, len(rows), size)], PACKETS)
    got = run.collected(arrivals.gathered(stream, 0.9)).collect()
    want = []
    for name in {r["session"] for r in rows}:
        held, n = [], 0
        for r in [r for r in rows if r["session"] == name]:
            held.append(r)
            total = math.fsum(h["seconds"] for h in held)
            if total >= 0.9 or r["eof"]:
                want.append((name, n, held[0]["event_id"], r["event_id"], len(held), total))
                held, n = [], n + 1
    # a session's seq goes up with time in these rows, so both orders are one
    assert sorted(map(tuple, got)) == sorted(want)


class Lost(RuntimeError):
    pass


def test_a_batch_counts_once(spark, tmp_path):
    schema = "kind string, text string"
    batches = [[{"kind": "partial", "text": f"a{i}"}, {"kind": "final", "text": f"b{i}"}] for i in range(4)]
    stream = arriving(spark, tmp_path / "in", batches, schema)
    sink = sinks.OnceSink(f"{tmp_path}/out")
    attempts = []

    def fragile(batch, number):
        attempts.append(number)
        if number == 2 and attempts.count(2) == 1:
            sink.write(batch.limit(1), number)  # half of it, and then the writer is lost
            raise Lost
        if number == 3 and attempts.count(3) == 1:
            sink(batch, number)  # all of it, but the run ends before the stream knows
            raise Lost
        sink(batch, number)

    for _ in range(5):
        query = stream.writeStream.foreachBatch(fragile).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            break
        except Exception as lost:  # the run is started again after each loss
            assert "Lost" in str(lost)
    assert attempts == [0, 1, 2, 2, 3, 3]
    rows = sink.read(spark, schema).collect()
    assert sorted((r.batch, r.text) for r in rows) == sorted((i, f"{k}{i}") for i in range(4) for k in "ab")
    (tmp_path / "out" / "batch=9").mkdir()
    spark.createDataFrame([("final", "never published")], schema).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=9")
    assert sink.read(spark, schema).count() == 8 and sink.published(spark) == [0, 1, 2, 3]
    assert sinks.OnceSink(f"{tmp_path}/none").read(spark, schema).collect() == []


def test_wire_lines(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("partial", ["a", "b"]), ("final", ["x ", None, "é"]), ("final", [])], "kind string, texts array<string>")
    assert [r[0] for r in frame.select(sinks.wire_line(F.col("kind"), F.col("texts"))).collect()] == ['{"partial":"ab"}', '{"text":"x é"}', '{"text":""}']
