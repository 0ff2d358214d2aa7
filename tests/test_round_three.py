"""What the findings of round three asked for, on rows made here."""

from __future__ import annotations

import glob
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from parlance import lineage
from parlance.functions import numbers
from parlance.llm import copies
from parlance.operators import assemble, casing
from parlance.plans import streams
from parlance.sources import audio, tables
from parlance.streaming import arrivals


def test_files_hold_the_bytes_and_nothing_else(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, bytearray(b"a\n\xff")), (1, 1, bytearray(b"")), (2, None, None)], "clip long, block long, content binary")
    for _ in range(2):  # as after a task that ran twice
        audio.write_files(rows, f"file://{tmp_path}", ["clip", "block"])
    found = {os.path.relpath(p, tmp_path): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/**/*", recursive=True) if os.path.isfile(p)}
    assert found == {"clip=1/block=0.wav": b"a\n\xff", "clip=1/block=1.wav": b"", "clip=2/block=__HIVE_DEFAULT_PARTITION__.wav": b""}


def test_an_address_that_only_spark_opens_is_left_to_its_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audio.named_files, "opens", lambda folder: False)
    rows = spark.range(3).select(F.col("id").alias("clip"), audio.wav_content(F.array(F.col("id"), F.lit(7))).alias("content"))
    audio.write_files(rows, f"file://{tmp_path}/wav", ["clip"])
    got = audio.scan_audio(spark, f"{tmp_path}/wav", "*.{wav,txt}").select("samples").collect()
    assert sorted(r.samples for r in got) == [[0, 7], [1, 7], [2, 7]]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_windows_of_glue_share_one_order(spark):
    rows = [("s", 0, i, t, 0, 1, 50) for i, t in enumerate([" a", "'s", " -", "'x", " '", " 'b"])]
    tokens = spark.createDataFrame(rows, "session string, seg_idx long, pos long, token string, start_ms long, end_ms long, conf_pct long")
    glued = assemble.glue_punctuation(tokens)
    before_groups = _plan(glued).split("ObjectHashAggregate")[-1]
    assert before_groups.count("Sort [") == 1 and before_groups.count("Window [") > 2
    assert [r.word for r in glued.orderBy("word_idx").collect()] == ["a's", "-'x", "' 'b"]


def test_turns_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id as conv_id", "id % 3 as turn", "'u' as role", "'a b' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(tables, "TURNS_A_TASK", 2)
    assert tables.timed_words(spark, str(tmp_path)).rdd.getNumPartitions() == 25


def test_lines_are_dealt_before_they_are_split(spark, tmp_path):
    spark.createDataFrame([(1, "en", "One two. three\nfour"), (2, None, None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cased = casing.sentence_case(tables.labelled_tokens(spark, str(tmp_path), together=True), ["doc_id", "line_no"])
    plan = _plan(cased)
    assert plan.count("Exchange") == 1 and "Generate" in plan.split("Exchange")[0]
    assert [(r.token, r.case_eff) for r in cased.orderBy("line_no", "pos").collect()] == [("one", 2), ("two", 0), ("three", 2), ("four", 2)]


def test_ordinals_from_words_that_are_there(spark):
    frame = spark.sql("select '21' d, 'twenty-one' w")
    assert "names_" not in numbers.ordinal("d", "en", "w")
    assert frame.selectExpr(numbers.ordinal("d", "en", "w")).first()[0] == "twenty-first"


def test_packets_are_joined_before_they_are_dealt(spark, tmp_path, monkeypatch):
    spark.sql("select 1L user_id, id event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) ts, 'view' event_type, 1D value from range(12)").write.parquet(f"{tmp_path}/events.parquet")
    written = []
    monkeypatch.setattr(streams, "cut", lambda rows: written.append(rows) or lineage.cut(rows))
    assert streams._packets(spark, str(tmp_path)).isStreaming and len(written) == 1 and "Join" in _plan(written[0])


class _Map(dict):
    calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_rows_that_leave_at_once_never_enter_the_state():
    order = arrivals.InOrder(0)
    order.held, order.next, timers = _Map(), _Value(), []
    order.remind = timers.append
    batch = lambda *seqs: iter([pd.DataFrame({"seq": seqs, "ts": [pd.Timestamp(s, unit="s") for s in seqs], "payload": [f"p{s}" for s in seqs]})])
    leave = lambda *seqs: [tuple(r) for f in order.handleInputRows(("s",), batch(*seqs), None) for r in f[["place", "seq", "payload"]].to_numpy().tolist()]
    assert leave(1, 0, 1, 3, 5) == [(0, 0, "p0"), (1, 1, "p1")] and order.held.calls == 2 and timers == [3001]
    assert leave(2, 2, 0) == [(2, 2, "p2"), (3, 3, "p3")] and set(order.held) == {(5,)} and order.held.calls == 3

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 9000)  # noqa: N815

    assert [r.seq for f in order.handleExpiredTimer(("s",), Times, None) for r in f.itertuples()] == [5] and not order.held


def test_sketches_differ_by_no_more_than_the_sets(spark):
    rng = random.Random(9)
    sets = [sorted(rng.randrange(-(2**62), 2**62) for _ in range(300)) for _ in range(2)]
    sets.append(sorted(sets[0][:280] + sets[1][:15]))
    drawn = copies.sketches(spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "node string, grams array<long>"))
    bits = {r.node: [b & (2**64 - 1) for b in r.bits] for r in drawn.collect()}
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
    assert 20 < far("0", "2") <= 35 and 200 < far("0", "1") <= 600
