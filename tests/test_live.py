"""Agreement of hypotheses, batch and stream."""

import json
import os
import random

import pandas as pd
from conftest import SF
from pyspark.sql import functions as F

from parlance.operators import live as L
from parlance.plans.catalog import QUERIES
from parlance.sources import tables as T
from parlance.streaming import agreement as G
from parlance.streaming import run

SCHEMA = f"session string, iter long, words array<{L.WORD}>, buffer_end double, eof boolean"


def W(*texts, at=0.0):
    return [(at + i, at + i + 0.8, t) for i, t in enumerate(texts)]


def hyp(i, words, end=100.0, eof=False, **more):
    return {"iter": i, "words": words, "buffer_end": end, "eof": eof, **more}


def naive_agreed(b, n, cap):
    b, n, k = list(b), list(n), 0
    while n and b and (n[0] == b[0] or len(b) > cap > -1):
        n.pop(0)
        b.pop(0)
        k += 1
    return k


def test_agreed_count(spark):
    rng = random.Random(7)
    pairs = [([rng.choice("ab") for _ in range(rng.randint(0, 8))], [rng.choice("ab") for _ in range(rng.randint(0, 8))]) for _ in range(400)]
    pairs.append((["a", "b", "c", "d"], ["x", "b", "c", "d"]))
    as_words = lambda xs: [(0.0, 1.0, x) for x in xs]
    frame = spark.createDataFrame([(as_words(b), as_words(n)) for b, n in pairs], f"b array<{L.WORD}>, n array<{L.WORD}>")
    rows = frame.select(L.agreed_count(F.col("b"), F.col("n")).alias("plain"), L.agreed_count(F.col("b"), F.col("n"), 3).alias("capped")).collect()
    assert [r.plain for r in rows] == [naive_agreed(b, n, -1) for b, n in pairs]
    assert [r.capped for r in rows] == [naive_agreed(b, n, 3) for b, n in pairs]
    assert rows[-1].capped == 4


def test_steps_commit_what_two_hypotheses_share():
    state, settings = G.Session(), G.Settings()
    assert G.step(state, hyp(1, W("a", "b")), settings) == [("partial", 0.0, 1.8, "a b")]
    G.step(state, hyp(2, W("A,", "b", "c")), settings)
    assert [w[2] for w in state.finals] == ["A,", "b"] and [w[2] for w in state.buffer] == ["c"]
    assert G.step(state, hyp(2, W("z")), settings) == []  # late row
    last = G.step(state, hyp(3, [], eof=True), settings)
    assert last == [("final", 0.0, 2.8, "A, b c")]


def test_final_needs_a_mark_and_a_pause():
    words = W("a", "b.")
    for texts, end, kind in ((words, 10.0, "final"), (words, 3.0, "partial"), (W("a", "b"), 10.0, "partial")):
        state = G.Session()
        G.step(state, hyp(1, texts, end), G.Settings())
        assert G.step(state, hyp(2, texts, end), G.Settings())[0][0] == kind
    state, counted = G.Session(), G.Settings(pause=1.2, final_min_words=2)
    three = W("a", "b", "c")
    G.step(state, hyp(1, three, 10.0), counted)
    assert G.step(state, hyp(2, three, 10.0), counted) == [("final", 0.0, 2.8, "a b c")]


def test_repeated_words_are_dropped():
    state, whole = G.Session(), G.Settings(trimming=1000.0)  # words cut from the buffer are no echo
    G.step(state, hyp(1, W("a", "b")), whole)
    G.step(state, hyp(2, W("a", "b")), whole)
    assert state.last_committed == 1.8
    G.step(state, hyp(3, W("a", "b", "c", at=1.9)), whole)
    assert [w[2] for w in state.buffer] == ["c"]


def test_edge_word_and_throttle():
    state = G.Session()
    G.step(state, hyp(1, W("a", "b"), 1.82), G.Settings())
    assert [w[2] for w in state.buffer] == ["a"]
    state, slow = G.Session(), G.Settings(partials_per_second=4)
    sent = [bool(G.step(state, hyp(i, W("a"), 5.0, at=i * 0.125), slow, pending=True)) for i in range(1, 8)]
    assert sent == [True, False, True, False, True, False, True]


def test_state_stays_small():
    state, settings = G.Session(), G.Settings()
    words = W(*[f"w{i}" for i in range(500)])
    for i in range(1, 125):
        G.step(state, hyp(i, words[max(0, 4 * i - 12): 4 * i], 4.0 * i + 1), settings)
    assert len(state.committed) < 40


def test_batch_equals_stream_and_direct_steps(spark):
    hyps = QUERIES  # the registered queries run over the same given table
    batch = sorted(map(tuple, hyps["stream_agreement"](spark, SF).collect()), key=repr)
    live = sorted(map(tuple, hyps["stream_agreement_live"](spark, SF).collect()), key=repr)
    assert batch == live and len(batch) > 100


def test_stream_over_many_batches(spark, tmp_path):
    """State survives between micro-batches: one file per iteration, one file per trigger."""
    rng = random.Random(8)
    sessions = {f"s{s}": [f"{rng.choice('abcdef')}{i}" for i in range(rng.randint(3, 17))] for s in range(6)}
    rows = []
    for name, texts in sessions.items():
        words = W(*texts)
        n = -(-len(words) // 4)
        rows += [(name, k, words[max(0, 4 * k - 12): 4 * k], words[min(4 * k, len(words)) - 1][1] + 0.1, False) for k in range(1, n + 1)]
        rows.append((name, n + 1, [], words[-1][1] + 0.5, True))
    source = tmp_path / "in"
    source.mkdir()
    for k in sorted({r[1] for r in rows}):
        target = source / f"part-{k:03}.json"
        with open(target, "w") as out:
            for r in rows:
                if r[1] == k:
                    ws = [dict(zip(("start", "end", "word"), w)) for w in r[2]]
                    out.write(json.dumps({"session": r[0], "iter": k, "words": ws, "buffer_end": r[3], "eof": r[4]}) + "\n")
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    live = sorted(map(tuple, run.collected(G.agree_stream(stream)).collect()), key=repr)
    batch = sorted(map(tuple, G.agree_batch(spark.read.schema(SCHEMA).json(str(source))).collect()), key=repr)
    assert live == batch
    finals = {}
    for session, it, kind, _, _, text in sorted(live, key=lambda r: r[1]):
        if kind == "final":
            finals.setdefault(session, []).append(text)
    assert {s: " ".join(t) for s, t in finals.items()} == {s: " ".join(t) for s, t in sessions.items()}


def test_idle_sessions_stream(spark, tmp_path):
    rows = pd.DataFrame({"session": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01 00:01:00", "2024-01-01 00:00:01"])})
    later = pd.DataFrame({"session": [9], "ts": pd.to_datetime(["2024-01-02"])})
    for i, part in enumerate((rows, later)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run.collected(L.idle_sessions_stream(stream, "10 seconds", "1 second"))
    assert sorted((r.session, r.n) for r in got.collect() if r.session != 9) == [(1, 1), (1, 2), (2, 1)]


def test_emission_json(spark):
    frame = spark.createDataFrame([("partial", "a é"), ("final", "b")], "kind string, text string")
    assert [r[0] for r in frame.select(run.emission_json(F.col("kind"), F.col("text"))).collect()] == ['{"partial":"a é"}', '{"text":"b"}']


def test_arrival_logs_small_blocks(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for s in range(3):
        at = 0
        for _ in range(80):
            at += rng.choice([1, 1, 2, 5, 30])
            n += 1
            rows.append((s, n, at, rng.choice(["partial"] * 5 + ["final"]), rng.choice([0, 1, 1, 1])))
    frame = spark.createDataFrame(rows, "session long, event_id long, at_s long, kind string, pending long")
    want = []
    for s in range(3):
        sent = None
        for _, event, at, kind, pending in [r for r in rows if r[0] == s]:
            if kind == "final":
                sent = None
                want.append(event)
            elif sent is None or at - sent > 4 or not pending:
                sent = at
                want.append(event)
    assert sorted(r.event_id for r in L.throttle_partials(frame, 4, slot=7).collect()) == want
    silent = L.fill_silence(frame, 4, 1.5, slot=7).filter("event_id is null").count()
    ats = {s: [r[2] for r in rows if r[0] == s] for s in range(3)}
    assert silent == sum(len(range(a + 6, b, 6)) for xs in ats.values() for a, b in zip(xs, xs[1:]) if b - a > 6)


def test_every_session_is_finished(spark):
    """All turns with words, those that say a word group twice included, against the rule written out."""
    hyps = T.hypotheses(T.turns(spark, SF)).select("session", "iter", "words", "buffer_end", "eof", "segment_ends").collect()
    sessions = {}
    for r in sorted(hyps, key=lambda r: (r.session, r.iter)):
        sessions.setdefault(r.session, []).append(r)
    want = {}
    for name, rows in sessions.items():
        state, said = G.Session(), []
        for r in rows:
            one = {**r.asDict(), "words": [(w.start, w.end, w.word) for w in r.words]}
            said += [e[3] for e in G.step(state, one, G.Settings()) if e[0] == "final"]
        want[name] = "".join(said).replace("#", "").replace(" ", "")
    for query in ("finish_every_session", "finish_session"):
        assert {r.session: r.text for r in QUERIES[query](spark, SF).collect()} == want
