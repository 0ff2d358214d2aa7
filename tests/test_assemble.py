"""Gluing, monotonic segments, language and message rules, alignment on small inputs."""

import random

from pyspark.sql import functions as F

from parlance.operators import align, languages, metrics
from parlance.operators import assemble as A
from parlance.sources import messages


def glue(spark, tokens):
    rows = [(1, 0, i, t, i * 10, i * 10 + 9, 80) for i, t in enumerate(tokens)]
    frame = spark.createDataFrame(rows, "session long, seg_idx long, pos long, token string, start_ms long, end_ms long, conf_pct int")
    return [r.word for r in A.glue_punctuation(frame).orderBy("word_idx").collect()]


def naive_glue(tokens):
    words = []
    for t in tokens:
        bare = t.lstrip(" ")
        joins = len(bare) > 1 and bare[0] in "'-&@.," and words and (
            bare == t or not any(c.isalnum() for c in words[-1]) or not any(c.isalnum() for c in t)
        )
        if joins:
            words[-1] += t
        else:
            words.append(t)
    return [w.lstrip(" ") for w in words]


def test_glue_examples(spark):
    assert glue(spark, [" l", "'eau"]) == ["l'eau"]
    assert glue(spark, [" a", "-b"]) == ["a-b"]
    assert glue(spark, [" 3", ".5"]) == ["3.5"]
    assert glue(spark, [" x", " ,"]) == ["x", ","]
    assert glue(spark, [" -", " -a"]) == ["- -a"]


def test_glue_random(spark):
    rng = random.Random(4)
    kinds = [" a", "b", " -", "-c", " -d", " ..", "..", " 'e", " #", ",f", " ,", "&&"]
    texts = [[rng.choice(kinds) for _ in range(rng.randint(1, 15))] for _ in range(300)]
    rows = [(1, s, i, t, i, i + 1, 50) for s, tokens in enumerate(texts) for i, t in enumerate(tokens)]
    frame = spark.createDataFrame(rows, "session long, seg_idx long, pos long, token string, start_ms long, end_ms long, conf_pct int")
    got = {}
    for r in A.glue_punctuation(frame).orderBy("seg_idx", "word_idx").collect():
        got.setdefault(r.seg_idx, []).append(r.word)
    assert [got[s] for s in range(len(texts))] == [naive_glue(t) for t in texts]


def naive_monotonic(segs, step):
    out, end = [], None
    for s, e in segs:
        s = s if end is None else max(s, end)
        e = e if e > s else s + step
        out.append((s, e))
        end = e
    return out


def test_monotonic(spark):
    frame = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 1), (1, 2, 5, 4)], "session long, seg_idx long, start_ms long, end_ms long")
    got = sorted(tuple(r)[1:] for r in A.monotonic_segments(frame, 1).collect())
    assert got == [(0, 0, 2), (1, 2, 3), (2, 5, 6)]
    rng = random.Random(5)
    rows, want = [], {}
    for session in range(30):
        segs = [(i * 8 + rng.randint(-20, 20), i * 8 + rng.randint(-20, 30)) for i in range(40)]
        rows += [(session, i, s, e) for i, (s, e) in enumerate(segs)]
        want[session] = naive_monotonic(segs, 5)
    frame = spark.createDataFrame(rows, "session long, seg_idx long, start_ms long, end_ms long")
    for block, fan in ((4096, 1024), (4, 2)):
        got = {}
        for r in A.monotonic_segments(frame, 5, block, fan).orderBy("session", "seg_idx").collect():
            got.setdefault(r.session, []).append((r.start_ms, r.end_ms))
        assert got == want


def test_parts_split_long_sessions(spark):
    frame = spark.range(2500).selectExpr("1L as session", "id as seg_idx", "concat(' s', id) as text")
    parts = A.assemble_text(frame).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2]
    assert " ".join(p.text for p in parts) == " ".join(f"s{i}" for i in range(2500))


def test_empty_confidence(spark):
    frame = spark.createDataFrame([(1, None), (2, 0.0)], "session long, avg_logprob double")
    assert {r.session: r.confidence for r in A.confidence_from_logprobs(frame).collect()} == {1: 0.0, 2: 1.0}


def test_languages(spark):
    given = ["fr-FR", "FR-FR", "French", "*", "yue-HK", "whatever", None]
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, language string")
    got = [(r.code, r.error is not None) for r in languages.resolve_language(frame).orderBy("i").collect()]
    assert got == [("fr", False), ("fr", False), ("fr", False), (None, False), ("yue", False), (None, True), (None, False)]
    forced = languages.language_fallback(spark.createDataFrame([("sw",), ("fr",)], "language string"), force=True)
    assert {r.language: r.error is not None for r in forced.collect()} == {"sw": True, "fr": False}


def test_messages(spark):
    texts = ['{"eof" : 1}', ' {"eof":1} ', '{"config":{"sample_rate":16000}}', 'x{"eof":1}', '{"config":{}}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    assert [r.kind for r in messages.parse_messages(frame).orderBy("i").collect()] == ["eof", "eof", "config", "audio", "error"]


def test_word_errors(spark):
    rows = [("a b c", "a c"), ("a b", "a x"), ("", "a"), ("a", "a"), ("x " * 300, "")]
    frame = spark.createDataFrame(rows, "r string, h string").select(
        F.expr("filter(split(r, ' '), w -> w <> '')").alias("reference"), F.expr("filter(split(h, ' '), w -> w <> '')").alias("hypothesis")
    )
    assert [r[0] for r in frame.select(metrics.word_errors(F.col("reference"), F.col("hypothesis"))).collect()] == [1, 1, 1, 0, 300]


def test_alignment_small_blocks(spark):
    rng = random.Random(6)
    path = [(s, 2 * i + rng.randint(0, 1), rng.choice([0, 0, 1, 2, 2, 2, 3]), 0.5) for s in range(3) for i in range(120)]
    frame = spark.createDataFrame(path, "seg_id long, time_idx long, token_idx long, score double")
    labels = spark.createDataFrame([(0, " "), (1, "a"), (2, "b"), (3, "c")], "token_idx long, label string")
    want_segments, want_words = [], []
    for s in range(3):
        runs = []
        for _, t, k, _ in [p for p in path if p[0] == s]:
            if runs and runs[-1][0] == k:
                runs[-1][2] = t + 1
            else:
                runs.append([k, t, t + 1])
        want_segments += [(s, k, a, b) for k, a, b in runs]
        word = []
        for k, a, b in [*runs, [0, 0, 0]]:
            if k == 0:
                if word:
                    want_words.append((s, "".join(" abc"[x[0]] for x in word), word[0][1], word[-1][2]))
                word = []
            else:
                word.append((k, a, b))
    for block, fan in ((4096, 1024), (16, 2)):
        segs = align.merge_repeats(frame, block, fan)
        assert sorted(tuple(r) for r in segs.select("seg_id", "token_idx", "start", "end").collect()) == sorted(want_segments)
        words = align.merge_words(segs, labels, block=4096, fan=fan)
        assert sorted(tuple(r) for r in words.select("seg_id", "word", "start", "end").collect()) == sorted(want_words)


def test_a_long_word_is_one_row(spark):
    segs = spark.createDataFrame([(0, 1 + i % 3, 3 * i, 3 * i + 2, -1.0) for i in range(50)], "seg_id long, token_idx long, start long, end long, score double")
    labels = spark.createDataFrame([(0, " "), (1, "a"), (2, "b"), (3, "c")], "token_idx long, label string")
    (word,) = align.merge_words(segs, labels, block=16, fan=2).collect()
    assert (word.word, word.start, word.end) == ("".join("abc"[i % 3] for i in range(50)), 0, 149)
    frames = spark.createDataFrame([(0, 48000, 150, 0.0)], "seg_id long, samples long, frames long, offset double")
    given = spark.createDataFrame([(0, 0, "whole")], "seg_id long, word_idx long, original string")
    (timed,) = align.frames_to_seconds(align.merge_words(segs, labels, block=16, fan=2), frames, given, block=16).collect()
    assert (timed.word, timed.word_idx, timed.mismatch) == ("whole", 0, False)
