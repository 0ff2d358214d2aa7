"""Segments, time maps, chunks and audio files."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import chunks, voice
from parlance.sources import audio


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dilate_merge_takes_the_newest_end(spark):
    segs = spark.createDataFrame([(1, 1, 9), (1, 9, 19), (1, 13, 13), (1, 17, 29)], "session long, start_f long, end_f long")
    lengths = spark.createDataFrame([(1, 30)], "session long, length long")
    # Widened by one: (0,10),(8,20),(12,14),(16,30).
    for block, fan in ((4096, 1024), (2, 2)):
        assert rows(voice.dilate_merge(segs, lengths, 1, block, fan)) == [(1, 0, 14), (1, 16, 30)]
    assert rows(voice.dilate_merge(segs, lengths, 0)) == rows(segs)


def test_vad_settings(spark):
    frames = spark.createDataFrame([(1, f, 60.0 if f in (0, 1, 4, 5, 9) else 1.0) for f in range(12)], "session long, f long, value double")
    assert rows(voice.vad_segments(frames, 50, 2, 2)) == [(1, 0, 6)]
    assert rows(voice.vad_segments(frames, 50, 1, 1, block=3, fan=2)) == [(1, 0, 2), (1, 4, 6), (1, 9, 10)]
    assert rows(voice.segments_for(frames, "false")) == [(1, 0, 12)]
    with pytest.raises(ValueError):
        voice.segments_for(frames, "unheard-of")


def naive_remap(segs, t, t2):
    """The rule followed segment by segment."""
    total, offset, best, ended = 0, 0, None, False
    for s, e in segs:
        offset = s - total
        total += e - s
        if min(t, t2) <= total and not ended:
            x0, x1 = (min(max(offset + v, s), e) for v in (t, t2))
            cost = abs(abs(t2 - t) - abs(x1 - x0))
            if best is None or cost < best[0]:
                best = (cost, x0, x1)
        ended = ended or max(t, t2) <= total
    return (best[1], best[2]) if best else (offset + t, offset + t2)


def test_remap_against_the_rule(spark):
    rng = random.Random(3)
    segments, words, want = [], [], {}
    for s in range(40):
        at, segs = 0, []
        for _ in range(rng.randint(1, 8)):
            at += rng.randint(1, 50)
            end = at + rng.randint(1, 60)
            segs.append((at, end))
            at = end
        segments += [(s, a, b) for a, b in segs]
        total = sum(b - a for a, b in segs)
        for w in range(30):
            t = rng.randint(0, total + 20)
            t2 = t + rng.randint(0, 80)
            words.append((s, w, t, t2))
            want[s, w] = naive_remap(segs, t, t2)
    segs = spark.createDataFrame(segments, "session long, start_f long, end_f long")
    mapped = voice.speech_map(segs, block=16, fan=2)
    word_rows = spark.createDataFrame(words, "session long, word_id long, t long, t2 long")
    got = {(r.session, r.word_id): (r.start_ms, r.end_ms) for r in voice.remap_timestamps(word_rows, mapped, slot=20).collect()}
    assert got == want
    points = {(r.session, r.word_id): r.original for r in voice.remap_points(word_rows.drop("t2"), mapped, 20).collect()}
    assert len(points) == len(words)
    for (s, w, t, _) in words:
        assert points[s, w] == naive_remap([(a, b) for k, a, b in segments if k == s], t, t)[0]


def test_speech_only_small_blocks(spark):
    segs = spark.createDataFrame([(1, 3, 5), (1, 8, 9), (1, 20, 24)], "session long, start_f long, end_f long")
    frames = spark.createDataFrame([(1, f, float(f)) for f in range(30)], "session long, f long, value double")
    got = rows(voice.speech_only(frames, segs, block=4, fan=2).select("f", "g"))
    assert got == [(3, 0), (4, 1), (8, 2), (20, 3), (21, 4), (22, 5), (23, 6)]


def test_chunks_give_every_word_once(spark):
    words = [(1, i, "ab", i * 500, i * 500 + 200) for i in range(60)]
    frame = spark.createDataFrame(words, "session long, pos long, word string, start_ms long, end_ms long")
    lengths = spark.createDataFrame([(1, 29_700)], "session long, length long")
    listed = chunks.words_per_chunk(frame, lengths, 6000, 500)
    assert listed.count() > 60
    got = rows(chunks.merge_chunk_words(listed, 6000, 500).select("pos", "start_ms", "end_ms"))
    assert got == [(i, s, e) for _, i, _, s, e in words]
    assert chunks.merge_chunk_words(listed, 6000, 500, compat=True).count() > 60
    plan = rows(chunks.chunk_plan(lengths, 6000, 500, 9000))
    assert plan[0] == (1, 0, 0, 6500) and plan[-1] == (1, 4, 23_500, 29_700)
    assert rows(chunks.chunk_plan(lengths, 6000, 500, 30_000)) == [(1, 0, 0, 29_700)]


def test_token_windows_pad(spark):
    tokens = spark.createDataFrame([(1, i, f"t{i}") for i in range(5)], "d int, pos long, t string")
    got = chunks.token_windows(tokens, ["d"], "pos", "t", 4).orderBy("window").collect()
    assert got[1].tokens == ["t4", "[PAD]", "[PAD]", "[PAD]"] and got[1].n == 1


def write_wav(path, rate, channels, samples):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(np.asarray(samples, "<i2").tobytes())


def test_wav_files(spark, tmp_path):
    tone = (10_000 * np.sin(2 * np.pi * 440 * np.arange(3200) / 16000)).astype("<i2")
    write_wav(tmp_path / "mono.wav", 16000, 1, tone)
    write_wav(tmp_path / "stereo.wav", 8000, 2, np.stack([tone, -tone], 1).ravel())
    (tmp_path / "short.wav").write_bytes((tmp_path / "mono.wav").read_bytes()[:500])
    (tmp_path / "text.wav").write_bytes(b"hello")
    (tmp_path / "other.txt").write_bytes(b"hello")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.scan_audio(spark, str(tmp_path)).collect()}
    assert set(got) == {"mono.wav", "stereo.wav", "short.wav", "text.wav"}
    assert got["mono.wav"].rate == 16000 and got["mono.wav"].samples == tone.tolist()
    assert got["short.wav"].error == "truncated" and got["text.wav"].error == "not a wav file"
    scanned = audio.scan_audio(spark, str(tmp_path)).filter("error is null")
    good, bad = voice.split_by_rate(scanned)
    assert good.count() == 1 and bad.first().error == "sample rate is not 16000: 8000"
    mono = bad.select(voice.downmix(audio.split_channels(F.col("samples"), F.col("channels"))).alias("m")).first().m
    assert len(mono) == 3200 and max(map(abs, mono)) == 0
    with pytest.raises(Exception):
        audio.scan_audio(spark, str(tmp_path / "missing")).collect()
