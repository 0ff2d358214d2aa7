"""Wav files by byte ranges."""

import struct
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException

from parlance.shipping import ship
from parlance.sources import wav_ranges as R


def write(path, samples, rate=16000, channels=1, before=b""):
    """A wav file, with other chunks before the samples."""
    data = samples.astype("<i2").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    body = b"WAVE" + head + before + struct.pack("<4sI", b"data", len(data)) + data
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def joined(rows):
    files = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start or 0)):
        held = files.setdefault(r.path.rsplit("/", 1)[-1], [])
        assert r.error or r.start * r.channels == len(held)
        held += r.samples or []
    return files


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_join_to_the_file(spark, tmp_path, size):
    ship(spark)
    rng = np.random.default_rng(size)
    want = {}
    for i, (n, channels) in enumerate([(0, 1), (1, 1), (33, 1), (40, 2), (39, 3)]):
        want[f"{i}.wav"] = rng.integers(-32768, 32768, n * channels).astype(np.int16)
        write(tmp_path / f"{i}.wav", want[f"{i}.wav"], 8000 + i, channels, b"" if i % 2 else struct.pack("<4sI", b"LIST", 5) + b"abcde\0")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "deep.wav", np.arange(20))
    want["deep.wav"] = np.arange(20)
    (tmp_path / "no.txt").write_text("left out")
    rows = R.scan_ranges(spark, str(tmp_path), range_bytes=size, task_bytes=3 * size).collect()
    assert {k: list(v) for k, v in joined(rows).items()} == {k: v.tolist() for k, v in want.items()}
    assert all(r.frames == len(want[r.path.rsplit("/", 1)[-1]]) // r.channels for r in rows)
    # the standard library reads the same
    with wave.open(str(tmp_path / "1.wav")) as file:
        assert file.getframerate() == 8001


def test_files_that_cannot_be_decoded(spark, tmp_path):
    ship(spark)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_text("hello there, no audio here")
    write(tmp_path / "short.wav", np.arange(1000))
    (tmp_path / "short.wav").write_bytes((tmp_path / "short.wav").read_bytes()[:-3])
    write(tmp_path / "none.wav", np.arange(4))
    (tmp_path / "none.wav").write_bytes((tmp_path / "none.wav").read_bytes()[:36])
    found = {r.path.rsplit("/", 1)[-1]: (r.error, r.rate, r.samples) for r in R.scan_ranges(spark, str(tmp_path), range_bytes=100).collect()}
    assert found == {
        "empty.wav": ("not a wav file", None, None), "text.wav": ("not a wav file", None, None),
        "short.wav": ("truncated", None, None), "none.wav": ("no data", None, None),
    }
    with pytest.raises(PySparkException, match="no such folder"):
        R.scan_ranges(spark, str(tmp_path / "missing")).collect()


def test_filters_reach_the_header(spark, tmp_path):
    ship(spark)
    for i, (rate, channels) in enumerate([(16000, 1), (8000, 1), (16000, 2), (44100, 2)]):
        write(tmp_path / f"{i}.wav", np.arange(64), rate, channels)
    (tmp_path / "bad.wav").write_text("x")
    source = R.scan_ranges(spark, str(tmp_path), range_bytes=50)
    names = lambda frame: sorted({r.path[-5] for r in frame.select("path").collect()})
    assert names(source.filter("rate = 16000")) == ["0", "2"]
    assert names(source.filter("rate >= 16000 and channels = 2")) == ["2", "3"]
    assert names(source.filter("rate in (8000, 44100) and start = 0")) == ["1", "3"]
    assert names(source.filter("rate is null")) == ["d"]
    assert names(source.filter("rate = 16000 or channels = 2")) == ["0", "2", "3"]
    reader = R.WavReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([R.EqualTo(("rate",), 8000), R.EqualTo(("path",), "x"), R.IsNotNull(("rate",))]))
    assert left == [R.EqualTo(("path",), "x")] and len(reader.tests) == 2
    # what a filter rules out is not read: only headers are, twelve bytes and some chunk heads
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [r["path"][-5:] for r in rows] == ["1.wav"]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    ship(spark)
    n = 150_000_000
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, 16000, 32000, 2, 16, b"data", 2 * n)
    with open(tmp_path / "large.wav", "wb") as file:  # 300 MB, mostly a hole in the file
        file.write(head)
        file.seek(44 + 2 * (n - 1))
        file.write(struct.pack("<h", 77))
    source = R.scan_ranges(spark, str(tmp_path))
    assert source.rdd.getNumPartitions() == 9
    found = source.selectExpr("size(samples) as n", "aggregate(samples, 0L, (a, x) -> a + x) as total").selectExpr("count(*)", "sum(n)", "sum(total)", "max(n)").first()
    assert tuple(found) == (72, n, 77, (4 << 20) // 2)
