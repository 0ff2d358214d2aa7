"""Wav files as a Python data source: byte ranges for tasks, filters on the header before any sample.

``spark.read.format("wav_ranges").load(folder)`` gives a row for each range of a file:
(path, rate, channels, frames, start, samples, error). ``start`` is the first frame of the row,
``frames`` the frames of the whole file, samples are interleaved by channel as in the file. A frame
belongs to the range in which its first byte lies, so the rows of a file join to the whole file
whatever the size of a range. Headers are read by tasks. ``scan_ranges`` lets tasks list the folder
too and gives the source a table of ranges; without one the listing happens on the driver.

Options: ``path`` (a folder or file, any address that ``pyarrow.fs`` opens), ``pathGlobFilter``
(``*.wav``), ``rangeBytes`` (bytes of a file for one row), ``taskBytes`` (bytes for one task) and
``listing`` (a folder of Parquet files, each with the parts of files for one task).

Filters on rate and channels are decided by the header of a file: where they fail, its samples are
not read. A file that is not 16-bit PCM, or ends early, gives one row with ``error``.
"""

from __future__ import annotations

import fnmatch
import operator
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)

from parlance.lineage import shared_dir
from parlance.sources import listing
from parlance.sources.named_files import opened, opens

SCHEMA = "path string, rate int, channels int, frames long, start long, samples array<smallint>, error string"
_ARROW = pa.schema(
    [("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("start", pa.int64()),
     ("samples", pa.list_(pa.int16())), ("error", pa.string())]
)
_PARTS = ["path", "size", "first", "last"]
RANGE_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: What is read before a batch goes on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1_000
_COMPARED = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda value, among: value in among, IsNotNull: lambda value, _: True,
}


@dataclass
class Ranges(InputPartition):
    """Parts of files for one task: (path, size of the file, first range, one beyond the last)."""

    value: tuple[tuple[str, int, int, int], ...]


@dataclass
class Listed(InputPartition):
    """The same as a Parquet file."""

    value: str


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    frames: int
    data: int


def read_header(file, size: int) -> Header | str:
    """The layout of an open wav file of ``size`` bytes, or what is wrong with it."""
    start = file.read_at(min(12, size), 0)
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        return "not a wav file"
    at, layout = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        body = at + 8
        if name == b"fmt " and length >= 16 and body + 16 <= size:
            layout = struct.unpack("<HHIIHH", file.read_at(16, body))
        elif name == b"data":
            if layout is None:
                return "data before format"
            kind, channels, rate, _, _, bits = layout
            if kind != 1 or bits != 16 or channels < 1:
                return "not 16-bit PCM"
            if body + length > size:
                return "truncated"
            return Header(rate, channels, length // (2 * channels), body)
        at = body + length + length % 2
    return "no data"


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.listing = options.get("listing")
        self.glob = options.get("pathglobfilter", "*.wav")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[tuple[str, type, object]] = []
        if self.range_bytes < 1 or self.task_bytes < 1:
            raise ValueError("rangeBytes and taskBytes must be positive")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for one in filters:
            if type(one) in _COMPARED and one.attribute in (("rate",), ("channels",)):
                self.tests.append((one.attribute[0], type(one), getattr(one, "value", None)))
            else:
                yield one

    def wanted(self, header: Header | str) -> bool:
        """Whether a file's rows pass; rows with an error have no rate and no channels."""
        if isinstance(header, str):
            return not self.tests
        return all(_COMPARED[kind](getattr(header, name), value) for name, kind, value in self.tests)

    def partitions(self) -> list[Ranges] | list[Listed]:
        if self.listing:
            system, root = opened(self.listing)
            files = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if posixpath.basename(i.path).startswith("part-"))
            return [Listed(path) for path in files] or [Ranges(())]
        system, root = opened(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such folder: {self.path}")
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(i.path), self.glob))
        tasks, parts, filled = [], [], 0
        each = max(1, self.task_bytes // self.range_bytes)
        for path, size in files:
            ranges = max(1, -(-size // self.range_bytes))
            for first in range(0, ranges, each):
                last = min(first + each, ranges)
                parts.append((path, size, first, last))
                # a file weighs something also when it is empty
                filled += min(size, (last - first) * self.range_bytes) + 4096
                if filled >= self.task_bytes:
                    tasks.append(Ranges(tuple(parts)))
                    parts, filled = [], 0
        return [*tasks, Ranges(tuple(parts))] if parts or not tasks else tasks

    def parts(self, partition: Ranges | Listed) -> Iterator[tuple[str, int, int, int]]:
        if isinstance(partition, Ranges):
            yield from partition.value
            return
        system, _ = opened(self.listing)
        with system.open_input_file(partition.value) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=_PARTS):
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def read(self, partition: Ranges | Listed) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += 0 if row[5] is None else row[5].nbytes
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, partition: Ranges | Listed) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, size, first, last in self.parts(partition):
            with system.open_input_file(path) as file:
                header = read_header(file, size)
                if not self.wanted(header):
                    continue
                if isinstance(header, str):
                    if first == 0:
                        yield path, None, None, None, None, None, header
                    continue
                width = 2 * header.channels
                for number in range(first, last):
                    begin, end = (min(max(0, -(-(n * self.range_bytes - header.data) // width)), header.frames) for n in (number, number + 1))
                    if begin < end or (number == 0 and header.frames == 0):
                        content = file.read_at((end - begin) * width, header.data + begin * width)
                        yield path, header.rate, header.channels, header.frames, begin, np.frombuffer(content, "<i2"), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WavRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})


def scan_ranges(spark: SparkSession, folder: str, pattern: str = "*.wav", range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every wav file under ``folder`` by ranges; filters on rate and channels reach the source."""
    spark.dataSource.register(WavRanges)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("wav_ranges").option("pathGlobFilter", pattern)
    if opens(shared_dir(spark)):  # else tasks cannot read the table
        source = source.option("listing", _ranges(spark, folder, pattern, range_bytes, task_bytes))
    return source.option("rangeBytes", range_bytes).option("taskBytes", task_bytes).load(folder)


def _ranges(spark: SparkSession, folder: str, pattern: str, range_bytes: int, task_bytes: int) -> str:
    """A folder of Parquet files with the parts of files for one task each."""
    files = listing.listed(spark, folder, lambda name, inner: inner or fnmatch.fnmatch(name, pattern))
    each = max(1, task_bytes // range_bytes)
    parts = files.withColumn("ranges", F.expr(f"greatest(1L, (size + {range_bytes - 1}L) div {range_bytes}L)")).select(
        "path", "size", "ranges", F.explode(F.expr(f"sequence(0L, ranges - 1, {each}L)")).alias("first")
    )
    parts = parts.select("path", "size", "first", F.expr(f"least(first + {each}L, ranges)").alias("last"))
    at = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    listing.spread(parts, f"least(size, (last - first) * {range_bytes}L)", task_bytes).write.parquet(at)
    return at
