"""Packing of tokenised documents into windows of fixed length.

A document gives whole windows of its own and one rest shorter than a window. The histogram of
rests has as many bins as a window has tokens, whatever the input, and is all that the driver sees.
Combinations of two and three rest lengths (and repeats of one) that fill a window are enumerated,
non-negative least squares finds how often each should be used to match the histogram, the counts
are rounded and cut to what is there, and combinations that still fit are taken greedily. What is
left is laid end to end and cut at window bounds; its last part is cut into powers of two, which
need no padding.

Every piece then finds its place by arithmetic: the rank of a document among those of equal rest,
counted inside buckets of a hash so that no length is one task's work, leads to a run of windows.

Defined results: a null text is empty and has the closing id only; repeated rows are packed each; a
null id is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from parlance.llm.common import stored, table
from parlance.llm.registry import register

VOCABULARY, CLOSING, WINDOW = "word_bpe_49k.json", 1, 2048
#: Buckets of one rest length; a third member of a combination is a multiple of STEP; solver rounds.
BUCKETS, STEP, ROUNDS = 64, 16, 120
#: Chunks a generation remembers and the longest of them; characters and new chunks that are worked on together.
REMEMBERED, LONGEST, PART, TOGETHER = 300_000, 48, 4_000_000, 4_096


class _Chunks:
    """Ids of the chunks between blanks; blanks part words, so a chunk's ids do not depend on its neighbours.

    Chunks are remembered in two generations: when the newer one is full it becomes the older, and
    chunks that are met again move over. A new chunk that is one Latin word, perhaps with a mark
    behind it, is merged by the ranks of the tokenizer's own vocabulary (the end of a word is a byte
    that no text has); the tests hold this against the tokenizer. All other new chunks of a part go
    to the tokenizer in one call, joined by blanks, and are told apart by the places of the ids.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = _dtype(self.tokenizer)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.merged = _word_merger(path)
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, self.dtype).tobytes() for m in _MARKS}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= PART:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()  # each distinct chunk of a part is looked up once
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        long = self._learn(chunks)
        ids = list(map(self.known.__getitem__, chunks))
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        firsts, counts = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.repeat(firsts[codes] - ends[:-1], counts) + np.arange(ends[-1])
        every = np.frombuffer(b"".join(ids), self.dtype)[places].tobytes()
        bounds = (ends[split.offsets.to_numpy()] * width).tolist()
        for chunk in long:
            self.known.pop(chunk, None)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        return [every[begin:end] for begin, end in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, seen: list[str]) -> list[str]:
        known, older, merged, code, marks = self.known, self.older, self.merged, self.code, self.marks
        rest, long = [], []
        for chunk in [c for c in seen if c not in known]:
            ids = older.get(chunk)
            if ids is None:
                found = _LATIN_WORD.fullmatch(chunk)
                if found and merged:
                    ids = array(code, merged(found[1].lower().encode() + _WORD_END)).tobytes() + marks[found[2]]
                else:
                    rest.append(chunk)
                if len(chunk) > LONGEST:
                    long.append(chunk)
            known[chunk] = ids
        for at in range(0, len(rest), TOGETHER):
            self._ask(rest[at : at + TOGETHER])
        return long

    def _ask(self, chunks: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype).tobytes()
        starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        places = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        ends = np.searchsorted(places, starts[1:]) * self.dtype.itemsize
        first = 0
        for chunk, end in zip(chunks, ends.tolist(), strict=True):
            self.known[chunk] = ids[first:end]
            first = end


#: Letters that no normal form changes and whose lower case is one letter, and marks that stand alone.
_MARKS = ("", ".", ",", "!", "?", ";", ":")
_LATIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,!?;:]?)")
_WORD_END = b"\xff"


def _word_merger(path: str):
    """Byte pairs of one word, its end as a last byte, merged by rank; None if the vocabulary is of another kind."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix = model.get("end_of_word_suffix")
    if not suffix or model.get("continuing_subword_prefix"):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {}
    for token, rank in model["vocab"].items():
        ends = token.endswith(suffix) and len(token) > len(suffix)
        body = token[: -len(suffix)] if ends else token
        if all(c in byte_of for c in body):
            ranks[bytes(byte_of[c] for c in body) + (_WORD_END if ends else b"")] = rank
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _dtype(tokenizer: Tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


@functools.cache
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def tokens(docs: DataFrame, path: str | None = None, closing: int = CLOSING, key: str = "doc_id") -> DataFrame:
    """(key, n, ids binary) of every row: little-endian ids of two bytes (four for large vocabularies), the closing id last."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        chunks = _chunks(path)
        width, end = chunks.dtype.itemsize, np.array([closing], chunks.dtype).tobytes()
        for batch in batches:
            ids = [i + end for i in chunks.encode([t or "" for t in batch.column(1).to_pylist()])]
            n = pa.array([len(i) // width for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary())], names=[key, "n", "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n long, ids binary")


def combinations(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of three rest lengths that fill a window, from the lengths that occur; 0 pads pairs."""
    there = np.flatnonzero(counts[1:]) + 1
    a = there[there <= window // 2]
    pairs = np.stack([window - a, a, np.zeros_like(a)], axis=1)
    every = [pairs[counts[pairs[:, 0]] > 0]]
    for c in there[(there % STEP == 0) & (there * 3 <= window)].tolist():
        b = there[(there >= c) & (2 * there <= window - c)]
        b = b[counts[window - c - b] > 0]
        every.append(np.stack([window - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(every)


def repeat_counts(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by multiplicative steps."""
    members = combos.ravel()
    target = counts.astype(float).copy()
    target[0] = 0.0
    gather = lambda w: np.where(combos > 0, w[combos], 0.0).sum(axis=1)
    above = gather(target)
    x = above / max(gather(np.bincount(members, minlength=len(counts)).astype(float)).max(initial=1.0), 1.0)
    for _ in range(rounds):
        used = np.bincount(members, np.repeat(x, 3), len(counts))
        used[0] = 0.0
        x = x * above / np.maximum(gather(used), 1e-12)
    return x


@dataclass
class Plan:
    """Runs of windows for each rest length, then one line of what is left, then whole windows."""

    window: int
    first: np.ndarray  # first run of each length, and one beyond the last
    rank: np.ndarray  # first rank of a run
    sequence: np.ndarray
    offset: np.ndarray
    placed: np.ndarray  # documents of a length that are in runs
    line: np.ndarray  # where a length begins on the line
    line_sequence: int
    bounds: np.ndarray  # cuts of the line beyond its last whole window
    whole: int  # first sequence of whole windows

    def pieces(self, rest: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of one rest."""
        if rest == 0:
            return []
        if rank < self.placed[rest]:
            low, high = self.first[rest], self.first[rest + 1]
            run = low + int(np.searchsorted(self.rank[low:high], rank, "right")) - 1
            return [(0, rest, int(self.sequence[run] + rank - self.rank[run]), int(self.offset[run]))]
        begin = int(self.line[rest] + (rank - self.placed[rest]) * rest)
        out, at, end = [], begin, begin + rest
        while at < end:
            if at < self.bounds[0]:
                number, edge = at // self.window, at - at % self.window
                upto = edge + self.window
            else:
                k = int(np.searchsorted(self.bounds, at, "right")) - 1
                number, edge, upto = int(self.bounds[0]) // self.window + k, int(self.bounds[k]), int(self.bounds[k + 1])
            stop = min(end, upto)
            out.append((at - begin, stop - at, self.line_sequence + number, at - edge))
            at = stop
        return out


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """Where rests go, from the number of documents of each rest length (index 0: no rest)."""
    left = counts.astype(np.int64).copy()
    combos = combinations(counts, window)
    wanted = repeat_counts(combos, counts) if len(combos) else np.zeros(0)
    runs: list[tuple[int, int, int, int]] = []  # length, rank, sequence, offset
    sequence = 0

    def take(members: list[int], most: int) -> None:
        nonlocal sequence
        n = min(most, *(int(left[m]) // members.count(m) for m in members))
        if n > 0:
            offset = 0
            for m in members:
                runs.append((m, int(counts[m] - left[m]), sequence, offset))
                left[m] -= n
                offset += m
            sequence += n

    order = np.argsort(-wanted, kind="stable")
    members = [[m for m in row if m] for row in combos[order].tolist()]
    for row, x in zip(members, wanted[order].tolist(), strict=True):
        take(row, int(x + 0.5))
    power = window // 2
    while power:
        take([power] * (window // power), int(left[power]))
        power //= 2
    for row in members:
        take(row, int(left[row[0]]))
    runs.sort()
    table_ = np.array(runs, np.int64).reshape(-1, 4)
    lengths = np.arange(window)
    spans = left * lengths
    line = np.concatenate(([0], np.cumsum(spans)[:-1]))
    total = int(spans.sum())
    tail, bounds = total % window, [total - total % window]
    while tail:
        bounds.append(bounds[-1] + (1 << (tail.bit_length() - 1)))
        tail -= bounds[-1] - bounds[-2]
    return Plan(
        window, np.searchsorted(table_[:, 0], np.arange(window + 1)), table_[:, 1], table_[:, 2], table_[:, 3], counts - left, line,
        sequence, np.array(bounds, np.int64), sequence + total // window + len(bounds) - 1,
    )


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """One row for each piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)."""
    encoded = stored(tokens(docs, path, key=key), "tokens").withColumns(
        {"rest": F.col("n") % window, "whole": F.floor(F.col("n") / window), "bucket": F.pmod(F.xxhash64(key, "n"), F.lit(BUCKETS))}
    )
    sizes = stored(encoded.groupBy("rest", "bucket").agg(F.count("*").alias("docs"), F.sum("whole").alias("wholes")), "rests")
    counts, wholes = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for row in sizes.groupBy("rest").agg(F.sum("docs").alias("docs"), F.sum("wholes").alias("wholes")).collect():  # a row a length
        counts[row.rest], wholes[row.rest] = row.docs, row.wholes
    made = plan(counts, window)
    whole_first = made.whole + np.concatenate(([0], np.cumsum(wholes)[:-1]))
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "rest", "bucket", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("wholes").over(before), F.lit(0)).alias("whole0")
    )
    inside = Window.partitionBy("rest", "bucket").orderBy(key, "n")
    ranked = encoded.withColumn("rank", F.row_number().over(inside) - 1).withColumn(
        "wholes", F.sum("whole").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")
    )
    # at most window * BUCKETS rows, whatever the input
    placed = ranked.join(F.broadcast(starts), ["rest", "bucket"]).select(
        key, "n", "ids", "rest", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("wholes") + F.col("whole0")).alias("wholes")
    )
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    narrow = _dtype(Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY)))

    def run(batches):
        for batch in batches:
            n, ids, rest, rank, wholes_ = (batch.column(i).to_pylist() for i in range(1, 6))
            owner, rows, cut = [], [], []
            for i in range(batch.num_rows):
                count = n[i] // window
                first = int(whole_first[rest[i]]) + wholes_[i]
                pieces = [(k * window, window, first + k, 0) for k in range(count)]
                pieces += [(count * window + s, size, seq, off) for s, size, seq, off in made.pieces(rest[i], rank[i])]
                every = np.frombuffer(ids[i], narrow).astype("<u4").tobytes()
                for start, size, seq, off in pieces:
                    part = every[4 * start : 4 * (start + size)]
                    owner.append(i)
                    rows.append((start, size, zlib.crc32(part), n[i], seq, off))
                    cut.append(part)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns), pa.array(cut, pa.binary())], names=names
            )

    longs = ", ".join(f"{c} long" for c in names[1:7])
    return placed.mapInArrow(run, f"{key} {kind}, {longs}, ids binary")


@register("op6_pack_least_squares")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
