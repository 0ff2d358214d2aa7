"""Best-fit packing of tokenised documents with certified partitions.

A document of more than a window of tokens gives whole windows and one shorter piece, which comes
first. Whole windows are sequences of their own. The shorter pieces are dealt into partitions of
about ``ITEMS`` pieces by a hash of their row, so no id, text or length is a hot key, and every
partition is packed by best-fit decreasing in its own task.

Dual feasible functions certify a partition: each maps lengths so that no window holds more than
one in all, so the sum over the pieces, rounded up, is a number of windows that no packing can go
below. A partition whose packing meets its bound is settled. Partitions with a gap form small
groups, exchange their pieces inside the group by another hash, and are packed anew; a group keeps
the new packing if it needs fewer windows. After ``EXCHANGES`` rounds the best packing found stays,
and ``bins`` and ``bound`` say how far it may be from the least.

Ids come from the rank file of the same vocabulary, which is faster than the tokenizer and gives the
same ids; the tests hold one against the other. Cuts of long texts are those of ``bpe``.

Defined results: a null text is empty and has the closing id only; null ids and repeated rows are
rows of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe
from parlance.llm.common import discard, stored, table
from parlance.llm.registry import register

RANKS, CLOSING, WINDOW = "byte_bpe_50k.tiktoken", 2, 1024
#: Fixed value: the one string that the tokenizer takes for an id of its own.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces a partition, rounds of exchange, and the dual feasible functions that count multiples.
ITEMS, EXCHANGES, MULTIPLES = 50_000, 4, 24


def token_ids(enc, text: str) -> np.ndarray:
    """The ids of a whole text."""
    if SPECIAL in text:
        apart = [np.array([SPECIAL_ID], np.uint32)]
        return np.concatenate([ids for part in text.split(SPECIAL) for ids in (*apart, token_ids(enc, part))][1:])
    if len(text) <= bpe.CUT:
        return enc.encode_to_numpy(text)
    return np.concatenate([enc.encode_to_numpy(c) if len(c) <= bpe.RUN else np.array(bpe.encode(enc, c), np.uint32) for c in bpe.cuts(text)])


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, closing: int = CLOSING, key: str = "doc_id") -> DataFrame:
    """(key, item, piece, start, length, ids_crc32, whole, ids) of every piece.

    item numbers the rows of ``docs``, whole the pieces that fill a window; both are unique over all
    tasks. ids are little-endian and of four bytes.
    """
    path = path or public_tokenizers.path(RANKS)
    names = [key, "item", "piece", "start", "length", "ids_crc32", "whole", "ids"]

    def run(batches):
        enc, end = bpe.encoding(path), np.array([closing], np.uint32)
        item = whole = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((token_ids(enc, text or ""), end)).astype("<u4")
                first = len(ids) % window or window
                for piece, start in enumerate([0, *range(first, len(ids), window)]):
                    part = ids[start : first + piece * window].tobytes()
                    full = len(part) == 4 * window
                    owner.append(at)
                    rows.append((item, piece, start, len(part) // 4, zlib.crc32(part), whole if full else None, part))
                    whole += full
                item += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, item long, piece int, start long, length long, ids_crc32 long, whole long, ids binary")


def lower_bound(counts: np.ndarray, window: int = WINDOW) -> int:
    """Windows that no packing of ``counts[length]`` pieces can go below.

    The functions are the identity and, for k up to ``MULTIPLES``, the one that rounds (k + 1) x down
    to k-ths, each after every one that takes lengths above ``window - e`` for a whole window and
    those below e for nothing. Sums are whole numbers, so the bound is exact.
    """
    counts = counts.astype(np.int64)
    lengths = np.arange(window + 1)
    edge = np.arange(window // 2 + 1)
    above = counts.sum() - np.cumsum(counts)[window - edge]
    best = 0
    for k in range(MULTIPLES + 1):
        scale = max(k, 1) * window
        times = (k + 1) * lengths
        value = lengths if k == 0 else np.where(times % window == 0, k * lengths, times // window * window)
        upto = np.concatenate(([0], np.cumsum(value * counts)))
        sums = scale * above + upto[window - edge + 1] - upto[edge]
        best = max(best, int(-(-sums.max() // scale)))
    return best


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins; ``lengths`` falls and is at most ``window``.

    Pieces of one length are placed together: bins are taken by how little is left in them, and each
    is filled until no further piece of the length fits, which is what piece by piece would give.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(window + 1)]
    many = np.zeros(window + 1, np.int64)
    opened = at = 0
    while at < len(lengths):
        size = int(lengths[at])
        stop = int(np.searchsorted(-lengths, -size, "right"))
        for room in [*(np.flatnonzero(many[size:]) + size).tolist(), None]:
            fits = (window if room is None else room) // size
            need = -(-(stop - at) // fits)
            if room is None:
                chosen, room = list(range(opened, opened + need)), window
                opened += need
            else:
                need = min(need, int(many[room]))
                chosen = left[room][-need:]
                del left[room][-need:]
                many[room] -= need
            placed = min(need * fits, stop - at)
            bins[at : at + placed] = np.repeat(chosen, fits)[:placed]
            offsets[at : at + placed] = window - room + size * np.tile(np.arange(fits), need)[:placed]
            last = placed - (need - 1) * fits
            for some, rest in ((chosen[:-1], room - fits * size), (chosen[-1:], room - last * size)):
                left[rest] += some
                many[rest] += len(some)
            at += placed
            if at == stop:
                break
    return bins, offsets, opened


_PACKED = "item long, length long, part long, bin long, offset long, bins long, bound long"


def packed(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, length, part, bin, offset, bins, bound) of items (item, length, part), a task a part."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("item", "ascending")])
        lengths = part["length"].to_numpy()
        bins, offsets, opened = best_fit_decreasing(lengths, window)
        bound = lower_bound(np.bincount(lengths, minlength=window + 1), window)
        same = [pa.array(np.full(len(lengths), v)) for v in (opened, bound)]
        return pa.table([part["item"], part["length"], part["part"], pa.array(bins), pa.array(offsets), *same], names=[f.split()[0] for f in _PACKED.split(", ")])

    return items.select("item", "length", "part").groupBy("part").applyInArrow(run, _PACKED)


def exchanged(open_: DataFrame, turn: int, gaps: int) -> DataFrame:
    """Items of partitions with a gap, dealt anew inside small groups (grp, before) of partitions."""
    parts = open_.select("part", "bins").distinct().withColumn("grp", F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(max(1, gaps // 2))))
    groups = parts.groupBy("grp").agg(F.sort_array(F.collect_list("part")).alias("members"), F.sum("bins").alias("before"))
    met = open_.join(parts.select("part", "grp"), "part").join(groups, "grp")
    to = F.pmod(F.xxhash64("item", F.lit(turn)), F.size("members")).cast("int")
    return met.select("item", "length", F.get("members", to).alias("to"), "part", "grp", "before")


def certified(items: DataFrame, window: int = WINDOW, exchanges: int = EXCHANGES) -> DataFrame:
    """The packing of items (item, length, part) after all exchanges."""
    open_, settled = stored(packed(items, window), "packed"), []
    for turn in range(1, exchanges + 1):
        settled.append(open_.filter("bins = bound"))
        open_ = open_.filter("bins > bound")
        gaps = open_.select("part").distinct().count()
        if gaps < 2:
            break
        dealt = stored(exchanged(open_, turn, gaps), "dealt")
        anew = stored(packed(dealt.select("item", "length", F.col("to").alias("part")), window), "packed-anew")
        after = anew.select("part", "bins").distinct().join(dealt.select(F.col("to").alias("part"), "grp", "before").distinct(), "part")
        better = stored(after.groupBy("grp").agg(F.sum("bins").alias("after"), F.first("before").alias("before")).filter("after < before"), "better")
        groups = dealt.select("part", "grp").distinct()
        gained = groups.join(better, "grp", "left_semi").select("part")
        taken = anew.join(gained, "part", "left_semi")
        open_ = stored(taken.unionByName(open_.join(gained, "part", "left_anti")), "packed")
        discard(dealt, anew, better)
    settled.append(open_)
    out = settled[0]
    for frame in settled[1:]:
        out = out.unionByName(frame)
    return out


def pack_best_fit(docs: DataFrame, window: int = WINDOW, path: str | None = None, key: str = "doc_id", items: int = ITEMS) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, bins, bound, ids) of every piece.

    bins and bound are those of the piece's partition, null for whole windows.
    """
    cut = stored(pieces(docs, window, path, key=key), "pieces")
    short = cut.filter(F.col("length") < window)
    parts = max(1, -(-short.count() // items))
    dealt = short.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("long").alias("part"))
    places = certified(dealt, window).select(
        "item", (F.shiftleft("part", 32) + F.col("bin")).alias("sequence_id"), "offset", "bins", "bound"
    )
    nothing = F.lit(None).cast("long")
    whole = cut.filter(F.col("length") == window).select(
        "*", (-1 - F.col("whole")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), nothing.alias("bins"), nothing.alias("bound")
    )
    every = short.join(places, "item").unionByName(whole)
    return every.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound", "ids")


@register("op11_best_fit_certified")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents")).drop("ids")
