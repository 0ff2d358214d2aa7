"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in few bits agree in some pair of four 16-bit blocks, so each distinct
fingerprint is dealt to six keys of 32 bits. A key with many fingerprints is dealt on to six keys
of 48 bits each; with 48 bits given, a group has 65,536 fingerprints at most, whatever the input.
Inside a task the groups are sorted by Gray rank. Nodes over 16 neighbours hold the bits that all
of them share; what a node shares is left out of its children, so differences add up on the way
down and a whole group is left as soon as its shared bits differ too much. Links of one task are
reduced to spanning ones before they leave it.

Equal fingerprints are one row of the index, so exact copies cost nothing. Defined results: null
and empty texts have fingerprint zero, which links like any other; a null id joins the component of
its fingerprint; repeated rows give repeated results; a component of null ids alone has a null id;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import batch_of, in_order, partitions_of, rows_of, stored, table
from parlance.llm.components import components, spanning
from parlance.llm.registry import register

SEED, WORDS, BITS = 42, 3, 2
#: Children per node; queries that walk down together; rows of a key beyond which it is dealt on.
FAN, WALK, WIDE = 16, 256, 512
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), _CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans[at : at + _CHUNK]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for keys, texts in rows_of(batches, "doc_id", "text"):
            fps = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield batch_of(schema, [keys, fps])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over codes in (group, Gray rank) order; walks give pairs of one group within ``bits``."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), groups))
        self.groups, self.codes = groups[self.order], codes[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        # a level holds, for each node: bits shared by all below it, their values, first and last group, last row
        level = (np.full(len(codes), full), self.codes, self.groups, self.groups, np.arange(len(codes)))
        self.levels = [level]
        while len(level[0]) > 1:
            mask, value, low, high, last = level
            at = np.arange(0, len(mask), FAN)
            either, every = np.bitwise_or.reduceat(value, at), np.bitwise_and.reduceat(value, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(either ^ every)
            ends = np.minimum(at + FAN, len(mask)) - 1
            level = (shared, every & shared, low[at], high[ends], last[ends])
            self.levels.append(level)

    def pairs(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (in sorted order) i < j of one group that differ in ``bits`` bits at most."""
        top = self.levels[-1]
        for begin in range(0, len(self.codes), WALK):
            query = np.arange(begin, min(begin + WALK, len(self.codes)))
            node = np.zeros(len(query), np.int64)
            differ = np.bitwise_count((self.codes[query] ^ top[1][0]) & top[0][0]).astype(np.int64)
            for depth in range(len(self.levels) - 1, 0, -1):
                above, (mask, value, low, high, last) = self.levels[depth][0], self.levels[depth - 1]
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, differ, given = np.repeat(query, FAN), np.repeat(differ, FAN), np.repeat(above[node], FAN)
                there = child < len(mask)
                query, differ, given, child = query[there], differ[there], given[there], child[there]
                group = self.groups[query]
                near = (last[child] > query) & (low[child] <= group) & (group <= high[child])
                query, differ, given, child = query[near], differ[near], given[near], child[near]
                differ = differ + np.bitwise_count((self.codes[query] ^ value[child]) & mask[child] & ~given)
                close = differ <= bits
                query, differ, node = query[close], differ[close], child[close]
            yield query[node > query], node[node > query]


def _blocks(of: str, width: int) -> list[str]:
    return [f"(shiftrightunsigned({of}, {s}) & {(1 << width) - 1})" for s in range(0, 64, width)]


def _keys(bits: int) -> DataFrame:
    if bits > 2:
        raise ValueError("four blocks of 16 bits serve differences of two bits at most")
    b = _blocks("fp", 16)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.expr("array(" + ",".join(f"(cast({c} as bigint) << 32) | ({b[i]} << 16) | {b[j]}" for c, (i, j) in enumerate(pairs)) + ")")


def _finer_keys() -> DataFrame:
    """Keys of 48 bits: the 32 of the key at hand, and two of the four bytes that it leaves."""
    b = _blocks("fp", 8)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    cases = []
    for c, (i, j) in enumerate(pairs):
        rest = [b[2 * k + h] for k in range(4) if k not in (i, j) for h in (0, 1)]
        subs = ",".join(
            f"(1L << 62) | (cast({s} as bigint) << 52) | (({rest[x]} << 8 | {rest[y]}) << 36) | 0L" for s, (x, y) in enumerate(pairs)
        )
        cases.append(f"when {c} then array({subs})")
    return F.expr("case shiftrightunsigned(key, 32) " + " ".join(cases) + " end")


def near_links(codes: DataFrame, bits: int = BITS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of ``codes`` (fp)."""
    keyed = stored(codes.select("fp", F.explode(_keys(bits)).alias("key")), "keys")
    # stored before it is joined back: between plain shuffles a crowded key can be split
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-keys")
    crowded = keyed.join(shared, "key")
    few = crowded.filter(F.col("n") <= WIDE).select(F.col("key").alias("k1"), F.lit(0).cast("long").alias("k2"), "fp")
    many = crowded.filter(F.col("n") > WIDE).select(F.col("key").alias("k1"), F.explode(_finer_keys()).alias("k2"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            rows += batch.num_rows
            if rows < _CHUNK:
                continue
            every = np.concatenate(held, axis=1)
            last = (every[0] == every[0, -1]) & (every[1] == every[1, -1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held, rows = [every[:, cut:]], every.shape[1] - cut
            if cut:
                yield links(every[:, :cut])
        if rows:
            yield links(np.concatenate(held, axis=1))

    def links(every: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])))
        index = GrayIndex(np.cumsum(new) - 1, every[2].view(np.uint64))
        codes, place = np.unique(index.codes.view(np.int64), return_inverse=True)
        root = np.arange(len(codes))
        left, right, waiting = [], [], 0
        for i, j in index.pairs(bits):
            left.append(place[i])
            right.append(place[j])
            waiting += len(i)
            if waiting > 1 << 20:
                root = spanning(len(codes), np.concatenate([*left, np.arange(len(codes))]), np.concatenate([*right, root]))
                left, right, waiting = [], [], 0
        root = spanning(len(codes), np.concatenate([*left, np.arange(len(codes))]), np.concatenate([*right, root]))
        linked = root != np.arange(len(codes))
        return batch_of(schema, [codes[linked], codes[root[linked]]])

    parts = partitions_of(codes.sparkSession)
    return in_order(["k1", "k2"], parts, few.unionAll(many)).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of ``bits`` bits."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "codes")
    roots = stored(components(near_links(codes.select("fp"), bits)), "roots").withColumnRenamed("node", "fp")
    linked = codes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_code = codes.join(roots.join(least, "root").select("fp", "component_id", F.lit(True).alias("linked")), "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")
    )
    return prints.join(stored(of_code, "classes"), "fp")


@register("op8_simhash_gray")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
