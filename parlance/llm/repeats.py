"""Removal of byte strings that occur twice or more, by a suffix sort around chosen places.

A string of ``span`` bytes is represented by one of its own grams: the leftmost one with the
smallest hash. The choice depends on the string alone, so equal strings are represented by the same
gram at the same distance, and it is enough to compare the contexts (bytes left and right) of equal
grams. Of a text of any length about one place in 180 is chosen.

1. Equal texts are put together by their SHA-256; what follows sees every text once. A text of
   ``span`` bytes or more that occurs twice is removed whole, and still serves as a partner.
2. Grams that occur once in all texts are dropped. Contexts that are equal as a whole (by a 128-bit
   BLAKE2b digest) are counted; where there are two, all strings around the place are repeats.
3. What is left differs somewhere in its contexts; one place of each kind gets its bytes, and the
   suffix sort of ``suffixes`` finds how far each agrees with another one of its gram.
4. A gram with more than ``WIDE`` different contexts is not gathered: all strings of ``span`` bytes
   around its places are counted by hash over the cluster instead. No place is left out.

Texts are written once in buckets of their key, so both later reads of texts need no shuffle.

Defined results: a null text is empty; texts shorter than ``span`` are kept whole; repeated rows are
equal texts and so removed whole; a null id is kept; an empty table gives an empty result; other
columns are kept by ``without_repeats`` and not looked at otherwise.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import batch_of, discard, in_order, partitions_of, shared_folder, stored, table
from parlance.llm.registry import register
from parlance.llm.suffixes import shared

SPAN, GRAM = 400, 50
#: Different contexts of one gram that a task sorts; contexts in one batch of small groups.
WIDE, BATCH = 20_000, 8_192
_BASE, _POSITION = 0x9E3779B97F4A7C15 | 1, 24
_SEGMENT = 1 << 22
_M64 = (1 << 64) - 1


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base & _M64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a hash base and of its inverse, as long as the longest segment so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            self.up, self.down = _powers(base, 2 * size), _powers(pow(base, -1, 1 << 64), 2 * size)
        return self.up[:size], self.down[:size]


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def string_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every string of ``size`` bytes, from prefix polynomial hashes modulo 2^64."""
    n = len(raw)
    up, down = _POWERS.of(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return _mixed((prefix[size:] - prefix[:-size]) * down[: n + 1 - size])


def chosen(raw: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places that represent the strings of ``span`` bytes of a text, and the hashes of their grams."""
    wide, places, grams = span - gram + 1, [], []
    every = np.frombuffer(raw, np.uint8)
    for start in range(0, max(len(raw) - span + 1, 0), _SEGMENT):
        hashes = string_hashes(every[start : start + _SEGMENT + span - 1], gram)
        n = len(hashes)
        keyed = (hashes >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // wide)
        padded = np.full(blocks * wide, _M64, np.uint64)
        padded[:n] = keyed
        padded = padded.reshape(blocks, wide)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        places.append(at + start)
        grams.append(hashes[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(grams)[first].view(np.int64)


def key_of(text: str | Column = "text") -> Column:
    """128 bits of the SHA-256 of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, copies, text) stored in buckets of the key; copies meet in their input task first."""
    spark = docs.sparkSession
    name = f"llm_texts_{uuid.uuid4().hex}"
    every = docs.select(key_of().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    each = every.groupBy("key").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    writer = each.write.bucketBy(partitions_of(spark), "key").option("path", f"{shared_folder(spark)}/{name}")
    writer.option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # noqa: B018  resolved here; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    texts._stored_at = f"{shared_folder(spark)}/{name}"
    return texts


def places(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, pos, gram, ctx) of every chosen place: ctx is a digest of all bytes that matter around it."""
    schema = pa.schema([("key", pa.binary()), ("pos", pa.int64()), ("gram", pa.int64()), ("ctx", pa.binary())])
    reach = span - gram

    def run(batches):
        for batch in batches:
            keys, pos, grams, digests = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                at, hashes = chosen(raw, span, gram)
                for p in at.tolist():
                    low = max(p - reach, 0)
                    digests.append(hashlib.blake2b((p - low).to_bytes(4, "big") + raw[low : p + span], digest_size=16).digest())
                keys += [key] * len(at)
                pos.append(at)
                grams.append(hashes)
                if len(keys) > 1 << 16:
                    yield batch_of(schema, [keys, np.concatenate(pos), np.concatenate(grams), digests])
                    keys, pos, grams, digests = [], [], [], []
            if keys:
                yield batch_of(schema, [keys, np.concatenate(pos), np.concatenate(grams), digests])

    return texts.select("key", "text").filter(F.octet_length("text") >= span).mapInArrow(run, "key binary, pos long, gram long, ctx binary")


def contexts(texts: DataFrame, kinds: DataFrame, span: int, gram: int) -> DataFrame:
    """(gram, wide, alone, key, pos, left, right): the bytes of one place of each kind of context."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("pos", "gram", "wide", "alone")).alias("picks"))
    schema = pa.schema(
        [("gram", pa.int64()), ("wide", pa.bool_()), ("alone", pa.bool_()), ("key", pa.binary()), ("pos", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]
    )
    reach = span - gram

    def run(batches):
        for batch in batches:
            for key, text, picks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, at = text.encode(), [p["pos"] for p in picks]
                yield batch_of(
                    schema,
                    [
                        [p["gram"] for p in picks], [p["wide"] for p in picks], [p["alone"] for p in picks], [key] * len(at), at,
                        [raw[max(p - reach, 0) : p] for p in at], [raw[p : p + span] for p in at],
                    ],
                )

    return (
        texts.select("key", "text").join(wanted.hint("shuffle_hash"), "key")
        .mapInArrow(run, "gram long, wide boolean, alone boolean, key binary, pos long, left binary, right binary")
    )


_STRETCH = pa.schema([("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def sorted_groups(groups: DataFrame, span: int) -> DataFrame:
    """(key, a, b): stretches around the places of grams that one task can sort."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            every = pa.Table.from_batches(held).combine_chunks()
            grams = every["gram"].to_numpy()
            inner = np.flatnonzero(grams != grams[-1])
            if len(inner):
                cut = int(inner[-1]) + 1
                yield every.slice(0, cut)
                held = every.slice(cut).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for group in whole_groups(batches):
            grams = group["gram"].to_numpy()
            number = np.cumsum(np.concatenate(([False], grams[1:] != grams[:-1])))
            left, right, found = shared(number, group["left"].to_pylist(), group["right"].to_pylist(), span)
            rows = np.flatnonzero(found & group["alone"].to_numpy())
            pos = group["pos"].to_numpy()[rows]
            yield batch_of(_STRETCH, [group["key"].combine_chunks().take(pa.array(rows)), pos - left[rows], pos + right[rows]])

    parts = partitions_of(groups.sparkSession)
    return in_order(["gram"], parts, groups.select("gram", "alone", "key", "pos", "left", "right")).mapInArrow(run, "key binary, a long, b long")


def counted_strings(groups: DataFrame, span: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, a, b): the same for grams with very many contexts, by counts of all their strings.

    Also gives the tables behind it.
    """
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.binary()), ("pos", pa.int64()), ("at", pa.int64()), ("alone", pa.bool_())])

    def run(batches):
        for batch in batches:
            of = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "pos", "alone", "left", "right")}
            for key, pos, alone, left, right in zip(*of.values(), strict=True):
                raw = np.frombuffer(left + right, np.uint8)
                if len(raw) < span:
                    continue
                one, two = string_hashes(raw, span), string_hashes(raw[::-1], span)[::-1]  # both directions: 128 bits
                n = len(one)
                at = pos - len(left) + np.arange(n)
                yield batch_of(schema, [one.view(np.int64), np.ascontiguousarray(two).view(np.int64), [key] * n, [pos] * n, at, [alone] * n])

    strings = stored(groups.mapInArrow(run, "h1 long, h2 long, key binary, pos long, at long, alone boolean"), "strings")
    # a string may hold several of the grams and so come several times from one place
    place = F.struct("key", "at")
    many = strings.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("h1", "h2")
    # read back from files, so that the join meets plain shuffles and a string of very many places can be split
    many = stored(many, "repeated-strings")
    hit = strings.filter("alone").join(many, ["h1", "h2"], "left_semi")
    found = hit.groupBy("key", "pos").agg(F.min("at").alias("a"), (F.max("at") + span).alias("b")).select("key", "a", "b")
    return found, [strings, many]


def stretches(texts: DataFrame, span: int = SPAN, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(key, spans array<struct<a,b>>): stretches of each text that repeats cover; they may overlap."""
    every = stored(places(texts, span, gram), "places")
    # counts are stored before they are joined back: between plain shuffles a very frequent gram can be split
    grams = stored(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    twice = stored(every.join(grams, "gram"), "twice")
    discard(every, grams)
    kinds = twice.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("of"))
    kinds = stored(kinds, "kinds")
    whole = twice.join(kinds.filter("n > 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select(
        "key", F.greatest(F.col("pos") - (span - gram), F.lit(0)).alias("a"), (F.col("pos") + span).alias("b")
    )
    mixed = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed")
    picks = kinds.join(mixed, "gram").select("gram", (F.col("kinds") > wide).alias("wide"), (F.col("n") == 1).alias("alone"), "of.key", "of.pos")
    around = stored(contexts(texts, picks, span, gram), "contexts")
    counted, behind = counted_strings(around.filter("wide"), span)
    found = whole.unionAll(sorted_groups(around.filter("not wide"), span)).unionAll(counted)
    spans = stored(found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "stretches")
    discard(twice, kinds, mixed, around, *behind)
    return spans


def merged(spans: list | None, size: int, copies: int, span: int = SPAN) -> list[tuple[int, int]]:
    """Removed runs of a text, in order, apart from each other."""
    if copies > 1 and size >= span:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], min(s["b"], size)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed_runs(docs: DataFrame, span: int = SPAN, gram: int = GRAM, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of ``docs`` (key, copies, text) and their stretches (key, spans)."""
    texts = distinct_texts(docs)
    return texts, stretches(texts, span, gram, wide)


def cut_texts(docs: DataFrame, span: int = SPAN, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every distinct text of ``docs``."""
    return _cut(removed_runs(docs, span, gram, wide), span, "kept binary", lambda kept: kept)


def _cut(found: tuple[DataFrame, DataFrame], span: int, column: str, of) -> DataFrame:
    texts, spans = found
    kind = pa.binary() if column.endswith("binary") else pa.string()
    names = ["key", "n_bytes", "n_removed", "n_spans", column.split()[0]]

    def run(batches):
        for batch in batches:
            sizes, gone, count, out = [], [], [], []
            for copies, text, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = text.encode()
                runs = merged(found, len(raw), copies, span)
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                out.append(of(without(raw, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, gone, count)), pa.array(out, kind)], names=names
            )

    joined = texts.select("key", "copies", "text").join(spans.hint("shuffle_hash"), "key", "left")
    return joined.mapInArrow(run, f"key binary, n_bytes long, n_removed long, n_spans long, {column}")


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """``docs`` with the kept bytes as text; bytes of a character that was cut through go with it.

    A null text stays null.
    """
    found = removed_runs(docs, span, gram, wide)
    kept = _cut(found, span, "_kept string", lambda raw: raw.decode("utf-8", "ignore"))
    changed = stored(kept.filter("n_removed > 0").select("key", "_kept"), "changed")
    discard(*found)
    # the given columns stay in a struct, so that none of them meets the two of this join
    joined = docs.select(F.struct("*").alias("doc"), key_of().alias("key")).join(changed, "key", "left")
    return joined.select(*(F.coalesce("_kept", "doc.text").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = removed_runs(docs)
    digests = stored(_cut(found, SPAN, "kept_sha256 string", lambda raw: hashlib.sha256(raw).hexdigest()), "digests")
    discard(*found)
    return docs.select("doc_id", key_of().alias("key")).join(digests, "key").drop("key")
