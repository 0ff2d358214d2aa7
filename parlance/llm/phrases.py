"""Phrases of two to four words that occur together, by dynamic itemset counting.

Texts become blocks of word codes once, and the blocks are dealt into ``SHARDS`` shards. Each step
scans the next shard, in cycles, and counts phrases of all lengths at once. Words are counted from
the first step on. A longer phrase is counted from the step after both of its subphrases (all words
but the last, all but the first) have reached the least frequency, also while those are still being
counted, and until its own cycle through all shards is over; its count is then exact. Counting
ends when no phrase has a shard left.

Which phrases have reached it is a table of ``SLOTS`` bytes, whatever the input: a phrase hashes to a
slot, which holds the step from which on it may carry longer ones. Two phrases in one slot only make
some longer phrase be counted without need; counts are exact. A counted phrase is named by its length and 112
bits made of the 128-bit XXH3 digests of its words in its language, and goes with the number of one of its
blocks; only phrases that are frequent in the end are spelled, from those blocks. So counters are rows of
four numbers. Counts of a shard are added up in each task before the shuffle, so a frequent
phrase costs a row a task. A word has no group of its own anywhere but in sums and joins with unique rows.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; an empty
table, or one without frequent phrases, gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import discard, shared_folder, stored, table
from parlance.llm.registry import register

LEAST, LONGEST, TOP = 30, 4, 2000
SHARDS, SLOTS = 2, 1 << 25
#: Bytes of text that make a block, and the step that stands for "not reached".
BLOCK, NEVER = 4_000_000, 255
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_BREAK = regex.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_BUCKET = 32_768  # bits of one bitmap of Spark


def _coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words, the first one standing for a break, and the texts as codes of words; breaks part texts too."""
    # the first word is the break; Arrow codes words by their first place
    joined = b"\n " + b"\n".join(texts).lower().translate(_TABLE).replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()[1:].astype(np.uint32)
    if b"" in words:
        codes = codes[codes != words.index(b"")]
    return words, codes


_BLOCKS = "lang string, block long, n long, words array<binary>, prints binary, codes binary"


def blocks(docs: DataFrame, shards: int = SHARDS, size: int = BLOCK) -> DataFrame:
    """(shard, lang, block, n, words, prints, codes): texts of one language as codes; blocks go to the shards in turn.

    ``block`` numbers the blocks, ``n`` counts their words, ``prints`` has 128 bits for each of ``words``.
    """
    kinds = {"lang": pa.string(), "block": pa.int64(), "n": pa.int64(), "words": pa.list_(pa.binary()), "prints": pa.binary(), "codes": pa.binary()}
    schema = pa.schema([("shard", pa.int32()), *kinds.items()])

    def run(batches):
        turn = task = TaskContext.get().partitionId()
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal turn
            words, codes = _coded(held.pop(lang))
            sizes.pop(lang)
            turn += 1
            of = {"shard": turn % shards, "lang": lang, "block": (task << 33) + turn - task, "n": int(np.count_nonzero(codes))}
            return pa.RecordBatch.from_pylist([of | {"words": words, "prints": _prints(lang, words), "codes": codes.tobytes()}], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                while text:
                    edge = _BREAK.search(text, size) if len(text) > size else None
                    part, text = (text[: edge.start()], text[edge.end() :]) if edge else (text, b"")
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= size:
                        yield block(lang)
            while sum(sizes.values()) >= 4 * size:
                yield block(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield block(lang)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"shard int, {_BLOCKS}")


def _prints(lang: str, words: list[bytes]) -> bytes:
    """128 bits of each word of a language."""
    head = lang.encode() + b"\xff"  # ends the language, as no text has this byte
    return b"".join([xxhash.xxh3_128_digest(head + w) for w in words])


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + (left >> np.uint64(29)))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slots(ones: np.ndarray, slots: int) -> np.ndarray:
    """Slots of phrases by their first 64 bits; ``_SLOT`` says the same of counters."""
    return ((ones & np.uint64((1 << 62) - 1)) % np.uint64(slots)).astype(np.int64)


_SLOT = f"(one & {(1 << 62) - 1}L) % {{slots}}"
_REST = np.uint64((1 << 48) - 1)


def _firsts(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A place of each id."""
    out = np.empty(n, np.int64)
    out[ids] = places
    return out


def counted(prints: np.ndarray, codes: np.ndarray, since: np.ndarray, step: int, shards: int, longest: int) -> Iterator[tuple]:
    """(length, ones, twos, versions, counts) of the phrases that ``step`` counts in one block.

    ``prints`` has two columns of 64 bits for each word, ``ones`` and ``twos`` have them for each phrase.
    ``since`` has the step from which a phrase of a slot may carry longer ones. A phrase's version is
    the step that first counts it; it is counted in ``shards`` steps from then on.
    """
    one, two = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
    place = codes.astype(np.int64)
    size = len(one)
    carries = since[_slots(one, len(since))]
    carries[0] = NEVER  # the break

    def result(length: int, ones: np.ndarray, twos: np.ndarray, version: np.ndarray, counts: np.ndarray):
        now = (version <= step) & (step < version.astype(np.int64) + shards)
        return length, ones[now], twos[now], version[now], counts[now]

    if step < shards:
        counts = np.bincount(codes, minlength=size)
        counts[0] = 0
        there = np.flatnonzero(counts)
        yield result(1, one[there], two[there], np.zeros(len(there), np.uint8), counts[there])
    if len(codes) < 2:
        return
    both = np.maximum(carries[place[:-1]], carries[place[1:]])
    at = np.flatnonzero(both <= step)
    ids, keys = pd.factorize(place[at] * size + place[at + 1])
    first = _firsts(ids, at, len(keys))
    version = both[first]
    left, right = place[first], place[first + 1]
    ones, twos = _mixed(one[left], one[right]), _mixed(two[left], two[right])
    for length in range(2, longest + 1):
        if len(ids):
            yield result(length, ones, twos, version, np.bincount(ids, minlength=len(ones)))
        if length == longest or len(at) < 2:
            return
        # a longer phrase is one of this length and the next word, where one of this length follows at once
        # not before its own version, which another phrase of the slot may precede
        carries = np.maximum(since[_slots(ones, len(since))], version)
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        both = np.maximum(carries[ids[follows]], carries[ids[follows + 1]])
        follows = follows[both <= step]
        both = both[both <= step]
        last, at = ids[follows], at[follows]
        ids, keys = pd.factorize(last.astype(np.int64) * size + place[at + length])
        n = len(keys)
        version = np.empty(n, np.uint8)
        version[ids] = both
        owner = _firsts(ids, last, n)
        tail = place[_firsts(ids, at, n) + length]
        ones, twos = _mixed(ones[owner], one[tail]), _mixed(twos[owner], two[tail])


#: A counter: 64 bits of a phrase; its length, its version (a byte each) and 48 more bits; its count; one of its blocks.
_COUNTERS = "one long, two long, n long, block long"
#: A phrase whose count is complete, spelled; its mark has its length and version.
_COUNTED = "lang string, phrase string, mark long, n long"


def _step_counts(shard: DataFrame, since, step: int, shards: int, longest: int) -> DataFrame:
    """Counts of the phrases that ``step`` counts, a row a block; ``since`` is a broadcast table."""

    def run(batches):
        names = [c.split()[0] for c in _COUNTERS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                prints, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, np.uint64), (2, np.uint32)))
                for length, one, two, version, n in counted(prints.reshape(-1, 2), codes, since.value, step, shards, longest):
                    if len(n):
                        marked = (version.astype(np.int64) + (length << 8) << 48) + (two & _REST).view(np.int64)
                        columns = [*(pa.array(c) for c in (one.view(np.int64), marked, n.astype(np.int64))), pa.repeat(batch.column(0)[i], len(n))]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return shard.select("block", "prints", "codes").mapInArrow(run, _COUNTERS)


def _places(one: np.ndarray, two: np.ndarray, length: int, prints: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A place in a block of each of its phrases of ``length`` words, given by 64 and 48 bits."""
    ones, twos = prints[codes, 0], prints[codes, 1]
    for k in range(1, length):
        ones, twos = _mixed(ones[:-1], prints[codes[k:], 0]), _mixed(twos[:-1], prints[codes[k:], 1])
    asked = np.zeros(1 << 20, bool)  # most places of most blocks are not asked for
    low = np.uint64(len(asked) - 1)
    asked[(one & low).astype(np.int64)] = True
    at = np.flatnonzero(asked[(ones & low).astype(np.int64)])
    there = pd.DataFrame({"one": ones[at], "two": twos[at] & _REST, "at": at}).drop_duplicates(["one", "two"])
    found = pd.DataFrame({"one": one, "two": two}).merge(there, "left", ["one", "two"])["at"]
    if found.isna().any():
        raise RuntimeError("a counted phrase is not in its block")
    return found.to_numpy(np.int64)


def _spelled(ended: DataFrame, every: DataFrame) -> DataFrame:
    """Counters with their phrases, each looked up in its block, which has a row at most for each place and length."""
    wanted = ended.groupBy("block").agg(F.collect_list(F.struct("one", "two", "n")).alias("phrases"))

    def run(batches):
        names = [c.split()[0] for c in _COUNTED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, phrases = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(4)[i].values.flatten()
                prints, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((2, np.uint64), (3, np.uint32)))
                one, two, n = (c.to_numpy() for c in phrases)
                mark = two >> 48
                for length in np.unique(mark >> 8).tolist():
                    rows = np.flatnonzero(mark >> 8 == length)
                    at = _places(one[rows].view(np.uint64), two[rows].view(np.uint64) & _REST, length, prints.reshape(-1, 2), codes)
                    joined = words.take(pa.array(codes[at]))
                    for k in range(1, length):
                        joined = pc.binary_join_element_wise(joined, words.take(pa.array(codes[at + k])), pa.scalar(b" ", pa.binary()))
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(rows)), joined.cast(pa.string()), pa.array(mark[rows]), pa.array(n[rows])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    met = every.select("block", "lang", "words", "prints", "codes").join(wanted.hint("shuffle_hash"), "block")
    return met.select("lang", "words", "prints", "codes", "phrases").mapInArrow(run, _COUNTED)


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, words, n) of one to ``longest`` words that occur ``least`` times or more, and all words (lang, n)."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/llm-blocks-{uuid.uuid4().hex}"
    blocks(docs, shards, block).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    every = spark.read.schema(f"{_BLOCKS}, shard int").parquet(path)
    words = stored(every.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "all-words")
    since = np.full(slots, NEVER, np.uint8)
    ended, running, totals = [], None, None
    step, last = 0, 0
    while step < last + shards:
        held = spark.sparkContext.broadcast(since)
        raw = _step_counts(every.filter(F.col("shard") == step % shards), held, step, shards, longest)
        if running is not None:
            raw = raw.unionByName(running)
        counters = stored(raw.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("block").alias("block")), "counters")
        held.destroy()
        if totals is not None:
            discard(totals)
        totals = counters
        length, version = F.shiftright("two", 56), F.shiftright("two", 48) % 256
        # phrases of the greatest length carry none
        reached = counters.filter((F.col("n") >= least) & (length < longest)).select((F.expr(_SLOT.format(slots=slots)) + 1).alias("bit"))
        maps = reached.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        for row in maps.collect():  # at most slots / 8 bytes
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")) + (row.bucket - 1) * _BUCKET
            new = bits[since[bits] == NEVER]
            if len(new):
                since = since.copy() if not since.flags.writeable else since
                since[new] = last = step + 1
        over = version + (shards - 1) == step
        if step >= shards - 1:
            ended.append(stored(counters.filter(over & (F.col("n") >= least)), "phrases"))
        running = counters.filter(~over)
        step += 1
    out = ended[0]
    for frame in ended[1:]:
        out = out.unionByName(frame)
    out = stored(_spelled(out, every).select("lang", "phrase", F.expr("cast(mark >> 8 as int)").alias("words"), "n"), "all-phrases")
    discard(totals, *ended)
    return out, words


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut."""
    long = phrases.filter("words > 1").withColumnRenamed("n", "a")
    part = F.split("phrase", " ")
    cuts = long.select("lang", "phrase", "words", "a", part.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stored(
        cuts.select(
            "lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
            F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
        ),
        "cuts",
    )
    known = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = stored(cuts.join(known("head", "l"), ["lang", "head"]), "heads").join(known("tail", "r"), ["lang", "tail"])
    # products may pass 64 bits; a is at most l and r, so the score is at most a million
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div cast(l + r as decimal(20,0))").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return met.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def without_contained(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without those inside a longer one that occurs ``percent`` of the times or more."""
    part = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(part, i, k), " ")),
        )
    )
    inner = candidates.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    most = stored(inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), "contained")
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    met = candidates.join(most, ["lang", "phrase"], "left")
    return met.filter(F.col("longer").isNull() | (wide("longer", 100) < wide("a", percent))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **counting: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    phrases, words = phrase_counts(docs, least, longest, **counting)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = without_contained(stored(scored(phrases), "scored")).withColumn("spread", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # first inside 64 parts of a language, so that the last sort has 64 times top rows at most
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "spread").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL_OP13 = """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE n >= 30),
cuts AS (
  SELECT lang, k, phrase, n AS a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1 : k], ' ') AS tail
  FROM often, (SELECT unnest([1, 2, 3]) AS c) WHERE k > 1 AND c < k),
scores AS (
  SELECT cuts.*, h.n AS l, t.n AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.n + t.n) AS BIGINT) AS score
  FROM cuts JOIN often h ON h.lang = cuts.lang AND h.phrase = head AND h.k = c JOIN often t ON t.lang = cuts.lang AND t.phrase = tail AND t.k = cuts.k - c),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_spans AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, k, n AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 2), (SELECT unnest([2, 3]) AS m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_spans GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(totals.n AS BIGINT) AS n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""


@register("op13_dynamic_phrases", SQL_OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
