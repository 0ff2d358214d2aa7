"""From recognizer output to transcripts.

Segments are ``(session, seg_idx)``; words of one segment come from one recognizer segment and are
few, sessions may be of any length. Scores, counts and times are per session, whatever its length.
Text of a session is put together in *parts* of ``SEGMENTS_PER_PART`` segments: a normal session
has one part, an endless one has many, and the parts in order give the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.columns import contains_alphanum, round2
from parlance.functions.fixed import GLUE_CHARS
from parlance.lineage import cut
from parlance.operators.ordered import lookup
from parlance.operators.voice import remap_timestamps

SEGMENTS_PER_PART = 1024


def part_of(seg_idx: str = "seg_idx") -> Column:
    return F.expr(f"{seg_idx} div {SEGMENTS_PER_PART}")


# --- predicates and projections -----------------------------------------------------------------


def drop_unk_words(words: DataFrame, word: str = "word") -> DataFrame:
    return words.filter(~F.col(word).eqNullSafe("<unk>"))


def strip_unk_text(text: Column) -> Column:
    """Erase the unknown-word mark, then close the gaps around apostrophes."""
    return glue_apostrophes(F.regexp_replace(text, "<unk>", ""))


def glue_apostrophes(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{L}\p{N}_]) *' *([\p{L}\p{N}_])", "$1'$2")


def validate_segments(segments: DataFrame, required: tuple[str, ...] = ("start", "end", "words", "avg_logprob")) -> DataFrame:
    """``missing_keys`` of every segment; the last segment of a session may lack them."""
    last = segments.groupBy("session").agg(F.max("seg_idx").alias("__last"))
    missing = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return (
        lookup(segments, last, ["session"])
        .withColumn(
            "missing_keys",
            F.when(F.col("seg_idx") == F.col("__last"), F.array().cast("array<string>")).otherwise(F.array_compact(missing)),
        )
        .drop("__last")
    )


def timestamp_warnings(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Flag times past the end of the recording, and ends before their start."""
    return (
        lookup(rows, durations, ["session"])
        .withColumn("late_start", F.col("start_ms") > F.col("duration"))
        .withColumn("late_end", F.col("end_ms") > F.col("duration"))
        .withColumn("reversed", F.col("end_ms") < F.col("start_ms"))
    )


def with_metadata(words: Column, flag: Column) -> Column:
    """The words only where they were asked for."""
    return F.when(flag, words).otherwise(F.array().cast("array<string>"))


# --- gluing -------------------------------------------------------------------------------------


def glue_punctuation(tokens: DataFrame) -> DataFrame:
    """Sub-word tokens (session, seg_idx, pos, token, start_ms, end_ms, conf_pct) to words.

    A token that starts with a glue character and is longer than it joins the word before it if it
    has no leading space, or if it or the word so far has no letter or digit. A spaced joining
    token always leaves a word with letters behind (it has some, or the word had), so whether the
    word so far has letters depends only on the tokens since the last token that is not unspaced
    glue: no sequential pass is needed, just two running windows inside the segment.
    """
    segment = Window.partitionBy("session", "seg_idx").orderBy("pos")
    bare = F.ltrim("token")
    marked = (
        tokens.withColumn("__alnum", contains_alphanum(F.col("token")))
        .withColumn(
            "__glue",
            (F.row_number().over(segment) > 1)
            & (F.length(bare) > 1)
            & F.substring(bare, 1, 1).isin(*GLUE_CHARS),
        )
        .withColumn("__sure", F.col("__glue") & ((bare == F.col("token")) | ~F.col("__alnum")))
        .withColumn("__spaced", F.col("__glue") & ~F.col("__sure"))
        .withColumn("__stretch", F.coalesce(F.sum((~F.col("__sure")).cast("int")).over(segment), F.lit(0)))
        .withColumn("__seen", F.col("__alnum") | F.col("__spaced"))
    )
    # A stretch is one token that is not sure glue and the sure glue after it. Stretches count up along
    # the segment, so the last one with letters is the largest, and one order serves all windows.
    worded = (
        marked.withColumn("__has", F.max(F.when(F.col("__seen"), F.col("__stretch"))).over(segment) == F.col("__stretch"))
        .withColumn("__before", F.coalesce(F.lag("__has").over(segment), F.lit(False)))
        .withColumn("__break", ~(F.col("__sure") | (F.col("__spaced") & ~F.col("__before"))))
        .withColumn("word_idx", F.sum(F.col("__break").cast("int")).over(segment) - 1)
    )
    return (
        worded.groupBy("session", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"))
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("__tokens"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("conf_pct").alias("conf_sum"),
            F.count("*").alias("n_tokens"),
        )
        .withColumn("word", F.ltrim(F.array_join(F.transform("__tokens", lambda x: x["token"]), "")))
        .drop("__tokens")
    )


def word_confidence() -> Column:
    """Mean of the glued tokens' probabilities, two decimals."""
    return round2(F.col("conf_sum") / (100 * F.col("n_tokens")))


# --- scores -------------------------------------------------------------------------------------


def confidence_from_logprobs(segments: DataFrame) -> DataFrame:
    """exp of the mean log-probability per segment, averaged per session; 0.0 without segments."""
    return segments.groupBy("session").agg(
        F.coalesce(round2(F.avg(F.exp(F.col("avg_logprob")))), F.lit(0.0)).alias("confidence")
    )


def confidence_without_unk(words: DataFrame) -> DataFrame:
    """Mean word confidence per session, unknown words left out."""
    return drop_unk_words(words).groupBy("session").agg((F.sum("conf_pct") / F.count("*") / 100).alias("confidence"))


def confidence_mean(words: DataFrame) -> DataFrame:
    """Rounded mean word confidence; null where no word carries one."""
    return words.groupBy("session").agg(round2(F.sum("conf_pct") / F.count("conf_pct") / 100).alias("confidence"))


# --- order and time of segments -----------------------------------------------------------------


def _block_function(starts: list[int], ends: list[int], step: int) -> tuple[list[int], list[int]]:
    """What a block of rows makes of the end before it: (bounds, results).

    An end below ``bounds[i]``, and not below the bounds before, leaves the block as ``results[i]``; an
    end that no bound is above goes up by ``step`` with every row.
    """
    n = len(starts)
    # with every row the carried end goes up by step until it is below a row's bound, and then restarts
    bound = [(b if b > a else a + 1) - i * step for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    restart = [(b if b > a else a + step) - (i + 1) * step for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    leaves = [0] * n
    later: list[int] = []  # rows that a restart further up may meet first: their bounds fall
    for i in range(n - 1, -1, -1):
        low, high = 0, len(later)
        while low < high:
            middle = (low + high) // 2
            if bound[later[middle]] > restart[i]:
                low = middle + 1
            else:
                high = middle
        leaves[i] = leaves[later[low - 1]] if low else restart[i] + n * step
        while later and bound[later[-1]] <= bound[i]:
            later.pop()
        later.append(i)
    rows = later[::-1]  # each bound is above all before it
    return [bound[i] for i in rows], [leaves[i] for i in rows]


def monotonic_segments(segments: DataFrame, step: int = 1000, block: int = 4096, fan: int = 1024) -> DataFrame:
    """start := max(start, end before); an end not after it becomes start + ``step``.

    A row makes a rising step function of the end before it, and such functions can be put together.
    Each block of rows is put together by itself; one pass over the functions, one row a block, gives
    the end that enters each block; then each block follows the rule from there. A session of any
    length uses all cores, whatever its times are. ``fan`` is not needed any more and has no effect.
    """
    kinds = dict(segments.dtypes)
    rows = segments.select("session", "seg_idx", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")).withColumn(
        "__block", F.expr(f"cast(seg_idx div {block} as bigint)")
    )
    rows = cut(rows)

    def compose(group: pa.Table) -> pa.Table:
        group = group.sort_by("seg_idx")
        bounds, results = _block_function(group["start_ms"].to_pylist(), group["end_ms"].to_pylist(), step)
        listed = [pa.array([v], pa.list_(pa.int64())) for v in (bounds, results)]
        return pa.table([group["session"].slice(0, 1), group["__block"].slice(0, 1), pa.array([group.num_rows], pa.int64()), *listed], names=["session", "__block", "n", "bounds", "results"])

    functions = cut(rows.groupBy("session", "__block").applyInArrow(compose, f"session {kinds['session']}, __block long, n long, bounds array<long>, results array<long>"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Functions come session by session, in order; one end is all that is carried on."""
        at, end = None, None
        for batch in batches:
            entering = []
            for i in range(batch.num_rows):
                session = batch.column(0)[i].as_py()
                if session != at:
                    at, end = session, None
                entering.append(end)
                bounds, results = batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values
                first = 0 if end is None else int(np.searchsorted(bounds, end, "right"))
                end = results[first].as_py() if first < len(bounds) else end + step * batch.column(2)[i].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entering, pa.int64())], names=["session", "__block", "before"])

    entering = functions.repartition("session").sortWithinPartitions("session", "__block").mapInArrow(scan, f"session {kinds['session']}, __block long, before long")

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("seg_idx")
        end = group["before"][0].as_py()
        starts, ends = [], []
        for a, b in zip(group["start_ms"].to_pylist(), group["end_ms"].to_pylist(), strict=True):
            a = a if end is None else max(a, end)
            end = b if b > a else a + step
            starts.append(a)
            ends.append(end)
        return pa.table([group["session"], group["seg_idx"], pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["session", "seg_idx", "start_ms", "end_ms"])

    met = rows.join(entering, ["session", "__block"])
    return met.groupBy("session", "__block").applyInArrow(follow, f"session {kinds['session']}, seg_idx {kinds['seg_idx']}, start_ms long, end_ms long")


def glue_word_times(words: DataFrame) -> DataFrame:
    """Inside a segment each word starts where the one before ends, and ends half way to the next.

    The first and last word are pinned to the segment's own bounds (seg_start, seg_end).
    """
    along = Window.partitionBy("session", "seg_idx").orderBy("pos")
    next_start = F.lead("start_ms").over(along)
    glued = words.withColumn(
        "glued_end",
        F.when(next_start.isNull(), F.col("seg_end").cast("double")).otherwise((next_start + F.col("end_ms")) / 2),
    )
    return glued.withColumn(
        "glued_start", F.coalesce(F.lag("glued_end").over(along), F.col("seg_start").cast("double"))
    )


# --- text ---------------------------------------------------------------------------------------


def assemble_text(segments: DataFrame, order: str = "seg_idx", text: str = "text") -> DataFrame:
    """Stripped segment texts in order, one space between, per session and part."""
    return (
        segments.groupBy("session", part_of(order).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))).alias("__s"))
        .select("session", "part", F.array_join(F.transform("__s", lambda x: x["t"]), " ").alias("text"))
    )


def flatten_words(segments: DataFrame) -> DataFrame:
    """Nested ``words array<struct<…>>`` to one row per word, in order."""
    return segments.select("session", "seg_idx", F.posexplode("words").alias("pos", "w")).select(
        "session", "seg_idx", "pos", "w.*"
    )


def on_timeline(tokens: DataFrame, mapped: DataFrame, timeline: str = "original") -> DataFrame:
    """Tokens timed in cut audio, on the timeline asked for: ``speech`` or ``original``.

    ``mapped`` is a speech map in the tokens' time unit.
    """
    if timeline == "speech":
        return tokens
    if timeline != "original":
        raise ValueError(f"unknown timeline {timeline!r}")
    keys = ["session", "seg_idx", "pos"]
    times = remap_timestamps(tokens.selectExpr(*keys, "start_ms as t", "end_ms as t2"), mapped).drop("t", "t2")
    return tokens.drop("start_ms", "end_ms").join(times, keys)


def transcript(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Tokens and segment log-probabilities to transcripts: text and words per session and part.

    ``tokens`` as in :func:`glue_punctuation`, ``segments`` (session, seg_idx, avg_logprob). Every
    segment counts, also one without words: it has part in the confidence and no text. Confidence,
    mean word confidence, number of words and time bounds are those of the whole session, on each
    of its parts; a session without words has null bounds and no mean.
    """
    words = glue_punctuation(tokens).withColumn("conf", word_confidence())
    spoken = words.groupBy("session", "seg_idx").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "word_idx", "word", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "conf"
                )
            )
        ).alias("ws"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum(F.rint(F.col("conf") * 100).cast("long")).alias("conf_pct"),
        F.count("*").alias("n_words"),
    )
    every = cut(segments.select("session", "seg_idx", "avg_logprob").join(spoken, ["session", "seg_idx"], "left"))
    scores = every.groupBy("session").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
        round2(F.avg(F.exp("avg_logprob"))).alias("confidence"),
        round2(F.sum("conf_pct") / F.sum("n_words") / 100).alias("mean_word_conf"),
    )
    parts = (
        every.groupBy("session", part_of().alias("part"))
        .agg(F.array_sort(F.collect_list(F.when(F.col("ws").isNotNull(), F.struct("seg_idx", "ws")))).alias("__s"))
        .withColumn("words", F.flatten(F.transform("__s", lambda s: s["ws"])))
        .withColumn("text", F.array_join(F.transform("words", lambda w: w["word"]), " "))
        .drop("__s")
    )
    return parts.join(scores, "session")
