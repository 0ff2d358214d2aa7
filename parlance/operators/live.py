"""Live transcription as tables: hypotheses of one session agree step by step on final text.

``hyps`` is (session, iter, words array<struct<start,end,word>>, buffer_end, eof); times are seconds
from the start of the session. The pieces below are column expressions on one hypothesis, or
operators on arrival logs; :mod:`parlance.streaming.agreement` runs them together per session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.columns import normalize_compare
from parlance.functions.fixed import ASCII_PUNCTUATION, IDLE_TIMEOUT_S, MIN_CHUNK_S, PROMPT_CHARS, SILENCE_TIMEOUT_FACTOR
from parlance.lineage import cut
from parlance.operators.ordered import Layout, islands, lookup, prefix

WORD = "struct<start:double,end:double,word:string>"


def shift(words: Column, by: Column) -> Column:
    return F.transform(
        words,
        lambda w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), w["word"].alias("word")),
    )


def dedup_overlap(new: Column, committed: Column, last_committed: Column, offset: Column) -> Column:
    """New words that go on after the committed ones; a repeated n-gram of up to five is dropped."""
    later = F.filter(shift(new, offset), lambda w: w["start"] > last_committed - 0.1)

    def text(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: w["word"]), " ")

    def drop_repeat(words: Column) -> Column:
        size = F.least(F.size(committed), F.size(words), F.lit(5))
        sizes = F.filter(F.array(*[F.lit(i) for i in range(1, 6)]), lambda i: i <= size)
        repeats = F.filter(sizes, lambda i: text(F.slice(committed, -i, i)) == text(F.slice(words, F.lit(1), i)))
        near = F.abs(F.get(words, F.lit(0))["start"] - last_committed) < 1
        drop = F.when(near, F.coalesce(F.get(repeats, F.lit(0)), F.lit(0))).otherwise(F.lit(0))
        return F.slice(words, drop + 1, F.greatest(F.size(words) - drop, F.lit(0)))

    return F.transform(F.array(later), drop_repeat)[0]


def agreed_count(buffer: Column, new: Column, max_words: int | None = None) -> Column:
    """How many leading words both hypotheses share.

    With ``max_words`` words are also taken while more than that many wait in the buffer;
    a negative number switches this off.
    """
    shared = F.least(F.size(buffer), F.size(new))
    places = F.filter(F.sequence(F.lit(0), F.greatest(shared, F.lit(1)) - 1), lambda j: j < shared)

    def stops(j: Column) -> Column:
        differs = normalize_compare(F.get(buffer, j)["word"]) != normalize_compare(F.get(new, j)["word"])
        if max_words is None or max_words < 0:
            return differs
        return differs & ~(F.size(buffer) - j > max_words)

    return F.coalesce(F.array_min(F.filter(places, stops)), shared)


def drop_edge_word(buffer: Column, buffer_end: Column, edge: float = 0.05) -> Column:
    last = F.try_element_at(buffer, F.lit(-1))
    close = F.coalesce(buffer_end - last["end"] < edge, F.lit(False))
    return F.when(close, F.slice(buffer, F.lit(1), F.size(buffer) - 1)).otherwise(buffer)


def emit_final(final_words: Column, buffer: Column, buffer_end: Column, pause: float, min_words: int | None = None) -> Column:
    """True when the waiting words are complete: the next sign of time comes after a pause.

    Without ``min_words`` the last word must end with a punctuation mark, with it there must be
    more than ``min_words`` words.
    """
    last = F.try_element_at(final_words, F.lit(-1))
    if min_words is None:
        complete = F.lit(ASCII_PUNCTUATION).contains(F.right(last["word"], F.lit(1)))
    else:
        complete = F.size(final_words) > min_words
    evidence = F.when(F.size(buffer) == 0, buffer_end).when(F.size(buffer) <= 3, F.get(buffer, F.lit(0))["end"])
    return F.coalesce(complete & (last["end"] != 0) & (evidence != 0) & (last["end"] + pause < evidence), F.lit(False))


def partial_text(final_words: Column, buffer: Column) -> Column:
    return F.array_join(F.transform(F.concat(final_words, buffer), lambda w: w["word"]), " ")


def trim_point(segment_ends: Column, last_committed: Column) -> Column:
    """Latest segment end, newest segment aside, that is not after the last committed word."""
    done = F.slice(segment_ends, F.lit(1), F.greatest(F.size(segment_ends) - 1, F.lit(0)))
    return F.array_max(F.filter(done, lambda e: e <= last_committed))


# --- arrival logs -------------------------------------------------------------------------------


def fill_silence(packets: DataFrame, length: float, factor: float = SILENCE_TIMEOUT_FACTOR, slot: int = 600) -> DataFrame:
    """Insert packets of silence where nothing arrived for ``length * factor`` seconds.

    ``packets`` is (session, event_id, at_s), seconds whole or with a fraction. A missing packet is
    put at each timeout after the last arrival; times stay whole if arrivals and timeout are.
    """
    layout = Layout(("session",), ("at_s", "event_id"), f"cast(floor(at_s / {slot}) as bigint)")
    wait = length * factor
    kind = dict(packets.dtypes)["at_s"]
    if kind not in ("int", "bigint") or wait != int(wait):
        kind = "double"
    gaps = prefix(packets, layout, __prev=("lag", "at_s")).filter(F.col("at_s") - F.col("__prev") > wait)
    steps = f"sequence(1L, cast(ceil((at_s - __prev) / {wait}D) as bigint) - 1)"
    silent = gaps.select("session", "__prev", F.expr(f"explode({steps})").alias("i")).select(
        "session", F.lit(None).cast("long").alias("event_id"), F.expr(f"cast(__prev + i * {wait}D as {kind})").alias("at_s")
    )
    return packets.select("session", "event_id", F.col("at_s").cast(kind).alias("at_s")).unionByName(silent)


def min_chunk_gate(packets: DataFrame, seconds: float, minimum: float = MIN_CHUNK_S, slot: int = 600) -> DataFrame:
    """Buffered seconds per arrival, and the number of the processing run it triggers, if any."""
    layout = Layout(("session",), ("at_s", "event_id"), f"cast(floor(at_s / {slot}) as bigint)")
    counted = prefix(packets, layout, __n=("sum", "1L")).withColumn("buffered", (F.col("__n") + 1) * F.lit(seconds))
    # The buffer only grows, so runs are counted from the first arrival that fills it.
    first = -(-minimum // seconds)
    return counted.withColumn(
        "trigger_id", F.when(F.col("buffered") >= minimum, F.col("__n") + 1 - F.lit(int(max(first, 1))))
    ).drop("__n")


def throttle_partials(emissions: DataFrame, interval: float, slot: int = 600) -> DataFrame:
    """At most one partial per ``interval`` seconds; finals pass always and restart the clock.

    ``emissions`` is (session, event_id, at_s, kind, pending), seconds whole or with a fraction. A
    partial passes if none was sent since the last final, if the last one is older than the
    interval, or if nothing is pending. Rows that pass whatever came before (finals, rows after a
    long silence or with nothing pending) cut the session into independent runs. Runs are followed
    in order through sorted partitions, with one time carried on, so a burst of any length takes
    linear time and no memory.
    """
    layout = Layout(("session",), ("at_s", "event_id"), f"cast(floor(at_s / {slot}) as bigint)")
    sure = f"kind = 'final' or pending = 0 or __prev_at is null or __prev_kind = 'final' or at_s - __prev_at > {interval}"
    marked = cut(
        prefix(emissions, layout, __prev_at=("lag", "at_s"), __prev_kind=("lag", "kind")).select(
            "session", "event_id", "at_s", "kind", F.expr(sure).alias("__sure")
        )
    )
    numbered = prefix(marked, layout, __run=("sum", "int(__sure)")).withColumn(
        "__run", F.col("__run") + F.col("__sure").cast("int")
    )
    names = ["session", "event_id", "at_s", "kind"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Within a run only the first row is sure; the rest pass one interval after the last that did.
        sent = None
        for batch in batches:
            passed = []
            for at, first in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                go = first or at - sent > interval
                sent = at if go else sent
                passed.append(go)
            yield batch.select(names).filter(pa.array(passed, pa.bool_()))

    spread = numbered.select(*names, "__sure", "__run").repartition("session", "__run")
    ordered = spread.sortWithinPartitions("session", "__run", "at_s", "event_id")
    return ordered.mapInArrow(follow, emissions.select(*names).schema)


def prompt_suffix(words: DataFrame, cuts: DataFrame, chars: int = PROMPT_CHARS) -> DataFrame:
    """Whole words from the end, until they and their blanks reach ``chars`` characters.

    ``words`` is (session, seg_idx, pos, word, end_ms), ``cuts`` (session, cut). Only words up to
    the last one that ends by the cut count, and never the newest word of the session. A word is at
    least a character and a blank, so half of ``chars`` words are enough; that ranking is pushed
    below the shuffle by Spark.
    """
    at = F.struct("seg_idx", "pos")
    placed = lookup(words, cuts, ["session"], "inner").withColumn("__at", at)
    newest = words.groupBy("session").agg(F.max(F.struct("seg_idx", "pos")).alias("__newest"))
    limits = (
        lookup(placed.select("session", "__at", "end_ms", "cut"), newest, ["session"], "inner")
        .filter("__at < __newest and end_ms <= cut")
        .groupBy("session")
        .agg(F.max("__at").alias("__limit"))
    )
    back = Window.partitionBy("session").orderBy(F.col("__at").desc())
    tail = (
        lookup(placed, limits, ["session"], "inner")
        .filter("__at <= __limit")
        .withColumn("__rank", F.row_number().over(back))
        .filter(F.col("__rank") <= chars // 2 + 1)
    )
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    taken = tail.withColumn(
        "__used", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    ).filter(F.col("__used") < chars)
    return taken.groupBy("session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "word"))), lambda x: x["word"]), " ").alias("prompt")
    )


def words_to_sentences(words: DataFrame) -> DataFrame:
    """Words of one utterance (session, seg_idx) to sentences closed by a terminal mark."""
    along = Window.partitionBy("session", "seg_idx").orderBy("pos")
    ended = F.col("word").rlike("[.?!]$").cast("int")
    numbered = words.withColumn("sentence", F.coalesce(F.sum(ended).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.groupBy("session", "seg_idx", "sentence").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"),
    )


def idle_sessions(packets: DataFrame, gap: int = IDLE_TIMEOUT_S, slot: int = 600) -> DataFrame:
    """Stretches of activity; ``gap`` seconds without a message close one."""
    layout = Layout(("session",), ("at_s", "event_id"), f"cast(floor(at_s / {slot}) as bigint)")
    runs = islands(packets, layout, ["at_s"], f"cur.at_s - prev.at_s >= {gap}", n=("sum", "1L"))
    return runs.selectExpr("session", "head.at_s as start_s", f"tail.at_s + {gap} as end_s", "n")


def idle_sessions_stream(messages: DataFrame, gap: str, lateness: str) -> DataFrame:
    """The same on an event-time stream with a watermark."""
    return (
        messages.withWatermark("ts", lateness)
        .groupBy("session", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def session_text(finals: DataFrame, part: Column) -> DataFrame:
    """Non-empty finals (session, iter, text) joined by newlines, in order, per part."""
    return (
        finals.filter(F.trim("text") != "")
        .groupBy("session", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("iter", "text"))).alias("__t"))
        .select("session", "part", F.array_join(F.transform("__t", lambda x: x["text"]), "\n").alias("text"))
    )
