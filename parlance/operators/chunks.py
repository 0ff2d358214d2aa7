"""Cutting long recordings into overlapping chunks, and joining the results again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import lookup


def chunk_plan(recordings: DataFrame, chunk: int, context: int, threshold: int) -> DataFrame:
    """(session, length) to (session, chunk_idx, start, end); short recordings stay whole."""
    count = f"if(length > {threshold}, cast(ceil(length / {chunk}) as bigint), 1L)"
    return (
        recordings.withColumn("__n", F.expr(count))
        .withColumn("chunk_idx", F.expr("explode(sequence(0L, __n - 1))"))
        .selectExpr(
            "session",
            "chunk_idx",
            f"if(__n = 1, 0L, greatest(chunk_idx * {chunk} - {context}, 0L)) as start",
            f"if(__n = 1, length, least((chunk_idx + 1) * {chunk} + {context}, length)) as end",
        )
    )


def words_per_chunk(words: DataFrame, lengths: DataFrame, chunk: int, context: int) -> DataFrame:
    """List each word (start_ms, end_ms) in every chunk that contains it whole, times made relative."""
    placed = lookup(words, lengths, ["session"]).withColumn(
        "last_chunk", F.expr(f"cast(ceil(length / {chunk}) as bigint) - 1")
    )
    first = f"greatest(0L, cast(ceil((end_ms - {context} - {chunk}) / {chunk}) as bigint))"
    last = f"least(last_chunk, (start_ms + {context}) div {chunk})"
    return (
        placed.filter(f"{first} <= {last}")
        .withColumn("chunk_idx", F.expr(f"explode(sequence({first}, {last}))"))
        .withColumn("__from", F.expr(f"if(chunk_idx = 0, 0L, chunk_idx * {chunk} - {context})"))
        .withColumn("rel_start", F.expr("start_ms - __from"))
        .withColumn("rel_end", F.expr("end_ms - __from"))
        .drop("__from", "start_ms", "end_ms", "length")
    )


def merge_chunk_words(
    chunk_words: DataFrame, chunk: int, context: int, per_char: float = 15, compat: bool = False
) -> DataFrame:
    """Keep every word only in the chunk that owns it and make its times absolute again.

    ``per_char`` is the tolerance in ms per character. ``compat`` lets the first chunk also accept
    words of its right context, which then come out twice.
    """
    slack = f"{per_char} * length(word)"
    first_bound = chunk + context if compat else chunk
    owned = (
        f"case when last_chunk = 0 then true "
        f"when chunk_idx = 0 then rel_end - {slack} < {first_bound} "
        f"when chunk_idx = last_chunk then rel_start + {slack} > {context} "
        f"else rel_start + {slack} > {context} and rel_end - {slack} < {chunk + context} end"
    )
    shift = f"if(chunk_idx = 0, 0L, chunk_idx * {chunk} - {context})"
    return (
        chunk_words.filter(owned)
        .withColumn("start_ms", F.expr(f"rel_start + {shift}"))
        .withColumn("end_ms", F.expr(f"rel_end + {shift}"))
    )


def token_windows(tokens: DataFrame, keys: list[str], pos: str, token: str, size: int = 256, pad: str = "[PAD]") -> DataFrame:
    """Token rows to fixed windows of ``size``; the last one is padded."""
    windows = tokens.groupBy(*keys, F.expr(f"{pos} div {size}").alias("window")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(token).alias("t")))).alias("__items")
    )
    return windows.withColumn("n", F.size("__items")).withColumn(
        "tokens",
        F.concat(
            F.transform("__items", lambda x: x["t"]), F.array_repeat(F.lit(pad), F.lit(size) - F.size("__items"))
        ),
    ).drop("__items")
