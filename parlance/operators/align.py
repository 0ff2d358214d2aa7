"""From alignment paths to timed words.

A path row is ``(seg_id, time_idx, token_idx, score)``. Paths may be of any length, so runs and
running totals use the blocked operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import transliterate
from parlance.lineage import cut
from parlance.operators.ordered import Layout, islands, lookup, prefix

BLOCK = 4096


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(logits, lambda x: x - (top + F.ln(total)))


def norm_labels(vocab: DataFrame, blank: str = "<pad>", separator: str = "|") -> DataFrame:
    return vocab.withColumn(
        "label",
        F.when(F.col("label") == blank, F.lit("")).when(F.col("label") == separator, F.lit(" ")).otherwise(F.col("label")),
    )


def char_lookup(chars: DataFrame, vocab: DataFrame, default: int | None = None) -> DataFrame:
    """Distinct ``char`` to ``ids``: itself, else another case or its ASCII form, else the ASCII form
    letter by letter, else ``default`` or nothing. ``vocab`` is (token_idx, label)."""
    c = F.col("char")
    plain = transliterate(c)
    candidates = F.array(c, F.lower(c), F.upper(c), plain, F.lower(plain), F.upper(plain))
    listed = chars.select("char", F.posexplode(candidates).alias("rank", "cand")).filter("cand <> ''")
    whole = (
        listed.join(vocab, listed["cand"] == vocab["label"])
        .groupBy("char")
        .agg(F.min(F.struct("rank", "token_idx")).alias("hit"))
        .select("char", F.array("hit.token_idx").alias("whole"))
    )
    letters = listed.filter("rank > 0 and length(cand) > 1").select(
        "char", "rank", F.posexplode(F.filter(F.split("cand", ""), lambda x: x != "")).alias("i", "letter")
    )
    spelled = (
        letters.join(vocab, letters["letter"] == vocab["label"])
        .groupBy("char", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("i", "token_idx"))).alias("ids"))
        .groupBy("char")
        .agg(F.max(F.struct(F.size("ids").alias("n"), (-F.col("rank")).alias("r"), "ids")).alias("hit"))
        .select("char", F.transform("hit.ids", lambda x: x["token_idx"]).alias("spelled"))
    )
    fallback = F.array(F.lit(default)) if default is not None else F.array()
    return (
        chars.join(whole, "char", "left")
        .join(spelled, "char", "left")
        .select("char", F.coalesce("whole", "spelled", fallback.cast("array<bigint>")).alias("ids"))
    )


def shrink_tokens(tokens: DataFrame, budget: DataFrame, block: int = BLOCK, fan: int = 1024) -> DataFrame:
    """Per segment: token count, equal neighbours, and how many leading tokens fit.

    ``tokens`` is (seg_id, pos, token_idx), ``budget`` (seg_id, frames). The first n tokens fit when
    n plus their repetitions does not exceed the frames; both grow with n, so the fitting rows are
    the leading ones.
    """
    layout = Layout(("seg_id",), ("pos",), f"pos div {block}", fan)
    twins = cut(
        prefix(tokens, layout, __prev=("lag", "token_idx")).select(
            "seg_id", "pos", F.coalesce((F.col("__prev") == F.col("token_idx")).cast("long"), F.lit(0)).alias("__same")
        )
    )
    running = prefix(twins, layout, __n=("sum", "1L"), __reps=("sum", "__same"))
    fits = F.expr("__n + 1 + __reps + __same <= frames")
    return lookup(running, budget, ["seg_id"]).groupBy("seg_id").agg(
        F.count("*").alias("n_tokens"), F.sum("__same").alias("repetitions"), F.count_if(fits).alias("kept")
    )


def merge_repeats(path: DataFrame, block: int = BLOCK, fan: int = 1024) -> DataFrame:
    """Consecutive points of one token to one segment with the mean score; the end is exclusive."""
    layout = Layout(("seg_id",), ("time_idx",), f"time_idx div {block}", fan)
    runs = islands(
        path, layout, ["time_idx", "token_idx"], "prev.token_idx <> cur.token_idx", total=("sum", "score"), points=("sum", "1L")
    )
    return runs.selectExpr(
        "seg_id", "head.token_idx as token_idx", "head.time_idx as start", "tail.time_idx + 1 as end", "total / points as score"
    )


def merge_words(segments: DataFrame, vocab: DataFrame, separator: str = " ", block: int = BLOCK, fan: int = 1024) -> DataFrame:
    """Character segments to words between separators; the score is weighted by length.

    A word is one row whatever its length: its letters are joined by blocks of frames, and those once
    more in the order of the blocks.
    """
    layout = Layout(("seg_id",), ("start",), f"start div {block}", fan)
    labelled = lookup(segments, vocab, ["token_idx"], "inner").withColumn("__sep", F.col("label") == separator)
    placed = cut(
        prefix(labelled, layout, __after=("max", "if(__sep, start, null)")).filter("not __sep").withColumn(
            "__after", F.coalesce("__after", F.lit(-1))
        )
    )
    words = placed.groupBy("seg_id", "__after").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.sum(F.expr("score * (end - start)")) / F.sum(F.expr("end - start"))).alias("score"),
    )
    parts = placed.groupBy("seg_id", "__after", F.expr(f"start div {block}").alias("__block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda x: x["label"]), ""
        ).alias("word")
    )
    whole = parts.groupBy("seg_id", "__after").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__block", "word"))), lambda x: x["word"]), ""
        ).alias("word")
    )
    return words.join(whole, ["seg_id", "__after"]).drop("__after")


def frames_to_seconds(words: DataFrame, segments: DataFrame, originals: DataFrame, rate: int = 16000, block: int = BLOCK) -> DataFrame:
    """Frame times to seconds; the original words are kept only where their count matches.

    ``segments`` is (seg_id, samples, frames, offset), ``originals`` (seg_id, word_idx, original).
    The frame count enters with one added, as the alignment grid has one more row than frames.
    """
    layout = Layout(("seg_id",), ("start",), f"start div {block}")
    index = prefix(words.select("seg_id", "start"), layout, word_idx=("sum", "1L"))
    numbered = words.join(index, ["seg_id", "start"])
    counts = (
        index.groupBy("seg_id").agg(F.count("*").alias("__aligned"))
        .join(originals.groupBy("seg_id").agg(F.count("*").alias("__given")), "seg_id", "full")
        .join(segments, "seg_id")
        .withColumn("mismatch", ~F.col("__aligned").eqNullSafe(F.col("__given")))
    )
    timed = lookup(numbered, counts, ["seg_id"]).withColumn("__ratio", F.expr(f"samples / ((frames + 1) * {rate})"))
    return (
        timed.join(originals, ["seg_id", "word_idx"], "left")
        .withColumn("start_s", F.expr("start * __ratio + offset"))
        .withColumn("end_s", F.expr("end * __ratio + offset"))
        .withColumn("word", F.when(F.col("mismatch"), F.col("word")).otherwise(F.col("original")))
        .select("seg_id", "word_idx", "word", "start_s", "end_s", "mismatch")
    )
