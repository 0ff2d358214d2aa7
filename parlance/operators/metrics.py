"""Word error rate, speed, and a hook for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Insertions, deletions and substitutions between two arrays of words.

    Every distinct word of the pair becomes one character beyond the basic plane; the built-in
    edit distance of the two strings is then the distance in words. For short texts: the time goes with
    the product of their lengths, see ``with_word_errors``.
    """
    letters = F.array_distinct(F.concat(reference, hypothesis))

    def encode(words: Column) -> Column:
        codes = F.transform(words, lambda w: F.lpad(F.hex(F.lit(0x10000) + F.array_position(letters, w)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    return F.levenshtein(encode(reference), encode(hypothesis))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and substitutions between two lists, a whole column of the table at once.

    A column is held as two large whole numbers, one bit a row: where the value grows by one over the
    row above, and where it falls by one. Each word of ``b`` moves on by a column with a few
    operations on numbers of ``len(a)`` bits.
    """
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for word in b:
        same = places.get(word, 0)
        level = ((((same & up) + up) ^ up) | same | down) & every
        right_up, right_down = (down | ~(level | up)) & every, up & level
        distance += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | 1) & every, right_down << 1 & every
        left = same | down
        up, down = (right_down | ~(left | right_up)) & every, right_up & left
    return distance


def with_word_errors(pairs: DataFrame, name: str = "errors") -> DataFrame:
    """``pairs`` with the word errors between their arrays of words ``reference`` and ``hypothesis``.

    A null array has no words, and a null word is a word like others.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + f", `{name}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("reference", "hypothesis"))
            errors = [edit_distance(a or [], b or []) for a, b in zip(*both, strict=True)]
            yield batch.append_column(name, pa.array(errors, pa.int32()))

    return pairs.mapInArrow(run, kind)


def word_error_rate(pairs: DataFrame, *group: str) -> DataFrame:
    """Corpus rate per group of ``pairs`` (reference and hypothesis, arrays of words)."""
    counted = with_word_errors(pairs.select(*group, "reference", "hypothesis"), "__errors")
    return counted.groupBy(*group).agg(
        F.sum("__errors").alias("errors"),
        F.sum(F.size("reference")).alias("words"),
    ).withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))


def rtfx(runs: DataFrame, *group: str) -> DataFrame:
    """Audio seconds per processing second."""
    return runs.groupBy(*group).agg((F.sum("audio_s") / F.sum("processing_s")).alias("rtfx"))


_LOADED: dict = {}


def batch_infer(
    rows: DataFrame, load: Callable[[], Callable], column: str, output: str, output_type: str, batch: int = 2
) -> DataFrame:
    """Run a user's model over a column in batches of ``batch`` values.

    ``load`` makes the model; it runs once per Python worker, which Spark reuses between tasks.
    Filter first: nothing is pushed below this step.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{output}` {output_type}"
    key = f"{load.__module__}.{load.__qualname__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _LOADED:
            _LOADED[key] = load()
        model = _LOADED[key]
        for frame in batches:
            values = frame[column].tolist()
            results = [r for i in range(0, len(values), batch) for r in model(values[i : i + batch])]
            yield frame.assign(**{output: results})

    return rows.mapInPandas(run, schema)


def revision_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    """How often a word that was shown changes in the next hypothesis: changed, shown, rate.

    ``pairs`` has two arrays of words, the hypothesis before (b) and the new one (n); places that
    both have are compared. The rate is null where none was shown twice.
    """
    shared = pairs.withColumn("shared", F.least(F.size("b"), F.size("n")))
    changed = F.expr("size(filter(arrays_zip(slice(b, 1, shared), slice(n, 1, shared)), z -> z.`0`.word <> z.`1`.word))")
    counted = shared.groupBy(*keys).agg(F.sum(changed).alias("changed"), F.sum("shared").alias("shown"))
    return counted.withColumn("rate", F.when(F.col("shown") > 0, F.col("changed") / F.col("shown")))
