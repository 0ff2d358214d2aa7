"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three characters, words padded
with a blank), in order of frequency. A document's own most frequent n-grams are compared with each
profile: an n-gram costs the distance between its two places, or the full length of a profile if it
is not in it. The language with the smallest sum wins; ties go to the first name in order.

Profiles are learned from a bounded sample of about ``SAMPLE`` texts for each language, drawn by a
hash of the id over the whole table; their n-grams are counted in Spark. The profiles handed to the
tasks have ``PROFILE`` rows for each language. Documents are judged by whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text whose
n-grams are in no profile gets the first language with score 0; a null language teaches nothing; if
nothing can be learned every document is ``und``; repeated rows give repeated results; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import batch_of, held_out, rows_of, stored, table, uniform
from parlance.llm.registry import register

SAMPLE, PROFILE, ORDER = 400, 400, 3
UNDETERMINED = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_WIDTH = 21  # bits of a code point


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as packed code points, ascending, and their counts."""
    line = _OTHER.sub(" ", text.lower()).strip() if text else ""
    if not _LETTER.search(line):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {line} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    packed, every = points, [points[points != 32]]
    for n in range(2, ORDER + 1):
        packed = (packed[:-1] << _WIDTH) | points[n - 1 :]
        if n == 3:  # a blank in the middle joins two words
            inner = points[1 : 1 + len(packed)] != 32
            every.append(packed[inner])
        else:
            every.append(packed)
    grams = np.sort(np.concatenate(every))
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams)))


def most_frequent(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by code."""
    grams, counts = ngrams(text)
    return grams[np.lexsort((grams, -counts))[:size]]


def learned_from(docs: DataFrame, key: str = "doc_id", label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(label, text) of about ``sample`` rows of each label that are not held out.

    The draw looks at ids and labels only; texts are read for the few ids drawn. A null id teaches nothing.
    """
    usable = docs.filter(~held_out(key) & F.col(label).isNotNull() & F.col("text").isNotNull())
    ids = usable.select(key, label)
    share = ids.groupBy(label).agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    drawn = ids.join(share, label).filter(uniform(key, F.lit("profile")) < F.col("share")).select(key).distinct()
    return usable.join(stored(drawn, "drawn"), key, "left_semi").select(label, "text")


def profiles(docs: DataFrame, key: str = "doc_id", label: str = "lang", sample: int = SAMPLE, size: int = PROFILE) -> DataFrame:
    """(label, gram, rank) with rank from 0; the two steps of the cut keep any one group small."""

    def run(batches):
        schema = pa.schema([("label", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for labels, texts in rows_of(batches, "label", "text"):
            for one in sorted(set(labels)):
                parts = [ngrams(t) for name, t in zip(labels, texts, strict=True) if name == one]
                grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)
                yield batch_of(schema, [[one] * len(grams), grams, n])

    chosen = learned_from(docs, key, label, sample).select(F.col(label).cast("string").alias("label"), "text")
    counts = chosen.mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.row_number().over(Window.partitionBy("label", F.pmod("gram", F.lit(16))).orderBy(*order))
    cut = counts.withColumn("place", part).filter(F.col("place") <= size)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return cut.withColumn("place", rank).filter(F.col("place") <= size).select("label", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Profiles as one sorted array of n-grams and a row of places for each language."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.labels = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.labels), len(self.grams) + 1), -1, np.int64)  # the last column: in no profile
        for name, gram, rank in rows:
            self.ranks[self.labels.index(name), np.searchsorted(self.grams, gram)] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        top = most_frequent(text, self.size)
        if not len(top) or not self.labels:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        at = np.where(self.grams[at] == top, at, len(self.grams))
        theirs = self.ranks[:, at]
        costs = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(costs.argmin())
        return self.labels[best], float(1.0 - costs[best] / (self.size * len(top)))


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs``; ``learned`` comes from ``profiles``."""
    rows = [tuple(r) for r in learned.select("label", "gram", "rank").collect()]  # bounded: size rows a language

    def run(batches):
        judge = Profiles(rows, size).judge
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores], names=[key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


@register("op4_language_rank_order")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = stored(profiles(docs), "profiles")
    return identify(docs, learned).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
