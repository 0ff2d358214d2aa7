"""Quality scores by histogram gradient-boosted trees over statistics of a text.

Statistics of every whole text are worked out once, in tasks, and stored. Trees are fitted on the
driver on a bounded sample: ``SAMPLE`` labelled rows at most, the first in the order of a hash of
the id over all labelled rows that are not held out. Fitting sees statistics only. The trees become
flat arrays, and all rows of a batch walk through all trees together.

Defined results: null and empty texts have statistics of zero length and are scored like others; a
null label teaches nothing; with no labelled rows at all every score is 0.5, with one class only it
is near that class; repeated rows give repeated results; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import held_out, stored, table, uniform
from parlance.llm.registry import register

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST = 20_000, 80, 4, 64, 0.15, 20
THRESHOLD = 0.3
_MARKS = b".,!?|#$%&*:;\"'-_/<>{}()[]@=+~^\\"


def statistics(text: str | None) -> np.ndarray:
    """About fifty numbers that describe a whole text."""
    raw = (text or "").encode()
    size = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    share = seen[seen > 0] / size
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / n,
            (max(counts.values()) if counts else 0) / n, upper / size, lower / size, upper / max(upper + lower, 1), seen[48:58].sum() / size,
            seen[32] / size, seen[10] / size, seen[128:].sum() / size, seen[:32].sum() / size, len(lines) / n, len(set(lines)) / max(len(lines), 1),
            np.log1p(max(map(len, lines), default=0)), float(-(share * np.log2(share)).sum()), sum(map(bytes.isupper, words)) / n,
            sum(map(bytes.istitle, words)) / n, sum(map(bytes.isalpha, words)) / n, sum(map(bytes.isdigit, words)) / n,
            *(seen[list(_MARKS)] / n),
        ],
        np.float32,
    )


def with_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stats array<float>) of every row."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=[key, "stats"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, stats array<float>")


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: node i has the children 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # (trees, inner nodes): left if value <= limit
    value: np.ndarray  # (trees, leaves)

    def score(self, stats: np.ndarray) -> np.ndarray:
        total = np.full(len(stats), self.start)
        if len(self.feature):
            trees, inner = np.arange(len(self.feature)), self.feature.shape[1]
            node = np.zeros((len(stats), len(trees)), np.int64)
            rows = np.arange(len(stats))[:, None]
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (stats[rows, self.feature[trees, node]] > self.limit[trees, node])
            total = total + self.value[trees, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    stats: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST
) -> Trees:
    """Boosted trees for 0/1 labels: logistic loss, second-order gains, histograms over ``bins`` bins."""
    inner = (1 << depth) - 1
    none = np.zeros((0, inner))
    if not len(labels):
        return Trees(0.0, none.astype(np.int64), none, np.zeros((0, inner + 1)))
    mean = np.clip(labels.mean(), 0.01, 0.99)
    start = float(np.log(mean / (1 - mean)))
    if labels.min() == labels.max():
        return Trees(start, none.astype(np.int64), none, np.zeros((0, inner + 1)))
    columns = stats.shape[1]
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(columns)]
    binned = np.stack([np.searchsorted(e, stats[:, f], "left") for f, e in enumerate(edges)], axis=1)
    offsets = np.arange(columns) * bins
    flat = binned + offsets
    raw = np.full(len(labels), start)
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    usable = np.zeros((columns, bins), bool)
    for f, e in enumerate(edges):
        usable[f, : len(e)] = True
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - labels, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (columns * bins) + flat).ravel()
            shape = (width, columns, bins)
            g, h, c = (
                np.bincount(at, np.repeat(w, columns), width * columns * bins).reshape(shape).cumsum(axis=2)
                for w in (grad, hess, np.ones(len(labels)))
            )
            gt, ht, ct = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            gain = np.where(usable & (c >= least) & (ct - c >= least), gain, 0.0).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                if gain[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), bins)
                    feature[t, first + k], limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (stats[np.arange(len(labels)), feature[t, node]] > limit[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        raw += value[t, leaf]
    return Trees(start, feature, limit, value)


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows that are not held out."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("label"))
    # a fifth more than wanted by a threshold on the hash, so that few rows meet where the first are taken
    place = uniform(key, F.lit("quality"))
    share = min(1.0, 1.2 * sample / max(known.count(), 1))
    near = stats.join(known.filter(place <= share), key)
    drawn = near.orderBy(place, "label", key).limit(sample).select("stats", "label")
    rows = drawn.collect()
    return fit(np.array([r.stats for r in rows], np.float32), np.array([r.label for r in rows], np.float64))


def scored(stats: DataFrame, trees: Trees, key: str = "doc_id") -> DataFrame:
    """(key, score) of rows that have statistics."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(values))], names=[key, "score"])

    return stats.select(key, "stats").mapInArrow(run, f"{key} {dict(stats.dtypes)[key]}, score double")


@register("op2_quality_trees")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    trees = learn(stats, table(spark, sf_dir, "labels"))
    return scored(stats, trees).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
