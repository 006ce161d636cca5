"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on a bounded sample of labelled documents and
flattened into arrays; scoring walks all trees for a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common_words import common_hashes
from tallyflow.llm.docstats import CLASS_NAMES, Statistics, statistics
from tallyflow.llm.textscan import slices

#: Most labelled documents that the trees are fitted on, a bound for the driver.
SAMPLE = 20_000
#: A score of at least this predicts label 1.
THRESHOLD = 0.3


def features(s: Statistics) -> np.ndarray:
    """One row per document; nothing but its text goes in.  Empty documents have zeros."""
    chars = np.maximum(s.classes.sum(axis=1), 1)
    words = np.maximum(s.n_words, 1)
    lines = np.maximum(s.n_lines, 1)
    columns = [
        np.log1p(s.n_words),
        s.word_chars / words,
        s.n_symbols / words,
        s.n_dup_lines / lines,
        s.n_repeat_words / words,
        s.n_distinct_words / words,
        s.n_capital_words / words,
        s.n_words / lines,
        1 - s.commons[:, -1] / words,
        s.commons[:, :-1].max(axis=1) / words,
        *(s.classes / chars[:, None]).T,
    ]
    return np.column_stack(columns).astype(np.float64)


N_FEATURES = 10 + len(CLASS_NAMES)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: arrays by tree and node."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


@dataclass(frozen=True)
class Boosting:
    """Parameters of the fit."""

    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    least_weight: float = 5.0


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points per feature: quantiles, without repetition."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting()) -> Trees:  # noqa: B008
    """Boosted trees for logistic loss; every node takes the best split of its gradient histograms.

    Without rows, or with one label only, the score is the same for all documents.
    """
    inner, leaves = 2**p.depth - 1, 2**p.depth
    rate1 = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate1 / (1 - rate1)))
    feature = np.zeros((p.trees, inner), dtype=np.int64)
    threshold = np.full((p.trees, inner), np.inf)
    leaf = np.zeros((p.trees, leaves))
    if len(np.unique(y)) < 2:
        return Trees(feature, threshold, leaf, start)
    edges = _edges(x, p.bins)
    code = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    n_features = x.shape[1]
    slots = (code + np.arange(n_features) * p.bins).ravel()
    total = np.full(len(y), start)
    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        gradient, weight = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(p.depth):
            first, width = 2**level - 1, 2**level
            key = np.repeat((node - first) * n_features * p.bins, n_features) + slots
            shape = (width, n_features, p.bins)
            g = np.bincount(key, np.repeat(gradient, n_features), width * n_features * p.bins).reshape(shape).cumsum(2)
            h = np.bincount(key, np.repeat(weight, n_features), width * n_features * p.bins).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + p.l2) + (g_all - g) ** 2 / (h_all - h + p.l2) - g_all**2 / (h_all + p.l2)
            gain[(h < p.least_weight) | (h_all - h < p.least_weight)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, cut = divmod(int(best[k]), p.bins)
                if gain[k, f, cut] > 1e-6 and cut < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        place = node - inner
        sums = np.bincount(place, gradient, leaves), np.bincount(place, weight, leaves)
        leaf[t] = p.rate * sums[0] / (sums[1] + p.l2)
        total += leaf[t][place]
    return Trees(feature, threshold, leaf, start)


def held_out(doc_id: F.Column) -> F.Column:
    """True for the fold that no label is learnt from; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts of at most ``sample`` labelled rows outside the held-out fold, the first by a hash of doc_id.

    Rows without doc_id, text or a label of 0 or 1 teach nothing.  A repeated document or
    label row is taken once.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The broadcast side has at most ``sample`` rows of two numbers.
    found = texts.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, p: Boosting = Boosting()) -> Trees:  # noqa: B008
    """Fits the trees; the driver sees features of a bounded sample, never texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1)):
                x = features(statistics(data, offsets, common_hashes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:end],
                        batch.column(2)[row:end],
                        pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "quality", "x"],
                )

    rows = (
        training_rows(docs, labels, sample)
        .select("doc_id", "text", "quality")
        .mapInArrow(run, "doc_id bigint, quality int, x array<double>")
        .toPandas()
        .sort_values("doc_id")
    )
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), N_FEATURES)
    return fit(x, rows["quality"].to_numpy(dtype=np.float64), p)


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``; null and empty texts are scored as empty.

    Existing columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index("text")
    docs = docs.select(kept).withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for row, end, data, offsets in slices(batch.column(at)):
                scores[row:end] = model.score(features(statistics(data, offsets, common_hashes())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
