"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal.

A document becomes ``len(STATISTICS)`` numbers: lengths, shares of kinds of bytes, repetition of words, word pairs and lines.
The trees are grown level by level on binned statistics: a level's histograms of gradients are one weighted count over
(node, statistic, bin), and each node takes the split of the largest gain.  Trees are complete and of one depth, so all
of them lie in two-dimensional arrays, and a batch of documents goes down all trees at once, one level at a time.

Labels are learned only from rows that are not held out, of those from at most ``TRAIN_ROWS`` with the smallest hashes:
the statistics of these rows, and nothing else, go to the driver.  Every row's score follows from its text alone.

Defined cases: a null or empty text has statistics of 0; rows without a label and labels without a row are not learned
from; of repeated labels of one id the best counts, and repeated rows of a labelled id are learned from as they come;
without labels of both kinds, every score is the share of good rows, or 0; an empty table gives an empty result; other
columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamarack.llm.common import documents, slices

TRAIN_ROWS, HELD_OUT_OF = 20_000, 5
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.1, 1.0, 1.0
THRESHOLD = 0.3

STATISTICS = (
    "bytes", "words", "lines", "lower", "upper", "digits", "stops", "symbols", "blanks", "other_bytes",
    "word_length", "longest_word", "distinct_words", "commonest_word", "ten_commonest", "distinct_pairs", "same_next", "upper_words", "short_words",
    "distinct_lines", "short_lines", "line_length", "words_a_stop", "single_letters",
)

#: Kinds of bytes, in the order of their statistics.
_KINDS = np.zeros((256, 7))
for _c in range(256):
    _k = chr(_c)
    _KINDS[_c, 6 if _c > 127 else 0 if _k.islower() else 1 if _k.isupper() else 2 if _k.isdigit() else 5 if _k.isspace() else 3 if _k in ".,;:!?'\"()-" else 4] = 1.0


def statistics(text: str | None) -> np.ndarray:
    """The numbers of one whole text, as ``STATISTICS`` names them."""
    out = np.zeros(len(STATISTICS))
    data = (text or "").encode("utf-8", "surrogatepass")
    w = data.split()
    if not w:
        return out
    kinds = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _KINDS
    n, lines = len(w), [x for x in data.split(b"\n") if x.strip()]
    length, counts = np.fromiter(map(len, w), dtype=np.int64, count=n), Counter(w)
    top = [k for _, k in counts.most_common(10)]
    out[:3] = np.log1p([len(data), n, len(lines)])
    out[3:10] = kinds / len(data)
    out[10:12] = length.mean(), np.log1p(length.max())
    out[12:16] = len(counts) / n, top[0] / n, sum(top) / n, len(set(zip(w, w[1:]))) / max(1, n - 1)
    out[16:19] = sum(map(eq, w, w[1:])) / n, sum(map(bytes.isupper, w)) / n, (length < 4).mean()
    out[19:22] = len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), np.log1p(len(data) / len(lines))
    out[22:] = n / (1.0 + kinds[3]), (length == 1).mean()
    return out


class Trees:
    """Boosted trees as arrays: ``feature`` and ``threshold`` by tree and inner node, ``value`` by tree and leaf.

    Node k has the children 2k + 1 and 2k + 2; values above the threshold go to the second.  A node without a split has
    an infinite threshold.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values for rows of statistics: all rows in all trees go down a level at once."""
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(tree)), dtype=np.int64)
        inner = self.feature.shape[1]
        while inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            inner >>= 1
        return self.start + self.value[tree, node - self.feature.shape[1]].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each statistic's bins: its quantiles, each value once."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float = RIDGE, least: float = LEAST_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For histograms by (node, statistic, bin): each node's statistic, bin and gain; what is in the bin or below goes left."""
    gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    gt, ht = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, 0.0).reshape(len(g), -1)
    at = gain.argmax(axis=1)
    return at // gl.shape[2], at % gl.shape[2], gain[np.arange(len(g)), at]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees for label 1 by logistic loss; the same rows in the same order give the same trees."""
    n, k = x.shape
    edges = bin_edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    margin, cells = np.full(n, start), np.arange(k) * bins + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        gs, hs = np.repeat(g, k), np.repeat(h, k)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + cells).ravel()
            hist = [np.bincount(at, weights=v, minlength=width * k * bins).reshape(width, k, bins) for v in (gs, hs)]
            f, b, gain = best_splits(*hist)
            limit = np.array([edges[i][j] if j < len(edges[i]) else np.inf for i, j in zip(f, b)])
            split = gain > 1e-9
            feature[t, first : first + width] = np.where(split, f, 0)
            threshold[t, first : first + width] = np.where(split, limit, np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + RIDGE)
        margin += value[t, leaf]
    return Trees(feature, threshold, value, start)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == 0
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(~held).withColumn("k", F.xxhash64("doc_id")).orderBy("k", "doc_id").limit(train_rows).select(F.col("doc_id").alias("of"), "y", "k")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t).tolist() for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), x], names=["k", "y", "x"])

    # at most train_rows ids are sent out; what comes back is their rows' statistics
    sample = d.join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("k", "y", "text").mapInArrow(measured, "k long, y int, x array<double>")
    rows = sorted((r["k"], r["y"], *r["x"]) for r in sample.orderBy("k").limit(train_rows).collect())
    y = np.array([r[1] for r in rows], dtype=float)
    base = float(y.mean()) if rows else 0.0
    model = docs.sparkSession.sparkContext.broadcast(fit(np.array([r[2:] for r in rows]), y) if 0 < base < 1 else None)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for part in slices([batch]):
                x = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
                score = trees.scores(x) if trees else np.full(len(x), base)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = d.mapInArrow(scored, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
