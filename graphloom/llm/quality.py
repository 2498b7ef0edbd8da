"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are; only those of a bounded sample of
labelled rows reach the driver, where the trees are fitted.  The fitted trees
are flattened into arrays, and a batch of documents walks all of them at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, column

#: Labelled rows that a fit reads at most (those whose hashed id is smallest).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.2, 1.0, 8
#: Bytes that have a share of their own among the statistics.
MARKS = b"%*#&$|!.,\"=/\\<>{}[]()@+-_:;?'"
STATISTICS = ["log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "space", "newline", "high", "control", *(f"byte_{m}" for m in MARKS), "word_length", "longest_word", "distinct_words", "repeated_next", "top_word", "distinct_lines", "line_words"]


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all zero if it is empty."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    seen = Counter(words)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        share[97:123].sum(), share[65:91].sum(), share[48:58].sum(), share[32], share[10], share[128:].sum(), share[:9].sum() + share[11:32].sum(),
        *share[list(MARKS)],
        (n - counts[32] - counts[10]) / k, max(map(len, words), default=0), len(seen) / k,
        sum(map(eq, words, words[1:])) / k, max(seen.values(), default=0) / k, len(set(lines)) / len(lines), k / len(lines),
    ]


def statistics_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    rows = [statistics(t) for t in bytes_of(batch, name)]
    return np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))


@dataclass
class FlatTrees:
    """All trees in five arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # (nodes, 2)
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.tile(self.roots, (len(x), 1))
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = self.child[at, (x[rows, self.feature[at]] > self.threshold[at]).astype(np.int8)]
            total += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> FlatTrees:
    """Boosted trees for the logistic loss.  Without rows the score is 0.5;
    with a single class it is that class's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    roots, feature, threshold, child, value = [], [], [], [], []
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        features = x.shape[1]
        cells = binned + np.arange(features) * BINS
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, depth: int, g: np.ndarray, h: np.ndarray) -> int:
            node = len(value)
            feature.append(0), threshold.append(np.inf), child.append([node, node])
            value.append(-RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
            if depth == DEPTH or len(rows) < 2 * LEAST:
                return node
            flat = cells[rows].ravel()
            size = features * BINS
            left = [np.cumsum(np.bincount(flat, w, size).reshape(features, BINS), axis=1) for w in (np.repeat(g[rows], features), np.repeat(h[rows], features), None)]
            (gl, hl, nl), (gt, ht) = left, (g[rows].sum(), h[rows].sum())
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                return node
            feature[node], threshold[node] = int(f), float(edges[f][b])
            goes = binned[rows, f] <= b
            child[node] = [grow(rows[goes], depth + 1, g, h), grow(rows[~goes], depth + 1, g, h)]
            return node

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), 0, p - y, np.maximum(p * (1 - p), 1e-9)))
            tree = FlatTrees(0.0, np.array(roots[-1:]), np.array(feature), np.array(threshold), np.array(child), np.array(value))
            s = tree.score(x)
            margin += np.log(s / (1 - s))
    return FlatTrees(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(child, np.int64).reshape(-1, 2), np.array(value))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may read: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FlatTrees:
    """Fit on at most ``sample_rows`` rows of ``labels(doc_id, quality)`` that
    are not held out, null labels and ids aside."""
    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids and labels: some hundred kB
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch, "text")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # a repeated id gives repeated rows; the limit holds for them too
    got = rows.mapInArrow(run, f"doc_id {kind}, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), F.to_json(F.struct("x"))).limit(sample_rows).collect()
    x = np.array([r.x for r in got]).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r.quality for r in got], np.float64))


def score(docs: DataFrame, model: FlatTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; null texts count as
    empty, repeats stay, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(model.score(statistics_of(batch, "text")))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FlatTrees, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics_of(batch, "text")) >= least))

    return docs.mapInArrow(run, docs.schema)
