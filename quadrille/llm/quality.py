"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are gathered in Arrow batches on the executors. Trees are
grown on a bounded sample of labelled rows and flattened into arrays (feature, cut, children,
value), so that scoring is a few numpy steps for all rows of a batch and all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import held_out, lean_batches, materialize

#: Labelled rows that a model is fitted on, at most; the ones with the least hash of the id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 60, 4, 64, 0.2, 1.0, 10
THRESHOLD = 0.3

_SYMBOLS = b"!|#$%&*.,;:?-_/\\=<>[](){}@\"'"
_NAMES = [
    "words", "mean_word", "std_word", "longest_word", "letters", "digits", "upper", "high", "space", "punctuation", *(f"byte_{b}" for b in _SYMBOLS),
    "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines", "mean_line", "lines", "end_mark", "one_letter",
]


def statistics(text: str | None) -> list[float]:
    """The inputs of the model: sizes, shares of bytes, repetition of words, pairs and lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    words = data.split()
    k = len(words)
    if not k:
        return [0.0] * len(_NAMES)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    lengths = np.fromiter(map(len, words), np.int64, k)
    upper, lower, high = share[65:91].sum(), share[97:123].sum(), share[128:].sum()
    space = share[32] + share[9:14].sum()
    digits = share[48:58].sum()
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    letters = upper + lower + high
    return [
        np.log1p(k), lengths.mean(), lengths.std(), np.log1p(lengths.max()), letters, digits, upper / max(letters, 1e-9), high, space,
        1 - letters - digits - space, *share[list(_SYMBOLS)],
        len(counts) / k, len(set(zip(words, words[1:]))) / max(1, k - 1), max(counts.values()) / k,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), np.log1p(len(lines)),
        share[46] * n / k, float((lengths == 1).mean()),
    ]


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(batch.num_rows, len(_NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(_NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i's children are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.value.shape[1]).bit_length() - 1
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosts trees on the logistic loss; splits are searched on histograms of binned features."""
    n, m = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if n < 2 * LEAST_ROWS or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    slot = np.arange(m) * bins
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (m * bins) + slot + binned).ravel()
            hist = [np.bincount(at, weights=np.repeat(w, m), minlength=wide * m * bins).reshape(wide, m, bins) for w in (g, h, np.ones(n))]
            left = [np.cumsum(a, axis=2) for a in hist]
            whole = [a[:, :, -1:] for a in left]
            right = [a - b for a, b in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - whole[0] ** 2 / (whole[1] + L2)
            gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), gain, -1).reshape(wide, -1)
            best = gain.argmax(axis=1)
            for i in range(wide):
                j, b = divmod(int(best[i]), bins)
                if gain[i, best[i]] > 1e-6 and b < len(cuts[j]):
                    model.feature[t, first + i], model.cut[t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        model.value[t] = -RATE * gs / (hs + L2)
        margin += model.value[t][leaf]
    return model


def train_ids(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y) of at most `rows` labelled rows that aren't held out, by hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels: (doc_id, quality 0/1). Only the text is an input. Null and empty texts have
    statistics of zero and a score like any other; without usable labels every score is 0.5.
    Rows that repeat an id are scored each by its own text. A null id is never held out.
    """
    lean_batches(docs.sparkSession)
    stats = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics_of, "doc_id long, x array<double>"), "statistics")
    sample = F.broadcast(train_ids(labels, "quality", train_rows))
    rows = stats.join(sample, "doc_id").select("x", "y").orderBy(F.xxhash64("x", "y"), "x", "y").limit(2 * train_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(rows.num_rows, len(_NAMES))
    model = fit(x, rows.column("y").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(_NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
