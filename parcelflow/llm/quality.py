"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares and rates of bytes, words and lines, computed with arrays for a whole slice of
documents.  Trees are grown on quantile bins from a bounded sample of labelled rows, and flattened into
arrays (feature, threshold, children, value) that are walked for all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_view, slices, split_distinct, sums, text_flags
from .storage import small_batches

#: Bound of the labelled rows that are learned from: those of the smallest hashes of doc_id.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.2, 20.0, 1.0
THRESHOLD = 0.3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".,;:", "loud": b"!?", "bar": b"|", "mark": b"#$%&*@^~_=+<>\\/", "quote": b"\"'()[]{}`-"}
FEATURES = ["log_bytes", *(f"share_{c}" for c in _CLASSES), "share_high", "word_bytes", "distinct_words", "loud_words", "distinct_lines", "words_a_line", "capital_words", "longest_word"]


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of each text of an array without nulls, as rows of FEATURES; an empty text has zeros."""
    data, offsets = byte_view(texts)
    size = np.diff(offsets)
    least = np.maximum(size, 1)
    columns = [np.log1p(size)]
    share = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        share[name] = sums(table[data], offsets)
        columns.append(share[name] / least)
    columns.append(sums((data >= 128).view(np.uint8), offsets) / least)

    starts, codes, words = split_distinct(pc.replace_substring(texts, "\n", " "))
    count = np.diff(starts)
    of = np.repeat(np.arange(len(texts)), count)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    columns.append(sums(lengths[codes], starts) / count)
    distinct = np.unique(of * len(words) + codes) // max(1, len(words))
    columns.append(np.bincount(distinct, minlength=len(texts)) / count)
    loud = pc.match_substring_regex(words, r"[!#$%&*|^~]$").to_numpy(zero_copy_only=False)
    columns.append(sums(loud[codes].view(np.uint8), starts) / count)

    lines, line_codes, line_texts = split_distinct(texts, "\n")
    line_count = np.diff(lines)
    distinct = np.unique(np.repeat(np.arange(len(texts)), line_count) * len(line_texts) + line_codes) // max(1, len(line_texts))
    columns.append(np.bincount(distinct, minlength=len(texts)) / line_count)
    columns.append(np.log1p(count / line_count))
    capital = pc.match_substring_regex(words, r"^\p{Lu}").to_numpy(zero_copy_only=False)
    columns.append(sums(capital[codes].view(np.uint8), starts) / count)
    columns.append(np.log1p(np.maximum.reduceat(lengths[codes], starts[:-1])) if len(texts) else np.zeros(0))
    return np.stack(columns, axis=1) * (size > 0)[:, None]


@dataclass
class Trees:
    """Flattened trees: node i sends a row left if its feature is at most the threshold; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Grow trees for labels 0 and 1 by the logistic loss; without both labels the score is a constant."""
    p = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) == 2:
        order = np.lexsort(x.T[::-1])
        x, y = x[order], y[order].astype(float)  # rows come in any order; the trees don't depend on it
        edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        total, n_features = np.full(len(y), base), x.shape[1]
        for _ in range(ROUNDS):
            prob = 1 / (1 + np.exp(-total))
            grad, hess = y - prob, prob * (1 - prob)
            at = np.full(len(y), len(nodes))
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            level = [roots[-1]]
            for depth in range(DEPTH):
                below = []
                for node in level:
                    rows = np.flatnonzero(at == node)
                    g, h, b = grad[rows], hess[rows], binned[rows]
                    key = (b + np.arange(n_features) * BINS).ravel()
                    hg = np.bincount(key, np.repeat(g, n_features), n_features * BINS).reshape(n_features, BINS).cumsum(axis=1)
                    hh = np.bincount(key, np.repeat(h, n_features), n_features * BINS).reshape(n_features, BINS).cumsum(axis=1)
                    hn = np.bincount(key, minlength=n_features * BINS).reshape(n_features, BINS).cumsum(axis=1)
                    sg, sh, sn = g.sum(), h.sum(), len(rows)
                    gain = hg**2 / (hh + RIDGE) + (sg - hg) ** 2 / (sh - hh + RIDGE) - sg**2 / (sh + RIDGE)
                    gain[(hn < LEAST) | (sn - hn < LEAST)] = -1
                    f, cut = divmod(int(gain.argmax()), BINS)
                    if gain[f, cut] <= 1e-9 or cut >= len(edges[f]):
                        continue
                    left, right = len(nodes), len(nodes) + 1
                    nodes[node][:4] = [f, edges[f][cut], left, right]
                    nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                    at[rows] = np.where(b[:, f] <= cut, left, right)
                    below += [left, right]
                level = below
            leaves = np.unique(at)
            for leaf in leaves.tolist():
                rows = at == leaf
                nodes[leaf][4] = RATE * float(grad[rows].sum() / (hess[rows].sum() + RIDGE))
                total[rows] += nodes[leaf][4]
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(base, np.array(roots, np.int64), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows whose crc32(doc_id as text) mod 5 isn't 0.

    Of those, the ``sample`` ids with the smallest hashes are learned from: the sample is bounded, so its
    ids can be broadcast and its statistics collected.  Null ids and labels don't count; of repeated
    labels or documents one does.  Without labels the score is 0.5 for all.
    """
    marked = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    marked = marked.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2):
            x = features(part.column(2))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = texts.mapInArrow(run, "doc_id bigint, quality int, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    return fit(np.stack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES))), rows["quality"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD).

    Only the text goes into a score; a null or empty text has zero statistics and a score as any other.
    Null ids are not held out; repeated rows are kept; other columns are not read.
    """
    small_batches(docs.sparkSession)
    trees = train(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2):
            score = trees.score(features(part.column(2)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, whole, whose predicted quality is 1, in one pass after the training.

    A null or empty text is scored like any other.  Only the texts go to Python, and only flags come back.
    """
    small_batches(docs.sparkSession)
    trees = train(docs, labels, id_col, text_col)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keep in text_flags(batches, lambda texts: trees.score(features(texts)) >= THRESHOLD):
            yield keep

    return docs.where(good(docs[text_col]))
