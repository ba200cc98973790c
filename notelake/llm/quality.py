"""Operator 5, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy, a megabyte of text at a time. The trees are grown on the driver from a
bounded sample of labelled rows (TRAIN_ROWS, the smallest by a hash of doc_id), whose statistics alone are collected;
they are flattened into arrays that every task walks for a whole batch at once. Labels, lang, source and doc_id are no
inputs of a score.

Defined cases: null text is the empty text, and the empty text has a score; labels that are null are left out of the
training, and a doc_id with several labels counts once for each; without both labels in the sample the score is the
share of label 1 (0.5 without any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import documents
from notelake.llm.vector_text import ngram_hashes, text_chunks, word_hashes, word_spans

#: Labelled rows that the trees are grown from, at most.
TRAIN_ROWS = 20_000
#: A document is accepted from this score on.
ACCEPT = 0.3

_BYTES = np.arange(256)
_between = lambda a, b: (_BYTES >= ord(a)) & (_BYTES <= ord(b))
_in = lambda chars: np.isin(_BYTES, list(chars.encode()))
_UPPER, _LOWER, _DIGIT, _HIGH = _between("A", "Z"), _between("a", "z"), _between("0", "9"), _BYTES >= 128
_SYMBOL, _STOP, _PUNCT = _in("#$%&*@^~_+=<>|\\/"), _in(".?!"), _in("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, _SYMBOL, _PUNCT, _in("!"), _in("|"), _in("\n"), _in(" \t"), _in(",;:"), _in("@/"), _in("*#"), _in("%&$")], axis=1).astype(float)
#: Of the statistics below; for reports.
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "upper_of_letters", "byte_entropy",
    *[f"share_{x}" for x in ("upper", "lower", "digit", "high", "symbol", "punct", "bang", "bar", "newline", "blank", "comma", "at_slash", "star_hash", "percent")],
    "distinct_words", "distinct_pairs", "distinct_fives", "adjacent_repeats", "stop_ends", "doubled_punct_ends", "title_words", "high_words", "plain_words", "words_per_line",
]


def _distinct_share(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys over all keys for each of n documents; 1 where there are none."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    total = np.bincount(doc, minlength=n)
    return np.where(total > 0, np.bincount(d[new], minlength=n) / np.maximum(total, 1), 1.0)


def _mean_by(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) / np.maximum(np.bincount(doc, minlength=n), 1)


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    parts = []
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        size = np.diff(offsets)
        hist = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
        share = hist / np.maximum(size, 1)[:, None]
        classes = share @ _CLASSES
        starts, ends, first = word_spans(data, offsets)
        doc = np.repeat(np.arange(n), np.diff(first))
        lens = (ends - starts).astype(float)
        words = word_hashes(data, starts, ends)
        mean = _mean_by(lens, doc, n)
        same_doc = lambda k: doc[k - 1 :] == doc[: len(doc) - k + 1]
        grams = lambda k: (g[ok], doc[: len(ok)][ok]) if len(g := ngram_hashes(words, k)) and len(ok := same_doc(k)) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        repeat = np.zeros(len(words))
        repeat[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        head, tail = data[starts], data[ends - 1]
        doubled = _PUNCT[tail] & (lens > 1) & (data[np.maximum(ends - 2, 0)] == tail)
        longest = np.zeros(n)
        np.maximum.at(longest, doc, lens)
        count = np.diff(first)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
        parts.append(
            np.column_stack(
                [
                    np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(_mean_by(lens**2, doc, n) - mean**2, 0)), np.log1p(longest), classes[:, 0] / np.maximum(classes[:, 0] + classes[:, 1], 1e-9), entropy,
                    classes, _distinct_share(words, doc, n), _distinct_share(*grams(2), n), _distinct_share(*grams(5), n), _mean_by(repeat, doc, n), _mean_by(_STOP[tail], doc, n), _mean_by(doubled, doc, n),
                    _mean_by(_UPPER[head], doc, n), _mean_by(_HIGH[head], doc, n), _mean_by(_LOWER[tail] | _HIGH[tail], doc, n), np.log1p(count / (1 + hist[:, 10])),
                ]
            )
        )
    return np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is its own child on both sides."""

    base: float
    depth: int
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows walk all trees together, a level at a time."""
        if not len(self.root) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.repeat(self.root[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.cut[at], self.right[at], self.left[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boosted trees on the logistic loss; splits are sought in histograms of gradients over quantile bins."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    f, cut, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), int)  # of the level that is being split, or -1 - id of the leaf
            ids = [len(f)]
            roots.append(len(f))
            f.append(0), cut.append(np.inf), left.append(len(f) - 1), right.append(len(f) - 1), value.append(0.0)
            for level in range(depth + 1):
                k, live = len(ids), node >= 0
                if not k:
                    break
                g_all, h_all = np.bincount(node[live], grad[live], k), np.bincount(node[live], hess[live], k)
                best = [(0.0, -1, 0)] * k
                if level < depth:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        slot = node[live] * bins + binned[live, j]
                        g = np.bincount(slot, grad[live], k * bins).reshape(k, bins).cumsum(axis=1)[:, : len(c)]
                        h = np.bincount(slot, hess[live], k * bins).reshape(k, bins).cumsum(axis=1)[:, : len(c)]
                        gain = g**2 / (h + ridge) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                        gain[(h < least / 4) | (h_all[:, None] - h < least / 4)] = -1
                        for i, b in enumerate(gain.argmax(axis=1)):
                            if gain[i, b] > best[i][0] + 1e-9:
                                best[i] = (gain[i, b], j, int(b))
                after, moved = [], node.copy()
                for i, (_, j, b) in enumerate(best):
                    rows = node == i
                    if j < 0:
                        value[ids[i]] = float(-rate * g_all[i] / (h_all[i] + ridge))
                        moved[rows] = -1 - ids[i]
                        continue
                    f[ids[i]], cut[ids[i]] = j, float(cuts[j][b])
                    up = rows & (binned[:, j] > b)
                    for side, where in ((left, rows & ~up), (right, up)):
                        side[ids[i]] = len(f)
                        moved[where] = len(after)
                        after.append(len(f))
                        f.append(0), cut.append(np.inf), left.append(len(f) - 1), right.append(len(f) - 1), value.append(0.0)
                node, ids = moved, after
            margin += np.array(value)[-1 - node]
    whole = lambda v, t: np.array(v, t)
    return Trees(base, depth, whole(roots, int), whole(f, int), whole(cut, float), whole(left, int), whole(right, int), whole(value, float))


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def training_ids(labels: DataFrame, label: str, held: Column, rows: int) -> DataFrame:
    """At most `rows` labelled doc_ids that are not held out: the smallest by a hash of doc_id."""
    able = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held)
    return able.select("doc_id", F.col(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = document_statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    chosen = F.broadcast(training_ids(labels, "quality", held_out(5, 0), rows))
    sample = docs.join(chosen, "doc_id").select("label", "text").mapInArrow(_statistics_of, "label int, x array<double>").toArrow()
    # the order of rows is no input of the trees
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = sample.column("label").to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit_trees(x[order], y[order])


def _score(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = trees.score(document_statistics(batch.column("text"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n != "score"], pa.array(score, pa.float64())], [*[n for n in batch.schema.names if n != "score"], "score"])

    return run


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with a column score (an own one of that name is replaced)."""
    docs = docs.drop("score")
    return docs.mapInArrow(_score(trees), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trees = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, trees).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
