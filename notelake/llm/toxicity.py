"""Operator 10, toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams (3 to 6, with a mark at both ends) and of itself, each hashed to a row of an
embedding table; its vector is their mean, so that an unseen misspelling shares most of a known word's rows. A bag of
SPAN words is averaged and goes into a softmax over the two classes. A document's score is that of its worst bag, so that
a few words count in a long text as much as in a short one: in training all bags of a clean document are clean, and
of a toxic one the worst is toxic.

The model is trained on the driver from a bounded sample of labelled rows (TRAIN_ROWS, a third of them toxic if there
are so many, the smallest by a hash of doc_id), whole texts. Table, softmax and bias follow their own gradients, jointly, by
full batches with AdaGrad steps from a small random start; a row of the table is drawn back to zero by as much as
DOUBT toxic bags pull, less in each round and not at all in the end, so that rows which few documents share learn
nothing by heart. As the softmax has two
classes and all is linear before it, a task needs the product of table and softmax only, one number for each row: a
word's are looked up and averaged in numpy, over whole texts. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null text is the empty text; a text without words gets the score of an empty bag; labels that are null
are left out of the training, and a doc_id with several labels counts once for each; without both labels in the
sample the score is the share of label 1 (0.5 without any); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import LOWER, UPPER, documents
from notelake.llm.quality import held_out, training_ids
from notelake.llm.vector_text import CHUNK_BYTES, mix, word_hashes, word_spans

TRAIN_ROWS = 4_500
#: A document counts as toxic from this score on.
TOXIC = 0.3
#: Words in a bag.
SPAN = 12
#: Full-batch steps, their length for table and softmax, and the pull (in toxic bags) that a row of the table has to exceed.
ROUNDS, RATE, DOUBT = 100, 4.0, 1.0
#: How far a toxic document's label goes to its worst bags in the end: the exponent of their odds.
SHARPER = 1.0
ROWS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5, 6)
#: A-Z to lower case, control characters and ASCII punctuation to a space; digits stay, as they stand for letters in misspellings.
_PLAIN = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets): texts in plain letters, each with a space before and after it."""
    held, size = [], 0
    for value in column:
        raw = b" " + (value.as_py() or "").encode().translate(_PLAIN) + b" "
        if held and size + len(raw) > CHUNK_BYTES:
            yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, row of the table) arrays, one pair for each size of n-gram and one for the words themselves."""
    yield np.arange(len(starts)), (word_hashes(data, starts, ends) & np.uint64(ROWS - 1)).astype(np.int64)
    letters = data.astype(np.uint64) + np.uint64(1)
    word_at = np.cumsum(np.bincount(starts, minlength=len(data))) - 1  # the word that a byte is in
    space = (data == 32).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(space)])
    key = letters[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[1:]
    for n in range(3, max(GRAMS) + 1):
        if len(data) < n:
            return
        key = key[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + letters[n - 1 :]
        if n not in GRAMS:
            continue
        inner = before[n - 1 : len(data)] - before[1 : len(data) - n + 2]
        at = np.flatnonzero(inner == 0)
        yield word_at[at + 1], (mix(key[at] + np.uint64(n)) & np.uint64(ROWS - 1)).astype(np.int64)


def bags(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each bag, document of each bag) for texts that begin at the given words; none for an empty text."""
    counts = np.diff(first)
    number = -(-counts // SPAN)
    doc = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    return first[doc] + place * SPAN, doc


@dataclass
class Toxicity:
    row: np.ndarray  # what a row of the table adds to the difference of the two classes
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for data, offsets in plain_chunks(column):
            starts, ends, first = word_spans(data, offsets)
            total, number = np.zeros(len(starts)), np.zeros(len(starts))
            if len(starts):
                for word, row in subwords(data, starts, ends):
                    total += np.bincount(word, self.row[row], len(starts))
                    number += np.bincount(word, minlength=len(starts))
            worst = np.zeros(len(offsets) - 1)
            begin, doc = bags(first)
            if len(begin):
                mean = np.add.reduceat(total / np.maximum(number, 1), begin) / np.diff(np.append(begin, len(starts)))
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                worst[doc[edge]] = np.maximum.reduceat(mean, edge)
            out.append(1 / (1 + np.exp(-(worst + self.bias))))
        return np.concatenate(out) if out else np.empty(0)


def fit(column: pa.Array, label: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, doubt: float = DOUBT, seed: int = 7) -> Toxicity:
    """Gradient descent on table and softmax together; words are embedded once each."""
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
    if not len(label) or label.min() == label.max():
        return Toxicity(np.zeros(ROWS), float(np.log(share / (1 - share))))
    keys, firsts, spelled = [], [], {}
    for data, offsets in plain_chunks(column):
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        keys.append(h)
        firsts.append(np.diff(first))
        known, where = np.unique(h, return_index=True)
        for k, w in zip(known.tolist(), where.tolist()):
            if k not in spelled:
                spelled[k] = data[starts[w] : ends[w]].tobytes()
    vocabulary, occurs = np.unique(np.concatenate(keys), return_inverse=True)
    one = np.frombuffer(b" " + b" ".join(spelled[k] for k in vocabulary.tolist()) + b" ", np.uint8)
    starts, ends, _ = word_spans(one, np.array([0, len(one)]))
    pairs = list(subwords(one, starts, ends))
    word, gram = (np.concatenate([p[i].astype(np.int32) for p in pairs]) for i in (0, 1))
    used, gram = np.unique(gram, return_inverse=True)  # the rows that these texts reach; the others stay at zero
    gram = gram.astype(np.int32)
    del pairs, spelled
    number = np.bincount(word, minlength=len(vocabulary)).astype(float)
    begin, doc = bags(np.concatenate([[0], np.cumsum(np.concatenate(firsts))]))
    size = np.diff(np.append(begin, len(occurs))).astype(float)
    bag = np.repeat(np.arange(len(begin), dtype=np.int32), size.astype(int))
    occurs = occurs.astype(np.int32)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    toxic = label[doc] == 1

    rng = np.random.default_rng(seed)
    table, out = rng.uniform(-0.01, 0.01, (len(used), DIM)), rng.uniform(-1, 1, (2, DIM))
    bias = np.log([1 - share, share])
    bags_of = np.diff(np.append(edge, len(doc)))
    all_bags = np.repeat(1.0 / bags_of, bags_of)
    one_bag = 1 / (SPAN * number.mean())  # what a toxic bag pulls at a row
    table_square, out_square = np.full(len(used), 1e-12), np.full(2, 1e-12)
    for turn in range(rounds):
        gap = out[1] - out[0]
        words = np.bincount(word, (table @ gap)[gram], len(vocabulary)) / number
        logit = np.add.reduceat(words[occurs], begin) / size + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        top = np.repeat(np.maximum.reduceat(logit, edge), bags_of)
        # which bags make a document toxic is not known: at first they share its label evenly, then by their odds
        odds = np.exp(np.maximum(logit - top, -60) * (SHARPER * turn / rounds))
        odds /= np.repeat(np.add.reduceat(odds, edge), bags_of)
        weight = np.where(toxic, odds, all_bags + (logit >= top))
        g = weight * (p - toxic)
        by_word = np.bincount(occurs, (g / size)[bag], len(vocabulary)) / number
        by_row = np.bincount(gram, by_word[word], len(used))
        # the gradients: of a row of the table by_row * gap, of the softmax by_row @ table for toxic and its negative for clean
        of_out, norm = by_row @ table, np.linalg.norm(gap)
        table_square += (by_row * norm) ** 2
        step = rate / np.sqrt(table_square)
        table -= (step * by_row)[:, None] * gap
        length = np.linalg.norm(table, axis=1)
        table *= np.maximum(0, 1 - step * doubt * (1 - turn / rounds) * one_bag * norm / np.maximum(length, 1e-12))[:, None]
        out_square += of_out @ of_out
        out += np.stack([of_out, -of_out]) * (0.1 * rate / np.sqrt(out_square))[:, None]
        shift = 0.1 * g.sum() / weight.sum()
        bias += np.array([shift, -shift])
    row = np.zeros(ROWS)
    row[used] = table @ (out[1] - out[0])
    return Toxicity(row, float(bias[1] - bias[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Toxicity:
    one = training_ids(labels.where(F.col("toxic") == 1), "toxic", held_out(4, 2), rows // 3)
    zero = training_ids(labels.where(F.col("toxic") == 0), "toxic", held_out(4, 2), rows - rows // 3)
    chosen = F.broadcast(one.unionByName(zero))
    sample = docs.join(chosen, "doc_id").select("label", "text").toArrow()
    sample = sample.sort_by([("text", "ascending"), ("label", "ascending")]).combine_chunks()  # the order of rows is no input
    texts = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    return fit(texts, sample.column("label").to_numpy().astype(int))


def _score(model: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "score"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(model.score(batch.column("text")), pa.float64())], [*kept, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs with a column score (an own one of that name is replaced)."""
    docs = docs.drop("score")
    return docs.mapInArrow(_score(model), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
