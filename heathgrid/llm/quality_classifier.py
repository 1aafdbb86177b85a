"""A supervised classifier of texts on subword embeddings.

Each white-space word, each pair of neighbouring words and each run of 3 and 4 bytes hashes to a learned vector. A document's vector is
the mean of them all, kind by kind, and a softmax over its products with two learned class vectors gives the score.
Vectors and classes are trained together by stochastic gradient descent in numpy.

The softmax reads a document's vector only through the difference of the class vectors. Scoring
therefore carries, for every bucket, the product of its vector and that difference, and averages the
products: the same numbers as averaging vectors first, in one vector pass over the bytes.

Labels come from at most `most` rows, those with the smallest hashes of doc_id, of the rows that the
training condition allows; every text of the corpus is scored.

Defined cases: null and empty texts score by the bias alone; labels without a document, and null
labels, teach nothing; without any usable label of both classes every text scores 0.5; a document with
several labels teaches each of them; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.byte_features import WHITE, grams, hashes, mixed, per_text, spans
from heathgrid.llm.common import bytes_of, slices

WORD_BITS, PAIR_BITS, GRAM_BITS, SIZES, WIDTH = 16, 15, 15, (3, 4), 10
#: Buckets of words and n-grams; those of pairs of words follow.
GRAMS = (1 << WORD_BITS) + (len(SIZES) << GRAM_BITS)
#: Words, pairs and each size of n-gram: a text's vector is the mean of the kinds' means, as else the many n-grams would drown the rest.
KINDS = 2 + len(SIZES)
#: The most labelled rows that training reads.
SAMPLE = 4000
#: Training goes over the sample so many times at least, and more often over a small one, up to so many steps.
PASSES, STEPS, RATE = 5, 10_000, 2.0


def buckets(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of the words, of the pairs of words, and of the n-grams of each size that cross no text's border.

    A pair's hash is a difference, so that all pairs of equal words, whatever the word, are one feature.
    """
    starts, ends = spans(flat, offsets, ~WHITE)
    words = hashes(flat, starts, ends)
    yield starts, (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    within = np.ones(max(len(starts) - 1, 0), dtype=bool)
    first = np.searchsorted(starts, offsets[1:-1])
    within[first[(first > 0) & (first < len(starts))] - 1] = False
    pairs = np.flatnonzero(within)
    yield starts[pairs], (mixed(words[pairs] - words[pairs + 1]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + GRAMS
    for k, size in enumerate(SIZES):
        found = (grams(flat, size) >> np.uint64(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS) + (k << GRAM_BITS)
        within = np.ones(len(found), dtype=bool)
        for j in range(1, size):
            cross = offsets[1:-1] - j
            within[cross[(cross >= 0) & (cross < len(found))]] = False
        places = np.flatnonzero(within)
        yield places, found[places]


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, for class 1 against class 0
    bias: float

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        for places, found in buckets(flat, offsets):
            sums, count = per_text(self.weights[found], places, offsets)
            total += sums / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(total / KINDS + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    n_buckets = GRAMS + (1 << PAIR_BITS)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(n_buckets, dtype=np.float32), 0.0)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (n_buckets, WIDTH)).astype(np.float32)
    classes = np.zeros((2, WIDTH), dtype=np.float32)
    classes[1, 0], classes[0, 0] = 0.1, -0.1
    bias = np.zeros(2)
    docs = []
    for text in texts:
        flat, offsets = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])
        kinds = [np.unique(x, return_counts=True) for _, x in buckets(flat, offsets)]
        docs.append((np.concatenate([x for x, _ in kinds]), np.concatenate([n / max(1, n.sum()) / KINDS for _, n in kinds]).astype(np.float32)))
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # the rarer class counts as much as the other
    passes = max(PASSES, STEPS // len(docs))
    for turn in range(passes):
        rate = RATE * (1 - turn / passes)
        for i in rng.permutation(len(docs)):
            found, share = docs[i]
            mean = share @ vectors[found]
            logits = classes @ mean + bias
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[y[i]] -= 1
            slope *= min(weight[y[i]], 5.0)
            back = slope @ classes
            classes -= rate * 0.1 * np.outer(slope, mean).astype(np.float32)
            bias -= rate * 0.02 * slope
            # a mean over thousands of vectors moves each of them by little: scale the step by the share's size
            vectors[found] -= (rate * share / max(float((share * share).sum()), 1e-4) * 0.1)[:, None] * back.astype(np.float32)
    return Model(vectors @ (classes[1] - classes[0]), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, most: int = SAMPLE) -> DataFrame:
    """text and label of at most `most` labelled rows for which `allowed`, a condition on doc_id, holds."""
    own = labels.where(allowed & F.col(column).isNotNull()).select("doc_id", F.col(column).cast("int").alias("label"))
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, most: int = SAMPLE) -> Model:
    rows = sorted((r.doc_id, r.text, r.label) for r in sample(docs, labels, column, allowed, most).toLocalIterator())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the model's size doesn't depend on the data."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = held.value.score(*bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
