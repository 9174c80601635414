"""Quality classifier (operator 3): supervised subword embeddings.

A text is the average of learned vectors of its words, of its pairs of consecutive words, and
of its character n-grams (blanks included, so they mark word ends), all hashed to ``BUCKETS``
rows; a softmax over two classes reads that average. Vectors and weights are trained together
by stochastic gradient descent in numpy, one document at a time.

Beside these learned n-grams one pair feature is made by hand: all pairs of a word and the same
word again share the bucket ``SAME``, since a hashed pair says nothing of other words that are
repeated. ``repeats=False`` leaves it out; README gives the held-out accuracy with and without.

The sample that is trained on is bounded: at most ``sample`` labelled documents of each class,
those with the smallest hashes of their ids, by default 1500; each counts for as many as its
class has, so scores keep the shares of the labels. Everything else covers all rows. Training
sees the text and the label alone.

As the model is linear in a document's features, a trained model is one number per bucket:
scoring is one pass without a shuffle, over whole texts, with a table of fixed size broadcast.

Null and empty texts have no features and get the score of the bias. Labels that are null or
of unknown documents are not used; of labels that repeat a document the smallest counts. With
labels of one class or none, every score is the share of label 1 (0.5 without labels). Rows
that repeat an id are scored each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.llm.common import blocks, extended, gram_hashes, stored, texts, without, word_hashes

BITS, GRAMS, DIMENSION = 17, (3, 4), 8
BUCKETS = 1 << BITS
#: Numbers of consecutive words whose hash is a feature.
WORD_GRAMS = (1, 2)
#: Bucket of a pair of equal words.
SAME = 1
SAMPLE, EPOCHS, RATE, SEED = 1500, 12, 1.0, 7
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Log-odds that each bucket adds to the average, and those of a text without features."""

    weights: np.ndarray
    bias: float
    repeats: bool = True


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 text, its bytes side by side, and the index of each row's first character."""
    first = (data & 0xC0) != 0x80
    if first.all():
        return data.astype(np.uint32), offsets
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(data)))
    out = data[starts].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(sizes > j)
        out[more] |= data[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out, np.searchsorted(starts, offsets)


def _grams(characters: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the ``n`` characters from each position on; grams cross rows."""
    if len(characters) < n:
        return np.zeros(0, np.uint32)
    x = np.full(len(characters) - n + 1, n, np.uint32)
    for j in range(n):
        x = (x ^ characters[j:len(characters) - n + 1 + j]) * np.uint32(0x01000193)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - BITS)


def _families(data: np.ndarray, offsets: np.ndarray, repeats: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of each kind of feature of a block, and the bounds of each row's own ones among them."""
    hashes, first = word_hashes(data, offsets)
    for n in WORD_GRAMS:
        found = hashes if n == 1 else gram_hashes(hashes, n, n)
        yield (found >> np.uint64(64 - BITS)).astype(np.uint32), *_bounds(first, n, len(found))
    if repeats and len(hashes):
        same = hashes[1:] == hashes[:-1]
        low, high = _bounds(first, 2, len(same))
        before = np.concatenate([[0], np.cumsum(same)])
        yield np.full(before[-1], SAME, np.uint32), before[low], before[high]
    characters, first = _characters(data, offsets)
    for n in GRAMS:
        found = _grams(characters, n)
        yield found, *_bounds(first, n, len(found))


def _bounds(first: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams of ``n`` that lie in one row start and end."""
    low = np.minimum(first[:-1], size)
    return low, np.maximum(np.minimum(first[1:] - n + 1, size), low)


def _features(batches: Iterator[pa.RecordBatch], repeats: bool) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text and how often each occurs."""
    for rows, data, offsets in blocks(batches):
        families = list(_families(data, offsets, repeats))
        found = [np.unique(np.concatenate([buckets[low[k]:high[k]] for buckets, low, high in families]), return_counts=True)
                 for k in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([
            rows.column(0), rows.column(2),
            pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()),
            pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], names=["doc_id", "label", "buckets", "counts"])


def _train(rows: list[tuple[int, np.ndarray, np.ndarray]], weight: dict[int, float], epochs: int, rate: float, seed: int, repeats: bool) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMENSION, 1.0 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, buckets, share = rows[k]
            mean = share @ vectors[buckets]
            logits = mean @ output + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1.0
            error *= np.float32(weight[label] * rate * (1.0 - step / steps))
            back = output @ error
            output -= np.outer(mean, error)
            bias -= error * 0.1
            # Shares sum to one over thousands of buckets; scaled so that frequent buckets move as far as the output does.
            vectors[buckets] -= np.outer(share * np.float32(10.0), back)
            step += 1
    difference = output[:, 1] - output[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]), repeats)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED,
          repeats: bool = True) -> Model:
    """A model of ``labels (doc_id, label)``, labels 0 or 1, fitted on a bounded sample of them."""
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    labels = stored(labels.join(ids, "doc_id", "left_semi"), "labels")
    count = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if len(count) < 2:
        share = next(iter(count)) if count else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))), repeats)
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = [labels.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids: small enough to broadcast whatever the corpus.
    picked = texts(docs).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    found = stored(picked.mapInArrow(lambda batches: _features(batches, repeats), "doc_id long, label int, buckets binary, counts binary"), "features")
    by_id = {}
    for row in found.toLocalIterator():  # a row at a time: the driver keeps the arrays only
        counts = np.frombuffer(row["counts"], "<u4").astype(np.float32)
        if len(counts) and row["doc_id"] not in by_id:
            by_id[row["doc_id"]] = row["label"], np.frombuffer(row["buckets"], "<u4"), counts / counts.sum()
    rows = [by_id[k] for k in sorted(by_id)]
    used = {k: sum(1 for r in rows if r[0] == k) for k in (0, 1)}
    total = sum(count.values())
    weight = {k: count[k] / total * sum(used.values()) / max(used[k], 1) for k in (0, 1)}
    return _train(rows, weight, epochs, rate, seed, repeats)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The input with ``score``, the probability of label 1 for every text."""
    docs = without(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for rows, data, offsets in blocks(batches):
            total, number = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for buckets, low, high in _families(data, offsets, shared.value.repeats):
                sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                total += sums[high] - sums[low]
                number += high - low
            odds = total / np.maximum(number, 1) + shared.value.bias
            yield rows.append_column("score", pa.array(1.0 / (1.0 + np.exp(-odds))))

    return docs.mapInArrow(run, extended(docs, "score double"))


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, repeats: bool = True) -> DataFrame:
    """The input with ``held_out``, ``score`` and ``predicted``, by a model of the labels that are not held out."""
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    docs = without(docs.where("doc_id IS NOT NULL"), "held_out", "predicted")
    return score(docs, train(docs, known, repeats=repeats)).select(
        "*", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
